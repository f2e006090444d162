"""Queries over crawl sets, policy, documents, catalogue, work lists, operations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions import patterns as P
from lucerna.functions import urls as U
from lucerna.operators import catalogue as K
from lucerna.operators import crawl, documents as D, judgement as J, ops as O, policy as G
from lucerna.operators.applicability import DOCUMENT_PROBES, condition
from lucerna.operators.skew import ensure_parallelism
from lucerna.plans.corpus import derive, mutated, table
from lucerna.plans.queries_pages import PARTS
from lucerna.plans.registry import M, inner_text, query
from lucerna.plans.review import parsed
from lucerna.streaming import jobs as W

UA = "Mozilla/5.0 (compatible; LucernaBot/1.0)"
NL = "chr(10)"
ROBOTS = (
    "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site FROM {t}"
)
ROBOTS_TEXT = (
    "CASE length(site) % 4 WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /fr/', chr(10), 'Allow: /fr/1', chr(10), 'Crawl-delay: 2')"
    " WHEN 1 THEN concat('User-agent: OtherBot', chr(10), 'User-agent: LucernaBot', chr(10), 'Disallow: /*?page=', chr(10), 'Allow: /en/*.html$ # tail', chr(10), '', chr(10), 'User-agent: *', chr(10), 'Disallow: /')"
    " WHEN 2 THEN concat('# none', chr(10), 'User-agent: *', chr(10), 'Disallow:') ELSE concat('User-agent: *', chr(10), 'Disallow: /de/', chr(10), 'Allow: /de/', chr(10), 'Allow:', chr(10), 'Sitemap: https://', site, '/sm.xml') END"
)


def robots(spark, d):
    return derive(spark, d, f"SELECT site, {ROBOTS_TEXT} AS text FROM ({ROBOTS.format(t='lucerna_src_pages')}) r", p="pages")


RB = f"rb AS ({ROBOTS.format(t='pages')})"


@query(
    "u9_robots_rules",
    f"""WITH {RB} SELECT site, 1 AS group_no, false AS allow, '/fr/' AS pattern FROM rb WHERE length(site) % 4 = 0 UNION ALL SELECT site, 1, true, '/fr/1' FROM rb WHERE length(site) % 4 = 0
    UNION ALL SELECT site, 1, false, '/*?page=' FROM rb WHERE length(site) % 4 = 1 UNION ALL SELECT site, 1, true, '/en/*.html$' FROM rb WHERE length(site) % 4 = 1 UNION ALL SELECT site, 2, false, '/' FROM rb WHERE length(site) % 4 = 1
    UNION ALL SELECT site, 1, false, '/de/' FROM rb WHERE length(site) % 4 = 3 UNION ALL SELECT site, 1, true, '/de/' FROM rb WHERE length(site) % 4 = 3""",
)
def u9(spark, d):
    return crawl.robots_rules(crawl.robots_groups(robots(spark, d)))


@query(
    "u10_u12_robots_choice",
    f"WITH {RB} SELECT site, 1 AS group_no, length(site) % 4 <> 1 AS wildcard, CASE WHEN length(site) % 4 = 0 THEN 2000.0 END::DOUBLE AS crawl_delay_ms, CASE WHEN length(site) % 4 = 0 THEN 2000 ELSE 250 END::DOUBLE AS delay_ms FROM rb",
)
def u10(spark, d):
    return crawl.robots_choice(crawl.robots_groups(robots(spark, d)), UA).withColumn("delay_ms", F.expr(crawl.effective_delay("250", "crawl_delay_ms")))


@query(
    "u11_robots_decisions",
    f"""WITH {PARTS}, q AS (SELECT page_id, host, path || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS pq FROM p) SELECT page_id,
    CASE length(host) % 4 WHEN 0 THEN NOT pq LIKE '/fr/%' OR pq LIKE '/fr/1%' WHEN 1 THEN NOT regexp_matches(pq, '^/.*[?]page=') OR regexp_matches(pq, '^/en/.*[.]html$') ELSE true END AS allowed FROM q""",
)
def u11(spark, d):
    urls = table(spark, d, "pages").selectExpr("page_id", f"{U.host('url')} as site", "url")
    return crawl.robots_decisions(urls, robots(spark, d), UA).select("page_id", "allowed")


FOUND = "SELECT event_id AS found_order, concat('s', cast(user_id % 5 AS string)) AS site, concat('/p', cast(cast(floor(value) AS int) AS string)) AS url, cast(event_id % 4 AS int) AS depth, event_type FROM {t}"
VISITED = "SELECT DISTINCT site, url FROM ({f}) x WHERE event_type = 'signup' AND found_order % 3 = 0"
FT, VT = FOUND.format(t="lucerna_src_events"), VISITED.format(f=FOUND.format(t="lucerna_src_events"))
FD, VD = FOUND.format(t="events"), VISITED.format(f=FOUND.format(t="events"))
FRONT_DB = f"fd AS ({FD}), vd AS ({VD}), fr AS (SELECT site, url, arg_min(depth, found_order) AS depth, min(found_order) AS found_order FROM fd GROUP BY 1, 2), nf AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM vd WHERE vd.site = fr.site AND vd.url = fr.url))"


def frontier(spark, d):
    return crawl.new_frontier(derive(spark, d, FT, e="events"), derive(spark, d, VT, e="events"))


@query("u13_frontier", f"WITH {FRONT_DB} SELECT site, url, depth, found_order FROM nf")
def u13(spark, d):
    return frontier(spark, d)


@query(
    "u14_reachability",
    "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 3 + 1 FROM part), ok AS (SELECT * FROM e WHERE dst IN (SELECT p_partkey FROM part)),"
    " r AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 100 = 1 UNION SELECT dst, depth + 1 FROM r JOIN ok ON ok.src = r.node WHERE depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY 1",
)
def u14(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    edges = part.selectExpr("p_partkey as src", "explode(array(p_partkey * 2, p_partkey * 3 + 1)) as dst").join(part.select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return crawl.reachable(edges, part.where("p_partkey % 100 = 1").select(F.col("p_partkey").alias("node")), 5)


@query("u15_page_cap", f"WITH {FRONT_DB}, q AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, found_order) AS queue_no FROM nf) SELECT site, url, queue_no FROM q WHERE queue_no <= 20")
def u15(spark, d):
    return crawl.page_cap(frontier(spark, d), 20)[0].select("site", "url", "queue_no")


@query(
    "u16_skipped_ledger",
    f"""WITH {FRONT_DB}, q AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, found_order) AS queue_no FROM nf WHERE depth <= 2), l AS (
    SELECT site, url, 'depth ' || depth || ' exceeds 2' AS reason FROM fd WHERE depth > 2 UNION ALL SELECT site, url, 'robots' FROM fd WHERE depth <= 2 AND found_order % 10 = 0
    UNION ALL SELECT site, url, 'guard: private' FROM fd WHERE depth <= 2 AND found_order % 10 <> 0 AND found_order % 17 = 0 UNION ALL SELECT site, url, 'page cap 20 reached' FROM q WHERE queue_no > 20) SELECT site, reason, count(*) AS n FROM l GROUP BY 1, 2""",
)
def u16(spark, d):
    found = derive(spark, d, FT, e="events").withColumn("allowed", F.expr("found_order % 10 <> 0")).withColumn("guard", F.expr("if(found_order % 17 = 0, 'private', null)"))
    _, rest = crawl.page_cap(frontier(spark, d).where("depth <= 2"), 20)
    return crawl.skipped_ledger(found, rest, 2, 20).groupBy("site", "reason").agg(F.count(F.lit(1)).alias("n"))


SITEMAPS = (
    "SELECT host AS site, concat('https://', host, '/sm-', cast(page_id AS string), '.xml') AS source, concat('<urlset><url><loc> ', replace(url, '&', '&amp;'), ' </loc></url><url><LOC>https://', host, '/extra</LOC></url></urlset>') AS xml, page_id FROM {h}"
    " UNION ALL SELECT host, concat('https://', host, '/index-', cast(page_id AS string), '.xml'), concat('<sitemapindex><sitemap><loc>https://', host, '/sm-', cast(page_id AS string), '.xml</loc></sitemap></sitemapindex>'), page_id FROM {h} WHERE page_id % 10 = 0"
)
HOSTS = "(SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM {t}) hh"


@query(
    "s6_sitemap_urls",
    f"""WITH h AS (SELECT * FROM {HOSTS.format(t='pages')}) SELECT host AS site, CASE WHEN page_id % 10 = 0 THEN 'https://' || host || '/index-' || page_id || '.xml' ELSE 'https://' || host || '/sm-' || page_id || '.xml' END AS source, url AS loc FROM h
    UNION ALL SELECT host, CASE WHEN page_id % 10 = 0 THEN 'https://' || host || '/index-' || page_id || '.xml' ELSE 'https://' || host || '/sm-' || page_id || '.xml' END, 'https://' || host || '/extra' FROM h""",
)
def s6(spark, d):
    sm = derive(spark, d, SITEMAPS.format(h=HOSTS.format(t="lucerna_src_pages")), p="pages")
    return crawl.sitemap_urls(sm.drop("page_id")).select("site", "source", "loc")


# three levels of index files, the lowest of which lists the top one again
DEEP = (
    "SELECT host AS site, concat('https://', host, '/top-', cast(page_id AS string), '.xml') AS source, concat('<sitemapindex><sitemap><loc>https://', host, '/mid-', cast(page_id AS string), '.xml</loc></sitemap><sitemap><loc>https://', host, '/leaf-', cast(page_id AS string), '.xml</loc></sitemap></sitemapindex>') AS xml FROM {h}"
    " UNION ALL SELECT host, concat('https://', host, '/mid-', cast(page_id AS string), '.xml'), concat('<sitemapindex><loc>https://', host, '/low-', cast(page_id AS string), '.xml</loc></sitemapindex>') FROM {h}"
    " UNION ALL SELECT host, concat('https://', host, '/low-', cast(page_id AS string), '.xml'), concat('<sitemapindex><loc>https://', host, '/top-', cast(page_id AS string), '.xml</loc><loc>https://', host, '/deep-', cast(page_id AS string), '.xml</loc></sitemapindex>') FROM {h}"
    " UNION ALL SELECT host, concat('https://', host, '/deep-', cast(page_id AS string), '.xml'), concat('<urlset><loc>', url, '</loc></urlset>') FROM {h}"
    " UNION ALL SELECT host, concat('https://', host, '/leaf-', cast(page_id AS string), '.xml'), concat('<urlset><loc>https://', host, '/a</loc><loc>https://', host, '/b</loc></urlset>') FROM {h}"
)


@query(
    "s6_nested_sitemaps",
    f"WITH h AS (SELECT * FROM {HOSTS.format(t='pages')}) SELECT host AS site, 'https://' || host || '/top-' || page_id || '.xml' AS source, '0,0,1,0' AS pos, url AS loc FROM h"
    " UNION ALL SELECT host, 'https://' || host || '/top-' || page_id || '.xml', '1,' || k, 'https://' || host || CASE k WHEN 0 THEN '/a' ELSE '/b' END FROM h, (SELECT unnest([0, 1]) AS k) n",
)
def s6_nested(spark, d):
    h = HOSTS.format(t="lucerna_src_pages")
    roots = derive(spark, d, f"SELECT host AS site, concat('https://', host, '/top-', cast(page_id AS string), '.xml') AS source FROM {h}", p="pages")
    found = crawl.sitemap_urls(derive(spark, d, DEEP.format(h=h), p="pages"), roots)
    return found.selectExpr("site", "source", "array_join(pos, ',') as pos", "loc")


@query(
    "u17_sitemap_seeds",
    f"""WITH h AS (SELECT * FROM {HOSTS.format(t='pages')}), s AS (SELECT host, min(page_id) AS p FROM h GROUP BY 1)
    SELECT h.host AS site, h.url AS loc, 1 AS depth FROM h JOIN s ON h.host = s.host AND h.page_id = s.p UNION ALL SELECT host, 'https://' || host || '/extra', 1 FROM s""",
)
def u17(spark, d):
    sm = derive(spark, d, SITEMAPS.format(h=HOSTS.format(t="lucerna_src_pages")), p="pages")
    listed = crawl.sitemap_urls(sm.drop("page_id"))
    # every site tries a file that does not exist first, then the index file or plain file of its first page
    first = table(spark, d, "pages").selectExpr("page_id", f"{U.host('url')} as site").groupBy("site").agg(F.min("page_id").alias("p"))
    declared = first.selectExpr("site", "posexplode(array(concat('https://', site, '/none.xml'), concat('https://', site, if(p % 10 = 0, '/index-', '/sm-'), p, '.xml'))) as (source_no, source)")
    return crawl.sitemap_seeds(declared, listed).select("site", "loc", "depth")


@query(
    "u18_documents",
    f"""WITH {M}, a AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>')) AS t FROM ok),
    dd AS (SELECT page_id, url, CASE WHEN t LIKE '%report.pdf%' THEN origin || '/files/report.pdf' ELSE 'https://cdn.other.org/x.docx' END AS doc, CASE WHEN t LIKE '%report.pdf%' THEN 'pdf' ELSE 'docx' END AS doc_type, {inner_text("regexp_replace(t, '<a [^>]*>', '')")} AS tx
    FROM a WHERE t LIKE '%report.pdf%' OR t LIKE '%x.docx%') SELECT doc AS url, doc_type, count(DISTINCT url) AS n_referrers, arg_min(url, page_id) AS first_referrer, count(DISTINCT tx) AS n_texts, arg_min(tx, page_id) AS first_text FROM dd GROUP BY 1, 2""",
)
def u18(spark, d):
    links = crawl.page_links(parsed(mutated(spark, d))).withColumn("crawl_order", F.col("page_id"))
    return crawl.documents_found(links)


IPS = "SELECT event_id, concat('h', cast(user_id AS string)) AS host, CASE WHEN event_id % 50 = 0 THEN '::ffff:10.1.2.3' WHEN event_id % 50 = 1 THEN 'fe80::1' WHEN event_id % 50 = 2 THEN '2606:2800:220:1::1' WHEN event_id % 50 = 3 THEN 'nonsense' WHEN event_id % 50 = 4 THEN '::ffff:a01:203' WHEN event_id % 50 = 5 THEN 'fd00:0:0::7' ELSE concat(cast(event_id * 7 % 256 AS string), '.', cast(user_id % 256 AS string), '.', cast(event_id % 256 AS string), '.9') END AS address FROM {t}"
_V4 = "(split_part(address, '.', 1)::BIGINT * 16777216 + split_part(address, '.', 2)::BIGINT * 65536 + split_part(address, '.', 3)::BIGINT * 256 + split_part(address, '.', 4)::BIGINT)"
_RANGES = " ".join(f"WHEN n BETWEEN {sum(int(x) << (24 - 8 * i) for i, x in enumerate(b.split('.')))} AND {sum(int(x) << (24 - 8 * i) for i, x in enumerate(b.split('.'))) + (1 << (32 - bits)) - 1} THEN '{why}'" for b, bits, why in G.V4_BLOCKED)
GUARD_DB = f"ip AS ({IPS.format(t='events')}), nn AS (SELECT *, CASE WHEN regexp_matches(address, '^[0-9.]+$') THEN {_V4} END AS n FROM ip), gd AS (SELECT event_id, host, CASE WHEN n IS NOT NULL THEN CASE {_RANGES} END WHEN address LIKE '::ffff%' THEN 'private' WHEN address LIKE 'fe80%' THEN 'link-local' WHEN address LIKE 'fd00%' THEN 'unique local' WHEN address = 'nonsense' THEN 'not an address' END AS blocked FROM nn)"


@query("u21_address_guard", f"WITH {GUARD_DB} SELECT event_id, blocked FROM gd")
def u21(spark, d):
    return G.guard_addresses(derive(spark, d, IPS.format(t="lucerna_src_events"), e="events")).select("event_id", "blocked")


@query("u21_host_guard", f"WITH {GUARD_DB} SELECT host, bool_and(blocked IS NULL) AS allowed, min(blocked) AS blocked, count(*) AS addresses FROM gd GROUP BY 1")
def u21b(spark, d):
    return G.guard_hosts(derive(spark, d, IPS.format(t="lucerna_src_events"), e="events"))


# one spelling of a host for each row in turn, and what it is refused for: fixed values of the check
SPELLINGS = [
    ("http://2130706433/", "loopback"), ("http://0x7f.1/", "loopback"), ("http://127.1/", "loopback"), ("http://0177.0.0.1/", "loopback"), ("http://[::ffff:7f00:1]/", "loopback"),
    ("http://localhost./", "local-host"), ("http://8.8.2056/", None), ("http://256.1.1.1/", "invalid"), ("http://[fd12::1]/", "unique local"), ("http://[2606:4700::1111]/", None), ("http://[1:2:3]/", "not an address"),
]
SHAPES = (
    "SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://u:p@') WHEN 2 THEN concat('ftp://', cast(page_id AS string), '/x') WHEN 3 THEN 'http://localhost:8080/'"
    " WHEN 4 THEN concat('http://printer', cast(page_id AS string), '.local/') WHEN 5 THEN 'not a url' WHEN 6 THEN concat('http://10.', cast(page_id % 256 AS string), '.0.7/') WHEN 7 THEN CASE floor(page_id / 9) % 11 "
    + " ".join(f"WHEN {i} THEN '{u}'" for i, (u, _) in enumerate(SPELLINGS)) + " END ELSE url END AS u FROM {t}"
)
SPELLED = "CASE CAST(floor(page_id / 9) AS INT) % 11 " + " ".join(f"WHEN {i} THEN '{why}'" for i, (_, why) in enumerate(SPELLINGS) if why) + " END"


@query("u22_url_shape", f"SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'userinfo' WHEN 2 THEN 'scheme' WHEN 3 THEN 'local-host' WHEN 4 THEN 'local-host' WHEN 5 THEN 'invalid' WHEN 6 THEN 'private' WHEN 7 THEN {SPELLED} END AS refused FROM pages")
def u22(spark, d):
    return derive(spark, d, SHAPES.format(t="lucerna_src_pages"), p="pages").selectExpr("page_id", f"{U.shape_guard('u')} as refused")


PROOFS = "SELECT page_id AS created_at, CASE WHEN page_id % 2 = 0 THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE host END AS domain, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-06-01' WHEN page_id % 3 = 1 THEN TIMESTAMP '2023-06-01' END AS verified_at FROM h WHERE page_id % 31 = 7"


def hosts_and_proofs(spark, d):
    h = table(spark, d, "pages").selectExpr("page_id", f"{U.host('url')} as host")
    p = h.where("page_id % 31 = 7").selectExpr(
        "page_id as created_at", "if(page_id % 2 = 0, array_join(slice(split(host, '[.]'), -2, 2), '.'), host) as domain",
        "case page_id % 3 when 0 then timestamp '2024-06-01' when 1 then timestamp '2023-06-01' end as verified_at",
    )
    return h, p


@query("u23_covering_proofs", f"WITH h AS (SELECT * FROM {HOSTS.format(t='pages')}), pr AS ({PROOFS}) SELECT h.page_id, pr.domain, pr.created_at FROM h JOIN pr ON h.host = pr.domain OR ends_with(h.host, '.' || pr.domain)")
def u23(spark, d):
    h, p = hosts_and_proofs(spark, d)
    return G.covering_proofs(h, p, ["page_id"]).select("page_id", "domain", "created_at")


@query(
    "u24_domain_standing",
    f"""WITH h AS (SELECT * FROM {HOSTS.format(t='pages')}), pr AS ({PROOFS}), c AS (SELECT h.page_id, arg_min(pr.domain, pr.created_at) AS domain, arg_min(pr.verified_at, pr.created_at) AS verified_at FROM h JOIN pr ON (h.host = pr.domain OR ends_with(h.host, '.' || pr.domain)) AND verified_at IS NOT NULL GROUP BY 1)
    SELECT h.page_id, coalesce(verified_at >= TIMESTAMP '2024-07-01' - INTERVAL 180 DAY, false) AS verified, CASE WHEN verified_at >= TIMESTAMP '2024-07-01' - INTERVAL 180 DAY THEN NULL ELSE verified_at END AS stale_since, domain AS matched_domain FROM h LEFT JOIN c USING (page_id)""",
)
def u24(spark, d):
    h, p = hosts_and_proofs(spark, d)
    return G.domain_standing(h, p, ["page_id"], "timestamp '2024-07-01'").select("page_id", "verified", "stale_since", "matched_domain")


@query("u25_page_limit", "SELECT event_id, CASE WHEN event_type = 'view' OR floor(value) <= 5 THEN floor(value) ELSE 5 END::INT AS max_pages, CASE WHEN event_type = 'view' OR floor(value) <= 5 THEN NULL ELSE 'ownership not verified; first 5 pages only' END AS capped FROM events")
def u25(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "event_type = 'view' as verified", "cast(floor(value) as int) as requested")
    return e.selectExpr("event_id", f"{G.page_limit('verified', 'requested')} as max_pages", f"{G.capped_reason('verified', 'requested')} as capped")


@query("u26_allow_list", f"WITH h AS (SELECT * FROM {HOSTS.format(t='pages')}), pr AS ({PROOFS}) SELECT page_id, host FROM h WHERE EXISTS (SELECT 1 FROM pr WHERE h.host = pr.domain OR ends_with(h.host, '.' || pr.domain))")
def u26(spark, d):
    h, p = hosts_and_proofs(spark, d)
    return G.allow_listed(h, p.select("domain"), ["page_id"]).select("page_id", "host")


RAWDOM = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('  HTTPS://', upper(regexp_extract(url, '://([^/?#]*)', 1)), ':8443/x ') WHEN 1 THEN 'bad host!' WHEN 2 THEN 'nodots' WHEN 3 THEN '-x.com' ELSE url END AS raw FROM {t}"


@query("u27_normalise_domain", "SELECT page_id, CASE WHEN page_id % 5 IN (0, 4) THEN lower(regexp_extract(url, '://([^/?#]*)', 1)) END AS domain FROM pages")
def u27(spark, d):
    return derive(spark, d, RAWDOM.format(t="lucerna_src_pages"), p="pages").selectExpr("page_id", f"{U.normalise_domain('raw')} as domain")


SECRET = "test-secret"
_IN, _OUT = U.hmac_pads(SECRET)


@query("u28_ownership_token", f"SELECT page_id, left(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(lower(regexp_extract(url, '://([^/?#]*)', 1)) || ':acct' || page_id % 7)))), 32) AS token FROM pages")
def u28(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", f"{U.host('url')} as host", "concat('acct', page_id % 7) as account")
    return p.selectExpr("page_id", f"{U.ownership_token('host', 'account', SECRET)} as token")


# ---- catalogue over targets --------------------------------------------------------------------------

KINDS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' ELSE 'docx' END AS kind FROM {t}"
_CATV = " UNION ALL ".join(f"SELECT '{r.item_id}' AS item_id, '{r.effective_level}' AS lv, '{r.level}' AS form_level, '{'page' if 'page' in r.applies_to else 'doc'}' AS kd, '{r.criterion}' AS criterion, {'NULL' if not r.cancelled else repr(r.cancelled)} AS cancelled FROM (SELECT 1) z" for r in K.CATALOGUE)


@query("k1_k4_expand_catalogue", f"WITH c AS ({_CATV}), t AS ({KINDS.format(t='documents')}) SELECT doc_id, item_id, lv AS level, form_level, cancelled FROM t JOIN c ON (t.kind = 'page') = (c.kd = 'page') WHERE lv IN ('A', 'AA')")
def k1(spark, d):
    t = derive(spark, d, KINDS.format(t="lucerna_src_documents"), x="documents")
    return K.expand(t).select("doc_id", "item_id", F.col("effective_level").alias("level"), F.col("level").alias("form_level"), F.col("cancelled_reason").alias("cancelled"))


_MAPV = " UNION ALL ".join(f"SELECT '{c}' AS rule_id, '{r.item_id}' AS item_id" for r in K.CATALOGUE for c in r.checker_rules)
_RULE5 = "CASE event_type WHEN 'click' THEN 'link-name' WHEN 'view' THEN 'label' WHEN 'error' THEN 'marquee' WHEN 'signup' THEN 'empty-heading' ELSE 'not-a-rule' END"


@query("k5_checker_rows", f"WITH mp AS ({_MAPV}) SELECT event_id, item_id FROM (SELECT event_id, {_RULE5} AS rule_id FROM events) e JOIN mp USING (rule_id)")
def k5(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{_RULE5} as rule_id")
    return e.join(F.broadcast(K.checker_map(spark)), "rule_id").select("event_id", "item_id")


@query(
    "k6_k8_catalogue_lint",
    f"""WITH c AS ({_CATV}), f AS (SELECT DISTINCT 'R' || lpad((event_id % 60)::VARCHAR, 2, '0') AS item_id FROM events) SELECT item_id, 'no engine mapping' AS problem FROM f WHERE item_id NOT IN (SELECT item_id FROM c)
    UNION ALL SELECT item_id, 'no form row' FROM c WHERE item_id NOT IN (SELECT item_id FROM f) UNION ALL SELECT item_id, 'matches 1.4' FROM c WHERE criterion LIKE '%1.4%'""",
)
def k6(spark, d):
    form = table(spark, d, "events").selectExpr("concat('R', lpad(event_id % 60, 2, '0')) as item_id").distinct()
    cat = K.catalogue_df(spark)
    return K.lint(form, cat.select("item_id")).unionByName(K.lookup(cat, "1.4").select("item_id", F.lit("matches 1.4").alias("problem")))


FORMCELL = "SELECT page_id, concat(' x ', cast(page_id % 4 + 1 AS string), '.', cast(page_id % 5 AS string), '.1 | 3.3.', cast(page_id % 9 AS string), ' ') AS no_cell, concat('Guideline ', cast(page_id AS string), ': long text: more') AS g_cell, CASE WHEN page_id % 2 = 0 THEN ' aa ' ELSE 'A' END AS l_cell FROM {t}"


@query("k7_normalise_form", "SELECT page_id, (page_id % 4 + 1) || '.' || (page_id % 5) || '.1 / 3.3.' || (page_id % 9) AS criterion, 'Guideline ' || page_id AS guideline, CASE WHEN page_id % 2 = 0 THEN 'AA' ELSE 'A' END AS level FROM pages")
def k7(spark, d):
    c = derive(spark, d, FORMCELL.format(t="lucerna_src_pages"), p="pages")
    return c.select("page_id", K.normalise_criterion(F.col("no_cell")).alias("criterion"), K.guideline_short(F.col("g_cell")).alias("guideline"), K.parse_level(F.col("l_cell")).alias("level"))


# ---- documents ---------------------------------------------------------------------------------------

DOCS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('1.2 Intro', chr(10), '1.2.1.1 Deep', chr(10), '- item', chr(10), 'ראה בטבלה מימין', chr(10), 'a chart here, mail x@y.org', chr(10), text) ELSE text END AS text FROM {t}"


def docs(spark, d):
    return ensure_parallelism(derive(spark, d, DOCS.format(t="lucerna_src_documents"), x="documents"), "doc_id")


LINES_DB = (
    f"dx AS ({DOCS.format(t='documents')}), ln AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS raw FROM dx), st AS (SELECT doc_id, raw, trim(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS s FROM ln),"
    " lf AS (SELECT doc_id, raw, s, regexp_matches(s, '^\\d+(\\.\\d+)*[.)]?\\s+\\S') AS head, regexp_matches(raw, '^\\s*[-–—•*]\\s+\\S') AS bullet FROM st WHERE s <> ''),"
    " fx AS (SELECT doc_id, count(*) AS runs, count(*) FILTER (head) AS headings, coalesce(sum(length(s) - length(replace(s, '.', '')) + 1) FILTER (head), 0) AS levels, count(DISTINCT CASE WHEN head THEN length(s) - length(replace(s, '.', '')) + 1 END) AS distinct_levels,"
    f" count(*) FILTER (bullet AND NOT head) AS lists, sum(len(regexp_extract_all(s, '{P.DOC_SENSORY}'))) AS sensory FROM lf GROUP BY 1),"
    f" tx AS (SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_length, len(regexp_extract_all(text, '{P.EMAIL}')) AS links FROM dx)"
)


@query(
    "d1_d2_text_facts",
    f"WITH {LINES_DB} SELECT tx.doc_id, coalesce(headings, 0)::INT AS headings, coalesce(levels, 0)::BIGINT AS level_sum, coalesce(lists, 0)::INT AS lists, coalesce(sensory, 0)::INT AS sensory, links::INT AS links, coalesce(runs, 0)::INT AS paragraphs, text_length::INT AS text_length FROM tx LEFT JOIN fx USING (doc_id)",
)
def d1(spark, d):
    f = D.with_counts(D.text_facts(docs(spark, d)))
    return f.selectExpr(
        "doc_id", "counts.headings as headings", "cast(aggregate(headings, 0L, (a, h) -> a + h.level) as bigint) as level_sum", "counts.lists as lists", "counts.sensoryPhrases as sensory", "counts.links as links",
        "counts.paragraphs as paragraphs", "counts.textLength as text_length",
    )


RUNS = "SELECT event_id, user_id AS doc_id, event_type AS text, concat('rgb(', cast(event_id * 37 % 256 AS string), ', ', cast(event_id * 91 % 256 AS string), ', ', cast(event_id * 13 % 256 AS string), ')') AS color, 'rgb(255, 255, 255)' AS background, cast(floor(value) AS int) % 24 * 1.0 AS size_pt, event_type = 'view' AS bold FROM {t}"


def _white(r, g, b):
    def ch(v):
        return f"CASE WHEN ({v})/255.0::DOUBLE <= 0.03928 THEN ({v})/255.0::DOUBLE/12.92 ELSE pow((({v})/255.0::DOUBLE + 0.055)/1.055, 2.4) END"

    return f"floor(1.05/(0.2126*({ch(r)}) + 0.7152*({ch(g)}) + 0.0722*({ch(b)}) + 0.05)*100 + 0.5)/100"


@query(
    "d3_d4_contrast_failures",
    f"WITH r AS (SELECT event_id, {_white('event_id*37%256', 'event_id*91%256', 'event_id*13%256')} AS ratio, CASE WHEN (floor(value)::INT % 24) >= CASE WHEN event_type = 'view' THEN 14 ELSE 18 END THEN 3.0 ELSE 4.5 END::DOUBLE AS required FROM events) SELECT * FROM r WHERE ratio < required",
)
def d4(spark, d):
    return D.contrast_failures(derive(spark, d, RUNS.format(t="lucerna_src_events"), e="events").withColumn("size_pt", F.col("size_pt").cast("double"))).select("event_id", "ratio", "required")


@query(
    "d5_inferred_headings",
    "WITH r AS (SELECT event_id, user_id AS doc_id, (floor(value)::INT % 24)::DOUBLE AS s, event_type = 'view' AS bold FROM events), c AS (SELECT doc_id, s, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, s) AS k FROM r GROUP BY 1, 2) SELECT event_id, c.s AS modal_size FROM r JOIN c ON r.doc_id = c.doc_id AND k = 1 WHERE r.s >= c.s * 1.15 OR (bold AND r.s >= c.s)",
)
def d5(spark, d):
    return D.infer_headings(derive(spark, d, RUNS.format(t="lucerna_src_events"), e="events").withColumn("size_pt", F.col("size_pt").cast("double"))).select("event_id", "modal_size")


@query(
    "d6_scanned_pages",
    """WITH p AS (SELECT user_id % 60 AS doc_id, row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS page, CASE WHEN user_id % 7 = 0 THEN 0 ELSE floor(value)::INT END AS chars, value / 100 AS img FROM events WHERE event_type = 'click'),
    s AS (SELECT *, chars < 40 AND img > 0.5 AS scan FROM p), w AS (SELECT doc_id, sum(chars) AS total, bool_or(scan) AS any_scan FROM s GROUP BY 1) SELECT doc_id, page, CASE WHEN scan THEN floor(img * 100 + 0.5) / 100 ELSE 1 END::DOUBLE AS coverage FROM s JOIN w USING (doc_id) WHERE scan OR (total < 40 AND NOT any_scan AND page <= 20)""",
)
def d6(spark, d):
    sql = "SELECT user_id % 60 AS doc_id, row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS page, if(user_id % 7 = 0, 0, cast(floor(value) AS int)) AS text_chars, 100D AS page_area, array(value, 1D) AS image_areas FROM lucerna_src_events WHERE event_type = 'click'"
    return D.scanned_pages(derive(spark, d, sql, e="events"))


@query("d7_phrases", f"WITH dx AS ({DOCS.format(t='documents')}), m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{P.DOC_COMPLEX}')) AS match FROM dx) SELECT doc_id, match, count(*) AS n FROM m GROUP BY 1, 2")
def d7(spark, d):
    return D.phrases(docs(spark, d), P.DOC_COMPLEX).where("substring(text, at, char_length(match)) = match").groupBy("doc_id", "match").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d8_slide_titles",
    "WITH s AS (SELECT user_id % 50 AS doc_id, event_id AS number, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'Sheet' || floor(value)::INT % 5 ELSE event_type || floor(value)::INT % 9 END AS title, event_type = 'click' AS is_sheet FROM events), f AS (SELECT *, min(number) OVER (PARTITION BY doc_id, title) AS f0 FROM s) SELECT number, NOT is_sheet AND title = '' AS missing, NOT is_sheet AND title <> '' AND number > f0 AS duplicate, is_sheet AS generic FROM f",
)
def d8(spark, d):
    sql = "SELECT user_id % 50 AS doc_id, event_id AS number, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN concat('Sheet', cast(floor(value) AS int) % 5) ELSE concat(event_type, cast(floor(value) AS int) % 9) END AS title, event_type = 'click' AS is_sheet FROM lucerna_src_events"
    return D.slide_titles(derive(spark, d, sql, e="events")).select("number", "missing", "duplicate", "generic")


def _arr(cond: str, fields: str) -> str:
    return f"transform(filter(array_sort(collect_list(struct(event_id, event_type, value))), x -> {cond}), x -> named_struct({fields}))"


_PL = "'page', cast(x.event_id % 30 + 1 as int), 'slide', cast(null as int), 'sheet', cast(null as string), 'cell', cast(null as string), 'line', cast(null as int)"
DOC_FACTS = (
    "SELECT user_id AS doc_id, if(user_id % 2 = 0, 'pdf', 'docx') AS kind, concat('https://d/', user_id) AS url, if(user_id % 3 = 0, 'scan 12.pdf', 'plan.pdf') AS file_name, if(user_id % 4 = 0, 'A title', null) AS title, user_id % 5 = 0 AS tagged, user_id % 8 <> 0 AS display_doc_title, "
    + _arr("x.event_type = 'click'", f"{_PL}, 'name', concat('i', x.event_id), 'alt', case x.event_id % 4 when 0 then null when 1 then 'x.png' when 2 then 'Image 7' else 'A red barn' end, 'decorative', x.event_id % 10 = 0") + " AS images, "
    + _arr("x.event_type = 'view'", f"{_PL}, 'level', cast(x.event_id % 4 + 1 as int), 'text', 'T', 'fake', x.event_id % 6 = 0, 'missing', false, 'duplicate', x.event_id % 13 = 0, 'generic', false, 'size_pt', 14D, 'bold', true") + " AS headings, "
    + _arr("x.event_type = 'error'", f"{_PL}, 'text', if(x.event_id % 2 = 0, '- a', '1. a'), 'manual', x.event_id % 3 <> 0, 'items', 1") + " AS lists, "
    + _arr("x.event_type = 'signup'", f"{_PL}, 'merged_cells', cast(x.event_id % 3 as int)") + " AS tables, "
    + _arr("x.event_type = 'purchase' and x.value > 60", "'page', cast(x.event_id % 30 as int), 'coverage', 0.9D") + " AS scanned_pages, "
    + _arr("x.event_type = 'purchase' and x.value < 4", f"{_PL}, 'text', 'c', 'color', 'rgb(1,2,3)'") + " AS coloured_runs, 1000 AS text_length FROM lucerna_src_events GROUP BY user_id"
)


def doc_facts(spark, d):
    return D.with_counts(D.with_facts(derive(spark, d, DOC_FACTS, e="events")))


@query(
    "d9_d19_document_rules",
    """WITH e AS (SELECT *, user_id AS doc_id FROM events), im AS (SELECT doc_id, count(*) FILTER (event_type = 'click' AND event_id % 10 <> 0 AND event_id % 4 <> 3) + (doc_id % 2 = 0 AND doc_id % 5 <> 0 AND count(*) FILTER (event_type = 'click') > 0)::INT AS n FROM e GROUP BY 1),
    hd AS (SELECT doc_id, event_id, event_id % 4 + 1 AS lv, lag(event_id % 4 + 1) OVER (PARTITION BY doc_id ORDER BY event_id) AS pv FROM e WHERE event_type = 'view' AND event_id % 6 <> 0), dl AS (SELECT doc_id, count(DISTINCT lv) AS k, count(*) FILTER (lv > pv + 1) AS j FROM hd GROUP BY 1),
    hh AS (SELECT doc_id, count(*) FILTER (event_type = 'view' AND event_id % 6 = 0) + count(*) FILTER (event_type = 'view' AND event_id % 13 = 0) AS n FROM e GROUP BY 1)
    SELECT doc_id, 'doc-image-alt' AS rule, (n)::INT AS n FROM im UNION ALL SELECT hh.doc_id, 'doc-heading-structure', (n + CASE WHEN k > 1 THEN j ELSE 0 END)::INT FROM hh LEFT JOIN dl USING (doc_id)
    UNION ALL SELECT doc_id, 'doc-list-structure', (count(*) FILTER (event_type = 'error' AND event_id % 3 <> 0 AND event_id % 2 = 0))::INT FROM e GROUP BY 1
    UNION ALL SELECT doc_id, 'doc-reading-order', ((doc_id % 2 = 0 AND doc_id % 5 <> 0)::INT + count(*) FILTER (event_type = 'signup' AND event_id % 3 > 0))::INT FROM e GROUP BY 1
    UNION ALL SELECT DISTINCT doc_id, 'doc-contrast', 0 FROM e UNION ALL SELECT DISTINCT doc_id, 'doc-text-image', 0 FROM e UNION ALL SELECT DISTINCT doc_id, 'doc-complex-info', 0 FROM e
    UNION ALL SELECT doc_id, 'doc-color-only', CASE WHEN count(*) FILTER (event_type = 'purchase' AND value < 4) = 0 THEN 0 END FROM e GROUP BY 1
    UNION ALL SELECT doc_id, 'doc-scanned-detect', (count(*) FILTER (event_type = 'purchase' AND value > 60) > 0)::INT FROM e GROUP BY 1
    UNION ALL SELECT DISTINCT doc_id, 'doc-title', CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE (doc_id % 2 = 0 AND doc_id % 8 = 0)::INT END FROM e""",
)
def d9(spark, d):
    return D.rule_results(doc_facts(spark, d)).selectExpr("doc_id", "rule", "if(opined, size(findings), null) as n")


_DOC_ITEMS = [r for r in K.CATALOGUE if r.part == "2"]


@query(
    "d20_document_verdicts",
    f"""WITH {LINES_DB}, hl AS (SELECT doc_id, length(s) - length(replace(s, '.', '')) + 1 AS lv, row_number() OVER (PARTITION BY doc_id) AS r FROM lf WHERE head),
    c AS (SELECT tx.doc_id, 0 AS images, coalesce(fx.headings, 0) AS headings, coalesce(fx.lists, 0) AS lists, 0 AS tables, links, coalesce(runs, 0) AS paragraphs, text_length AS "textLength", coalesce(sensory, 0) AS "sensoryPhrases", 0 AS "complexInfo", 0 AS "scannedPages", 0 AS "textImages", 0 AS "colouredRuns", 0 AS "contrastFailures", coalesce(distinct_levels, 0) AS dlv FROM tx LEFT JOIN fx USING (doc_id)),
    cat AS ({' UNION ALL '.join(f"SELECT '{r.item_id}' AS item_id, '{r.probe}' AS probe, {str(r.needs_judgement).lower()} AS nj" for r in _DOC_ITEMS)}),
    v AS (SELECT doc_id, item_id, CASE probe {' '.join(f"WHEN '{p}' THEN ({condition(p, 'c', DOCUMENT_PROBES)})" for p in DOCUMENT_PROBES)} END AS ok, nj, CASE item_id WHEN 'D03' THEN lists > 0 WHEN 'D09' THEN true ELSE false END AS failed, headings FROM c, cat)
    SELECT doc_id, item_id, CASE WHEN NOT ok THEN 'NA' WHEN failed OR nj THEN 'FAIL' ELSE 'PASS' END AS verdict FROM v""",
)
def d20(spark, d):
    f = D.with_counts(D.text_facts(docs(spark, d))).withColumns({"url": F.expr("concat('doc', doc_id)"), "file_name": F.expr("concat('doc-', doc_id, '.txt')")})
    return D.evaluate_documents(f).select("doc_id", "item_id", "verdict")


@query(
    "d21_download_ledger",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'HTTP 404' WHEN value * 1000000 > 26214400 THEN 'too large: ' || round(value * 1000000 / 1048576)::BIGINT || ' MB' END AS download_error FROM events",
)
def d21(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "if(event_id % 7 = 0, 404, 200) as status", "value * 1000000 as bytes")
    return D.download_ledger(e, 26214400).select("event_id", "download_error")


@query("d23_document_name", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'T' || page_id ELSE 'my file ' || page_id || '.pdf' END AS name FROM pages")
def d23(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "if(page_id % 4 = 0, concat(' T', page_id, ' '), if(page_id % 4 = 1, ' ', null)) as title", "concat('https://x/y/my%20file%20', page_id, '.pdf') as u")
    return p.selectExpr("page_id", f"{D.document_name('title', 'u')} as name")


# ---- judgement work ------------------------------------------------------------------------------------

TASKS = "SELECT event_id AS task_no, event_id % 4 AS run_id, event_type AS item, concat('{{\"a\":\"', cast(cast(floor(value) AS int) % 40 AS string), '\"}}') AS json, CASE WHEN event_type = 'signup' THEN 'siteConsistency' ELSE 'links' END AS slice, concat('u', cast(user_id AS string)) AS url FROM {t}"


def tasks(spark, d):
    t = derive(spark, d, TASKS.format(t="lucerna_src_events"), e="events")
    return t.withColumn("work_key", F.expr(J.work_key("item", "'r'", "json", "array('p|q')", "url", "slice"))).withColumn("tokens", F.expr(J.estimate_tokens("json")))


_ESC = "replace(replace(json, '\\', '\\\\'), '\"', '\\\"')"
TASK_DB = (
    f"tk AS ({TASKS.format(t='events')}), tw AS (SELECT *, left(sha256('{{\"item\":\"' || item || '\",\"rubric\":\"r\",\"slice\":\"' || {_ESC} || '\",\"prior\":[\"p|q\"],\"url\":\"' || CASE WHEN slice = 'siteConsistency' THEN url ELSE '' END || '\"}}'), 32) AS work_key, ceil(length(json) / 2.5)::BIGINT AS tokens FROM tk)"
)


@query("j3_j5_work_keys", f"WITH {TASK_DB} SELECT task_no, work_key, tokens FROM tw")
def j5(spark, d):
    return tasks(spark, d).select("task_no", "work_key", "tokens")


@query("j6_unique_work", f"WITH {TASK_DB} SELECT work_key, min(task_no) AS task_no, count(*) AS uses, max(tokens) AS tokens FROM tw GROUP BY 1")
def j6(spark, d):
    return J.unique_work(tasks(spark, d))


@query("j6_fan_out", f"WITH {TASK_DB}, u AS (SELECT work_key, min(task_no) AS first_task FROM tw GROUP BY 1) SELECT tw.task_no, u.first_task FROM tw JOIN u USING (work_key)")
def j6b(spark, d):
    t = tasks(spark, d)
    return J.fan_out(t.select("task_no", "work_key"), J.unique_work(t).selectExpr("work_key", "task_no as first_task", "uses"), rows_per_slice=3).select("task_no", "first_task")


CACHE_COND = "substring(work_key, 1, 1) IN ('0', '1', '2', '3', '4')"


@query("j7_cache_split", f"WITH {TASK_DB}, u AS (SELECT work_key, count(*) AS uses FROM tw GROUP BY 1) SELECT work_key, {CACHE_COND} AND substring(work_key, 2, 1) <> 'a' AS cached FROM u")
def j7(spark, d):
    work = J.unique_work(tasks(spark, d))
    cache = work.where(CACHE_COND).selectExpr("work_key", "if(substring(work_key, 2, 1) = 'a', 'old', 'm1') as model", "'PASS' as j_verdict")
    hits, todo = J.split_cached(work, cache, "m1")
    return hits.selectExpr("work_key", "true as cached").unionByName(todo.selectExpr("work_key", "false as cached"))


_MICRO = "((tokens + 900) * 5 + 8000 * 25)"
# calls of very unlike size, some of them cached; the greedy gate as one fold over a run's calls: paid and counted in one number
_GATED = f"""e AS (SELECT run_id, task_no, (tokens + task_no * 7919 % 200000)::BIGINT AS tokens, {CACHE_COND} AS cached FROM tw), f AS (SELECT run_id, task_no, cached, {_MICRO} AS micro FROM e),
    g AS (SELECT run_id, count(*) FILTER (cached) AS cache_hits, count(*) FILTER (NOT cached) AS todo, list_reduce(coalesce(list((micro * 1000000 + 1)::BIGINT ORDER BY task_no) FILTER (NOT cached), []), lambda a, x: CASE WHEN a // 1000000 + x // 1000000 <= 100000000 THEN a + x ELSE a END, 0::BIGINT) AS r FROM f GROUP BY 1)"""


@query("j8_j11_budget", f"WITH {TASK_DB}, {_GATED} SELECT run_id, r % 1000000 AS calls, r // 1000000 AS cost, todo - r % 1000000 AS skipped, cache_hits FROM g")
def j8(spark, d):
    work = tasks(spark, d).withColumn("tokens", F.expr("tokens + task_no * 7919 % 200000")).withColumn("cached", F.expr(CACHE_COND))
    return J.usage(J.budget_gate(work, 100.0, bucket_rows=500)).withColumn("cost", F.expr("cast(round(cost * 1e6) as bigint)"))


@query(
    "j9_sanitise",
    f"""WITH {TASK_DB} SELECT task_no, CASE WHEN item = 'view' THEN 'PASS' WHEN item = 'click' THEN 'NA' ELSE 'FAIL' END AS j_verdict,
    CASE WHEN item NOT IN ('view', 'click') AND NOT (slice = 'siteConsistency' OR strpos(json, '1') > 0) THEN 0.4 ELSE 1 END::DOUBLE AS j_confidence, CASE WHEN slice = 'siteConsistency' OR strpos(json, '1') > 0 THEN 1 ELSE 0 END::INT AS kept FROM tw""",
)
def j9(spark, d):
    t = tasks(spark, d).selectExpr(
        "task_no", "slice", "json", "case item when 'view' then 'PASS' when 'click' then 'NA' else item end as j_verdict", "1.7D as j_confidence",
        "array(named_struct('locator', '1', 'snippet', cast(null as string), 'code', 'c', 'reason', 'r'), named_struct('locator', '', 'snippet', cast(null as string), 'code', 'c', 'reason', 'r')) as j_findings", "cast(null as string) as j_note",
    )
    return J.sanitise(t).selectExpr("task_no", "j_verdict", "j_confidence", "size(j_findings) as kept")


@query("j10_not_judged", f"WITH {TASK_DB}, e AS (SELECT *, {_MICRO} AS micro FROM tw), r AS (SELECT *, sum(micro) OVER (PARTITION BY run_id ORDER BY task_no) AS running FROM e) SELECT task_no, 'FAIL' AS j_verdict, 0::DOUBLE AS j_confidence, CASE WHEN running > 100000000 THEN 'budget used up before this row' ELSE 'judgement failed; check by hand' END AS j_note FROM r WHERE running > 100000000 OR task_no % 97 = 0")
def j10(spark, d):
    g = J.budget_gate(tasks(spark, d), 100.0, bucket_rows=500).withColumn("failed", F.expr("task_no % 97 = 0"))
    return J.not_judged(g).select("task_no", "j_verdict", "j_confidence", "j_note")


@query("s12_merge_cache", f"WITH {TASK_DB}, u AS (SELECT DISTINCT work_key FROM tw) SELECT work_key, CASE WHEN substring(work_key, 1, 1) < '8' THEN 'new' ELSE 'old' END AS j_verdict FROM u WHERE substring(work_key, 1, 1) < '8' OR substring(work_key, 2, 1) < '8'")
def s12(spark, d):
    u = tasks(spark, d).select("work_key").distinct()
    cache = u.selectExpr("work_key", "if(substring(work_key, 2, 1) < '8', 'm1', 'm0') as model", "'old' as j_verdict")
    fresh = u.where("substring(work_key, 1, 1) < '8'").selectExpr("work_key", "'m1' as model", "'new' as j_verdict")
    return J.merge_cache(cache, fresh, "m1").select("work_key", "j_verdict")


# ---- operations ----------------------------------------------------------------------------------------

def jobs(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id as id", "concat('u', user_id % 20) as url", "if(value > 10, 'done', 'running') as status", "ts as started_at", "if(value > 10, timestampadd(SECOND, cast(floor(value * 30) as int), ts), null) as finished_at", "value / 100 as cost"
    )


JOBS_DB = "jobs AS (SELECT event_id AS id, 'u' || user_id % 20 AS url, CASE WHEN value > 10 THEN 'done' ELSE 'running' END AS status, ts AS started_at, CASE WHEN value > 10 THEN ts + to_seconds(floor(value * 30)::BIGINT) END AS finished_at, value / 100 AS cost FROM events)"


@query(
    "o1_recent_scan",
    f"""WITH {JOBS_DB}, rq AS (SELECT event_id AS request_id, 'u' || user_id % 20 AS url, ts AS requested_at FROM events WHERE event_type = 'view') SELECT request_id, (SELECT arg_max(id, finished_at) FROM jobs j WHERE j.url = rq.url AND j.status = 'done' AND j.finished_at <= requested_at AND j.finished_at >= requested_at - INTERVAL 60 MINUTE) AS reuse_job FROM rq""",
)
def o1(spark, d):
    rq = table(spark, d, "events").where("event_type = 'view'").selectExpr("event_id as request_id", "concat('u', user_id % 20) as url", "ts as requested_at")
    return O.recent_scan(rq, jobs(spark, d)).select("request_id", "reuse_job")


@query("o2_daily_spend", f"WITH {JOBS_DB}, s AS (SELECT date_trunc('day', started_at) AS day, count(*) AS scans, sum(cost) AS spent FROM jobs GROUP BY 1) SELECT day::TIMESTAMP AS day, scans, round(spent, 6) AS spent, round(greatest(0.5, 25 - spent), 6) AS remaining, spent >= 25 AS exhausted FROM s")
def o2(spark, d):
    return O.daily_spend(jobs(spark, d)).withColumn("spent", F.round("spent", 6)).withColumn("remaining", F.round("remaining", 6))


@query("o3_active_scans", f"WITH {JOBS_DB}, s AS (SELECT id, started_at, (SELECT count(*) FROM jobs a WHERE a.started_at <= j.started_at) - (SELECT count(*) FROM jobs b WHERE b.finished_at <= j.started_at) AS active FROM jobs j) SELECT id, active, active > 1 AS over_cap FROM s")
def o3(spark, d):
    return O.active_scans(jobs(spark, d)).select("id", "active", "over_cap")


@query("o4_admission", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'reuse' WHEN event_id % 3 >= 1 THEN 'busy' WHEN value >= 25 THEN 'budget' ELSE 'accept' END AS decision FROM events")
def o4(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "if(event_id % 4 = 0, event_id, null) as reuse_job", "event_id % 3 as active", "value as spent")
    return O.admission(e).select("event_id", "decision")


@query(
    "o5_scan_options",
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 50 ELSE least(2000, greatest(1, floor(value * 20) - 50)) END::DOUBLE AS max_pages_used, CASE WHEN event_id % 9 = 1 THEN 5 ELSE least(20, greatest(0, floor(value) - 3)) END::DOUBLE AS max_depth_used, round(least(least(500, greatest(0.5, value * 3 - 4)), greatest(0.5, 25 - value)), 6)::DOUBLE AS budget_used FROM events",
)
def o5(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "if(event_id % 9 = 0, null, floor(value * 20) - 50) as max_pages", "if(event_id % 9 = 1, null, floor(value) - 3) as max_depth", "value * 3 - 4 as budget", "value as spent")
    return O.scan_options(e).selectExpr("event_id", "max_pages_used", "max_depth_used", "round(budget_used, 6) as budget_used")


@query("o6_run_history", "WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id AS run_id, n FROM r WHERE n <= 3")
def o6(spark, d):
    return O.run_history(table(spark, d, "events").selectExpr("event_id as run_id", "user_id as project_id", "event_type as status", "ts as created_at"), 3).select("run_id", "n")


def tenants(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as row_id", "o_custkey % 50 as workspace_id")
    members = table(spark, d, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey % 50 as workspace_id", "c_nationkey as user_id")
    return rows, members


@query("o7_visible_rows", "SELECT o_orderkey AS row_id FROM orders WHERE o_custkey % 50 IN (SELECT c_custkey % 50 FROM customer WHERE c_custkey % 4 = 0 AND c_nationkey = 3)")
def o7(spark, d):
    rows, members = tenants(spark, d)
    return O.visible_rows(rows, members, 3).select("row_id")


@query("o8_isolation", "WITH m AS (SELECT DISTINCT c_nationkey AS user_id, c_custkey % 50 AS w FROM customer WHERE c_custkey % 4 = 0), s AS (SELECT o_custkey % 50 AS w, count(*) AS n FROM orders GROUP BY 1) SELECT user_id, sum(n)::BIGINT AS visible, false AS leak FROM m JOIN s USING (w) GROUP BY 1")
def o8(spark, d):
    return O.isolation_check(*tenants(spark, d)).select("user_id", "visible", "leak")


@query(
    "o9_constraints",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'Bad.Com' WHEN event_id % 10 = 1 THEN 'a/b' WHEN event_id % 10 = 2 THEN NULL ELSE 'd' || event_id % 700 || '.com' END AS domain, user_id AS w FROM events)
    SELECT 'domain is lower case without slash or colon' AS rule, count(*) FILTER (domain IN ('Bad.Com', 'a/b')) AS violations FROM r UNION ALL SELECT 'name has 1 to 120 characters', count(*) FILTER (event_id % 11 = 0) FROM events
    UNION ALL SELECT 'pages between 1 and 2000', count(*) FILTER (floor(value * 30) NOT BETWEEN 1 AND 2000) FROM events UNION ALL SELECT 'cost is not negative', count(*) FILTER (value - 1 < 0) FROM events UNION ALL SELECT 'role is known', count(*) FILTER (event_type = 'error') FROM events
    UNION ALL SELECT 'unique workspace_id domain', (SELECT count(*) FROM (SELECT w, domain FROM r GROUP BY 1, 2 HAVING count(*) > 1))""",
)
def o9(spark, d):
    e = table(spark, d, "events").selectExpr(
        "case event_id % 10 when 0 then 'Bad.Com' when 1 then 'a/b' when 2 then null else concat('d', event_id % 700, '.com') end as domain", "user_id as workspace_id", "if(event_id % 11 = 0, '', 'n') as name", "floor(value * 30) as requested_pages",
        "value - 1 as cost", "if(event_type = 'error', 'admin', 'owner') as role",
    )
    return O.constraint_audit(e, ["workspace_id", "domain"])


_ART = "CASE event_type WHEN 'view' THEN 'screenshot' WHEN 'click' THEN 'json' WHEN 'error' THEN 'fix_plan' ELSE 'html' END"


@query(
    "o10_retention",
    f"""WITH a AS (SELECT event_id, {_ART} AS f, ts::DATE AS dd FROM events), b AS (SELECT *, CASE WHEN f = 'screenshot' THEN dd + 90 WHEN f = 'html' THEN dd + 365 END AS x FROM a) SELECT event_id, x::DATE AS expires_on, coalesce(x <= DATE '2024-04-10', false) AS expired, coalesce(x > DATE '2024-04-10' AND x <= DATE '2024-04-24', false) AS expiring_soon FROM b""",
)
def o10(spark, d):
    a = table(spark, d, "events").selectExpr("event_id", f"{_ART} as format", "ts as created_at")
    return O.retention(a, "date '2024-04-10'").select("event_id", "expires_on", "expired", "expiring_soon")


@query("o11_delete_runs", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def o11(spark, d):
    e = table(spark, d, "events")
    return O.without_runs(e.selectExpr("event_id", "user_id as run_id"), e.where("event_type = 'purchase' and value > 100").selectExpr("user_id as run_id")).select("event_id")


@query("o12_upsert_claims", "WITH r AS (SELECT user_id % 10 AS workspace_id, 'd' || floor(value)::INT % 50 AS domain, event_id, ts, event_type IN ('click', 'view') AS nw, row_number() OVER (PARTITION BY user_id % 10, floor(value)::INT % 50 ORDER BY event_type IN ('click', 'view') DESC, ts DESC) AS k FROM events) SELECT workspace_id, domain, event_id AS token FROM r WHERE k = 1")
def o12(spark, d):
    e = table(spark, d, "events").selectExpr("user_id % 10 as workspace_id", "concat('d', cast(floor(value) as int) % 50) as domain", "event_id as token", "ts as claimed_at", "event_type")
    new = "event_type in ('click', 'view')"
    return O.upsert_claims(e.where(f"not {new}").drop("event_type"), e.where(new).drop("event_type")).select("workspace_id", "domain", "token")


@query("o13_capped_runs", "SELECT event_id, (floor(value) - least(5, floor(value)))::BIGINT AS missing_pages FROM events WHERE least(5, floor(value)) < floor(value)")
def o13(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "floor(value) as requested_pages", "least(5, floor(value)) as applied_pages")
    return O.capped_runs(e).select("event_id", "missing_pages")


@query(
    "s11_artifact_keys",
    f"SELECT event_id, CASE {_ART} WHEN 'screenshot' THEN 'screenshots' WHEN 'html' THEN 'reports' ELSE 'data' END || '/run-' || user_id || '/' || CASE event_id % 3 WHEN 0 THEN 'etc_passwd' WHEN 1 THEN 'rf.html' ELSE 'artifact' END AS key FROM events",
)
def s11(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{_ART} as format", "concat('run-', user_id) as run_id", "case event_id % 3 when 0 then '../../etc/passwd' when 1 then '---rf.html' else '...' end as filename")
    return e.selectExpr("event_id", f"{O.artifact_key('run_id', 'format', 'filename')} as key")


# ---- streams (run to the end of the given table) ---------------------------------------------------------

@query("w2_cooldown", "SELECT DISTINCT 'u' || user_id AS url FROM events")
def w2(spark, d):
    # which of the repeats inside the watermark comes first is not fixed; that each address comes once is
    return W.collected(spark, W.rescan_cooldown(W.job_stream(spark, d)), "append", "w2").select("url")


@query("w3_daily_spend", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS scans, round(sum(value / 100), 6) AS spent FROM events GROUP BY 1")
def w3(spark, d):
    return W.collected(spark, W.daily_spend(W.job_stream(spark, d)), "update", "w3", ["day"]).selectExpr("day", "scans", "round(spent, 6) as spent")


@query("w4_active_jobs", "WITH x AS (SELECT 's' || user_id % 10 AS site, ts, value, date_trunc('minute', ts) + unnest(generate_series(1, 120)) * INTERVAL 1 MINUTE AS e FROM events) SELECT site, e::TIMESTAMP AS at, count(*) AS active FROM x WHERE epoch_us(e) < epoch_us(ts) + least(value, 120) * 60000000 GROUP BY 1, 2")
def w4(spark, d):
    return W.collected(spark, W.active_jobs(W.job_stream(spark, d)), "update", "w4", ["site", "at"])


@query("w5_job_progress", "WITH x AS (SELECT event_type AS phase, unnest(generate_series(0, 9)) AS k, time_bucket(INTERVAL 1 MINUTE, ts) AS b FROM events) SELECT (b - k * INTERVAL 1 MINUTE)::TIMESTAMP AS window_start, phase, count(*) AS n FROM x GROUP BY 1, 2")
def w5(spark, d):
    return W.collected(spark, W.job_progress(W.job_stream(spark, d)), "update", "w5", ["window_start", "phase"])


_SESSIONS = (
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),"
    " a AS (SELECT user_id, k, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY 1, 2)"
)


@query("w6_crawl_sessions", f"{_SESSIONS} SELECT user_id AS site, session_start, session_end, n FROM a WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def w6(spark, d):
    return W.collected(spark, W.crawl_sessions(W.job_stream(spark, d)), "append", "w6")


@query("w6_all_sessions", f"{_SESSIONS} SELECT user_id AS site, session_start, session_end, n, session_end > (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS open FROM a")
def w6_all(spark, d):
    closed, still = W.session_outputs(spark, W.job_stream(spark, d))
    return closed.withColumn("open", F.lit(False)).unionByName(still.withColumn("open", F.lit(True)))


@query("w7_delta_stream", "SELECT e.event_id, CASE WHEN b.k IS NULL THEN 'new' WHEN e.value > 20 AND b.v > 20 THEN 'stillBroken' WHEN e.value > 20 THEN 'newlyBroken' WHEN b.v > 20 THEN 'fixed' ELSE 'unchanged' END AS outcome FROM events e LEFT JOIN (SELECT c_custkey AS k, c_acctbal / 100 AS v FROM customer) b ON e.user_id = b.k")
def w7(spark, d):
    baseline = table(spark, d, "customer").selectExpr("c_custkey as user_id", "c_acctbal / 100 > 20 as was_broken")
    return W.collected(spark, W.delta_against(W.job_stream(spark, d), baseline), "append", "w7")


@query("w7_late_ledger", "SELECT event_id, 'in time' AS part FROM events")
def w7_late(spark, d):
    baseline = table(spark, d, "customer").selectExpr("c_custkey as user_id", "c_acctbal / 100 > 20 as was_broken")
    raw = spark.readStream.schema(W.EVENT_SCHEMA).parquet(f"{d}/events*.parquet")
    in_time, late = W.delta_with_ledger(spark, raw, baseline)
    # one file is one batch, which has no watermark yet: nothing is late (tests bring late files)
    return in_time.selectExpr("event_id", "'in time' as part").unionByName(late.selectExpr("event_id", "reason as part"))


@query("w8_politeness", "WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT event_id, (epoch_us(ts) // 1000 - epoch_us(p) // 1000)::BIGINT AS gap_ms FROM g WHERE p IS NOT NULL AND epoch_us(ts) // 1000 - epoch_us(p) // 1000 < 600000")
def w8(spark, d):
    return W.politeness_gaps(table(spark, d, "events").selectExpr("event_id", "user_id as host", "ts"), 600_000).select("event_id", "gap_ms")
