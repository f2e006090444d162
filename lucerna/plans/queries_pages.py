"""Queries over pages: URLs, links, element table, collectors, applicability, preflight."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions import urls as U
from lucerna.functions.html import elements
from lucerna.operators import applicability as A
from lucerna.operators import crawl, preflight
from lucerna.operators.evidence import COUNTS, template_hash
from lucerna.operators.skew import join_on_hot_key
from lucerna.plans.corpus import mutated, table
from lucerna.plans.materialize import materialize
from lucerna.plans.registry import M, attr, body_text, inner_text, query, tags, unescape
from lucerna.plans.review import SITE_BY_DOMAIN, evidence, parsed

# ---- URL operators -------------------------------------------------------------------------

PARTS = (
    "p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,"
    " regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS qs FROM pages)"
)
TRACK = "^utm_|^ga_|^_ga$|^gclid$|^gbraid$|^wbraid$|^dclid$|^fbclid$|^msclkid$|^mc_(cid|eid)$|^igshid$|^ref$|^referrer$|^source$|^campaign|^yclid$|^_openstat$"
KEPT = (
    f"list_sort(list_filter(string_split(qs, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '{TRACK}')))"
)
FOLDED = (
    "regexp_replace(CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END, '/(index|default)[.](html?|php|aspx?)$', '/')"
)
CANON = f"scheme || '://' || host || CASE WHEN {FOLDED} = '' THEN '/' ELSE {FOLDED} END || CASE WHEN len({KEPT}) = 0 THEN '' ELSE '?' || array_to_string({KEPT}, '&') END"


@query("u1_canonicalize", f"WITH {PARTS} SELECT page_id, {CANON} AS canonical FROM p")
def u1(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{U.canonicalize('url')} as canonical")


@query(
    "u2_tracking_params",
    f"WITH {PARTS}, q AS (SELECT page_id, unnest(string_split(qs, '&')) AS kv FROM p WHERE qs <> '') SELECT page_id, split_part(kv, '=', 1) AS key, regexp_matches(lower(split_part(kv, '=', 1)), '{TRACK}') AS tracking FROM q",
)
def u2(spark, d):
    q = table(spark, d, "pages").selectExpr("page_id", f"inline({U.params(U.query('url'))})")
    return q.selectExpr("page_id", "key", f"key rlike r'{U.TRACKING}' as tracking")


@query(
    "u3_u4_link_kind",
    f"""WITH {M}, a AS ({tags('<a [^>]*>', 'page_id, url')}), h AS (SELECT page_id, {attr('t', 'href')} AS href, url FROM a),
    e AS (SELECT page_id, href, lower(regexp_extract(split_part(split_part(CASE WHEN href LIKE '#%' THEN regexp_extract(url, '://[^/?#]*(.*)$', 1) ELSE regexp_replace(href, '^https?://[^/]*', '') END, '?', 1), '#', 1), '([.][^./]*)$', 1)) AS ext FROM h)
    SELECT page_id, href, ext,
    CASE WHEN ext IN ('.pdf','.docx') THEN 'document' WHEN ext = '.css' THEN 'ignore' ELSE 'page' END AS kind,
    CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.docx' THEN 'docx' END AS doc_type FROM e""",
)
def u4(spark, d):
    links = crawl.page_links(parsed(mutated(spark, d)))
    t = "target"
    return links.selectExpr("page_id", "href", f"{U.extension(U.path(t))} as ext", f"{U.link_kind(t)} as kind", f"{U.doc_type(t)} as doc_type")


@query(
    "u5_u6_site_scope",
    f"""WITH {PARTS}, dd AS (SELECT page_id, url, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM p)
    SELECT page_id, domain, domain = 'example.com' AS same_site,
    (NOT regexp_matches(url, 'casino') AND regexp_matches(url, '/en/')) AS included FROM dd""",
)
def u6(spark, d):
    inc, exc = "array('/en/')", "array('casino')"
    start = "'https://www.example.com/'"
    return table(spark, d, "pages").selectExpr(
        "page_id", f"{U.registrable_domain(U.host('url'))} as domain", f"{U.in_scope('url', start)} as same_site", f"{U.in_scope('url', start, inc, exc)} as included"
    )


_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(path || CASE WHEN strpos(url, '?') > 0 THEN '?' || qs ELSE '' END, '{keep}', '-', 'g'), '{fold}', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(
    "u7_slugs",
    f"""WITH {PARTS} SELECT page_id, CASE WHEN {_SLUG.format(keep='[^a-zA-Z0-9_/-]+', fold='/+')} = '' THEN 'home' ELSE left({_SLUG.format(keep='[^a-zA-Z0-9_/-]+', fold='/+')}, 80) END AS slug,
    CASE WHEN {_SLUG.format(keep='[^a-zA-Z0-9_/.-]+', fold='[/.]+')} = '' THEN 'home' ELSE left({_SLUG.format(keep='[^a-zA-Z0-9_/.-]+', fold='[/.]+')}, 70) END AS fix_slug FROM p""",
)
def u7(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{U.slug('url')} as slug", f"{U.slug('url', 70, True)} as fix_slug")


@query(
    "u8_links",
    f"""WITH {M}, a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>')) AS t FROM ok)
    SELECT page_id, CASE WHEN {attr('t', 'href')} LIKE 'http%' THEN {attr('t', 'href')} WHEN {attr('t', 'href')} LIKE '#%' THEN regexp_replace(url, '#.*$', '') || {attr('t', 'href')}
    ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {attr('t', 'href')} END AS target, left({inner_text("regexp_replace(t, '<a [^>]*>', '')")}, 120) AS text FROM a""",
)
def u8(spark, d):
    return crawl.page_links(parsed(mutated(spark, d))).select("page_id", "target", "text")


@query(
    "u29_strip_html",
    f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '\\s+', ' ', 'g')) AS text FROM pages""",
)
def u29(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{U.strip_html('html')} as text")


# ---- element table and collectors ----------------------------------------------------------

@query(
    "c0_elements",
    f"""WITH {M}, a AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM ok),
    b AS (SELECT page_id, tag FROM a UNION ALL SELECT page_id, 'tbody' FROM a WHERE tag = 'table') SELECT page_id, tag, count(*) AS n FROM b GROUP BY ALL""",
)
def c0(spark, d):
    return elements(parsed(mutated(spark, d)), "page_id").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def pick(spark, d, column: str, fields: str, need: set[str] | None = None):
    """Rows of one collector."""
    ev = evidence(mutated(spark, d), {column, *(need or ())}).where("is_dom")
    names = ", ".join(f"'{f.split(' as ')[-1].strip()}', x.{f.split(' as ')[0].strip()}" for f in fields.split(","))
    return ev.selectExpr("page_id", f"inline(transform({column}, x -> named_struct({names})))")


NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@query(
    "c1_selectors",
    f"""WITH {M}, n AS (SELECT page_id, regexp_extract_all({NAV}, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM ok),
    u AS (SELECT page_id, len(hrefs) AS k, unnest(range(1, len(hrefs) + 1)) AS i, unnest(hrefs) AS href FROM n)
    SELECT page_id, href, 'body > nav > ul > li' || CASE WHEN k > 1 THEN ':nth-of-type(' || i || ')' ELSE '' END || ' > a' AS selector FROM u""",
)
def c1(spark, d):
    return pick(spark, d, "links", "href,selector,region").where("region = 'nav'").drop("region")


@query(
    "c2_names",
    f"""WITH {M}, e AS (SELECT page_id FROM ok WHERE strpos(html, 'placeholder="Your name"') > 0)
    SELECT page_id, 'text' AS type, '' AS name FROM e UNION ALL SELECT page_id, 'email', 'Email *' FROM e UNION ALL SELECT page_id, '', 'a' FROM e""",
)
def c2(spark, d):
    return pick(spark, d, "controls", "type,name,tag").where("tag in ('input', 'select')").drop("tag")


@query("c3_aria_hidden", f"WITH {M} SELECT page_id, 2::BIGINT AS n FROM ok WHERE strpos(html, 'aria-hidden=\"true\"') > 0")
def c3(spark, d):
    return elements(parsed(mutated(spark, d)), "page_id").where("aria_hidden").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


RTL = f"(len(regexp_extract_all(left({body_text('html')}, 4000), '[\\x{{0590}}-\\x{{05FF}}\\x{{0600}}-\\x{{06FF}}]')) > len(regexp_extract_all(left({body_text('html')}, 4000), '[A-Za-z]')))"


@query("c6_rtl_majority", f"WITH {M} SELECT page_id, {RTL} AS rtl FROM ok")
def c6(spark, d):
    return evidence(mutated(spark, d), {"rtl_content", "is_dom"}).where("is_dom").selectExpr("page_id", "rtl_content as rtl")


@query(
    "c7_images",
    f"""WITH {M}, a AS ({tags('<img [^>]*>', 'page_id, html')}) SELECT page_id, {attr('t', 'src')} AS src, CASE WHEN strpos(t, ' alt=') > 0 THEN {attr('t', 'alt')} END AS alt,
    strpos(t, 'banner.png') > 0 AS filename_alt, {attr('t', 'src')} = '/i.gif' AS in_link, strpos(t, 'alt=""') > 0 AS likely_decorative FROM a""",
)
def c7(spark, d):
    return pick(spark, d, "images", "src,alt,filename_alt,in_link,likely_decorative")


@query(
    "c8_media",
    f"""WITH {M}, a AS ({tags('<(?:video|audio|iframe) [^>]*>')}) SELECT page_id, regexp_extract(t, '<([a-z]+)', 1) AS tag, {attr('t', 'src')} AS src,
    CASE WHEN t LIKE '<video%' THEN 'video' WHEN t LIKE '<audio%' THEN 'audio' ELSE 'player' END AS kind, strpos(t, 'autoplay') > 0 AS autoplay, {attr('t', 'title')} AS name, false AS captions FROM a""",
)
def c8(spark, d):
    return pick(spark, d, "media", "tag,src,kind,autoplay,name,captions")


HEADS = "heads AS (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])>.*?</h[1-6]>', 1) AS lv, regexp_extract_all(html, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1) AS tx FROM ok), hd AS (SELECT page_id, unnest(range(1, len(lv) + 1)) AS n, unnest(lv)::INT AS level, unnest(tx) AS raw FROM heads)"


@query("c9_headings", f"WITH {M}, {HEADS} SELECT page_id, level, {inner_text('raw')} AS text, {inner_text('raw')} = '' AS empty FROM hd")
def c9(spark, d):
    return pick(spark, d, "headings", "level,text,empty")


@query(
    "c11_tables",
    f"""WITH {M}, t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<table>.*?</table>')) AS s FROM ok)
    SELECT page_id, len(regexp_extract_all(s, '<tr>'))::INT AS rows, len(regexp_extract_all(s, '<th>'))::INT AS th, len(regexp_extract_all(regexp_extract(s, '(?s)<tr>(.*?)</tr>', 1), '<t[dh]>'))::INT AS cols,
    (strpos(s, '<th>') = 0 AND len(regexp_extract_all(s, '<tr>')) > 1) AS looks_layout FROM t""",
)
def c11(spark, d):
    return pick(spark, d, "tables", "rows,th,cols,looks_layout")


@query("c12_lists", f"WITH {M} SELECT page_id, 'ul' AS tag, len(regexp_extract_all(html, '<li>'))::INT AS items, 0::INT AS invalid FROM ok WHERE strpos(html, '<ul>') > 0")
def c12(spark, d):
    return pick(spark, d, "lists", "tag,items,invalid")


@query("c13_typed_lists", f"WITH {M} SELECT page_id, '- one' AS text FROM ok WHERE strpos(html, '<p>- one</p>') > 0")
def c13(spark, d):
    return pick(spark, d, "fake_lists", "text")


@query("c14_landmarks", f"WITH {M}, a AS (SELECT page_id, unnest(regexp_extract_all(html, '<(header|nav|main|footer|aside)[ >]', 1)) AS tag FROM ok) SELECT page_id, tag FROM a")
def c14(spark, d):
    return pick(spark, d, "landmarks", "tag")


@query("c15_presentational", f"WITH {M}, a AS (SELECT page_id, unnest(regexp_extract_all(html, '<(font|center|marquee|blink|big|strike|tt)[ >]', 1)) AS tag FROM ok) SELECT page_id, tag FROM a")
def c15(spark, d):
    return pick(spark, d, "presentational", "tag")


@query("c17_sensory_wording", f"WITH {M} SELECT page_id, 'shape-or-colour' AS kind, 'הכפתור האדו' AS match FROM ok WHERE strpos(html, 'הכפתור האדום') > 0")
def c17(spark, d):
    return pick(spark, d, "sensory", "kind,match").where("kind = 'shape-or-colour'")


@query(
    "c20_required_markers",
    f"""WITH {M}, e AS (SELECT page_id FROM ok WHERE strpos(html, 'placeholder="Your name"') > 0)
    SELECT page_id, 'Email *' AS text, true AS asterisk, false AS says_required, false AS aria_required FROM e UNION ALL SELECT page_id, '', false, false, true FROM e""",
)
def c20(spark, d):
    return pick(spark, d, "required_markers", "text,asterisk,says_required,aria_required")


@query("c21_text_images", f"WITH {M} SELECT page_id, '/promo.png' AS src, 600::INT AS width, 100::INT AS height, false AS is_logo FROM ok WHERE strpos(html, 'promo.png') > 0")
def c21(spark, d):
    return pick(spark, d, "text_images_static", "src,width,height,is_logo")


def _links_sql() -> str:
    seg = (
        "seg AS (SELECT page_id, 'nav' AS region, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS s FROM ok UNION ALL SELECT page_id, 'header', regexp_extract(html, '(?s)<header>(.*?)</header>', 1) FROM ok"
        " UNION ALL SELECT page_id, 'footer', regexp_extract(html, '(?s)<footer>(.*)$', 1) FROM ok"
        " UNION ALL SELECT page_id, 'body', regexp_replace(regexp_replace(regexp_replace(html, '(?s)<nav>.*?</nav>', ''), '(?s)<header>.*?</header>', ''), '(?s)<footer>.*$', '') FROM ok),"
        " lk AS (SELECT page_id, region, s, unnest(regexp_extract_all(s, '(?s)<a [^>]*>.*?</a>')) AS t FROM seg)"
    )
    text = inner_text("regexp_replace(t, '<a [^>]*>', '')")
    return seg + f", links AS (SELECT page_id, region, strpos(s, t) + CASE region WHEN 'header' THEN 0 WHEN 'nav' THEN 100000 ELSE 200000 END AS seen_at, {attr('t', 'href')} AS href, {text} AS text FROM lk)"


LINKS = _links_sql()
GENERIC = "(?i)^(לחץ כאן|לחצו כאן|כאן|קרא עוד|קראו עוד|למידע נוסף|לפרטים|עוד|המשך|click here|read more|more|here|link|details)$"


@query(
    "c22_c23_links",
    f"""WITH {M}, {LINKS} SELECT page_id, region, text, href, regexp_matches(text, '{GENERIC}') AS generic, text = '' AS empty,
    (text <> '' AND min(href) OVER (PARTITION BY page_id, text) <> max(href) OVER (PARTITION BY page_id, text)) AS ambiguous FROM links""",
)
def c22(spark, d):
    return pick(spark, d, "links", "region,text,href,generic,empty,ambiguous")


@query(
    "c24_form_controls",
    f"""WITH {M}, e AS (SELECT page_id FROM ok WHERE strpos(html, 'placeholder="Your name"') > 0), w AS (SELECT page_id FROM ok WHERE strpos(html, 'role="checkbox"') > 0)
    SELECT page_id, 'input' AS tag, 'text' AS type, true AS placeholder_only, false AS required, false AS on_change FROM e UNION ALL SELECT page_id, 'input', 'email', false, true, false FROM e
    UNION ALL SELECT page_id, 'select', '', false, false, true FROM e UNION ALL SELECT page_id, 'div', '', false, false, false FROM w""",
)
def c24(spark, d):
    return pick(spark, d, "controls", "tag,type,placeholder_only,required,on_change")


@query(
    "c25_forms",
    f"""WITH {M} SELECT page_id, {attr("regexp_extract(html, '<form [^>]*>')", 'action')} AS action, 3::INT AS controls, '' AS submit_label, false AS high_stakes FROM ok WHERE strpos(html, '<form ') > 0""",
)
def c25(spark, d):
    return pick(spark, d, "forms", "action,controls,submit_label,high_stakes")


@query("c26_error_boxes", f"WITH {M} SELECT page_id, 'alert' AS role, NULL::VARCHAR AS live, 'Bad' AS text, false AS referenced FROM ok WHERE strpos(html, 'role=\"alert\"') > 0")
def c26(spark, d):
    return pick(spark, d, "error_boxes", "role,live,text,referenced")


@query("c27_captcha", f"WITH {M} SELECT page_id, 'div' AS tag FROM ok WHERE strpos(html, 'class=\"g-captcha\"') > 0")
def c27(spark, d):
    return pick(spark, d, "captcha", "tag")


@query(
    "c28_foreign_runs",
    f"WITH {M} SELECT page_id, 'This paragraph is written in English only and it is long enough to count as a passage.' AS text, 'latin' AS detected FROM ok WHERE strpos(html, 'This paragraph is written in English only') > 0",
)
def c28(spark, d):
    return pick(spark, d, "foreign_runs", "text,detected").where("detected = 'latin'")


@query("c29_ltr_islands", f"WITH {M} SELECT page_id, 'phone' AS kind, '03-1234567' AS match FROM ok WHERE strpos(html, '03-1234567') > 0")
def c29(spark, d):
    return pick(spark, d, "islands", "kind,match")


@query("c30_english_names", f"WITH {M} SELECT page_id, 'Open the main menu' AS name, 'aria-label' AS source FROM ok WHERE strpos(html, 'Open the main menu') > 0")
def c30(spark, d):
    return pick(spark, d, "english_names", "name,source")


@query(
    "c31_motion",
    f"""WITH {M} SELECT page_id, (strpos(html, 'http-equiv="refresh"') > 0)::INT AS refresh, (strpos(html, '<marquee>') > 0)::INT AS moving, (strpos(html, 'class="carousel"') > 0)::INT AS carousels,
    (strpos(html, ' autoplay') > 0)::INT AS autoplay, (strpos(html, '.gif"') > 0)::INT AS gifs FROM ok""",
)
def c31(spark, d):
    ev = evidence(mutated(spark, d), {"meta_refresh", "moving_tags", "carousels", "autoplay", "gifs", "is_dom"}).where("is_dom")
    return ev.selectExpr("page_id", "size(meta_refresh) as refresh", "size(moving_tags) as moving", "size(carousels) as carousels", "size(autoplay) as autoplay", "size(gifs) as gifs")


IDS = "ids AS (SELECT page_id, unnest(regexp_extract_all(html, ' id=\"([^\"]*)\"', 1)) AS id FROM ok)"


@query(
    "c32_markup",
    f"""WITH {M}, {IDS}, refs AS (SELECT page_id, unnest(regexp_extract_all(html, ' aria-describedby="([^"]*)"', 1)) AS id FROM ok)
    SELECT page_id, 'duplicate-id' AS problem, id FROM ids GROUP BY page_id, id HAVING count(*) > 1
    UNION ALL SELECT page_id, 'broken-reference', id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.page_id = r.page_id AND i.id = r.id)""",
)
def c32(spark, d):
    ev = evidence(mutated(spark, d), {"dup_ids", "broken_refs", "orphan_labels", "is_dom"}).where("is_dom")
    return ev.selectExpr(
        "page_id",
        "inline(concat(transform(dup_ids, x -> named_struct('problem', 'duplicate-id', 'id', x.id)), transform(broken_refs, x -> named_struct('problem', 'broken-reference', 'id', x.missing_id)),"
        " transform(orphan_labels, x -> named_struct('problem', 'orphan-label', 'id', x.label_for))))",
    )


@query(
    "c33_c34_widgets",
    f"""WITH {M}, e AS (SELECT page_id FROM ok WHERE strpos(html, 'role="checkbox"') > 0) SELECT page_id, 'checkbox' AS role, 'x' AS name, false AS focusable FROM e UNION ALL SELECT page_id, 'tab', 't', true FROM e
    UNION ALL SELECT page_id, 'pseudo', 'Go', false FROM e""",
)
def c33(spark, d):
    ev = evidence(mutated(spark, d), {"widgets", "pseudo_controls", "is_dom"}).where("is_dom")
    return ev.selectExpr(
        "page_id",
        "inline(concat(transform(widgets, w -> named_struct('role', w.role, 'name', w.name, 'focusable', w.focusable)), transform(pseudo_controls, p -> named_struct('role', 'pseudo', 'name', p.text, 'focusable', false))))",
    )


@query(
    "c35_frames_icons",
    f"""WITH {M} SELECT page_id, 'frame' AS kind, '' AS name FROM ok WHERE strpos(html, '<iframe') > 0 UNION ALL SELECT page_id, 'icon', '' FROM ok WHERE strpos(html, '<a href="/i"><img') > 0""",
)
def c35(spark, d):
    ev = evidence(mutated(spark, d), {"iframes", "icon_buttons", "is_dom"}).where("is_dom")
    return ev.selectExpr("page_id", "inline(concat(transform(iframes, f -> named_struct('kind', 'frame', 'name', coalesce(f.title, ''))), transform(icon_buttons, b -> named_struct('kind', 'icon', 'name', b.name))))")


@query(
    "c36_skip_links",
    f"""WITH {M} SELECT page_id, '#m' AS href, strpos(html, ' id="m"') > 0 AS target_exists, strpos(html, ' id="m"') > 0 AS target_focusable, true AS looks_skip, 0::INT AS dom_position FROM ok WHERE strpos(html, '<a href="#m">') > 0""",
)
def c36(spark, d):
    return pick(spark, d, "skip_links", "href,target_exists,target_focusable,looks_skip,dom_position")


@query(
    "c37_navs",
    f"""WITH {M}, {LINKS}, o AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1) AS x FROM ok)
    SELECT page_id, {unescape("array_to_string(x, ' > ')")} AS items, len(x)::INT AS n FROM o""",
)
def c37(spark, d):
    ev = evidence(mutated(spark, d), {"navs", "is_dom"}).where("is_dom")
    return ev.selectExpr("page_id", "explode(navs) as nav").selectExpr("page_id", "array_join(transform(nav.items, i -> i.text), ' > ') as items", "size(nav.items) as n")


@query("c38_statement_links", f"WITH {M} SELECT page_id, 'הצהרת נגישות' AS text, '/statement' AS href FROM ok WHERE strpos(html, 'href=\"/statement\"') > 0")
def c38(spark, d):
    return pick(spark, d, "statement_links", "text,href")


@query("c39_mechanisms", f"WITH {M} SELECT page_id, 0::INT AS search, (lower(html) LIKE '%sitemap%')::INT AS sitemap, 0::INT AS breadcrumbs FROM ok")
def c39(spark, d):
    ev = evidence(mutated(spark, d), {"search_mechanisms", "sitemap_links", "breadcrumbs", "is_dom"}).where("is_dom")
    return ev.selectExpr("page_id", "search_mechanisms as search", "sitemap_links as sitemap", "breadcrumbs")


@query("c40_overlays", f"WITH {M} SELECT page_id, 'userway' AS vendor FROM ok WHERE strpos(html, 'userway') > 0")
def c40(spark, d):
    return evidence(mutated(spark, d), {"overlay_vendors", "is_dom"}).where("is_dom").selectExpr("page_id", "explode(overlay_vendors) as vendor")


@query(
    "c41_contacts",
    f"""WITH {M}, b AS (SELECT page_id, {body_text('html')} AS tx FROM ok), x AS (
    SELECT page_id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(tx, '[\\w.+-]+@[\\w-]+\\.[\\w.]+'))) AS value FROM b UNION ALL SELECT page_id, 'phone', unnest(list_distinct(regexp_extract_all(tx, '0\\d{{1,2}}[-\\s]?\\d{{7}}|\\+972[-\\s]?\\d{{1,2}}[-\\s]?\\d{{7}}'))) FROM b)
    SELECT * FROM x""",
)
def c41(spark, d):
    ev = evidence(mutated(spark, d), {"emails", "phones", "is_dom"}).where("is_dom")
    return ev.selectExpr("page_id", "inline(concat(transform(emails, e -> named_struct('kind', 'email', 'value', e)), transform(phones, p -> named_struct('kind', 'phone', 'value', p))))")


FOCUSABLE = (
    "(len(regexp_extract_all(html, '<a [^>]*href=')) + len(regexp_extract_all(html, '<(?:button|select|textarea)[ >]')) + len(regexp_extract_all(html, '<input '))"
    " + len(regexp_extract_all(html, '<(?:div|span)[^>]* tabindex=\"[0-9]')))"
)


@query(
    "c42_focusable",
    f"""WITH {M} SELECT page_id, {FOCUSABLE}::INT AS focusable, len(regexp_extract_all(html, 'tabindex="[1-9]'))::INT AS positive, (strpos(html, '<a href="/h">hidden') > 0)::INT AS hidden FROM ok""",
)
def c42(spark, d):
    ev = evidence(mutated(spark, d), {"focusable_count", "positive_tabindex", "hidden_focusable", "is_dom"}).where("is_dom")
    return ev.selectExpr("page_id", "focusable_count as focusable", "size(positive_tabindex) as positive", "size(hidden_focusable) as hidden")


TITLE = inner_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
SITE_NAME = (
    f"CASE WHEN len(regexp_split_to_array({TITLE}, '\\s[|–—•-]\\s')) > 1 AND trim(list_last(regexp_split_to_array({TITLE}, '\\s[|–—•-]\\s'))) <> '' THEN trim(list_last(regexp_split_to_array({TITLE}, '\\s[|–—•-]\\s')))"
    " ELSE regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www[.]', '') END"
)


@query(
    "c43_meta",
    f"""WITH {M} SELECT page_id, {TITLE} AS title, {SITE_NAME} AS site_name, CASE WHEN strpos(html, '<html lang') > 0 THEN regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang,
    strpos(html, 'user-scalable=no') > 0 AS blocks_zoom, CASE WHEN strpos(html, 'name="viewport"') > 0 THEN 'width=device-width, user-scalable=no' END AS viewport FROM ok""",
)
def c43(spark, d):
    return evidence(mutated(spark, d), {"title", "site_name", "lang", "blocks_zoom", "viewport", "is_dom"}).where("is_dom").select("page_id", "title", "site_name", "lang", "blocks_zoom", "viewport")


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))"


_FORM = "(strpos(html, 'placeholder=\"Your name\"') > 0)::INT"
COUNT_SQL = {
    "images": _n("<img "), "linkedImages": "(strpos(html, '<a href=\"/i\"><img') > 0)::INT", "decorativeCandidates": _n('<img [^>]*alt=""'), "complexImages": "0", "embeddedMedia": _n("<iframe "),
    "audioOnly": _n("<audio "), "videoElements": _n("<(?:video|iframe) "), "timeBasedMedia": _n("<(?:video|audio|iframe) "), "captcha": _n('class="g-captcha"'), "autoplayAudio": _n("<video [^>]*autoplay"),
    "headings": _n("<h[1-6]>"), "lists": _n("<ul>"), "tables": _n("<table>"), "forms": _n("<form "), "formControls": f"{_n('<(?:input|select|textarea)[ >]')} + {_n('role=' + chr(34) + 'checkbox' + chr(34))}",
    "highStakesForms": "0", "validationSignals": f"{_FORM} + (strpos(html, 'role=\"alert\"') > 0)::INT", "focusable": FOCUSABLE, "timeLimits": _n('http-equiv="refresh"'), "movingContent": f"{_n('<marquee>')} + {_n('class=' + chr(34) + 'carousel')} + {_n('[.]gif' + chr(34))}",
    "flashCandidates": _n('[.]gif"'), "links": _n("<a [^>]*href="), "foreignRuns": "(strpos(html, 'This paragraph is written in English only') > 0)::INT", "iframes": _n("<iframe "),
    "textLength": f"length({body_text('html')})", "colourCoded": f"2 * {_FORM}", "sensoryInstructions": "(strpos(html, 'הכפתור האדום') > 0)::INT", "textImages": "(strpos(html, 'promo.png') > 0)::INT",
    "sections": f"{_n('<(?:article|section)[ >]')} + {_n('<h[1-6]>')}", "repeatedBlocks": _n("<nav>"),
}


@query("c44_counts", f"WITH {M} SELECT page_id, " + ", ".join(f"({v})::INT AS \"{k}\"" for k, v in COUNT_SQL.items()) + " FROM ok")
def c44(spark, d):
    return evidence(mutated(spark, d), {"counts", "is_dom"}).where("is_dom").selectExpr("page_id", *[f"counts.{k} as {k}" for k in COUNTS])


@query("u20_template_hash")
def u20(spark, d):
    ev = evidence(mutated(spark, d), {"skeleton", "is_dom"}).where("is_dom")
    return ev.withColumn("hash", template_hash()).select("page_id", "hash")


@query("u19_template_clusters")
def u19(spark, d):
    ev = evidence(mutated(spark, d), {"skeleton", "is_dom"}).where("is_dom").withColumn("template_hash", template_hash()).withColumn("site", F.expr(SITE_BY_DOMAIN))
    return crawl.template_clusters(ev).select("site", "template_hash", "pages", "first_url")


# ---- applicability ---------------------------------------------------------------------------

_APPLIES = {p: A.condition(p, "c") for p in A.PAGE_PROBES}


@query(
    "a0_probes",
    f"WITH {M}, c AS (SELECT page_id, count(*) OVER (PARTITION BY array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.'), -2, -1), '.')) AS \"sitePageCount\", " + ", ".join(f"({v})::INT AS \"{k}\"" for k, v in COUNT_SQL.items()) + " FROM ok) "
    + " UNION ALL ".join(f"SELECT page_id, '{p}' AS probe, ({cond}) AS applicable FROM c" for p, cond in _APPLIES.items()),
)
def a0(spark, d):
    # the counts are written before they meet another table: a join would otherwise pull every nested field through the plan
    ev = evidence(mutated(spark, d), {"counts"}).withColumn("site", F.expr(SITE_BY_DOMAIN)).select("page_id", "site", "is_dom", "counts")
    ev = materialize(ev, "counts").where("is_dom")
    sizes = ev.groupBy("site").agg(F.count(F.lit(1)).alias("n")).withColumn("_rows", F.col("n"))
    fields = ", ".join(f"'{k}', counts.{k}" for k in COUNTS)
    with_total = join_on_hot_key(ev, sizes, ["site"], "_rows", "page_id").selectExpr("page_id", f"named_struct({fields}, 'sitePageCount', n) as counts")
    return A.probe_results(A.checked_counts(with_total), "page_id").select("page_id", "probe", "applicable")


@query("a1_count_contract", f"WITH {M}, k AS (SELECT unnest([{', '.join(repr(k) for k in COUNTS)}]) AS key) SELECT key, 0::BIGINT AS violations FROM k")
def a1(spark, d):
    ev = evidence(mutated(spark, d), {"counts", "is_dom"}).where("is_dom")
    return A.count_violations(ev, "counts", list(COUNTS))


# ---- preflight ---------------------------------------------------------------------------------

def _pf(rule: str, status: str, cond: str, detail: str = "''") -> str:
    return f"SELECT page_id, '{rule}' AS rule, '{status}' AS status, ({detail})::VARCHAR AS detail FROM ok WHERE {cond}"


_TAGTEXT = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
_PFRTL = f"(len(regexp_extract_all({_TAGTEXT}, '[\\x{{0590}}-\\x{{05FF}}]')) > len(regexp_extract_all({_TAGTEXT}, '[A-Za-z]')))"
_PF_FORM = "strpos(html, 'placeholder=\"Your name\"') > 0"
_EMPTY_LINKS = _n("<a [^>]*>(?:<img[^>]*>)?</a>")
_JUMPS = "strpos(html, '</h1><h3>') > 0"
PF_SQL = [
    _pf("lang", "FAIL", "strpos(html, '<html lang') = 0"), _pf("lang", "OK", "strpos(html, '<html lang') > 0", "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)"), _pf("dir", "FAIL", _PFRTL),
    _pf("title", "OK", f"{TITLE} <> ''", f"left({TITLE}, 60)"), _pf("title", "FAIL", f"{TITLE} = ''"), _pf("title-meaning", "CHECK", f"{TITLE} <> ''"), _pf("h1", "OK", "true"), _pf("heading-jump", "FAIL", _JUMPS, "1"),
    _pf("heading-empty", "FAIL", "regexp_matches(html, '<h1>\\s*</h1>')", "1"),
    _pf("alt-missing", "FAIL", "strpos(html, '<img src=\"/b.png\">') > 0", "1"), _pf("alt-filename", "FAIL", "strpos(html, 'alt=\"banner.png\"') > 0", "1"),
    _pf("images", "OK", "strpos(html, '<img src=\"/b.png\">') = 0", _n("<img ")), _pf("alt-meaning", "CHECK", f"{_n('<img ')} > 0"),
    _pf("input-unlabelled", "FAIL", _PF_FORM, "2"), _pf("input-placeholder", "FAIL", _PF_FORM, "1"),
    _pf("link-empty", "FAIL", f"{_EMPTY_LINKS} > 0", _EMPTY_LINKS), _pf("link-generic", "CHECK", "strpos(html, '>read more<') > 0", "2"),
    _pf("links", "OK", f"{_EMPTY_LINKS} = 0 AND strpos(html, '>read more<') = 0", _n("<a ")),
    _pf("button-unnamed", "FAIL", "strpos(html, '<button></button>') > 0", "1"), _pf("frame-untitled", "FAIL", "strpos(html, '<iframe') > 0", "1"),
    _pf("duplicate-id", "FAIL", "strpos(html, '<div id=\"d\"></div><div id=\"d\">') > 0", "'d'"), _pf("duplicate-id", "OK", "strpos(html, '<div id=\"d\"></div><div id=\"d\">') = 0"),
    _pf("presentational", "FAIL", "regexp_matches(html, '<(font|marquee)[ >]')", "array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<(font|marquee)[ >]', 1))), ', ')"),
    _pf("zoom", "FAIL", "strpos(html, 'user-scalable=no') > 0"), _pf("bypass", "OK", "strpos(html, '<a href=\"#m\">') > 0 OR regexp_matches(html, '<main[ >]')", "CASE WHEN strpos(html, '<a href=\"#m\">') > 0 THEN 'skip link' ELSE 'main' END"),
    _pf("bypass", "FAIL", "strpos(html, '<a href=\"#m\">') = 0 AND NOT regexp_matches(html, '<main[ >]')"), _pf("table-caption", "CHECK", "strpos(html, '<table>') > 0", "2"),
    _pf("statement", "OK", "strpos(html, 'הצהרת נגישות') > 0"), _pf("statement", "FAIL", "strpos(html, 'הצהרת נגישות') = 0"), _pf("english-label", "FAIL", f"{_PFRTL} AND strpos(html, 'Open the main menu') > 0", "1"),
    *[_pf("manual", "CHECK", "true", f"'{m}'") for m in preflight.MANUAL], _pf("rendering", "SKIPPED", "true"),
]


@query("p0_preflight", f"WITH {M} " + " UNION ALL ".join(PF_SQL))
def p0(spark, d):
    return preflight.preflight(parsed(mutated(spark, d)))


@query(
    "p13_preflight_totals",
    f"WITH {M}, r AS ({' UNION ALL '.join(PF_SQL)}) SELECT rule, count(*) FILTER (status = 'FAIL') AS failures, count(*) FILTER (status = 'CHECK') AS checks, max((status = 'FAIL')::INT) AS exit_status FROM r GROUP BY ROLLUP (rule)",
)
def p13(spark, d):
    return preflight.corpus_totals(preflight.preflight(parsed(mutated(spark, d))))
