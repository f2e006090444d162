"""Link, robots and crawl-set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lucerna.functions import urls as U
from lucerna.operators.skew import first_k, join_on_hot_key
from lucerna.plans.materialize import materialize


def page_links(pages_with_dom: DataFrame) -> DataFrame:
    """U8: every anchor with an href: absolute address, text of at most 120 characters, position."""
    anchors = "transform(filter(dom.elements, e -> e.tag = 'a' and e.attrs['href'] is not null), e -> named_struct('pos', e.pos, 'href', e.attrs['href'], 'text', left(coalesce(e.text, ''), 120)))"
    flat = pages_with_dom.selectExpr("page_id", "url", f"inline({anchors})")
    return flat.withColumn("target", F.expr(U.resolve("href", "url"))).withColumn("canonical", F.expr(U.canonicalize("target")))


# ---- robots -------------------------------------------------------------------------------

def robots_lines(robots: DataFrame) -> DataFrame:
    """U9, first half: ``site, text`` -> field/value lines in file order, comments and blanks dropped."""
    lines = robots.selectExpr("site", r"posexplode(split(text, r'\r?\n')) as (line_no, raw)")
    clean = lines.withColumn("line", F.expr("trim(regexp_replace(raw, '#.*$', ''))")).where("instr(line, ':') > 0")
    return clean.selectExpr("site", "line_no", "lower(trim(split_part(line, ':', 1))) as field", "trim(substring(line, instr(line, ':') + 1)) as value")


def robots_groups(robots: DataFrame) -> DataFrame:
    """Lines with the number of their group; agent lines in a row share one group.

    A robots file is one row of the input and is parsed by its lines, so the window per file is bounded by that row.
    """
    w = W.partitionBy("site").orderBy("line_no")
    lines = robots_lines(robots).where("field <> 'sitemap'")
    opens = F.expr("if(field = 'user-agent' and coalesce(lag(field) over (partition by site order by line_no), '') <> 'user-agent', 1, 0)")
    return lines.withColumn("_o", opens).withColumn("group_no", F.sum("_o").over(w)).drop("_o").where("group_no > 0")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    return robots_lines(robots).where("field = 'sitemap'").select("site", "line_no", F.col("value").alias("sitemap"))


def robots_rules(groups: DataFrame) -> DataFrame:
    """Rules of every group; an empty Allow says nothing, an empty Disallow allows everything."""
    return groups.where("field in ('allow', 'disallow') and value <> ''").selectExpr("site", "group_no", "field = 'allow' as allow", "value as pattern")


def robots_choice(groups: DataFrame, user_agent: str) -> DataFrame:
    """First group naming this agent, else the first ``*`` group, with its crawl delay."""
    ua = user_agent.lower().replace("'", "")
    agents = groups.where("field = 'user-agent'").withColumn("agent", F.lower("value"))
    named = F.expr(f"agent <> '*' and instr('{ua}', agent) > 0")
    fit = agents.where(named | (F.col("agent") == "*")).withColumn("wild", F.expr(f"not (agent <> '*' and instr('{ua}', agent) > 0)"))
    chosen = fit.groupBy("site").agg(F.expr("min(struct(wild, group_no))").alias("g")).selectExpr("site", "g.group_no as group_no", "g.wild as wildcard")
    delay = (
        groups.where("field = 'crawl-delay' and try_cast(value as double) is not null")
        .groupBy("site", "group_no")
        .agg(F.expr("max_by(try_cast(value as double), line_no) * 1000").alias("crawl_delay_ms"))
    )
    return chosen.join(delay, ["site", "group_no"], "left")


def robots_regex(pattern: str) -> str:
    """A robots pattern as an anchored regular expression (``*`` any run, ``$`` end)."""
    body = rf"regexp_replace({pattern}, r'[$]$', '')"
    quoted = rf"regexp_replace({body}, r'([\\.\[\]\{{\}}()+?^$|])', r'\\$1')"
    # a trailing star before $ matches anything, so the end anchor falls away
    return rf"concat('^', replace({quoted}, '*', '.*'), if({pattern} like '%$' and not {pattern} like '%*$', '$', ''))"


def robots_decisions(urls: DataFrame, robots: DataFrame, user_agent: str) -> DataFrame:
    """Longest matching pattern wins, allow wins a tie, no match allows.

    ``urls`` has ``site, url``. The chosen rules of a site are folded into one array on one row per site
    (a robots file is a single bounded row), so a site with most of the urls costs one lookup per url and no pair list.
    """
    groups = robots_groups(robots)
    picked = robots_rules(groups).join(robots_choice(groups, user_agent).select("site", "group_no"), ["site", "group_no"])
    packed = picked.groupBy("site").agg(F.expr(f"collect_list(named_struct('len', char_length(pattern), 'allow', allow, 'rx', {robots_regex('pattern')}))").alias("rules"))
    target = f"concat({U.path('url')}, if({U.query('url')} = '', '', concat('?', {U.query('url')})))"
    best = f"get(sort_array(transform(filter(rules, r -> {target} rlike r.rx), r -> named_struct('len', r.len, 'allow', r.allow)), false), 0).allow"
    sized = urls.groupBy("site").agg(F.count(F.lit(1)).alias("_urls")).join(packed, "site", "left")
    return join_on_hot_key(urls, sized, ["site"], "_urls", "url", "left").withColumn("allowed", F.expr(f"coalesce({best}, true)")).drop("rules")


def effective_delay(politeness_ms: str, crawl_delay_ms: str) -> str:
    """U12."""
    return f"greatest(cast({politeness_ms} as double), coalesce({crawl_delay_ms}, 0D))"


# ---- sitemaps -----------------------------------------------------------------------------

def sitemap_urls(sitemaps: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``site, source, xml`` -> site, source, pos, loc: what every root file lists, itself or through index files.

    Index files are followed through the same table level by level, each once for a root, so a cycle ends; ``max_depth`` stops
    earlier (the original follows two levels of indexes). ``roots`` (site, source) are the files to start at, by default all that no
    index lists. ``pos`` is the path of places in the files down to the address and orders what a root lists. Each level is a
    table in the shared folder.
    """
    locs = r"transform(regexp_extract_all(xml, r'(?is)<loc>\s*(.*?)\s*</loc>', 1), l -> trim(replace(l, '&amp;', '&')))"
    listed = materialize(sitemaps.selectExpr("site", "source", "xml rlike '(?i)<sitemapindex' as is_index", f"posexplode_outer({locs}) as (at, loc)").where("loc is not null"), "sitemaps")
    index = listed.where("is_index").selectExpr("source", "cast(at as bigint) as at", "loc as child").where("child <> source")
    plain = listed.where("not is_index").selectExpr("source", "cast(at as bigint) as at", "loc")
    start = sitemaps.select("site", "source").distinct().join(index.select(F.col("child").alias("source")).distinct(), "source", "left_anti") if roots is None else roots.select("site", "source").distinct()
    frontier = materialize(start.selectExpr("site", "source as root", "source", "cast(array() as array<bigint>) as path"), "sitemap-0")
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(index, "source").selectExpr("site", "root", "child as source", "concat(path, array(at)) as path")
        firsts = found.groupBy("site", "root", "source").agg(F.min("path").alias("path"))
        frontier = materialize(firsts.join(seen.select("site", "root", "source"), ["site", "root", "source"], "left_anti"), f"sitemap-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(plain, "source").selectExpr("site", "root as source", "concat(path, array(at)) as pos", "loc")


def sitemap_seeds(declared: DataFrame, listed: DataFrame, max_sources: int | None = None) -> DataFrame:
    """The first source (of the first ``max_sources``, if given) that lists anything seeds the crawl at depth 1.

    ``declared`` has ``site, source_no, source`` (sources in trial order, from 0); ``listed`` is ``sitemap_urls``.
    """
    tried = declared if max_sources is None else declared.where(F.col("source_no") < max_sources)
    usable = tried.join(listed.select("site", "source").distinct(), ["site", "source"]).groupBy("site").agg(F.expr("min_by(source, source_no)").alias("source"))
    return listed.join(usable, ["site", "source"]).select("site", "source", "pos", "loc", F.lit(1).alias("depth"))


# ---- frontier -----------------------------------------------------------------------------

def new_frontier(found: DataFrame, visited: DataFrame) -> DataFrame:
    """First discovery of every address not seen before. ``found`` has ``site, url, depth, found_order``."""
    firsts = found.groupBy("site", "url").agg(F.expr("min(struct(found_order, depth))").alias("f")).selectExpr("site", "url", "f.depth as depth", "f.found_order as found_order")
    return firsts.join(visited.select("site", "url"), ["site", "url"], "left_anti")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first depth over a recorded link graph (``src, dst``), at most ``max_depth`` rounds.

    Each round is join, aggregate, anti-join; its result is written to the shared checkpoint folder, so the
    lineage never grows and a lost executor costs one round.
    """
    seen = materialize(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs-0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        nxt = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def page_cap(queue: DataFrame, max_pages: int) -> tuple[DataFrame, DataFrame]:
    """The first pages of each site in queue order, and the rest. ``queue`` has ``site, url, depth, found_order``."""
    order = [F.col("depth"), F.col("found_order")]
    kept = first_k(queue, ["site"], order, max_pages, "queue_no")
    rest = queue.join(kept.select("site", "url"), ["site", "url"], "left_anti")
    return kept, rest


def skip_reason(max_depth: int) -> str:
    """U16: why a discovered address is not queued; depth is tested before robots."""
    return f"case when depth > {max_depth} then concat('depth ', depth, ' exceeds ', {max_depth}) when not allowed then 'robots' when guard is not null then concat('guard: ', guard) end"


def skipped_ledger(found: DataFrame, over_cap: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """U16: the whole ledger. Refused discoveries are kept once per discovery, so duplicates are intended."""
    refused = found.withColumn("reason", F.expr(skip_reason(max_depth))).where("reason is not null").select("site", "url", "reason")
    return refused.unionByName(over_cap.select("site", "url", F.lit(f"page cap {max_pages} reached").alias("reason")))


def documents_found(links: DataFrame) -> DataFrame:
    """Linked documents with distinct referrers and link texts in discovery order, off-site ones included."""
    docs = links.where("canonical is not null").withColumn("doc_type", F.expr(U.doc_type("canonical"))).where("doc_type is not null")
    # repeated links collapse before the list is built, so a document linked from every page stays one row per referrer
    refs = docs.groupBy("canonical", "doc_type", "url").agg(F.expr("min(struct(crawl_order, pos))").alias("o"))
    texts = docs.where("text <> ''").groupBy("canonical", "doc_type", "text").agg(F.expr("min(struct(crawl_order, pos))").alias("o"))
    a = refs.groupBy("canonical", "doc_type").agg(F.count(F.lit(1)).alias("n_referrers"), F.expr("min_by(url, o)").alias("first_referrer"))
    b = texts.groupBy("canonical", "doc_type").agg(F.count(F.lit(1)).alias("n_texts"), F.expr("min_by(text, o)").alias("first_text"))
    return a.join(b, ["canonical", "doc_type"], "left").withColumnRenamed("canonical", "url")


def document_references(links: DataFrame) -> DataFrame:
    """U18 in long form: one row per document and referrer, with its place in discovery order."""
    docs = links.where("canonical is not null").withColumn("doc_type", F.expr(U.doc_type("canonical"))).where("doc_type is not null")
    return docs.groupBy("canonical", "doc_type", F.col("url").alias("referrer")).agg(F.expr("min(struct(crawl_order, pos))").alias("o")).selectExpr(
        "canonical as url", "doc_type", "referrer", "o.crawl_order as crawl_order", "o.pos as pos"
    )


def template_clusters(pages: DataFrame) -> DataFrame:
    """Pages per template; size and first page per cluster, never a list that grows with the crawl."""
    return pages.groupBy("site", "template_hash").agg(F.count(F.lit(1)).alias("pages"), F.expr("min_by(url, crawl_order)").alias("first_url"))
