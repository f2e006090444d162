"""Site context (X1-X10): cross-page facts without any per-site window, cross join or pair list.

Input rows are compact page facts: ``page_id, url, site, crawl_order, load_error, title, lang, site_name,
navs, links, widgets, icon_buttons, search_mechanisms, sitemap_links, breadcrumbs, statement_links,
statement_flags, text_len``. One site may hold most of the pages, so every step is either an aggregate that
combines before the shuffle, a first-k rank that limits before the shuffle, or a join split on hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import patterns as P
from lucerna.functions import urls as U
from lucerna.functions.patterns import lit
from lucerna.operators.evidence import squash
from lucerna.operators.skew import first_k, join_on_hot_key

ALL = "*"


def statement_flags(text: str) -> str:
    """What a statement text carries; NULL when the page has too little text to be one."""
    # a pattern walks the whole text, so each is asked only where a letter or sign it cannot do without is there
    needs = {"email": "instr(x.t, '@') > 0", **{k: "x.he" for k in ("features_list", "known_limitations", "coordinator_name", "audit_date", "update_date")}}
    flags = ", ".join(f"'{k}', {needs[k] + ' and ' if k in needs else ''}x.t rlike {lit(p)}" for k, p in P.STATEMENT_AUDIT)
    return f"get(transform(filter(array({squash(text)}), t -> char_length(t) > 100), t -> get(transform(array(named_struct('t', t, 'he', t rlike {lit(P.HEBREW)})), x -> named_struct({flags})), 0)), 0)"


def base_lang(col: str) -> str:
    """Primary language subtag, '' when none is declared."""
    return f"lower(split_part(coalesce({col}, ''), '-', 1))"


def component_key(name: str) -> str:
    """Which repeated component a name stands for, first class wins."""
    n = f"lower(trim({name}))"
    return "case " + " ".join(f"when {n} rlike {lit(p)} then '{k}'" for k, p in P.COMPONENT_KEYS) + " end"


def primary_nav(navs: str = "navs") -> str:
    """Item texts of the nav with most items; the first such nav on a tie."""
    best = f"get(array_sort(transform({navs}, (n, i) -> named_struct('less', -size(n.items), 'i', i, 'items', n.items))), 0).items"
    return f"coalesce(filter(transform({best}, t -> t.text), t -> t <> ''), cast(array() as array<string>))"


def component_names(var: str = "") -> str:
    """First name per component key, from links outside the body, widgets and icon buttons."""
    pool = (
        "concat(transform(filter(links, l -> l.region <> 'body'), l -> l.name), transform(widgets, w -> w.name), transform(icon_buttons, b -> b.name))"
    )
    keyed = f"filter(transform({pool}, n -> named_struct('key', {component_key('n')}, 'name', trim(n))), x -> x.key is not null)"
    # equal keys are neighbours once sorted; the first of each keeps its place
    order = "array_sort(transform(ks, (x, i) -> named_struct('key', x.key, 'i', i)))"
    firsts = f"get(transform(array({order}), r -> array_sort(transform(filter(r, (y, i) -> i = 0 or get(r, i - 1).key <> y.key), y -> y.i))), 0)"
    once = f"get(transform(array({keyed}), ks -> transform({firsts}, j -> get(ks, j))), 0)"
    return f"map_from_entries({once})"


def page_inputs(evidence: DataFrame, site_sql: str) -> DataFrame:
    """X2-X5 projections that the site step needs, all narrow."""
    return (
        evidence.withColumn("site", F.expr(site_sql))
        .withColumn("nav_seq", F.expr(f"if(is_dom, {primary_nav()}, null)"))
        .withColumn("components", F.expr(f"if(is_dom, {component_names()}, null)"))
        .withColumn("statement_flags", F.expr(f"if(is_dom, {statement_flags(U.strip_html('html'))}, null)"))
        .withColumn(
            "statement_ref",
            F.expr(
                "if(is_dom, coalesce("
                f"get(transform(filter(statement_links, l -> l.text rlike {lit(P.STATEMENT_EXPLICIT)} and l.href <> ''), l -> named_struct('rank', 0, 'href', {U.resolve('l.href', 'url')})), 0),"
                f"get(transform(filter(slice(statement_links, 1, 1), l -> l.href <> ''), l -> named_struct('rank', 1, 'href', {U.resolve('l.href', 'url')})), 0)), null)"
            ),
        )
    )


def site_facts(pages: DataFrame) -> DataFrame:
    """One aggregate, one row per site, partial before the shuffle."""
    ok = "load_error is null"
    return pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("site_rows"),
        F.expr(f"count_if({ok})").alias("page_count"),
        F.expr(f"coalesce(bool_or({ok} and search_mechanisms > 0), false)").alias("site_search"),
        F.expr(f"coalesce(bool_or({ok} and sitemap_links > 0), false)").alias("site_sitemap"),
        F.expr(f"coalesce(bool_or({ok} and breadcrumbs > 0), false)").alias("site_breadcrumbs"),
        F.expr("min(if(statement_ref is null, null, named_struct('rank', statement_ref.rank, 'crawl_order', crawl_order, 'href', statement_ref.href)))").alias("_ref"),
        F.expr(f"coalesce(min_by(site_name, if({ok} and site_name <> '', crawl_order, null)), min(site))").alias("site_title"),
    ).withColumn("statement_url", F.expr("_ref.href")).drop("_ref")


def statement_audits(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """The audit of each site's statement page, when the crawl holds that page."""
    wanted = sites.where("statement_url is not null").select("site", F.col("statement_url").alias("url"))
    hits = pages.where("load_error is null and statement_flags is not null").select("site", "url", "crawl_order", "statement_flags")
    found = hits.join(wanted, ["site", "url"]).groupBy("site").agg(F.expr("min_by(struct(url, statement_flags.*), crawl_order)").alias("statement"))
    return found


def title_duplicates(pages: DataFrame) -> DataFrame:
    """Per (site, title): how many pages carry it and the first two of them in crawl order.

    ``first_page`` tells the first page from others of its address.
    """
    base = pages.where("load_error is null and title <> ''").select("site", "title", "crawl_order", "url", "page_id")
    count = base.groupBy("site", "title").agg(F.count(F.lit(1)).alias("title_n")).where("title_n > 1")
    firsts = (
        first_k(base, ["site", "title"], [F.col("crawl_order"), F.col("url"), F.col("page_id")], 2)
        .groupBy("site", "title")
        .agg(
            F.expr("max(if(_rank = 1, page_id, null))").alias("first_page"),
            F.expr("max(if(_rank = 1, url, null))").alias("first_url"),
            F.expr("max(if(_rank = 2, url, null))").alias("second_url"),
        )
    )
    return count.join(firsts, ["site", "title"])


def nav_conflicts(pages: DataFrame, rows_per_slice: int = 500_000) -> DataFrame:
    """First page, in crawl order, whose navigation orders the shared items differently.

    Two sequences agree on their shared items exactly when their projections onto every pair of shared
    items agree. So distinct sequences are cut into item pairs, each (site, language, pair) keeps the first
    page of each projection, and a sequence looks up the first page whose projection differs from its own.
    Work grows with distinct sequences times items squared; no two sequences are ever paired with each other.
    A page without a language is compared with every page of the site (scope ``*``).
    """
    base = pages.where("load_error is null and size(nav_seq) > 0").select("site", F.expr(base_lang("lang")).alias("lang"), "nav_seq", "crawl_order", "url")
    seqs = base.groupBy("site", "lang", "nav_seq").agg(F.expr("min(struct(crawl_order, url))").alias("first"), F.count(F.lit(1)).alias("n"))
    # only sites that have language-less pages need the whole-site scope
    star = seqs.where("lang = ''").select("site").distinct()
    own = seqs.select("*", F.col("lang").alias("scope")).where("lang <> ''")
    wide = seqs.join(star, "site", "left_semi").select("*", F.lit(ALL).alias("scope"))
    build = own.unionByName(wide)
    items = "array_distinct(nav_seq)"
    pairs = (
        f"flatten(transform({items}, a -> transform(filter({items}, b -> b >= a), b -> named_struct('a', a, 'b', b,"
        " 'proj', if(a = b, concat('m', size(filter(nav_seq, x -> x = a))), array_join(transform(filter(nav_seq, x -> x = a or x = b), x -> if(x = a, 'a', 'b')), ''))))))"
    )
    cut = build.selectExpr("site", "scope", "lang", "nav_seq", "first", f"inline_outer({pairs})").where("a is not null")
    per_proj = cut.groupBy("site", "scope", "a", "b", "proj").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("seqs"))
    # the two earliest projections of a pair decide every lookup: a projection is beaten by the other one
    key = ["site", "scope", "a", "b"]
    first = per_proj.groupBy(*key).agg(
        F.expr("min(struct(first, proj))").alias("p1"), F.count(F.lit(1)).alias("projections"), F.sum("seqs").alias("seqs")
    ).where("projections > 1")
    second = per_proj.join(first.select(*key, F.col("p1.proj").alias("_p")), key).where("proj <> _p").groupBy(*key).agg(F.min("first").alias("p2"))
    decided = first.join(second, key)
    lookup = build.where(f"scope <> '{ALL}' or lang = ''").selectExpr("site", "scope", "lang", "nav_seq", f"inline_outer({pairs})").where("a is not null")
    # one row per pair on the right; a pair that a large site repeats in most of its sequences is split
    lookup = lookup.withColumn("seq_id", F.xxhash64("nav_seq"))
    hits = join_on_hot_key(lookup, decided, key, "seqs", "seq_id", "inner", rows_per_slice).withColumn("other", F.expr("if(proj = p1.proj, p2, p1.first)"))
    # a single shared item only counts when this page repeats it
    hits = hits.where("a <> b or cast(substring(proj, 2) as int) >= 2")
    best = hits.groupBy("site", "lang", "nav_seq").agg(F.min("other").alias("other"))
    # two pages may share an address: the place in the crawl tells which of them is meant
    other = base.select("site", "crawl_order", "url", F.col("nav_seq").alias("other_seq"))
    full = best.select("site", "lang", "nav_seq", "other.crawl_order", "other.url").join(other, ["site", "crawl_order", "url"])
    return (
        full.withColumn("shared", F.expr("filter(nav_seq, x -> array_contains(other_seq, x))"))
        .withColumn("other_shared", F.expr("filter(other_seq, x -> array_contains(nav_seq, x))"))
        .where("size(shared) >= 2 and array_join(shared, '|') <> array_join(other_shared, '|')")
        .join(seqs.select("site", "lang", "nav_seq", F.col("n").alias("seq_rows")), ["site", "lang", "nav_seq"])
        .select("site", "lang", "nav_seq", "seq_rows", F.expr("named_struct('other_url', url, 'shared', shared, 'other_shared', other_shared)").alias("nav_conflict"))
    )


def component_rivals(pages: DataFrame) -> DataFrame:
    """Per (site, scope, component key): the ten earliest pages after keeping five per name.

    Any page needs at most the five earliest pages whose name differs from its own. Keeping the five
    earliest pages per name and then the ten earliest overall always leaves those five.
    """
    base = pages.where("load_error is null").selectExpr("site", f"{base_lang('lang')} as lang", "crawl_order", "url", "explode(components) as (key, name)")
    star = base.where("lang = ''").select("site").distinct()
    both = base.where("lang <> ''").withColumn("scope", F.col("lang")).unionByName(base.join(star, "site", "left_semi").withColumn("scope", F.lit(ALL)))
    order = [F.col("crawl_order"), F.col("url")]
    five = first_k(both, ["site", "scope", "key", "name"], order, 5)
    ten = first_k(five, ["site", "scope", "key"], order, 10)
    rivals = ten.groupBy("site", "scope", "key").agg(F.expr("array_sort(collect_list(struct(crawl_order, url, name)))").alias("rivals"))
    rows = base.withColumn("scope", F.expr(f"if(lang = '', '{ALL}', lang)")).groupBy("site", "scope", "key").agg(F.count(F.lit(1)).alias("key_rows"))
    names = both.groupBy("site", "scope", "key").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select("site", "scope", "key")
    return rivals.join(names, ["site", "scope", "key"]).join(rows, ["site", "scope", "key"])


def component_conflicts(pages: DataFrame, rows_per_slice: int) -> DataFrame:
    """Per page: other names of the same component, other pages in crawl order, at most five."""
    mine = pages.where("load_error is null").selectExpr(
        "page_id", "site", "url", f"if({base_lang('lang')} = '', '{ALL}', {base_lang('lang')}) as scope", "posexplode(map_entries(components)) as (pos, c)"
    ).selectExpr("page_id", "site", "url", "scope", "pos", "c.key as key", "c.value as name")
    joined = join_on_hot_key(mine, component_rivals(pages), ["site", "scope", "key"], "key_rows", "page_id", "inner", rows_per_slice)
    hit = joined.withColumn("found", F.expr("slice(filter(rivals, r -> r.name <> name and r.url <> url), 1, 5)")).where("size(found) > 0")
    return hit.groupBy("page_id").agg(
        F.expr(
            "slice(flatten(transform(array_sort(collect_list(struct(pos, key, name, found))), x -> transform(x.found, f -> named_struct('key', x.key, 'name', x.name, 'other_name', f.name, 'other_url', f.url)))), 1, 5)"
        ).alias("component_conflicts")
    )


def with_site_context(pages: DataFrame, rows_per_slice: int = 500_000) -> DataFrame:
    """Compact page facts -> the same pages with every site column the rules read."""
    sites = site_facts(pages)
    audits = statement_audits(pages, sites)
    out = join_on_hot_key(pages, sites.join(audits, "site", "left"), ["site"], "site_rows", "page_id", "left", rows_per_slice)
    titles = title_duplicates(pages)
    out = join_on_hot_key(out, titles, ["site", "title"], None, "page_id", "left", rows_per_slice, pages)
    out = out.withColumn("title_others", F.expr("if(title_n is null, 0, title_n - 1)")).withColumn(
        "title_first_other", F.expr("if(first_page = page_id, second_url, first_url)")
    ).drop("title_n", "first_page", "first_url", "second_url")
    navs = nav_conflicts(pages, rows_per_slice).withColumnRenamed("lang", "_lang")
    out = out.withColumn("_lang", F.expr(base_lang("lang")))
    out = join_on_hot_key(out, navs.drop("seq_rows"), ["site", "_lang", "nav_seq"], None, "page_id", "left", rows_per_slice, pages.withColumn("_lang", F.expr(base_lang("lang")))).drop("_lang")
    return out.join(component_conflicts(pages, rows_per_slice), "page_id", "left")
