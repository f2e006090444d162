"""Work lists for judgement (J1-J12). The call itself is made elsewhere; everything around it is data work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# Call prices per million tokens, output allowance, prompt overhead, evidence budget.
PRICE_IN, PRICE_OUT = 5.0, 25.0
MAX_OUT_TOKENS = 8_000
MAX_IN_TOKENS = 24_000
PROMPT_OVERHEAD = 900
VISUAL_SLICES = ["colorUsage", "contrast", "textImages", "focusVisible", "sensoryText", "readingOrder"]
DOCUMENT_SLICES = ["documentStructure", "documentText", "documentComplexInfo"]

# slice -> (array members, scalar members); arrays are whole, the token budget alone shortens them
SLICES: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "images": ({"images": "images"}, {}),
    "media": ({"media": "media", "pageHeadings": "transform(headings, h -> struct(h.text))"}, {}),
    "structure": (
        {
            "headings": "headings", "unmarkedHeadings": "fake_headings", "lists": "lists", "typedLists": "fake_lists", "tables": "tables",
            "landmarks": "landmarks", "presentational": "presentational",
        },
        {"hasH1": "has_h1", "sectionCount": "section_count", "textLength": "text_length"},
    ),
    "readingOrder": ({"reordered": "css_reordered", "mismatches": "visual_mismatches"}, {"direction": "if(coalesce(dir, '') = 'rtl', 'rtl', 'ltr')"}),
    "sensoryText": ({"references": "sensory"}, {}),
    "colorUsage": ({"inTextLinks": "link_styles", "colourCoded": "colour_coded", "requiredMarkers": "required_markers"}, {}),
    "contrast": ({"clippedAt200": "zoom.clipped", "lostAt200": "zoom.lost"}, {"blocksZoom": "blocks_zoom", "viewport": "viewport"}),
    "textImages": ({"candidates": "coalesce(text_images, text_images_static)"}, {}),
    "keyboard": (
        {"positiveTabindex": "positive_tabindex", "hiddenFocusable": "hidden_focusable", "pseudoControls": "pseudo_controls", "tabOrder": "keyboard.stops", "orderMismatches": "keyboard.order_mismatches", "unreachable": "keyboard.unreachable"},
        {"focusable": "focusable_count", "trap": "keyboard.trap.selector", "frame": "keyboard.frame_boundary.selector"},
    ),
    "timing": ({"metaRefresh": "meta_refresh", "timers": "timers"}, {}),
    "motion": ({"animations": "animated", "carousels": "carousels", "autoplay": "autoplay", "gifs": "gifs", "movingTags": "moving_tags"}, {}),
    "links": ({"links": "links"}, {}),
    "navigation": (
        {"skipLinks": "skip_links", "navs": "navs", "landmarks": "landmarks"},
        {"title": "title", "siteName": "site_name", "search": "search_mechanisms", "sitemap": "sitemap_links", "breadcrumbs": "breadcrumbs"},
    ),
    "headingsLabels": ({"headings": "headings", "labels": "controls"}, {}),
    "focusVisible": ({"withoutIndicator": "keyboard.no_indicator", "sample": "keyboard.stops"}, {}),
    "language": (
        {"foreign": "foreign_runs", "islands": "islands", "englishNames": "english_names"},
        {"lang": "lang", "dir": "dir", "rtl": "rtl_content", "langElements": "lang_elements"},
    ),
    "forms": ({"forms": "forms", "controls": "controls", "captcha": "captcha"}, {}),
    "formErrors": ({"errorBoxes": "error_boxes", "controls": "controls"}, {}),
    "markupValidity": ({"duplicateIds": "dup_ids", "brokenRefs": "broken_refs", "orphanLabels": "orphan_labels"}, {"doctype": "doctype", "elements": "total_elements"}),
    "ariaWidgets": ({"widgets": "widgets", "iconButtons": "icon_buttons", "iframes": "iframes", "pseudoControls": "pseudo_controls"}, {}),
    "siteConsistency": (
        {"widgets": "widget_candidates", "statementLinks": "statement_links", "skipLinks": "skip_links", "emails": "transform(emails, e -> struct(e as email))", "phones": "transform(phones, e -> struct(e as phone))", "overlayVendors": "transform(overlay_vendors, e -> struct(e as vendor))"},
        {"search": "search_mechanisms", "sitemap": "sitemap_links", "coordinator": "mentions_coordinator"},
    ),
}


def slice_needs(names: list[str]) -> set[str]:
    from lucerna.operators.evidence import words_of

    sqls = [sql for n in names for sql in SLICES[n][0].values()] + [sql for n in names for sql in SLICES[n][1].values()]
    return words_of(*sqls)


#: where an element stands in its page: left out of evidence texts, so that equal evidence on unlike pages is equal text
POSITION = r'"(?:pos|s0|s1)":-?\d+,?'


def canonical(item: str) -> str:
    """An item's JSON without positions. Quotes inside strings are escaped, so only keys can match."""
    return rf"regexp_replace(regexp_replace(to_json({item}), r'{POSITION}', ''), r',}}', '}}')"


def slice_parts(name: str) -> tuple[str, str]:
    """Arrays of JSON items and the JSON of the scalars, free of positions."""
    arrays, scalars = SLICES[name]
    parts = ", ".join(f"named_struct('name', '{k}', 'items', coalesce(transform({sql}, x -> {canonical('x')}), cast(array() as array<string>)))" for k, sql in arrays.items())
    arr = f"array({parts})" if parts else "cast(array() as array<struct<name:string,items:array<string>>>)"
    sc = "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in scalars.items()) + "))" if scalars else "'{}'"
    return arr, sc


def fragments(evidence: DataFrame, names: list[str], keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """J1, J5 in long form: keys, slice, part, no, address (digest of the fragment's text), json. Narrow.

    A fragment is one item of one part. What many pages repeat, a footer's links say, has one address wherever it stands.
    """
    parts = [f"transform({slice_parts(n)[0]}, p -> named_struct('slice', '{n}', 'part', p.name, 'items', p.items))" for n in names]
    rows = evidence.where("is_dom").selectExpr(*keys, f"inline(concat({', '.join(parts)}))").selectExpr(*keys, "slice", "part", "posexplode(items) as (no, json)")
    return rows.withColumn("address", F.expr("left(sha2(json, 256), 32)"))


def unique_fragments(rows: DataFrame) -> DataFrame:
    """Each fragment once, with its uses: what is stored, and judged, instead of every page's copy."""
    return rows.groupBy("address").agg(F.min("json").alias("json"), F.count(F.lit(1)).alias("uses"))


def render(arrays: str, scalars: str) -> str:
    """One JSON text from the parts."""
    body = f"array_join(transform({arrays}, a -> concat('\"', a.name, '\":[', array_join(a.items, ','), ']')), ',')"
    return f"concat('{{', {body}, if({body} = '', '', ','), '\"facts\":', {scalars}, '}}')"


def estimate_tokens(json: str) -> str:
    """J3."""
    return f"cast(ceil(char_length({json}) / 2.5D) as bigint)"


def truncate(arrays: str, scalars: str, max_tokens: int = MAX_IN_TOKENS) -> str:
    """Shorten the largest arrays first, to 40, 25, 15 and 8 items, until the text fits; then cut the text."""
    order = f"transform(array_sort(transform({arrays}, (a, i) -> named_struct('less', -size(a.items), 'i', i, 'name', a.name))), o -> o.name)"
    steps = f"flatten(transform({order}, o -> transform(array(40, 25, 15, 8), n -> named_struct('name', o, 'n', n))))"
    full = f"transform({arrays}, a -> named_struct('name', a.name, 'items', a.items, 'all', a.items))"
    fits = estimate_tokens(render("s.parts", scalars)) + f" <= {max_tokens}"
    cut = (
        "transform(s.parts, a -> if(a.name = t.name and size(a.all) > t.n, named_struct('name', a.name, 'items', concat(slice(a.all, 1, t.n), array(concat('\"', size(a.all) - t.n, ' more left out\"'))), 'all', a.all), a))"
    )
    state = f"aggregate({steps}, named_struct('parts', {full}), (s, t) -> if({fits}, s, named_struct('parts', {cut})), s -> s.parts)"
    text = render(state, scalars)
    limit = int(max_tokens * 2.5)
    return f"get(transform(array({text}), j -> if({estimate_tokens('j')} <= {max_tokens} or char_length(j) <= {limit}, j, concat(left(j, {limit}), '…'))), 0)"


def with_slices(evidence: DataFrame, names: list[str], max_tokens: int = MAX_IN_TOKENS, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(page, slice, json, tokens, visual), narrow."""
    items = []
    for n in names:
        arr, sc = slice_parts(n)
        items.append(f"named_struct('slice', '{n}', 'json', {truncate(arr, sc, max_tokens)})")
    out = evidence.where("is_dom").selectExpr(*keys, f"inline(array({', '.join(items)}))")
    return out.withColumn("tokens", F.expr(estimate_tokens("json"))).withColumn("visual", F.expr(visual("slice")))


def visual(slice_col: str) -> str:
    """J12."""
    return f"{slice_col} in ({', '.join(repr(s) for s in VISUAL_SLICES)})"


def site_slice(pages: DataFrame, per_titles: int | None = None, per_names: int | None = None) -> DataFrame:
    """What each (site, language) is compared on, in long form: site, base_lang, kind, place, url, value.

    Kinds are ``title``, ``nav`` and ``names``; ``place`` is the page's place in crawl order within its set, so that a limit,
    where one is wanted, is a filter (``per_titles``, ``per_names``). Nothing of a set is ever gathered into one row.
    """
    from lucerna.operators.site import base_lang
    from lucerna.operators.skew import first_k

    base = pages.where("load_error is null").withColumn("base_lang", F.expr(base_lang("lang")))
    slim = base.select("site", "base_lang", "crawl_order", "url", "title", F.to_json("nav_seq").alias("nav"), F.to_json("components").alias("names"))
    order = [F.col("crawl_order"), F.col("url")]
    if per_titles is not None and per_names is not None:
        placed = first_k(slim, ["site", "base_lang"], order, max(per_titles, per_names), "place")
        limit = f"place <= if(kind = 'title', {per_titles}, {per_names})"
    else:
        placed, limit = slim.withColumn("place", F.lit(None).cast("int")), "true"
    long = placed.select("site", "base_lang", "crawl_order", "place", "url", F.expr("stack(3, 'title', title, 'nav', nav, 'names', names) as (kind, value)"))
    return long.where(limit).select("site", "base_lang", "kind", "crawl_order", "place", "url", "value")


def site_facts_slice(sites: DataFrame, audits: DataFrame) -> DataFrame:
    """One row a site with its flags and what its statement page holds, for the rows that compare pages."""
    return sites.join(audits, "site", "left").select(
        "site", F.expr("to_json(named_struct('pageCount', page_count, 'search', site_search, 'sitemap', site_sitemap, 'breadcrumbs', site_breadcrumbs, 'statement', statement))").alias("facts")
    )


def work_key(item: str, rubric: str, json: str, priors: str, url: str, slice_col: str) -> str:
    """What makes two judgements the same work; cross-page rows also carry their page."""
    body = f"to_json(named_struct('item', {item}, 'rubric', {rubric}, 'slice', {json}, 'prior', {priors}, 'url', if({slice_col} = 'siteConsistency', {url}, '')))"
    return f"left(sha2({body}, 256), 32)"


def unique_work(tasks: DataFrame) -> DataFrame:
    """One row per key, with the first task that needs it; the text is identical inside a key."""
    return tasks.groupBy("work_key").agg(F.min("task_no").alias("task_no"), F.count(F.lit(1)).alias("uses"), F.expr("max(tokens)").alias("tokens"))


def fan_out(tasks: DataFrame, judged: DataFrame, rows_per_slice: int = 500_000) -> DataFrame:
    """Every task gets the judgement of its key (``judged`` carries ``uses``); popular keys are split."""
    from lucerna.operators.skew import join_on_hot_key

    return join_on_hot_key(tasks, judged, ["work_key"], "uses", "task_no", "left", rows_per_slice)


def split_cached(work: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Hits of this model, and what is left to do."""
    own = cache.where(F.col("model") == model)
    return work.join(own, "work_key"), work.join(own.select("work_key"), "work_key", "left_anti")


def call_cost(tokens: str) -> str:
    """Millionths of the currency, a whole number: prices are per million tokens, so one token costs its price."""
    return f"cast(({tokens} + {PROMPT_OVERHEAD}) * {PRICE_IN:.0f} + {MAX_OUT_TOKENS} * {PRICE_OUT:.0f} as bigint)"


def _running(calls: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``_running``, the cost of a run's calls up to each one. Two levels: one row per block of work numbers goes through
    the ordered pass, and each block is then finished on its own."""
    w = calls.withColumn("_block", F.expr(f"cast(floor(task_no / {bucket_rows}D) as bigint)"))
    per = w.groupBy("_run", "_block").agg(F.sum("_cost").alias("_sum"))
    before = per.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("_run").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum("_cost").over(W.partitionBy("_run", "_block").orderBy("task_no").rowsBetween(W.unboundedPreceding, 0))
    return w.join(before, ["_run", "_block"]).withColumn("_running", F.col("_before") + inside).drop("_block", "_before")


def budget_gate(work: DataFrame, budget: float, run: str = "run_id", bucket_rows: int = 100_000) -> DataFrame:
    """Estimated cost of every call, and whether it still fits when its turn comes.

    Calls are taken in work order, and only a call that is made is spent: one that is cached (column ``cached``, if there is
    one) or refused leaves the budget as it is, so a smaller call may still fit after a large one did not. Each round accepts
    a run's calls up to the first that does not fit, then goes on behind it with those that what is left can pay at all; it ends
    when no run has any. A round keeps one row per run. Work numbers are unique within a run.
    """
    from lucerna.plans.materialize import materialize

    limit = int(round(budget * 1_000_000))
    w = work if "cached" in work.columns else work.withColumn("cached", F.lit(False))
    w = w.withColumn("_cost", F.expr(call_cost("tokens"))).withColumn("estimate", F.col("_cost") / F.lit(1e6)).withColumn("_run", F.xxhash64(F.col(run)))
    calls = materialize(w.where("not cached").select("_run", "task_no", "_cost"), "calls")
    state = materialize(calls.select("_run").distinct().withColumns({"_after": F.lit(None).cast("bigint"), "_spent": F.lit(0).cast("bigint")}), "budget")
    rounds = []
    while True:
        open_calls = calls.join(state, "_run").where(f"(_after is null or task_no > _after) and _cost <= {limit} - _spent")
        run_on = _running(open_calls.select("_run", "task_no", "_cost", "_spent"), bucket_rows)
        taken = run_on.groupBy("_run").agg(
            F.min(F.when(F.col("_running") > limit - F.col("_spent"), F.col("task_no"))).alias("_stop"),
            F.sum(F.when(F.col("_running") <= limit - F.col("_spent"), F.col("_cost"))).alias("_paid"),
        )
        step = materialize(state.join(taken, "_run").select("_run", "_after", "_spent", "_stop", F.coalesce("_paid", F.lit(0)).alias("_paid")), "budget-round")
        if step.isEmpty():
            break
        rounds.append(step)
        # a run without a stop has no call left
        state = step.where("_stop is not null").selectExpr("_run", "_stop as _after", "_spent + _paid as _spent")
    made = None
    for step in rounds:
        part = calls.join(step, "_run").where(f"(_after is null or task_no > _after) and (_stop is null or task_no < _stop) and _cost <= {limit} - _spent").select("_run", "task_no")
        made = part if made is None else made.unionByName(part)
    if made is None:
        return w.withColumn("fits", F.lit(False)).drop("_cost", "_run")
    return w.join(made.withColumn("_made", F.lit(True)), ["_run", "task_no"], "left").withColumn("fits", F.coalesce("_made", F.lit(False))).drop("_cost", "_run", "_made")


def sanitise(judgements: DataFrame) -> DataFrame:
    """Drop findings whose place is not in the evidence text, clamp, and weaken an empty FAIL.

    Needs ``slice, json, j_verdict, j_confidence, j_findings, j_note``.
    """
    usable = "filter(coalesce(j_findings, array()), f -> trim(coalesce(f.locator, '')) <> '' and trim(coalesce(f.reason, '')) <> '')"
    kept = f"filter({usable}, f -> slice = 'siteConsistency' or instr(json, f.locator) > 0)"
    df = judgements.withColumn("_kept", F.expr(kept)).withColumn("_dropped", F.expr(f"size({usable}) - size(_kept)"))
    return (
        df.withColumn("j_verdict", F.expr("if(j_verdict in ('PASS', 'NA'), j_verdict, 'FAIL')"))
        .withColumn("j_confidence", F.expr("least(1D, greatest(0D, coalesce(j_confidence, 0.5D)))"))
        .withColumn("j_findings", F.col("_kept"))
        .withColumn("j_confidence", F.expr("if(j_verdict = 'FAIL' and size(j_findings) = 0, least(j_confidence, 0.4D), j_confidence)"))
        .withColumn("j_note", F.expr("nullif(concat_ws(' ', j_note, if(_dropped > 0, concat(_dropped, ' findings not found in the evidence were dropped'), null)), '')"))
        .drop("_kept", "_dropped")
    )


def not_judged(work: DataFrame) -> DataFrame:
    """Calls over budget or failed end as unverified rows; ``judged`` keeps the merge from ever passing them."""
    work = work if "cached" in work.columns else work.withColumn("cached", F.lit(False))
    return work.where("not cached and (not fits or failed)").withColumn("judged", F.lit(False)).withColumn("j_verdict", F.lit("FAIL")).withColumn("j_confidence", F.lit(0.0)).withColumn(
        "j_note", F.expr("if(not fits, 'budget used up before this row', 'judgement failed; check by hand')")
    )


def usage(work: DataFrame, run: str = "run_id") -> DataFrame:
    """J11. Needs ``cached, fits, estimate``."""
    return work.groupBy(run).agg(
        F.expr("count_if(not cached and fits)").alias("calls"), F.expr("coalesce(sum(if(not cached and fits, estimate, 0D)), 0D)").alias("cost"),
        F.expr("count_if(cached)").alias("cache_hits"), F.expr("count_if(not cached and not fits)").alias("skipped"),
    )


def merge_cache(cache: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """Entries of other models drop out; a fresh judgement replaces an old one."""
    both = cache.where(F.col("model") == model).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    cols = [c for c in both.columns if c not in ("work_key", "_new")]
    return both.groupBy("work_key").agg(F.expr(f"max_by(struct({', '.join(cols)}), _new)").alias("r")).select("work_key", "r.*")
