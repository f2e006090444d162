"""Static self-check of pages (P0-P13): one tri-state row per page and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import patterns as P
from lucerna.functions.patterns import lit

# Fixed values
GENERIC = "לחץ כאן|לחצו כאן|כאן|קרא עוד|קראו עוד|למידע נוסף|לפרטים|עוד|המשך|click here|read more|more|here|link".split("|")
PRESENTATIONAL = "font center marquee blink big strike tt".split()
BLOCKS_ZOOM = r"(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1"
MANUAL = ["contrast is measured in a browser", "keyboard and focus are checked in a browser", "reading order against layout needs rendering"]


def _facts() -> dict[str, str]:
    text = "coalesce(e.text, '')"
    headings = "transform(filter(dom.elements, e -> e.tag in ('h1','h2','h3','h4','h5','h6')), e -> named_struct('level', cast(substring(e.tag, 2) as int), 'text', coalesce(e.text, '')))"
    return {
        "pf_rtl": f"regexp_count(regexp_replace(html, '<[^>]+>', ' '), {lit(P.HEBREW)}) > regexp_count(regexp_replace(html, '<[^>]+>', ' '), {lit(P.LATIN)})",
        "pf_lang": "coalesce(get(dom.elements, 0).attrs['lang'], '')",
        "pf_dir": "coalesce(get(dom.elements, 0).attrs['dir'], '')",
        "pf_title": "trim(coalesce(get(filter(dom.elements, e -> e.tag = 'title'), 0).text, ''))",
        "pf_headings": headings,
        "pf_images": "filter(dom.elements, e -> e.tag in ('img','area') or (e.tag = 'input' and e.attrs['type'] = 'image'))",
        "pf_inputs": "filter(dom.elements, e -> (e.tag = 'input' and coalesce(e.attrs['type'], '') <> 'image') or e.tag in ('select','textarea'))",
        "pf_for": "transform(filter(dom.elements, e -> e.tag = 'label' and e.attrs['for'] is not null), e -> e.attrs['for'])",
        "pf_links": f"transform(filter(dom.elements, e -> e.tag = 'a'), e -> named_struct('text', {text}, 'href', coalesce(e.attrs['href'], ''), 'label', coalesce(e.attrs['aria-label'], '')))",
        "pf_buttons": f"size(filter(dom.elements, e -> e.tag = 'button' and {text} = '' and coalesce(e.attrs['aria-label'], '') = '' and coalesce(e.attrs['aria-labelledby'], '') = ''))",
        "pf_frames": "size(filter(dom.elements, e -> e.tag = 'iframe' and coalesce(e.attrs['title'], '') = ''))",
        "pf_ids": "array_sort(transform(filter(dom.elements, e -> e.attrs['id'] is not null), e -> e.attrs['id']))",
        "pf_pres": f"array_sort(array_distinct(transform(filter(dom.elements, e -> e.tag in ({', '.join(repr(t) for t in PRESENTATIONAL)})), e -> e.tag)))",
        "pf_viewport": "coalesce(get(filter(dom.elements, e -> e.tag = 'meta' and lower(coalesce(e.attrs['name'], '')) = 'viewport'), 0).attrs['content'], '')",
        "pf_main": "exists(dom.elements, e -> e.tag = 'main' or coalesce(e.attrs['role'], '') = 'main')",
        "pf_tables": "size(filter(dom.elements, e -> e.tag = 'table'))",
        "pf_th": "size(filter(dom.elements, e -> e.tag = 'th'))",
        "pf_captions": "size(filter(dom.elements, e -> e.tag = 'caption'))",
    }


def _row(rule: str, status: str, cond: str, detail: str = "''") -> str:
    return f"if({cond}, named_struct('rule', '{rule}', 'status', '{status}', 'detail', cast({detail} as string)), null)"


def _rules() -> list[str]:
    unlabelled = (
        "filter(pf_inputs, i -> coalesce(i.attrs['type'], '') not in ('hidden','submit','button','reset') and coalesce(i.attrs['aria-label'], '') = ''"
        " and coalesce(i.attrs['aria-labelledby'], '') = '' and not coalesce(array_contains(pf_for, i.attrs['id']), false))"
    )
    generic = "filter(pf_links, l -> lower(l.text) in (" + ", ".join(f"'{g}'" for g in GENERIC) + "))"
    empty = "filter(pf_links, l -> l.text = '' and l.label = '')"
    no_alt = "filter(pf_images, i -> i.attrs['alt'] is null and coalesce(i.attrs['aria-label'], '') = '')"
    file_alt = f"filter(pf_images, i -> coalesce(i.attrs['alt'], '') rlike {lit(P.FILENAME_ALT)})"
    h1 = "size(filter(pf_headings, h -> h.level = 1))"
    jumps = "size(filter(transform(pf_headings, (h, i) -> h.level > get(pf_headings, i - 1).level + 1), j -> coalesce(j, false)))"
    dup = "array_distinct(filter(pf_ids, (x, i) -> x = get(pf_ids, i - 1)))"
    skip = "exists(pf_links, l -> startswith(l.href, '#') and l.text rlike '(?i)דלג|skip')"
    english = f"filter(regexp_extract_all(html, r'aria-label=\"([^\"]+)\"', 1), m -> m rlike {lit(P.LATIN)} and not m rlike {lit(P.HEBREW)} and size(filter(split(trim(m), r'\\s+'), w -> w <> '')) > 1)"
    return [
        _row("lang", "FAIL", "pf_lang = ''"), _row("lang", "OK", "pf_lang <> ''", "pf_lang"),
        _row("dir", "FAIL", "pf_rtl and pf_dir <> 'rtl'"), _row("dir", "OK", "pf_rtl and pf_dir = 'rtl'"),
        _row("title", "FAIL", "pf_title = ''"), _row("title", "OK", "pf_title <> ''", "left(pf_title, 60)"), _row("title-meaning", "CHECK", "pf_title <> ''"),
        _row("headings", "FAIL", "size(pf_headings) = 0"), _row("h1", "FAIL", f"size(pf_headings) > 0 and {h1} = 0"),
        _row("h1", "FAIL", f"{h1} > 1", h1), _row("h1", "OK", f"{h1} = 1"), _row("heading-jump", "FAIL", f"{jumps} > 0", jumps),
        _row("heading-empty", "FAIL", "exists(pf_headings, h -> h.text = '')", "size(filter(pf_headings, h -> h.text = ''))"),
        _row("alt-missing", "FAIL", f"size({no_alt}) > 0", f"size({no_alt})"), _row("alt-filename", "FAIL", f"size({file_alt}) > 0", f"size({file_alt})"),
        _row("images", "OK", f"size({no_alt}) = 0 and size({file_alt}) = 0", "size(pf_images)"), _row("alt-meaning", "CHECK", "size(pf_images) > 0"),
        _row("input-unlabelled", "FAIL", f"size({unlabelled}) > 0", f"size({unlabelled})"),
        _row("input-placeholder", "FAIL", f"exists({unlabelled}, i -> coalesce(i.attrs['placeholder'], '') <> '')", f"size(filter({unlabelled}, i -> coalesce(i.attrs['placeholder'], '') <> ''))"),
        _row("inputs", "OK", f"size(pf_inputs) > 0 and size({unlabelled}) = 0", "size(pf_inputs)"),
        _row("link-empty", "FAIL", f"size({empty}) > 0", f"size({empty})"), _row("link-generic", "CHECK", f"size({generic}) > 0", f"size({generic})"),
        _row("links", "OK", f"size(pf_links) > 0 and size({empty}) = 0 and size({generic}) = 0", "size(pf_links)"),
        _row("button-unnamed", "FAIL", "pf_buttons > 0", "pf_buttons"), _row("frame-untitled", "FAIL", "pf_frames > 0", "pf_frames"),
        _row("duplicate-id", "FAIL", f"size({dup}) > 0", f"array_join({dup}, ', ')"), _row("duplicate-id", "OK", f"size({dup}) = 0"),
        _row("presentational", "FAIL", "size(pf_pres) > 0", "array_join(pf_pres, ', ')"),
        _row("zoom", "FAIL", f"pf_viewport rlike {lit(BLOCKS_ZOOM)}"), _row("zoom", "OK", f"pf_viewport <> '' and not pf_viewport rlike {lit(BLOCKS_ZOOM)}"),
        _row("bypass", "OK", f"{skip} or pf_main", f"if({skip}, 'skip link', 'main')"), _row("bypass", "FAIL", f"not {skip} and not pf_main"),
        _row("table-header", "FAIL", "pf_tables > 0 and pf_th = 0", "pf_tables"), _row("table-caption", "CHECK", "pf_tables > 0 and pf_captions = 0", "pf_tables"),
        _row("statement", "OK", "html like '%הצהרת נגישות%'"), _row("statement", "FAIL", "not html like '%הצהרת נגישות%'"),
        _row("english-label", "FAIL", f"pf_rtl and size({english}) > 0", f"size({english})"),
        *[_row("manual", "CHECK", "true", f"'{m}'") for m in MANUAL],
        _row("rendering", "SKIPPED", "true"),
    ]


def preflight(pages_with_dom: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, rule, status, detail). Narrow."""
    df = pages_with_dom.where("dom is not null").withColumns({k: F.expr(v) for k, v in _facts().items()})
    return df.selectExpr(key, f"inline_outer(array_compact(array({', '.join(_rules())})))").where("rule is not null")


def corpus_totals(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Totals per rule and for the corpus, with the exit status a build would use."""
    return rows.rollup("rule").agg(
        F.expr("count_if(status = 'FAIL')").alias("failures"), F.expr("count_if(status = 'CHECK')").alias("checks"),
        F.expr("cast(bool_or(status = 'FAIL') as int)").alias("exit_status"),
    )
