"""Document facts, rules and verdicts (D-1 to D-23, A2/A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import color as C
from lucerna.functions import patterns as P
from lucerna.functions.patterns import lit
from lucerna.operators import applicability as A
from lucerna.operators.catalogue import CANCELLED, rows_for
from lucerna.operators.page_rules import NO_OPINION, NONE, together, each, finding, when

# Large text and the contrast it needs.
LARGE_BOLD_PT, LARGE_REGULAR_PT = 14.0, 18.0
CONTRAST_LARGE, CONTRAST_NORMAL = 3.0, 4.5

PLACE = "page:int,slide:int,sheet:string,cell:string,line:int"
FACTS = {
    "kind": "string", "url": "string", "file_name": "string", "title": "string", "tagged": "boolean", "display_doc_title": "boolean",
    "images": f"array<struct<{PLACE},name:string,alt:string,decorative:boolean>>",
    "headings": f"array<struct<{PLACE},level:int,text:string,fake:boolean,missing:boolean,duplicate:boolean,generic:boolean,size_pt:double,bold:boolean>>",
    "lists": f"array<struct<{PLACE},text:string,manual:boolean,items:int>>",
    "tables": f"array<struct<{PLACE},merged_cells:int>>",
    "links": "array<struct<uri:string,text:string>>",
    "text_runs": f"array<struct<{PLACE},text:string>>",
    "contrast_failures": f"array<struct<{PLACE},text:string,ratio:double,required:double,size_pt:double,bold:boolean>>",
    "reading_order_issues": f"array<struct<{PLACE},issue:string>>",
    "sensory_phrases": f"array<struct<{PLACE},match:string>>",
    "complex_info": f"array<struct<{PLACE},match:string,context:string>>",
    "scanned_pages": "array<struct<page:int,coverage:double>>",
    "text_images": f"array<struct<{PLACE},width:int,height:int>>",
    "coloured_runs": f"array<struct<{PLACE},text:string,color:string>>",
    "text_length": "int", "notes": "array<string>", "error": "string", "download_error": "string",
}


def with_facts(df: DataFrame) -> DataFrame:
    """S3: every fact column with its type. Arrays a producer leaves out are empty, scalars stay NULL."""
    have = set(df.columns)
    out = []
    for name, t in FACTS.items():
        if name not in have:
            out.append(F.expr(f"cast({'array()' if t.startswith('array') else 'null'} as {t})").alias(name))
    return df.select("*", *out)


def place(**known: str) -> str:
    parts = {"page": "int", "slide": "int", "sheet": "string", "cell": "string", "line": "int"}
    return ", ".join(f"'{k}', cast({known.get(k, 'null')} as {t})" for k, t in parts.items())


def text_facts(docs: DataFrame, text: str = "text", max_lines: int | None = None) -> DataFrame:
    """D-1: facts of plain-text documents, over the whole text unless a line limit is asked for."""
    lines = rf"split({text}, r'\r?\n')"
    numbered = f"transform({lines}, (l, i) -> named_struct('n', i + 1, 'raw', l, 's', trim(regexp_replace(l, r'^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', ''))))"
    if max_lines:
        numbered = f"slice({numbered}, 1, {max_lines})"
    d = docs.withColumn("_lines", F.expr(f"filter({numbered}, x -> x.s <> '')"))
    heading = lit(P.DOC_NUMBERED_HEADING)
    return with_facts(
        d.withColumns(
            {
                "kind": F.lit("txt"),
                "language": F.expr(f"if({text} rlike {lit(P.HEBREW)}, 'he', null)"),
                "tagged": F.lit(False),
                "text_length": F.expr(rf"char_length(regexp_replace({text}, r'^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', ''))"),
                "text_runs": F.expr(f"transform(_lines, x -> named_struct({place(line='x.n')}, 'text', x.s))"),
                # quirk kept: the level counts every dot of the line
                "headings": F.expr(
                    f"transform(filter(_lines, x -> x.s rlike {heading}), x -> named_struct({place(line='x.n')}, 'level', char_length(x.s) - char_length(replace(x.s, '.', '')) + 1,"
                    " 'text', x.s, 'fake', false, 'missing', false, 'duplicate', false, 'generic', false, 'size_pt', cast(null as double), 'bold', cast(null as boolean)))"
                ),
                "lists": F.expr(
                    f"transform(filter(_lines, x -> not x.s rlike {heading} and x.raw rlike {lit(P.DOC_TYPED_BULLET)}), x -> named_struct({place(line='x.n')}, 'text', cast(null as string), 'manual', true, 'items', 1))"
                ),
                "sensory_phrases": F.expr(
                    # the phrases are all in Hebrew letters: a text without any is not searched line by line
                    f"if(not {text} rlike {lit(P.HEBREW)}, cast(array() as {FACTS['sensory_phrases']}), flatten(transform(_lines, x -> transform(regexp_extract_all(x.s, {lit('(' + P.DOC_SENSORY + ')')}, 1), m -> named_struct({place(line='x.n')}, 'match', m)))))"
                ),
                "links": F.expr(
                    f"if(instr({text}, '@') = 0, cast(array() as {FACTS['links']}), transform(regexp_extract_all({text}, {lit('(' + P.EMAIL + ')')}, 1), m -> named_struct('uri', concat('mailto:', m), 'text', m)))"
                ),
            }
        ).drop("_lines")
    )


def with_counts(df: DataFrame) -> DataFrame:
    """D-2: the thirteen counts."""
    sized = {
        "images": "images", "headings": "headings", "lists": "lists", "tables": "tables", "links": "links", "paragraphs": "text_runs", "sensoryPhrases": "sensory_phrases",
        "complexInfo": "complex_info", "scannedPages": "scanned_pages", "textImages": "text_images", "colouredRuns": "coloured_runs", "contrastFailures": "contrast_failures",
    }
    parts = ", ".join(f"'{k}', size({v})" for k, v in sized.items())
    return df.withColumn("counts", F.expr(f"named_struct({parts}, 'textLength', text_length)"))


def is_large(size: str, bold: str) -> str:
    """D-3."""
    return f"({size} >= if({bold}, {LARGE_BOLD_PT}D, {LARGE_REGULAR_PT}D))"


def required_ratio(size: str, bold: str) -> str:
    return f"if({is_large(size, bold)}, {CONTRAST_LARGE}D, {CONTRAST_NORMAL}D)"


def contrast_failures(runs: DataFrame) -> DataFrame:
    """D-4: ``color, background`` (css), ``size_pt, bold`` -> runs below the ratio their size needs."""
    return runs.withColumn("ratio", F.expr(C.contrast("color", "background"))).withColumn("required", F.expr(required_ratio("size_pt", "bold"))).where("ratio < required")


def infer_headings(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """D-5: runs that look like headings: body size is the modal size, smaller size first on a tie.

    The mode is two aggregates (count per size, best per document); no document is gathered into one place.
    """
    per = runs.where("size_pt is not null").groupBy(key, "size_pt").agg(F.count(F.lit(1)).alias("n"))
    modal = per.groupBy(key).agg(F.expr("max_by(size_pt, struct(n, -size_pt))").alias("modal_size"))
    return runs.join(modal, key).where(
        "char_length(trim(text)) > 2 and char_length(trim(text)) < 120 and (size_pt >= modal_size * 1.15 or (bold and size_pt >= modal_size))"
    )


def scanned_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """D-6: pages mostly covered by an image with hardly any text; a document without text is a scan as a whole.

    ``pages`` has key, page, text_chars, page_area, image_areas (array).
    """
    p = pages.withColumn("coverage", F.expr("floor(coalesce(array_max(image_areas), 0) / greatest(page_area, 1D) * 100D + 0.5D) / 100D"))
    p = p.withColumn("scan", F.expr("size(image_areas) > 0 and text_chars < 40 and coalesce(array_max(image_areas), 0) / greatest(page_area, 1D) > 0.5"))
    whole = p.groupBy(key).agg(F.sum("text_chars").alias("total"), F.expr("bool_or(scan)").alias("any_scan"))
    j = p.join(whole, key)
    return j.where("scan or (total < 40 and not any_scan)").select(key, "page", F.expr("if(scan, coverage, 1D)").alias("coverage"))


def phrases(docs: DataFrame, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """D-7: every match with 60 characters of context on both sides, in text order, over the whole text."""
    p = lit("(" + pattern + ")")
    # cut the text at its matches: the pieces between them give every match its place
    found = docs.withColumn("_m", F.expr(f"regexp_extract_all({text}, {p}, 1)")).where("size(_m) > 0").withColumn("_gaps", F.expr(f"split({text}, {lit(pattern)})"))
    placed = found.selectExpr(
        key, text,
        "posexplode(zip_with(_m, aggregate(sequence(0, size(_m) - 1), cast(array() as array<int>), (acc, i) -> concat(acc, array("
        "coalesce(get(acc, i - 1) + char_length(get(_m, i - 1)), 1) + char_length(get(_gaps, i))))), (m, p) -> named_struct('match', m, 'at', p))) as (pos, x)",
    )
    return placed.selectExpr(
        key, "pos", "x.match as match", "x.at as at",
        f"replace(substring({text}, greatest(1, x.at - 60), x.at - greatest(1, x.at - 60) + char_length(x.match) + 60), '\\n', ' ') as context",
    )


def slide_titles(slides: DataFrame, key: str = "doc_id") -> DataFrame:
    """D-8: missing and repeated slide titles, default sheet names. ``slides`` has key, number, title, is_sheet."""
    first = slides.where("trim(title) <> ''").groupBy(key, F.trim("title").alias("_t")).agg(F.min("number").alias("_first"))
    s = slides.withColumn("_t", F.trim("title")).join(first, [key, "_t"], "left")
    return s.selectExpr(
        key, "number", "title", "not is_sheet and coalesce(_t, '') = '' as missing", "not is_sheet and coalesce(_t, '') <> '' and number > _first as duplicate",
        f"is_sheet and coalesce(_t, '') rlike {lit(P.DOC_DEFAULT_SHEET)} as generic",
    )


def where_in(x: str) -> str:
    """D-19: a readable place inside the document."""
    return (
        f"case when coalesce({x}.sheet, '') <> '' then concat('sheet ', {x}.sheet, coalesce(concat(' cell ', {x}.cell), '')) when {x}.slide > 0 then concat('slide ', {x}.slide)"
        f" when {x}.page > 0 then concat('page ', {x}.page) when {x}.line > 0 then concat('line ', {x}.line) else 'document' end"
    )


def _rules() -> dict[str, str]:
    w = where_in("x")
    r: dict[str, str] = {}
    alt = "trim(coalesce(x.alt, ''))"
    r["doc-image-alt"] = together(
        f"flatten(transform(filter(images, x -> not coalesce(x.decorative, false)), x -> case when {alt} = '' then array({finding(w, 'x.name', 'doc-alt-missing', 'x.name')})"
        f" when {alt} rlike {lit(P.DOC_FILENAME_ALT)} or {alt} rlike {lit(P.DOC_GENERIC_ALT)} then array({finding(w, alt, 'doc-alt-generic', alt)}) else {NONE} end))",
        when("kind = 'pdf' and size(images) > 0 and tagged = false", finding("'document'", None, "untagged")),
    )
    real = "filter(headings, h -> not coalesce(h.fake, false) and not coalesce(h.missing, false) and h.level is not null)"
    jumps = f"get(transform(array({real}), hs -> filter(transform(hs, (h, i) -> named_struct('h', h, 'prev', get(hs, i - 1).level)), y -> y.prev is not null and y.prev <> 0 and y.h.level > y.prev + 1)), 0)"
    r["doc-heading-structure"] = together(
        each("filter(headings, h -> coalesce(h.fake, false))", w, "x.text", "doc-fake-heading", "x.text"),
        f"if(size(array_distinct(transform({real}, h -> h.level))) > 1, {each(jumps, where_in('x.h'), 'x.h.text', 'doc-heading-jump', 'concat(x.h.level, ' + repr(' after ') + ', x.prev)')}, {NONE})",
        f"flatten(transform(headings, x -> case when coalesce(x.missing, false) then array({finding(w, None, 'slide-untitled')})"
        f" when coalesce(x.duplicate, false) then array({finding(w, 'x.text', 'slide-title-repeated', 'x.text')}) when coalesce(x.generic, false) then array({finding(w, 'x.text', 'sheet-default-name', 'x.text')}) else {NONE} end))",
    )
    r["doc-list-structure"] = together(each(f"filter(lists, l -> coalesce(l.manual, false) and (coalesce(l.text, '') = '' or l.text rlike {lit(P.DOC_BULLET)}))", w, "x.text", "doc-typed-list"))
    r["doc-reading-order"] = together(
        each("reading_order_issues", w, None, "doc-reading-order", "x.issue"),
        when("kind = 'pdf' and tagged = false", finding("'document'", None, "untagged")),
        each("filter(tables, t -> coalesce(t.merged_cells, 0) > 0)", w, None, "doc-merged-cells", "x.merged_cells"),
    )
    r["doc-contrast"] = together(each("contrast_failures", w, "x.text", "doc-contrast", "concat(x.ratio, ' of ', x.required)"))
    r["doc-color-only"] = f"if(size(coloured_runs) = 0, {NONE}, {NO_OPINION})"
    r["doc-scanned-detect"] = when(
        "size(scanned_pages) > 0",
        finding("concat('pages ', array_join(transform(scanned_pages, p -> cast(p.page as string)), ', '))", None, "doc-scanned", "size(scanned_pages)"),
    )
    r["doc-text-image"] = together(each("text_images", w, "concat(x.width, 'x', x.height)", "doc-text-image"))
    bare = r"regexp_replace(file_name, r'[.][^.]+$', '')"
    titled = "trim(coalesce(title, '')) <> ''"
    r["doc-title"] = together(
        when(f"not {titled}", finding("'document properties'", "file_name", "doc-untitled", f"if({bare} rlike {lit(P.DOC_GENERIC_FILE)} or {bare} rlike '^[0-9]+$', 'and the file name says nothing', 'file name used instead')")),
        when(f"kind = 'pdf' and {titled} and display_doc_title = false", finding("'ViewerPreferences'", None, "doc-title-not-shown", "title")),
    )
    r["doc-complex-info"] = f"if(size(complex_info) = 0, {NONE}, {NO_OPINION})"
    return r


DOCUMENT_RULES = _rules()


def rule_sql(rule_id: str) -> str:
    if rule_id not in DOCUMENT_RULES:
        raise KeyError(f"unknown document rule {rule_id!r}")
    return DOCUMENT_RULES[rule_id]


def rule_results(facts: DataFrame, keys: tuple[str, ...] = ("doc_id",), rules: list[str] | None = None) -> DataFrame:
    items = ", ".join(f"named_struct('rule', '{r}', 'opined', {rule_sql(r)} is not null, 'findings', {rule_sql(r)})" for r in (rules or DOCUMENT_RULES))
    return facts.selectExpr(*keys, f"inline(array({items}))")


PASS_NOTES = {
    "hasImages": "concat('images checked: ', c.images)",
    "hasHeadingsOrLists": "concat('headings checked: ', c.headings, ', lists checked: ', c.lists)",
    "hasTables": "concat('tables checked: ', c.tables)",
    "hasLinks": "concat('links checked: ', c.links)",
}


def evaluate_documents(facts: DataFrame, level: str = "AA", use_ai: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """D-20: cancelled, not analysable, analysis error, NA, findings, unverified, PASS. There is no obligation step.

    Notes of the analyser go to the first row of each document.
    """
    rows = rows_for("pdf", level)

    def out(row, verdict, method, conf, findings, note):
        return f"named_struct('item_id', '{row.item_id}', 'ordinal', {row.ordinal}, 'verdict', '{verdict}', 'method', '{method}', 'confidence', {conf}D, 'findings', {findings}, 'note', cast({note} as string))"

    def broken(row, code, text):
        f = f"array(named_struct('locator', url, 'snippet', cast(null as string), 'code', '{code}', 'reason', concat('{code}: ', {text})))"
        return out(row, "FAIL", "auto", "0", f, f"'{code}'")

    structs = []
    for row in rows:
        parts = [f"coalesce(`rule:{r}`, {NONE})" for r in row.own_rules] or [NONE]
        found = f"concat({', '.join(parts)})"
        decided = " or ".join(f"`rule:{r}` is not null" for r in row.own_rules) or "false"
        cancelled = f"'{CANCELLED[row.item_id]}'" if row.item_id in CANCELLED else "cast(null as string)"
        manual = f"not ({decided})" + (" or true" if row.needs_judgement and not use_ai else "")
        structs.append(
            f"case when {cancelled} is not null then {out(row, 'NA', 'na-probe', '1', NONE, cancelled)} when download_error is not null then {broken(row, 'doc-not-loaded', 'download_error')}"
            f" when error is not null then {broken(row, 'doc-analysis-failed', 'error')}"
            f" when not ({A.condition(row.probe, 'c', A.DOCUMENT_PROBES)}) then {out(row, 'NA', 'na-probe', '1', NONE, repr(A.reason(row.probe, A.DOCUMENT_PROBES)))}"
            f" when size({found}) > 0 then {out(row, 'FAIL', 'auto', '1', found, 'null')} when {manual} then {out(row, 'FAIL', 'auto', '0', NONE, repr('needs judgement; not verified'))}"
            f" else {out(row, 'PASS', 'auto', '1', NONE, PASS_NOTES.get(row.probe, repr('no findings')))} end"
        )
    used = {r for row in rows for r in row.own_rules}
    df = facts.withColumns({f"rule:{r}": F.expr(rule_sql(r)) for r in used})
    contract = A.checked("c", A.DOCUMENT_COUNT_KEYS)
    sql = f"flatten(transform(transform(array(counts), c -> if(download_error is null and error is null, {contract}, c)), c -> array({', '.join(structs)})))"
    # the outer generator keeps Spark from testing size(array) first, which would evaluate every rule twice
    flat = df.selectExpr(*keys, "notes", f"posexplode_outer({sql}) as (_i, v)").where("v is not null")
    return flat.selectExpr(*keys, "v.item_id", "v.ordinal", "v.verdict", "v.method", "v.confidence", "v.findings", "if(_i = 0 and size(notes) > 0, concat_ws(' | ', v.note, array_join(notes, ' | ')), v.note) as note")


def download_ledger(docs: DataFrame, max_bytes: int) -> DataFrame:
    """D-21: why a document was not analysed. ``docs`` has status, bytes."""
    return docs.withColumn(
        "download_error",
        F.expr(f"case when status not between 200 and 299 then concat('HTTP ', status) when bytes > {max_bytes} then concat('too large: ', cast(round(bytes / 1048576D) as bigint), ' MB') end"),
    )


def pass_note(probe: str) -> str:
    """D-22."""
    return PASS_NOTES.get(probe, "'no findings'")


def document_name(title: str, url: str) -> str:
    """D-23: title, else the decoded last path segment."""
    last = f"element_at(split({url}, '/'), -1)"
    return f"coalesce(nullif(trim({title}), ''), try_url_decode(replace({last}, '+', '%2B')), {last})"
