"""Obligation and verdict (V1-V23): one narrow expression per page, then plain aggregates.

The catalogue is fixed, so its rows are unrolled into one array of structs per page and folded to
verdicts with a single ``transform``; nothing is joined or shuffled until results are rolled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.operators import applicability as A
from lucerna.operators.catalogue import CANCELLED, CATALOGUE, catalogue_df, rows_for
from lucerna.operators.page_rules import NONE, RULE_NOTES, with_site_defaults

# Turnover thresholds in the obligation rules.
FULL_EXEMPTION_TURNOVER = 100_000
LEGACY_SITE_TURNOVER = 1_000_000
VIDEO_DUTY_TURNOVER = 5_000_000

PROFILE = {"public_authority": "boolean", "turnover": "double", "edits_video": "boolean", "before_2017": "boolean"}
VERDICT_LABELS = {"PASS": "pass", "FAIL": "fail", "NA": "not applicable"}
METHOD_LABELS = {"auto": "automatic", "ai": "judgement", "auto+ai": "automatic and judgement", "na-probe": "applicability probe"}


def site_exemption() -> str:
    """V1: NULL never exempts; a public authority is never exempt."""
    return (
        f"case when coalesce(public_authority, false) or turnover is null then null when turnover <= {FULL_EXEMPTION_TURNOVER} then 'small-turnover'"
        f" when turnover <= {LEGACY_SITE_TURNOVER} and coalesce(before_2017, false) then 'legacy-site' end"
    )


def row_exemption(criterion: str = "criterion") -> str:
    """V2: only the time-based-media rows can be exempt."""
    return (
        f"case when not {criterion} rlike '^1[.]2[.]' or coalesce(public_authority, false) then null when edits_video = false then 'no-video-production'"
        f" when turnover <= {VIDEO_DUTY_TURNOVER} then 'video-turnover' end"
    )


def binding_level(requested: str) -> str:
    """V3."""
    return f"if(coalesce(public_authority, false), 'AA', {requested})"


def _checker(kind: str, rules: tuple[str, ...]) -> str:
    """V4/V5 for one catalogue row: checker nodes of its rules, in checker order."""
    if not rules:
        return NONE
    names = ", ".join(f"'{r}'" for r in rules)
    tail = r"regexp_replace(coalesce(n.summary, ''), r'\s*\n\s*', ' ')"
    reason = f"trim(concat(v.help, '. ', trim({tail})))" if kind == "violations" else "concat(v.help, ' - undecided')"
    f = f"named_struct('locator', array_join(n.target, ' , '), 'snippet', n.html, 'code', v.id, 'reason', {reason})"
    return f"coalesce(flatten(transform(filter(checker.{kind}, v -> v.id in ({names})), v -> transform(v.nodes, n -> {f}))), {NONE})"


def checker_findings(pages: DataFrame, kind: str = "violations", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """V4 (``violations``) and V5 (``incomplete``): checker nodes per catalogue row."""
    rows = [r for r in CATALOGUE if r.checker_rules]
    items = ", ".join(f"named_struct('item_id', '{r.item_id}', 'findings', {_checker(kind, r.checker_rules)})" for r in rows)
    return pages.selectExpr(*keys, f"inline(array({items}))").where("size(findings) > 0")


def dedupe(findings: str) -> str:
    """Same place and same first 80 characters of reason count once, in order; a missing part equals nothing.

    Equal keys are neighbours once sorted, so the cost grows with the findings and not with their pairs.
    """
    keyed = "array_sort(transform(fs, (f, i) -> named_struct('k', coalesce(concat(f.locator, '\\u0000', left(f.reason, 80)), concat('\\u0001', i)), 'i', i)))"
    firsts = f"get(transform(array({keyed}), r -> array_sort(transform(filter(r, (y, i) -> i = 0 or get(r, i - 1).k <> y.k), y -> y.i))), 0)"
    return f"get(transform(array({findings}), fs -> transform({firsts}, j -> get(fs, j))), 0)"


PASS_NOTES = {
    "hasImages": "concat('images checked: ', c.images)",
    "hasLinks": "concat('links checked: ', c.links)",
    "hasForms": "concat('form fields checked: ', c.formControls)",
    "hasFocusableElements": "concat('focusable elements checked: ', c.focusable)",
    "hasTables": "concat('tables checked: ', c.tables)",
}


def _row_facts(row) -> str:
    opinions = [f"`rule:{r}` is not null" for r in row.own_rules]
    if row.checker_rules:
        opinions.append("checker is not null")
    parts = [_checker("violations", row.checker_rules), *[f"coalesce(`rule:{r}`, {NONE})" for r in row.own_rules]]
    notes = [RULE_NOTES[r] for r in row.own_rules if r in RULE_NOTES]
    note = f"nullif(concat_ws(' ', {', '.join(notes)}), '')" if notes else "cast(null as string)"
    cancelled = f"'{CANCELLED[row.item_id]}'" if row.item_id in CANCELLED else "cast(null as string)"
    return (
        f"named_struct('item_id', '{row.item_id}', 'needs_judgement', {str(row.needs_judgement).lower()}, 'cancelled', {cancelled},"
        f" 'exempt', {row_exemption(repr(row.criterion))}, 'applicable', {A.condition(row.probe, 'c')}, 'na_reason', '{A.reason(row.probe)}',"
        f" 'findings', concat({', '.join(parts)}), 'opined', {' or '.join(opinions) or 'false'}, 'incomplete', {_checker('incomplete', row.checker_rules)},"
        f" 'rule_note', {note}, 'pass_note', {PASS_NOTES.get(row.probe, repr('no findings'))}, 'has_checker_rules', {str(bool(row.checker_rules)).lower()}, 'ordinal', {row.ordinal})"
    )


def _decide(use_ai: bool) -> str:
    def out(verdict, method, conf, findings, note, pending="false"):
        return (
            f"named_struct('item_id', r.item_id, 'ordinal', r.ordinal, 'verdict', {verdict}, 'method', '{method}', 'confidence', {conf}D, 'findings', {findings},"
            f" 'note', cast({note} as string), 'pending', {pending}, 'incomplete', r.incomplete, 'rule_satisfied', r.opined and size(r.findings) = 0,"
            f" 'has_checker_rules', r.has_checker_rules)"
        )

    manual = "concat_ws(' ', r.rule_note, 'needs judgement; not verified')"
    ask = f"when r.needs_judgement then {out(repr('FAIL'), 'auto', '0', dedupe('r.findings'), 'r.rule_note', 'true')}" if use_ai else ""
    return (
        f"case when load_error is not null then {out(repr('FAIL'), 'auto', '0', 'array(named_struct(' + repr('locator') + ', url, ' + repr('snippet') + ', cast(null as string), ' + repr('code') + ', ' + repr('not-loaded') + ', ' + repr('reason') + ', concat(' + repr('not-loaded: ') + ', load_error)))', repr('page did not load'))}"
        f" when r.exempt is not null then {out(repr('NA'), 'na-probe', '1', NONE, 'r.exempt')}"
        f" when r.cancelled is not null then {out(repr('NA'), 'na-probe', '1', NONE, 'r.cancelled')}"
        f" when not r.applicable then {out(repr('NA'), 'na-probe', '1', NONE, 'r.na_reason')} {ask}"
        f" when size(r.findings) > 0 then {out(repr('FAIL'), 'auto', '1', dedupe('r.findings'), 'null')}"
        f" when r.needs_judgement then {out(repr('FAIL'), 'auto', '0', 'r.incomplete', manual)}"
        f" when not r.opined then {out(repr('FAIL'), 'auto', '0', 'r.incomplete', 'concat_ws(' + repr(' ') + ', r.rule_note, ' + repr('nothing decided this row') + ')')}"
        f" when size(r.incomplete) > 0 then {out(repr('FAIL'), 'auto', '0', 'r.incomplete', repr('the checker could not decide'))}"
        f" else {out(repr('PASS'), 'auto', '1', NONE, 'r.pass_note')} end"
    )


def with_profile_defaults(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in PROFILE.items() if c not in have])


def evaluate_pages(pages: DataFrame, level: str = "AA", use_ai: bool = False, items: list[str] | None = None, keys: tuple[str, ...] = ("page_id", "url", "site")) -> DataFrame:
    """Page facts with ``rule:*`` columns -> one row per page and catalogue row."""
    rows = [r for r in rows_for("page", level) if items is None or r.item_id in items]
    df = with_profile_defaults(with_site_defaults(pages))
    fields = ", ".join(f"'{k}', counts.{k}" for k in A.COUNTS)
    facts = "array(" + ", ".join(_row_facts(r) for r in rows) + ")"
    # the counts row is bound once as a lambda variable, so the contract is checked once per page
    # a row about several pages must not pass as not applicable because nobody counted them
    many = any(r.probe == "isMultiPageSite" for r in rows)
    site_pages = "if(page_count is null, cast(raise_error('page_count is missing: rows that compare pages need the site context') as bigint), page_count)" if many else "coalesce(page_count, 1)"
    sql = (
        f"flatten(transform(transform(array(if(counts is null, null, named_struct({fields}, 'sitePageCount', {site_pages}))),"
        f" c -> {A.checked('c')}), c -> transform({facts}, r -> {_decide(use_ai)})))"
    )
    # the outer generator keeps Spark from testing size(array) first, which would evaluate every rule twice
    return df.selectExpr(*keys, f"inline_outer({sql})").where("item_id is not null")


def merge_judgement(pending: DataFrame) -> DataFrame:
    """Pending rows with nullable judgement columns ``j_verdict, j_confidence, j_findings, j_note``.

    A row whose optional column ``judged`` is false was refused or failed: whatever its judgement columns hold it stays
    unverified (FAIL with confidence 0, or the rule's own FAIL), and its incomplete findings are kept.
    """
    if "judged" in pending.columns:
        for c in ("j_verdict", "j_confidence", "j_findings"):
            pending = pending.withColumn(c, F.when(F.coalesce("judged", F.lit(True)), F.col(c)))
        pending = pending.drop("judged")
    method = "if(size(findings) > 0 or has_checker_rules, 'auto+ai', 'ai')"
    place = f"filter(j_findings, f -> {is_page_locator('f.locator')})"

    def out(v, m, c, f, n):
        return f"named_struct('verdict', '{v}', 'method', {m}, 'confidence', cast({c} as double), 'findings', {f}, 'note', cast({n} as string))"

    already = "size(findings) > 0"
    sql = (
        f"case when j_verdict is null and {already} then {out('FAIL', repr('auto'), '1', 'findings', 'null')}"
        f" when j_verdict is null then {out('FAIL', repr('auto'), '0', 'incomplete', 'coalesce(j_note, ' + repr('judgement did not finish; not verified') + ')')}"
        f" when {already} then {out('FAIL', method, '1', dedupe('concat(findings, coalesce(j_findings, ' + NONE + '))'), 'j_note')}"
        f" when j_verdict = 'NA' then {out('NA', method, 'j_confidence', NONE, 'coalesce(j_note, ' + repr('not relevant to this page') + ')')}"
        f" when j_verdict = 'FAIL' and rule_satisfied and coalesce(size({place}), 0) = 0 then {out('PASS', method, 'least(j_confidence, 0.8D)', NONE, repr('the rule found what is required; the judgement named no place'))}"
        f" when j_verdict = 'FAIL' then {out('FAIL', method, 'j_confidence', dedupe('coalesce(j_findings, ' + NONE + ')'), 'j_note')}"
        f" else {out('PASS', method, 'j_confidence', NONE, 'j_note')} end"
    )
    keep = [c for c in pending.columns if c not in ("verdict", "method", "confidence", "findings", "note", "pending", "j_verdict", "j_confidence", "j_findings", "j_note")]
    return pending.withColumn("_m", F.expr(sql)).select(*keep, "_m.*")


def is_page_locator(value: str) -> str:
    """Names a place on the page, not the whole page and not a path into the evidence."""
    v = f"trim(coalesce({value}, ''))"
    head = rf"regexp_extract({v}, r'^([^\[.\s>+~]*)', 1)"
    before = rf"regexp_extract({v}, r'^([^\[\s>+~]*)', 1)"
    return (
        f"({v} not in ('', 'body', 'html') and not ({head} rlike '^[a-z][A-Za-z0-9]*$' and {before} rlike '[A-Z]')"
        rf" and not {v} rlike r'^[a-zA-Z][A-Za-z0-9]*\[\d+\]')"
    )


def summarise(results: DataFrame, *keys: str) -> DataFrame:
    """Unverified rows are a subset of the failures."""
    return results.groupBy(*keys).agg(
        F.expr("count_if(verdict = 'PASS')").alias("pass"),
        F.expr("count_if(verdict = 'FAIL')").alias("fail"),
        F.expr("count_if(verdict = 'NA')").alias("na"),
        F.expr("count_if(verdict = 'FAIL' and confidence = 0)").alias("unverified"),
    )


def rank_failures(results: DataFrame, *keys: str) -> DataFrame:
    """Failures per catalogue row; NA is not in the denominator, unverified failures are in the numerator."""
    return (
        results.where("verdict <> 'NA'")
        .groupBy(*keys, "item_id")
        .agg(F.expr("count_if(verdict = 'FAIL')").alias("fail_count"), F.count(F.lit(1)).alias("total"))
        .where("fail_count > 0")
        .withColumn("rate", F.col("fail_count") / F.col("total"))
        .join(F.broadcast(catalogue_df(results.sparkSession).select("item_id", "criterion", "name", "ordinal")), "item_id")
    )


def run_stats(results: DataFrame) -> DataFrame:
    """Pages scanned and pages failed (any FAIL, unverified included), per site and in total."""
    per_page = results.groupBy("site", "page_id").agg(F.expr("bool_or(verdict = 'FAIL')").alias("failed"))
    return per_page.rollup("site").agg(F.count(F.lit(1)).alias("pages_scanned"), F.expr("count_if(failed)").alias("pages_failed"))


TARGET = ["site", "kind", "target", "item_id", "verdict", "confidence", "findings", "method", "note"]


def all_targets(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of pages and of linked documents in one shape, for the rollups over both. ``documents`` has ``site`` and ``url``."""
    one = pages.withColumns({"kind": F.lit("page"), "target": F.col("url")}).select(*TARGET)
    return one.unionByName(documents.withColumns({"kind": F.lit("document"), "target": F.col("url")}).select(*TARGET))


def run_totals(targets: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per site and in total, pages and documents scanned and failed, and addresses skipped. ``skipped``: site, url, reason.

    A site that has only skipped addresses has a row too.
    """
    failed = targets.groupBy("site", "kind", "target").agg(F.expr("bool_or(verdict = 'FAIL')").alias("failed"))
    ledger = skipped.select("site", F.lit("skipped").alias("kind"), F.col("url").alias("target"), F.lit(False).alias("failed"))
    counts = {f"{k}s_{what}": F.expr(f"count_if(kind = '{k}'{cond})") for k in ("page", "document") for what, cond in (("scanned", ""), ("failed", " and failed"))}
    return failed.unionByName(ledger).rollup("site").agg(*[c.alias(n) for n, c in counts.items()], F.expr("count_if(kind = 'skipped')").alias("skipped"))


def shared_failures(targets: DataFrame, *keys: str) -> DataFrame:
    """per catalogue row, on how many targets of each kind it fails for real and how many nothing verified; most shared first.

    What fails on many targets is best fixed once, in what they share. Counts combine before the shuffle.
    """
    real = "verdict = 'FAIL' and confidence > 0"
    out = targets.where("verdict = 'FAIL'").groupBy(*keys, "item_id").agg(
        F.expr(f"count_if({real} and kind = 'page')").alias("pages"), F.expr(f"count_if({real} and kind = 'document')").alias("documents"), F.expr("count_if(confidence = 0)").alias("unverified")
    )
    return out.withColumn("shared", F.expr("pages + documents > 1"))


def totals(results: DataFrame) -> DataFrame:
    """Pass rate over assessed rows, real failures apart from unverified ones."""
    s = summarise(results)
    return s.withColumn("pass_rate", F.expr("round(100D * pass / nullif(pass + fail, 0), 0)")).withColumn("real_failures", F.expr("fail - unverified"))


def by_part(results: DataFrame) -> DataFrame:
    """Standard rows and national rows apart."""
    cat = F.broadcast(catalogue_df(results.sparkSession).select("item_id", "part"))
    return summarise(results.join(cat, "item_id").withColumn("group", F.expr("if(part = 'IL', 'national', 'standard')")), "group")


def verify_criterion(results: DataFrame, text: str, *keys: str) -> DataFrame:
    """Does any row of one criterion fail on a target."""
    cat = F.broadcast(catalogue_df(results.sparkSession).where(F.col("criterion").contains(text)).select("item_id"))
    return results.join(cat, "item_id").groupBy(*keys).agg(F.expr("bool_or(verdict = 'FAIL')").alias("any_fail"), F.count(F.lit(1)).alias("rows"))


def labels(results: DataFrame) -> DataFrame:
    """V21."""
    def m(d):
        return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")"

    return results.withColumn("verdict_label", F.expr(f"{m(VERDICT_LABELS)}[verdict]")).withColumn("method_label", F.expr(f"{m(METHOD_LABELS)}[method]"))


def quality_gates(results: DataFrame, targets: DataFrame, key: str, level: str = "AA") -> DataFrame:
    """Rows that break a promise. Empty when the run is sound."""
    bad = results.where("confidence = 0 and verdict <> 'FAIL'").selectExpr(f"cast({key} as string) as target", "item_id", "'unverified row that is not a failure' as problem")
    no_note = results.where("verdict = 'NA' and (note is null or note = '')").selectExpr(f"cast({key} as string) as target", "item_id", "'NA without a reason' as problem")
    wanted = "array(" + ", ".join(f"'{r.item_id}'" for r in rows_for("page", level)) + ")"
    have = results.groupBy(F.col(key).cast("string").alias("target")).agg(F.collect_set("item_id").alias("have"))
    every = targets.select(F.col(key).cast("string").alias("target")).join(have, "target", "left")
    missing = every.selectExpr("target", f"explode(array_except({wanted}, coalesce(have, array()))) as item_id", "'row missing' as problem")
    return bad.unionByName(no_note).unionByName(missing)


def grouping_totals(results: DataFrame) -> DataFrame:
    """Totals over site x part x level, every combination in one pass."""
    cat = F.broadcast(catalogue_df(results.sparkSession).select("item_id", "part", F.col("effective_level").alias("level")))
    return (
        results.join(cat, "item_id")
        .cube("site", "part", "level")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.expr("count_if(verdict = 'FAIL')").alias("fail"), F.expr("count_if(verdict = 'PASS')").alias("pass"),
            F.expr("cast(grouping_id() as int)").alias("gid"),
        )
    )
