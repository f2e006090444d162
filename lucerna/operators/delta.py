"""Delta between two reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["target_url", "item_id"]


def delta_rows(base: DataFrame, current: DataFrame) -> DataFrame:
    """One row per (target, row). Inputs: ``target_url, item_id, verdict, confidence, locators``.

    A row that cannot be verified now, or is gone, is never counted as fixed.
    """
    b = base.select(*KEY, F.col("verdict").alias("base_verdict"), F.col("confidence").alias("base_confidence"), F.col("locators").alias("base_locators"))
    c = current.select(*KEY, F.col("verdict").alias("now_verdict"), F.col("confidence").alias("now_confidence"), F.col("locators").alias("now_locators"))
    both = b.join(c, KEY, "full_outer")
    outcome = (
        "case when now_verdict is null or (now_verdict = 'FAIL' and now_confidence = 0) then 'unverified'"
        " when base_verdict = 'FAIL' and now_verdict = 'PASS' then 'fixed'"
        " when base_verdict = 'FAIL' and now_verdict = 'FAIL' then 'stillBroken'"
        " when coalesce(base_verdict, '') <> 'FAIL' and now_verdict = 'FAIL' then 'newlyBroken' else 'unchanged' end"
    )
    empty = "cast(array() as array<string>)"
    return both.withColumns(
        {
            "outcome": F.expr(outcome),
            "cleared": F.expr(f"if(now_verdict is null or (now_verdict = 'FAIL' and now_confidence = 0), {empty}, array_except(coalesce(base_locators, {empty}), coalesce(now_locators, {empty})))"),
            "added": F.expr(f"array_except(coalesce(now_locators, {empty}), coalesce(base_locators, {empty}))"),
            "note": F.expr("case when now_verdict is null then 'not part of the later review' when now_verdict = 'FAIL' and now_confidence = 0 then 'could not be verified' end"),
        }
    ).drop("base_locators", "now_locators")


def compare_reviews(base: DataFrame, current: DataFrame, base_version: str | None, current_version: str | None) -> DataFrame:
    """Delta rows of two reviews; refused unless both state the same catalogue version."""
    reason = refusal(base_version, current_version)
    if reason:
        raise ValueError(reason)
    return delta_rows(base, current)


def refusal(base_version: str | None, current_version: str | None) -> str | None:
    """T4: why two reviews do not compare; None where they do."""
    if base_version is None or current_version is None:
        return "catalogue version not stated"
    return None if base_version == current_version else f"catalogue versions differ: {base_version} and {current_version}"


def delta_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts per outcome; net progress is fixed minus newly broken."""
    names = {"fixed": "fixed", "still_broken": "stillBroken", "newly_broken": "newlyBroken", "unverified": "unverified", "unchanged": "unchanged"}
    out = rows.groupBy(*keys).agg(*[F.expr(f"count_if(outcome = '{v}')").alias(k) for k, v in names.items()])
    return out.withColumn("net_progress", F.expr("fixed - newly_broken"))


def comparability(runs: DataFrame) -> DataFrame:
    """T4: two reviews compare only under one stated catalogue version."""
    return runs.withColumn(
        "incomparable_reason",
        F.expr(
            "case when base_version is null or now_version is null then 'catalogue version not stated'"
            " when base_version <> now_version then concat('catalogue versions differ: ', base_version, ' and ', now_version) end"
        ),
    ).withColumn("comparable", F.expr("incomparable_reason is null"))


def target_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """T5: targets on one side only."""
    b, c = base.select("target_url").distinct(), current.select("target_url").distinct()
    return c.exceptAll(b).withColumn("change", F.lit("added")).unionByName(b.exceptAll(c).withColumn("change", F.lit("removed")))
