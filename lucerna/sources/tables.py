"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.operators.catalogue import catalogue_df
from lucerna.operators.documents import FACTS
from lucerna.operators.evidence import RECORDED
from lucerna.operators.ops import artifact_key, artifact_prefix
from lucerna.operators.verdict import labels, summarise

PAGES = "page_id bigint, url string, html string, status int, load_error string, crawl_order bigint, depth int"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """The crawl corpus. A link-only job that never names ``html`` never reads it."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def recorded_schema() -> str:
    return "page_id bigint, " + ", ".join(f"{k} {t}" for k, t in RECORDED.items())


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded browser evidence, one JSON object per line, with a fixed schema (nothing is inferred)."""
    return spark.read.schema(recorded_schema()).json(path)


def read_document_facts(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.schema("doc_id bigint, " + ", ".join(f"{k} {t}" for k, t in FACTS.items())).json(path)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """Robots files, one whole file per row; the file name is the site."""
    return spark.read.text(path, wholetext=True).selectExpr(r"regexp_extract(input_file_name(), r'([^/]+?)([.]txt)?$', 1) as site", "value as text")


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap files, whole; one folder per site."""
    return spark.read.text(path, wholetext=True).selectExpr(r"regexp_extract(input_file_name(), r'([^/]+)/[^/]+$', 1) as site", "input_file_name() as source", "value as xml")


def report_rows(results: DataFrame) -> DataFrame:
    """Nested report, one row per target. A target has at most sixty rows, so its list is bounded."""
    return results.groupBy("site", "url").agg(
        F.expr("array_sort(collect_list(struct(ordinal, item_id, verdict, method, confidence, findings, note)))").alias("results"),
        F.expr("count_if(verdict = 'PASS')").alias("pass"), F.expr("count_if(verdict = 'FAIL')").alias("fail"), F.expr("count_if(verdict = 'NA')").alias("na"),
        F.expr("count_if(verdict = 'FAIL' and confidence = 0)").alias("unverified"),
    )


def write_report_json(results: DataFrame, path: str) -> None:
    report_rows(results).write.mode("overwrite").json(path)


def check_sheet(results: DataFrame) -> DataFrame:
    """The nine columns of the check sheet in their official order, with the target in front."""
    cat = F.broadcast(catalogue_df(results.sparkSession).select("item_id", "criterion", "name", F.col("effective_level").alias("level"), "part"))
    text = "array_join(concat(if(note is null or note = '', array(), array(note)), transform(findings, f -> concat_ws(' | ', f.locator, f.reason, f.snippet))), '\\n')"
    return labels(results.join(cat, "item_id")).selectExpr(
        "url", "ordinal", "split_part(criterion, '.', 1) as guideline", "criterion", "name", "concat(criterion, ' ', name) as description", "level", "verdict_label as result",
        f"{text} as findings_text", "method_label as method", "if(method in ('ai', 'auto+ai'), confidence, null) as confidence",
    )


def write_check_sheet(results: DataFrame, path: str) -> None:
    """One folder per site, rows in form order; writing per target would make one file per page."""
    sheet = check_sheet(results).withColumn("site", F.expr("regexp_extract(url, '://([^/]+)', 1)"))
    sheet.repartitionByRange("site", "url").sortWithinPartitions("site", "url", "ordinal").write.mode("overwrite").partitionBy("site").option("header", True).option("escape", "\"").csv(path)


def index_sheet(results: DataFrame) -> DataFrame:
    """One line per target."""
    return summarise(results, "site", "url")


def index_of_targets(targets: DataFrame) -> DataFrame:
    """One line per page and document (``all_targets``)."""
    return summarise(targets, "site", "kind", "target")


def remediation_text(steps: DataFrame) -> DataFrame:
    """The text of each target's fixes, in step order (``fix_order`` output)."""
    line = "concat('### ', step_no, ' ', criterion, ' ', name, '\\n', array_join(transform(findings, f -> concat('- ', f.locator, ' - ', f.reason)), '\\n'))"
    return steps.withColumn("_l", F.expr(line)).groupBy("url").agg(F.expr("array_join(transform(array_sort(collect_list(struct(step_no, _l))), x -> x._l), '\\n\\n')").alias("value"))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Partitioned by retention prefix and run, so expiry and deletion are folder operations."""
    df = artifacts.withColumn("prefix", F.expr(artifact_prefix("format"))).withColumn("object_key", F.expr(artifact_key("run_id", "format", "filename")))
    df.write.mode("append").partitionBy("prefix", "run_id").parquet(path)
