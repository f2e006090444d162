"""Streams (W1-W8): Structured Streaming over job events and arriving pages."""

from __future__ import annotations

import json
import sys
import uuid
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lucerna.session import checkpoint_dir

# executors need not have this package installed: the session processor travels with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
STUCK_MINUTES = 120


def job_stream(spark: SparkSession, folder: str, watermark: str = "10 minutes", **options: str) -> DataFrame:
    """Job events as a file stream, event time in ``ts``."""
    raw = spark.readStream.schema(EVENT_SCHEMA).options(**options).parquet(f"{folder}/events*.parquet")
    return raw.withWatermark("ts", watermark)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def collected(spark: SparkSession, stream: DataFrame, mode: str, name: str, keys: list[str] | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over everything available and return what it produced, from the shared folder.

    With ``keys`` (update mode) a row stands for the last state of its keys: later batches replace earlier ones. A batch that
    runs again overwrites its own folder. ``progress`` takes the query's progress reports.
    """
    base = _folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}" if mode != "complete" else f"{base}/out/batch=0")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return _last(spark, f"{base}/out", stream.schema, keys)


def _last(spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None) -> DataFrame:
    """Rows of all batches, or of each key the rows of its last batch."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if keys is None:
        return rows.drop("batch")
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in schema.names])


VERDICT_ROWS = "page_id bigint, url string, site string, item_id string, verdict string, confidence double"


def incremental_review(spark: SparkSession, pages: DataFrame | str, items: list[str] | None = None, level: str = "AA") -> DataFrame:
    """Review pages as they arrive; after every batch the stored verdicts equal a review of all pages so far.

    Each micro-batch parses only its own pages and stores their facts. Rows that a page decides alone are written once. The
    rows that compare pages are evaluated again for the sites that the batch touches, from stored facts, and replace the ones
    before. Facts and verdicts are keyed by batch, so a batch that runs twice changes nothing.
    """
    from lucerna.operators.catalogue import rows_for
    from lucerna.plans.review import needs_site, page_facts, rules_of, verdicts

    rows = [r for r in rows_for("page", level) if items is None or r.item_id in items]
    alone, across = [r.item_id for r in rows if not needs_site(r)], [r.item_id for r in rows if needs_site(r)]
    base = _folder(spark, "w1")
    if isinstance(pages, str):
        pages = spark.readStream.schema("page_id bigint, url string, html string").parquet(pages)
    columns = [c.split()[0] for c in VERDICT_ROWS.split(", ")]

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        page_facts(batch, rules_of(items, level)).write.mode("overwrite").parquet(f"{base}/facts/batch={batch_id}")
        facts = spark.read.parquet(f"{base}/facts").where(F.col("batch") <= batch_id)
        new = facts.where(F.col("batch") == batch_id).drop("batch")
        if alone:
            verdicts(new, level, items=alone).select(*columns).write.mode("overwrite").parquet(f"{base}/alone/batch={batch_id}")
        if across:
            touched = facts.drop("batch").join(new.select("site").distinct(), "site", "left_semi")
            verdicts(touched, level, items=across).select(*columns).write.mode("overwrite").parquet(f"{base}/across/batch={batch_id}")

    q = pages.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(evaluate).start()
    q.awaitTermination()
    schema = T.StructType.fromDDL(VERDICT_ROWS)
    parts = [_last(spark, f"{base}/{kind}", schema, ["page_id", "item_id"]) for kind, own in (("alone", alone), ("across", across)) if own]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rescan_cooldown(events: DataFrame) -> DataFrame:
    """One scan per url inside the watermark; later repeats are dropped with bounded state."""
    return events.withColumn("url", F.expr("concat('u', user_id)")).dropDuplicatesWithinWatermark(["url"]).select("url", "event_id", "ts")


def daily_spend(events: DataFrame) -> DataFrame:
    """Spend per UTC day."""
    return events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("scans"), F.sum(F.col("value") / 100).alias("spent")).selectExpr("w.start as day", "scans", "spent")


def active_jobs(events: DataFrame) -> DataFrame:
    """Jobs running per site at every full minute; a job that never reports its end counts for ``STUCK_MINUTES``.

    The state is one count per site and open minute and goes with the watermark; order of arrival does not matter.
    """
    minutes = F.window("ts", f"{STUCK_MINUTES} minutes", "1 minute")
    keyed = events.select(F.expr("concat('s', user_id % 10)").alias("site"), minutes.alias("w"), "ts", "value")
    running = keyed.where(f"unix_micros(w.end) < unix_micros(ts) + least(value, {STUCK_MINUTES}) * 60000000D")
    return running.groupBy("site", "w").agg(F.count(F.lit(1)).alias("active")).selectExpr("site", "w.end as at", "active")


def job_progress(events: DataFrame) -> DataFrame:
    """Jobs per phase over a sliding window."""
    g = events.groupBy(F.window("ts", "10 minutes", "1 minute").alias("w"), F.col("event_type").alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    return g.selectExpr("w.start as window_start", "phase", "n")


def crawl_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Crawl sessions per site, closed after a gap."""
    g = events.groupBy(F.col("user_id").alias("site"), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.selectExpr("site", "w.start as session_start", "w.end as session_end", "n")


SESSION = "site bigint, session_start timestamp, session_end timestamp, n bigint, open boolean, version bigint"


class _Sessions(StatefulProcessor):
    """One site's open sessions as sorted intervals; each has a timer at its end, and goes when the watermark passes it."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "spans string, version bigint")  # spans as JSON: lists of start, end, count

    def _rows(self, site, spans, version, is_open):
        when = lambda us: datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
        return [Row(site=site, session_start=when(a), session_end=when(b), n=n, open=is_open, version=version) for a, b, n in spans]

    def _load(self):
        kept = self.state.get()
        return ([tuple(s) for s in json.loads(kept[0])], kept[1]) if kept else ([], 0)

    def handleInputRows(self, key, rows, timerValues):
        spans, version = self._load()
        fresh = [(us, us + self.gap * 1_000_000, 1) for us in (r["us"] for r in rows)]
        merged: list[tuple] = []
        for a, b, n in sorted([*spans, *fresh]):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((a, b, n))
        self.state.update((json.dumps(merged), version + 1))
        for _, b, _ in merged:
            self.handle.registerTimer(b // 1000 + 1)
        yield from self._rows(key[0], merged, version + 1, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        spans, version = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        closed, rest = [s for s in spans if s[1] <= now], [s for s in spans if s[1] > now]
        if not closed:
            return
        self.state.update((json.dumps(rest), version + 1))
        yield from self._rows(key[0], closed, version + 1, False)
        yield from self._rows(key[0], rest, version + 1, True)

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """W6 with open sessions: SESSION rows, one for each session that closes, and all open ones of a site whenever they change.

    ``version`` counts a site's changes: its open sessions are the open rows of its greatest version. State is the open
    sessions alone. Needs the RocksDB state store, which ``session_outputs`` sets.
    """
    keyed = events.select(F.col("user_id").alias("site"), "ts", F.expr("unix_micros(ts)").alias("us"))
    return keyed.groupBy("site").transformWithState(_Sessions(gap_seconds), SESSION, "Update", "EventTime")


def session_outputs(spark: SparkSession, events: DataFrame, gap_seconds: int = 1800, name: str = "w6") -> tuple[DataFrame, DataFrame]:
    """The sessions that closed, and those still open at the end, each from a folder of its own."""
    base, store = _folder(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("open").parquet(f"{base}/out/batch={batch_id}")

    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = session_stream(events, gap_seconds).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        spark.conf.set(store, before) if before is not None else spark.conf.unset(store)
    rows = spark.read.schema(f"{SESSION}, batch bigint").parquet(f"{base}/out")
    last = rows.groupBy("site").agg(F.max("version").alias("version"))
    columns = ["site", "session_start", "session_end", "n"]
    return rows.where("not open").select(*columns), rows.where("open").join(last, ["site", "version"]).select(*columns)


def delta_against(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Arriving results against a stored baseline (``user_id, was_broken``), stream-static join."""
    j = events.join(baseline, "user_id", "left")
    return j.selectExpr(
        "event_id",
        "case when was_broken is null then 'new' when value > 20 and was_broken then 'stillBroken' when value > 20 then 'newlyBroken' when was_broken then 'fixed' else 'unchanged' end as outcome",
    )


def late_ledger(batch: DataFrame, watermark_ms: int) -> DataFrame:
    """Rows older than the watermark go to the ledger instead of vanishing."""
    return batch.where(F.expr(f"unix_millis(cast(ts as timestamp)) < {watermark_ms}")).withColumn("reason", F.lit("late"))


def delta_with_ledger(spark: SparkSession, events: DataFrame, baseline: DataFrame, delay_ms: int = 600_000, name: str = "w7") -> tuple[DataFrame, DataFrame]:
    """Outcomes of the rows in time, and the ledger of late ones; together they are the input.

    A row is late when it is older than the watermark: the latest time of all batches before, less the delay. Every batch leaves
    its latest time in the shared folder, so a batch that runs again after a restart meets the same watermark. ``events`` is a
    stream without a watermark of its own, as Spark would drop what is late.
    """
    base = _folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        now = spark.createDataFrame([(None,)], "ms bigint") if batch_id == 0 else spark.read.schema("ms bigint, batch bigint").parquet(f"{base}/marks").where(F.col("batch") < batch_id)
        latest = now.agg(F.max("ms")).first()[0]
        mark = -(1 << 62) if latest is None else latest - delay_ms
        late_ledger(batch, mark).write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
        in_time = batch.where(F.expr(f"ts is null or unix_millis(cast(ts as timestamp)) >= {mark}"))
        delta_against(in_time, baseline).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        batch.agg(F.expr("max(unix_millis(cast(ts as timestamp)))").alias("ms")).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")

    q = events.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema("event_id bigint, outcome string").parquet(f"{base}/out"), spark.read.schema(f"{EVENT_SCHEMA}, reason string").parquet(f"{base}/late")


def politeness_gaps(requests: DataFrame, min_gap_ms: int, bucket_hours: int = 1) -> DataFrame:
    """Requests to one host that follow each other too fast.

    The lag runs inside (host, hour) buckets; only the last request of each hour crosses into the next
    non-empty one, so a single busy host is spread over its hours.
    """
    size = bucket_hours * 3_600_000
    if min_gap_ms > size:
        raise ValueError("the gap must fit into a bucket: raise bucket_hours")
    r = requests.withColumn("bucket", F.expr(f"cast(floor(unix_millis(cast(ts as timestamp)) / {size}D) as bigint)"))
    w = W.partitionBy("host", "bucket").orderBy("ts")
    inside = r.withColumn("prev", F.lag("ts").over(w))
    last = r.groupBy("host", "bucket").agg(F.max("ts").alias("last")).withColumn("bucket", F.col("bucket") + 1)
    both = inside.join(last, ["host", "bucket"], "left").withColumn("before", F.expr("coalesce(prev, last)"))
    return both.withColumn("gap_ms", F.expr("unix_millis(cast(ts as timestamp)) - unix_millis(cast(before as timestamp))")).where(F.col("gap_ms") < min_gap_ms).drop("prev", "last", "before", "bucket")
