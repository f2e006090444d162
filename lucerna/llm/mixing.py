"""Mixing sources to target weights by entropy balancing.

Rates stay as close as possible (in relative entropy) to one copy of each document while every source meets its target of
words and no document is taken more than ``cap`` times. The optimum is an exponential tilt of a document's size,
``rate = min(cap, exp(lambda * size / mean size))``, with one ``lambda`` per source: the minimum of the convex dual.
Newton steps, safeguarded by a bracket, run for all sources at once over counts of (source, size), which one pass makes.

Rates become copies by carrying the rounding error on: from the largest size down, each cell of n equal documents takes
the whole number of copies that brings the words taken nearest to the words due so far, at most one from its rate.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm.base import WORD, Stage, query, row_hash, ship, table

ship(__name__)

CYCLE = (3, 1, 2)
SHARE = 1.5
CAP = 2
PER_SLICE = 200_000
TOLERANCE = 1e-7
ROUNDS = 60


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds ``position`` from 0 in the order of ``keys``: range partitions, counted; no task sees all rows."""
    spread = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    kept = Stage(spread, "ranked").df
    before, base = {}, 0
    for part, n in sorted(kept.groupBy("_part").count().collect()):  # one number for each partition
        before[part], base = base, base + n
    if not before:
        return kept.drop("_part").withColumn("position", F.lit(0).cast("long"))
    first = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])[F.col("_part")]
    place = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return kept.withColumn("position", (place + first).cast("long")).drop("_part")


def targets(sources: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (skey, source, docs, source_size): weighted shares, cut at ``cap`` sizes, the excess reshared."""
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("position") % len(cycle) + 1).cast("int"))
    weighed = Stage(ranked(sources, [F.col("source").isNull(), F.col("source")]).withColumn("weight", weights), "weights").df
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= cap * F.col("source_size")
        taken, open_weight = weighed.agg(F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - taken) / open_weight if open_weight else level
        if new == level or not open_weight:
            break
        level = new
    shared = F.lit(float(level or 0.0)) * F.col("weight")
    return weighed.withColumn("target", F.least(shared, cap * F.col("source_size").cast("double")))


def solve(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """(skey, scale, lam) per source: Newton on the dual. ``cells``: skey, size, n. ``goals``: skey, docs, source_size, target."""
    scale = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(1.0)
    start = goals.select(
        "skey", scale.alias("scale"), (F.col("target") / scale).alias("goal"), (F.col("target") >= cap * F.col("source_size")).alias("full"), F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    now = Stage(start.withColumn("done", F.col("full")), "dual")
    for _ in range(ROUNDS):
        tilt = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0)))
        joined = cells.join(now.df.where("not done").select("skey", "scale", "lam"), "skey").withColumn("x", F.col("size") / F.col("scale"))
        sums = joined.groupBy("skey").agg(
            F.sum(F.col("n") * F.least(F.lit(float(cap)), tilt) * F.col("x")).alias("got"),
            F.sum(F.when(tilt < cap, F.col("n") * tilt * F.col("x") * F.col("x")).otherwise(0.0)).alias("slope"),
        )
        miss = F.col("got") - F.col("goal")
        low = F.when(miss < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - miss / F.col("slope")
        # outside the bracket, or on a flat piece: halve the bracket, or widen it where it is open
        middle = F.when(F.col("low2").isNull(), F.col("high2") * 2 - 1).when(F.col("high2").isNull(), F.col("low2") * 2 + 1).otherwise((F.col("low2") + F.col("high2")) / 2)
        inside = (F.col("slope") > 0) & (step > F.coalesce("low2", F.lit(-math.inf))) & (step < F.coalesce("high2", F.lit(math.inf)))
        moved = (
            now.df.join(sums, "skey", "left")
            .withColumn("low2", low).withColumn("high2", high)
            .withColumn("ends", F.col("done") | F.coalesce(F.abs(miss) <= TOLERANCE * F.col("goal"), F.lit(True)))
            .select("skey", "scale", "goal", "full", F.when(F.col("ends"), F.col("lam")).when(inside, step).otherwise(middle).alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("ends").alias("done"))
        )
        before, now = now, Stage(moved, "dual")
        before.drop()
        if now.df.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"the dual did not settle in {ROUNDS} rounds")
    return now.df.select("skey", "scale", "full", F.round("lam", 9).alias("lam"))


def deal(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies ``m`` of each cell of one source, largest sizes first: what one cell misses, the next makes up for.

    The group is one row per distinct size (and slice), not per document.
    """
    cells = cells.sort_values(["size", "slice"], ascending=[False, True])
    due, got, out = 0.0, 0, []
    for n, size, rate in zip(cells["n"].tolist(), cells["size"].tolist(), cells["rate"].tolist()):
        due += n * rate * size
        wish = round(n * rate) if size == 0 else math.floor((due - got) / size + 0.5)
        m = min(max(wish, 0, math.floor(n * rate) - 1), CAP * n, math.ceil(n * rate) + 1)
        out.append(m)
        got += m * size
    return cells.assign(m=out)[["skey", "size", "slice", "n", "m", "source_size", "target"]]


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: tuple[int, ...] = CYCLE, share: float = SHARE, per_slice: int = PER_SLICE, tag: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to 2) and taken words of every row.

    Size: words of the whole text, null counts 0. Null is a source of its own. A source without words has target 0 and its
    rows keep one copy of nothing. Which of equal-sized documents get the odd copies follows a hash of the id, so reruns
    agree; rows that share an id are rows of their own. Cells of many equal sizes (a hot source of one repeated text) are
    cut into slices of about ``per_slice`` rows. An empty table gives no rows.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"), (F.lit(0) if tag is None else tag).alias("tag"))
    rows = named.select("doc_id", "source", "tag", word_count().alias("size"))
    sized = Stage(rows.withColumn("skey", key), "sizes").df
    counted = sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    # hot cells: at most rows / per_slice of them, three short columns each
    hot = counted.where(F.col("n") > per_slice).select("skey", "size", F.ceil(F.col("n") / per_slice).alias("slices"))
    sliced = sized.join(F.broadcast(hot), ["skey", "size"], "left").withColumn("slice", F.pmod(F.xxhash64("doc_id", "tag"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    cells = Stage(sliced.groupBy("skey", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "cells").df
    sources = cells.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")).withColumn(
        "source", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30))
    )
    goals = Stage(targets(sources, cycle, share), "targets").df
    dual = solve(cells, goals)
    rate = F.when(F.col("full"), F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    rated = cells.join(dual, "skey").join(goals.select("skey", "source_size", "target"), "skey").withColumn("rate", rate)
    dealt = rated.select("skey", "size", "slice", "n", "rate", "source_size", "target").groupBy("skey").applyInPandas(
        deal, "skey string, size long, slice int, n long, m long, source_size long, target double"
    )
    placed = sliced.withColumn("place", F.row_number().over(W.partitionBy("skey", "size", "slice").orderBy(F.xxhash64("doc_id"), "doc_id", "tag")))
    got = F.floor(F.col("m") / F.col("n")) + F.when(F.col("place") <= F.col("m") % F.col("n"), 1).otherwise(0)
    joined = placed.join(dealt, ["skey", "size", "slice"]).withColumn("copies", got.cast("int"))
    return joined.select("doc_id", *([] if tag is None else ["tag"]), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: tuple[int, ...] = CYCLE, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to 2 times).

    A row is known by a hash of all its columns, so shared and null ids do no harm. Rows that are equal in all columns stand
    for each other: one of them comes as often as the mix takes them together. An empty table gives no rows.
    """
    mark = row_hash(docs)
    dealt = copies(docs, id_col, source_col, text_col, cycle, share, tag=mark).groupBy(F.col("tag").alias("_mix_row")).agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows"))
    dealt = Stage(dealt, "dealt").df
    marked = docs.withColumn("_mix_row", mark)
    single = marked.join(dealt.where("_mix_copies > 0 and _mix_rows = 1"), "_mix_row").withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int"))))
    # repeats: their copies are dealt out a hundred at a time, so that one text taken very often is many tasks' work
    often = marked.join(F.broadcast(dealt.where("_mix_rows > 1").select("_mix_row")) if dealt.where("_mix_rows > 1").count() <= 50_000 else dealt.where("_mix_rows > 1").select("_mix_row"), "_mix_row", "left_semi")
    once = often.dropDuplicates(["_mix_row"]).join(dealt.where("_mix_copies > 0"), "_mix_row")
    parts = once.withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_mix_copies") - 1) / 100).cast("int")))).repartition("_mix_row", "_mix_part")
    many = parts.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(100), F.col("_mix_copies") - 100 * F.col("_mix_part")).cast("int"))))
    return single.select(*docs.columns).union(many.select(*docs.columns))
