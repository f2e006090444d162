"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROWS_PER_SLICE = 500_000
HEAVY_ROWS_PER_TASK = 1_000


def join_on_hot_key(
    big: DataFrame, small: DataFrame, keys: list[str], weight: str | None, spread: str, how: str = "left", rows_per_slice: int = ROWS_PER_SLICE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to one row per key, splitting the keys that hold too many rows.

    ``small`` has one row per key and ``weight``, the number of ``big`` rows of that key. A key
    above ``rows_per_slice`` is cut into ``ceil(weight / rows_per_slice)`` slices: its small row is
    repeated per slice and its big rows are spread by a hash of ``spread``. The broadcast list holds
    only the hot keys, at most ``rows(big) / rows_per_slice`` of them, so its size is bounded.

    Without ``weight`` the keys of ``big`` itself are counted, so a key that ``small`` lacks is split too, and rows
    with a NULL key, which meet nothing, are spread. ``counted`` has the same keys and rows as ``big`` and a shorter way to them:
    where ``big`` is itself a chain of joins, counting it would run and plan the chain once more for every link.
    """
    if weight is None:
        counts = (big if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_slice)
        hot = counts.select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_slice)).cast("bigint").alias("_slices"))
        no_key = F.lit(False)
        for k in keys:
            no_key = no_key | F.col(k).isNull()
        slices = F.when(no_key, F.lit(1 << 20)).otherwise(F.coalesce("_slices", F.lit(1))).cast("bigint")
        left = big.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.pmod(F.xxhash64(spread), slices)).drop("_slices")
        right = small.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
        return left.join(right, [*keys, "_slice"], how).drop("_slice")
    n = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(rows_per_slice)))
    hot = small.where(F.col(weight) > rows_per_slice).select(*keys, n.alias("_slices"))
    left = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(spread), F.coalesce("_slices", F.lit(1)).cast("bigint"))
    ).drop("_slices")
    right = small.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))).drop(weight)
    return left.join(right, [*keys, "_slice"], how).drop("_slice")


def first_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "_rank") -> DataFrame:
    """First k rows per key. The rank filter becomes a per-partition group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def ensure_parallelism(df: DataFrame, key: str, rows_per_task: int = HEAVY_ROWS_PER_TASK) -> DataFrame:
    """Deal CPU-heavy rows out evenly: a task gets about ``rows_per_task`` of them, however the input's files are cut.

    The splits of a scan say little: a file of one row group is one task, whatever its size and the number of its splits. Tasks
    grow in number with the rows and not in length, and with them what a Python worker is sent at once. A table that is one
    task's work at most is left alone where it has splits enough.
    """
    cores, rows = df.sparkSession.sparkContext.defaultParallelism, df.count()
    if rows <= rows_per_task and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, -(-rows // rows_per_task)), key)
