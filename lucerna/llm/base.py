"""What the operators of this subpackage share: staged tables, input selection, query registration."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Executors need not have this package installed: the module's functions travel with the task."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def process_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one kind of work; the next kind's first task frees it.

    Functions travel by value, so their module's globals do not last. A worker serves many stages, and an executor's memory
    has no room for what stages before have left. Freed memory goes back to the system: neither Arrow's pool nor malloc does
    that by itself.
    """
    kept = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__
    if kept.get("_owner") != owner:
        for name in [n for n in kept if not str(n).startswith("__")]:
            del kept[name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)
        kept["_owner"] = owner
    return kept


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """A table written to the shared checkpoint folder: it cuts lineage and survives lost executors.

    ``rows_per_file`` is for rows of megabytes: a reader decodes up to 4096 rows of a file at once, whatever they hold.
    """

    def __init__(self, df: DataFrame, name: str, rows_per_file: int = 0):
        spark = df.sparkSession
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under internal names, so extra or clashing columns do no harm."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row: rows with the same one are taken for repeats of each other."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*plain)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, slices: int = 16, how: str = "left") -> DataFrame:
    """Join many rows to one row per key, every key spread over ``slices`` tasks.

    For a ``small`` side of few rows (one per source, say): it is repeated ``slices`` times, so a key that
    holds a third of ``big`` lands in that many tasks. Keys match as with ``<=>``: null meets null.
    """
    left = big.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
    right = small.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
    right = right.withColumnRenamed("_slice", "_rslice")
    on = left["_slice"] == F.col("_rslice")
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop("_slice", "_rslice", *[f"_r_{k}" for k in keys])


def join_sources(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, limit: int = 50_000) -> DataFrame:
    """Left join to one short row per key: broadcast where a count shows at most ``limit`` rows, else salted. Null meets null."""
    if small.count() > limit:
        return salted_join(big, small, keys, spread)
    for k in keys:
        small = small.withColumnRenamed(k, f"_r_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & big[k].eqNullSafe(small[f"_r_{k}"])
    return big.join(F.broadcast(small), on, "left").drop(*[f"_r_{k}" for k in keys])
