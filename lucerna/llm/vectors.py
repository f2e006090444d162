"""Integer vectors, exact inner products of them, and what the searches over them share."""

from __future__ import annotations

import math
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.base import Stage, ship
from lucerna.session import checkpoint_dir

ship(__name__)

SCALE = 256
EXACT = 2.0**53  # whole numbers below it are exact in double precision


def whole_vectors(rows: DataFrame, name: str = "vectors") -> DataFrame:
    """A written table of the ``rows`` with a sound vector ``x``: the other columns, ``row`` (unique) and ``v``.

    ``v`` holds floor(256 * x), x in double precision. Null vectors and those with a null or non-finite component are
    left out. Rows are told apart by ``row``, so shared and null ids do no harm.
    """
    rows = rows.withColumn("x", F.col("x").cast("array<double>")).where("x is not null")
    sound = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)))
    whole = F.transform("x", lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return Stage(sound.withColumn("v", whole).drop("x").withColumn("row", F.monotonically_increasing_id()), name).df


def by_length(batch: pa.RecordBatch | pa.Table, column: str = "v"):
    """(length, row numbers, matrix) for each length of vector in a batch."""
    lists = batch.column(column)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        yield int(d), own, flat[at[own][:, None] + np.arange(d)[None, :]].reshape(len(own), d)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exact, as 64-bit integers. A score beyond 64 bits raises."""
    if not len(a) or not len(b) or a.shape[1] == 0:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < EXACT:
        return (a @ b.T).astype(np.int64)
    # few vectors hold such components; Python's integers take any size and fail to convert beyond 64 bits
    big_a, big_b = ([[int(c) for c in row] for row in m] for m in (a, b))
    return np.array([[sum(x * y for x, y in zip(p, q)) for q in big_b] for p in big_a], dtype=np.int64)


def asked_rows(table: pa.Table) -> SimpleNamespace:
    """A bounded number of rows whose vectors all tasks compare with their own: plain values, as they are broadcast."""
    label = table.column("label").to_numpy() if "label" in table.column_names else None
    return SimpleNamespace(row=table.column("row").to_numpy(), id=table.column("id").to_pylist(), label=label, by_length={d: (own, m) for d, own, m in by_length(table)})


def passes(vectors: DataFrame, asked, per_pass: int):
    """The rows for which ``asked`` holds, about ``per_pass`` at a time, each part once; at most a part is on the driver."""
    rows = vectors.where(asked)
    parts = -(-rows.count() // per_pass)
    for p in range(parts):
        part = asked_rows(rows.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).toArrow())
        if len(part.row):
            yield part


class Results:
    """Rows of all passes, appended to one table in the shared folder, so the plan does not grow with the passes."""

    def __init__(self, spark, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
