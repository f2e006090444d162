"""Exact top-k search by distributed histogram selection.

All candidates are scored against a bounded part of the queries at a time. Each round counts the scores of every query in
equal bins over the interval that still holds its kth value, adds up the counts of all tasks, and narrows the interval to
the bin where the count from above reaches k; rounds end when bins are one score wide. A last round keeps what is above the
kth value and, of the rows tied with it, the smallest ids that are still wanted. Scores are computed again in every round
and never stored.

A task leaves out bins that lie below its own k largest scores, as the kth of all rows is at least as large. So a task
sends at most k counts for a query, whatever the table's size, and ties are cut to the wanted number before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm import vectors as vec
from lucerna.llm.base import pick, query, ship, table

ship(__name__)

K = 5
BINS = 512
PER_PASS = 4096
CELLS = 1_000_000  # scores a task holds at once
FOUND = "query_row long, query_id long, vec_id long, score long"


def _scored(batches: Iterator[pa.RecordBatch], asked: SimpleNamespace) -> Iterator[tuple]:
    """(queries, their rows' ids, scores, own) by blocks; ``own`` marks a query met by its own row."""
    for batch in batches:
        ids, rows = batch.column("id"), batch.column("row").to_numpy()
        for d, own, m in vec.by_length(batch):
            if d not in asked.by_length:
                continue
            queries, q = asked.by_length[d]
            step = max(1, CELLS // len(queries))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                itself = asked.row[queries][:, None] == rows[part][None, :]
                yield queries, ids.take(pa.array(part)), vec.inner_products(q, m[i : i + step]), itself


def _histogram(rows: DataFrame, shared, low: np.ndarray, width: np.ndarray, span: np.ndarray, need: np.ndarray, bins: int) -> DataFrame:
    """(query, bin, n, need): scores from ``low`` on, in bins of ``width``, below ``low + span``; bins that can't hold the kth are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        counts = np.zeros((len(asked.row), bins), dtype=np.int64)
        for queries, _, scores, itself in _scored(batches, asked):
            past = scores - low[queries][:, None]
            inside = (past >= 0) & (past < span[queries][:, None]) & ~itself
            at, col = np.nonzero(inside)
            q = queries[at]
            np.add.at(counts.reshape(-1), q * bins + past[at, col] // width[q], 1)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b]), pa.array(need[q])], ["query", "bin", "n", "need"])

    return rows.mapInArrow(run, "query int, bin int, n long, need long")


def _located(histogram: DataFrame) -> DataFrame:
    """(query, bin, above): the bin in which the count from above reaches what the query needs, and the count above that bin."""
    total = histogram.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    reach = F.sum("n").over(W.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
    return total.withColumn("reach", reach).where("reach >= need and reach - n < need").select("query", "bin", (F.col("reach") - F.col("n")).alias("above"))


def _taken(rows: DataFrame, shared, kth: np.ndarray, need: np.ndarray) -> DataFrame:
    """Candidates above each query's kth value, and of those tied with it the smallest ids of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for queries, ids, scores, itself in _scored(batches, asked):
            bound = kth[queries][:, None]
            take = (scores > bound) & ~itself
            tied = (scores == bound) & ~itself
            if tied.any():
                known = np.array([i is not None for i in ids.to_pylist()])
                order = np.lexsort((ids.fill_null(0).to_numpy(), ~known))  # ids ascending, nulls last
                sorted_ties = tied[:, order]
                take[:, order] |= sorted_ties & (sorted_ties.cumsum(axis=1) <= need[queries][:, None])
            at, col = np.nonzero(take)
            q = queries[at]
            yield pa.RecordBatch.from_arrays([pa.array(asked.row[q]), pa.array([asked.id[i] for i in q], pa.int64()), ids.take(pa.array(col)).cast(pa.int64()), pa.array(scores[at, col])], [c.split()[0] for c in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def select_top_k(rows: DataFrame, asked: SimpleNamespace, longest: float, k: int = K, bins: int = BINS) -> DataFrame:
    """The k best rows of (id, row, v) for each asked row, by rounds of histograms; ``longest`` bounds the length of every v."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(asked)
    reach = np.zeros(len(asked.row))
    for own, m in asked.by_length.values():
        reach[own] = np.sqrt((m * m).sum(axis=1)) * longest * (1 + 1e-9) + 1
    reach = np.minimum(reach, 2.0**62).astype(np.int64)
    low, span = -reach, 2 * reach + 1
    kth, need = -reach - 1, np.full(len(asked.row), k, dtype=np.int64)  # below all scores, where there are fewer than k
    open_ = np.ones(len(asked.row), dtype=bool)
    while open_.any():
        width = np.maximum(1, -(-span // bins))
        rounds = _located(_histogram(rows, shared, low, width, np.where(open_, span, 0), need, bins)).toArrow()
        q, b, above = (rounds.column(c).to_numpy() for c in ("query", "bin", "above"))
        open_ = np.zeros(len(asked.row), dtype=bool)
        open_[q] = True
        low[q] += b * width[q]
        need[q] -= above
        span[q] = width[q]
        done = q[width[q] == 1]
        kth[done] = low[done]
        open_[done] = False
    return _taken(rows, shared, kth, need)


def exact_top_k(table: DataFrame, asked: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, bins: int = BINS, per_pass: int = PER_PASS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(256 * x) for each row where ``asked`` holds.

    ``asked`` is a condition on ``id``. Candidates are all rows but the query's own; all come back where there are fewer
    than ``k``. Ties go to the smaller id, null ids last. Null vectors and those with null or non-finite components take no
    part; vectors of unequal length do not meet; vectors without components score 0. Rows that share an id are candidates
    each, and queries each. Repeated rows tie. An empty table gives no rows; other columns are ignored. A score beyond
    64 bits raises.
    """
    rows = vec.whole_vectors(pick(table, id=id_col, x=vector_col)).withColumn("id", F.col("id").cast("long"))
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()[0] or 0.0
    found = vec.Results(table.sparkSession, "top-k", FOUND)
    for part in vec.passes(rows, asked, per_pass):
        found.add(select_top_k(rows, part, longest, k, bins))
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.read().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


WHOLE_SQL = """
v AS (
  SELECT row_number() OVER () AS rn, vec_id, {label} list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {where}
)"""

ORACLE = f"""
WITH {WHOLE_SQL.format(label="", where="")},
s AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rn <> c.rn AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op12_exact_topk", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
