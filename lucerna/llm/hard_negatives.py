"""Hard negatives from candidate blocks along a Hilbert curve, chosen by zone maps.

1. Vectors are ordered by label and by their key on a Hilbert curve through the dimensions that vary most, and written as
   Parquet blocks of one label each. Every block has a zone map: the least and the largest value of each dimension.
2. Interval arithmetic on a zone map bounds the inner products of an anchor with all rows of a block. An anchor's positives
   are read from the blocks of its label whose upper bound reaches the score it already has from its most promising block.
3. The windows of its positives then choose the blocks of other labels whose interval of scores meets a window; only those
   are read, and each gives the first negatives of each window.

Blocks have a bounded number of rows, whatever their label, so a hot label or vector is many blocks. Anchors come a bounded
part at a time and are broadcast; blocks and zone maps stay where they are, and what a task returns for an anchor is bounded
by the numbers of positives and negatives asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm import vectors as vec
from lucerna.llm.base import Stage, pick, query, ship, table
from lucerna.llm.exact_topk import WHOLE_SQL
from lucerna.llm.packing import hilbert_keys
from lucerna.session import checkpoint_dir

ship(__name__)

POSITIVES = NEGATIVES = 5
SHARE = (80, 100)  # a negative has at least 80 of 100 parts of the positive's score
BLOCK_ROWS = 512
FILE_ROWS = 32 * BLOCK_ROWS
PER_PASS = 2048
DIMS, BITS = 8, 7
CELLS = 1_000_000
BLOCK = "label long, d int, rows array<long>, ids array<long>, v array<double>, lo array<double>, hi array<double>"
WANTED = "block long, file int, anchors array<int>"
NEAR = "anchor int, vec_id long, score long"
HELD = "anchor int, top long, vec_id long, score long"
MINED = "anchor_row long, anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"


def widest_dimensions(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vector: the dimensions of the largest variance, their means and deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, m in vec.by_length(batch):
                sums[d] = sums.get(d, 0) + np.stack([np.full(d, len(m), dtype=float), m.sum(axis=0), (m * m).sum(axis=0)])
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, dtype=np.int32)), pa.array(np.arange(d, dtype=np.int32)), *(pa.array(c) for c in s)], ["d", "dim", "n", "s", "ss"])

    found = rows.select("v").mapInArrow(run, "d int, dim int, n double, s double, ss double").groupBy("d", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    first = found.select("d", "dim", mean.alias("mean"), spread.alias("spread")).withColumn("nth", F.row_number().over(W.partitionBy("d").orderBy(F.desc("spread"), "dim"))).where(F.col("nth") <= DIMS)
    out: dict[int, list] = {}
    for r in first.orderBy("d", "nth").collect():
        out.setdefault(r["d"], []).append((r["dim"], round(r["mean"], 6), round(r["spread"], 6) or 1.0))
    return {d: tuple(np.array(c) for c in zip(*dims)) for d, dims in out.items()}


def with_curve(rows: DataFrame) -> DataFrame:
    """Adds ``d``, the vector's length, and ``curve``, its Hilbert key."""
    dims = widest_dimensions(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int32)
            for d, own, m in vec.by_length(batch):
                size[own] = d
                if d:
                    at, mean, spread = dims[d]
                    # the logistic curve stands for the normal one, so the grid's cells hold about equally many rows
                    grid = np.floor((1 << BITS) / (1 + np.exp(-1.702 * np.clip((m[:, at] - mean) / spread, -30, 30))))
                    key[own] = hilbert_keys(np.clip(grid, 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(key)], [*batch.schema.names, "d", "curve"])

    return rows.mapInArrow(run, "row long, id long, label long, v array<double>, d int, curve long")


class Blocks:
    """Candidate blocks in Parquet folders by file, so files without a wanted block are not read."""

    def __init__(self, rows: DataFrame, block_rows: int, file_rows: int):
        spark = rows.sparkSession
        files = max(1, -(-rows.count() // file_rows))
        ordered = with_curve(rows.select("row", "id", "label", "v")).repartitionByRange(files, "label", "d", "curve", "row").sortWithinPartitions("label", "d", "curve", "row")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                label, d = batch.column("label").to_numpy(), batch.column("d").to_numpy()
                starts = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (d[1:] != d[:-1])])
                for a, b in zip(starts, [*starts[1:], len(d)]):
                    for i in range(a, b, block_rows):
                        part = batch.slice(i, min(block_rows, b - i))
                        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                        zones = (v.min(axis=0), v.max(axis=0)) if v.size else (np.zeros(0), np.zeros(0))
                        lists = [part.column("row").to_pylist(), part.column("id").to_pylist(), v.ravel(), *zones]
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([label[i]], pa.int64()), pa.array([d[i]], pa.int32()), *(pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds))],
                            ["label", "d", "rows", "ids", "v", "lo", "hi"],
                        )

        self.path = f"{checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
        blocks = ordered.mapInArrow(cut, BLOCK).withColumn("block", F.monotonically_increasing_id()).withColumn("file", F.spark_partition_id())
        blocks.write.partitionBy("file").parquet(self.path)
        self.df = spark.read.schema(f"{BLOCK}, block long, file int").parquet(self.path)

    @property
    def zones(self) -> DataFrame:
        return self.df.select("block", "file", "label", "d", "lo", "hi")

    def read(self, wanted: DataFrame) -> DataFrame:
        """The wanted blocks with the numbers of the anchors that want them."""
        wanted = Stage(wanted, "wanted").df
        files = [r[0] for r in wanted.select("file").distinct().collect()]  # one number per ``file_rows`` rows
        return self.df.where(F.col("file").isin(files)).drop("lo", "hi").join(wanted.drop("file"), "block")


def score_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with any point between ``lo`` and ``hi``."""
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi))) + 0.5
    return up @ lo + down @ hi - slack, up @ hi + down @ lo + slack


def _bounded(batches: Iterator[pa.RecordBatch], asked: SimpleNamespace) -> Iterator[tuple]:
    """(block, file, label, anchors of its length, lower and upper bounds) of every zone map."""
    for batch in batches:
        for r in batch.to_pylist():
            if r["d"] in asked.by_length:
                anchors, q = asked.by_length[r["d"]]
                yield r["block"], r["file"], r["label"], anchors, *score_bounds(q, np.array(r["lo"], dtype=float), np.array(r["hi"], dtype=float))


def _wanted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["block", "file", "anchors"]
    )


def promising_blocks(zones: DataFrame, shared) -> DataFrame:
    """For each anchor the block of its own label with the largest upper bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = np.full(len(asked.row), -np.inf)
        where = np.zeros((len(asked.row), 2), dtype=np.int64)
        for block, file, label, anchors, _, upper in _bounded(batches, asked):
            better = (asked.label[anchors] == label) & (upper > best[anchors])
            best[anchors[better]] = upper[better]
            where[anchors[better]] = block, file
        found = np.flatnonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(best[found]), pa.array(where[found, 0]), pa.array(where[found, 1].astype(np.int32))], ["anchor", "upper", "block", "file"])

    each = zones.mapInArrow(run, "anchor int, upper double, block long, file int")
    one = each.groupBy("anchor").agg(F.max_by(F.struct("block", "file"), F.struct("upper", "block")).alias("at"))
    return one.groupBy("at.block", "at.file").agg(F.collect_list("anchor").alias("anchors")).select("block", "file", "anchors")


def reaching_blocks(zones: DataFrame, shared, floor: np.ndarray) -> DataFrame:
    """Blocks of the anchor's label whose upper bound is at least the anchor's ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for block, file, label, anchors, _, upper in _bounded(batches, asked):
            take = anchors[(asked.label[anchors] == label) & (upper >= floor[anchors])]
            if len(take):
                yield _wanted([(block, file, take)])

    return zones.mapInArrow(run, WANTED)


def window_blocks(zones: DataFrame, shared, least: np.ndarray, top: np.ndarray) -> DataFrame:
    """Blocks of other labels whose scores may fall in one of the anchor's windows (rows of ``least`` and ``top``, padded with NaN)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for block, file, label, anchors, lower, upper in _bounded(batches, asked):
            meets = ((upper[:, None] >= least[anchors]) & (lower[:, None] <= top[anchors])).any(axis=1)
            take = anchors[(asked.label[anchors] != label) & meets]
            if len(take):
                yield _wanted([(block, file, take)])

    return zones.mapInArrow(run, WANTED)


def _read_scores(batches: Iterator[pa.RecordBatch], asked: SimpleNamespace) -> Iterator[tuple]:
    """(anchors, ids in ascending order with nulls last, scores, own) of every wanted block."""
    for batch in batches:
        for r in range(batch.num_rows):
            rows = np.array(batch.column("rows")[r].as_py(), dtype=np.int64)
            ids = batch.column("ids")[r].values
            wanting = np.array(batch.column("anchors")[r].as_py(), dtype=np.int64)
            d = batch.column("d")[r].as_py()
            m = batch.column("v")[r].values.to_numpy(zero_copy_only=False).reshape(len(rows), d)
            order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            ids, rows, m = ids.take(pa.array(order)), rows[order], m[order]
            all_anchors, q = asked.by_length[d]
            step = max(1, CELLS // len(rows))
            for i in range(0, len(wanting), step):
                anchors = wanting[i : i + step]
                scores = vec.inner_products(q[np.searchsorted(all_anchors, anchors)], m)
                yield anchors, ids, scores, asked.row[anchors][:, None] == rows[None, :]


def _first(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest valid entries of each row, ties to the earlier column."""
    least = np.iinfo(np.int64).min
    held = np.where(valid, scores, least)
    order = np.argsort(-held.astype(np.float64) if np.abs(scores).max(initial=0) < vec.EXACT else ~held, axis=1, kind="stable")[:, :k]
    at = np.repeat(np.arange(len(scores)), order.shape[1])
    col = order.ravel()
    keep = valid[at, col]
    return at[keep], col[keep]


def nearest(read: DataFrame, shared, k: int) -> DataFrame:
    """(anchor, vec_id, score): the k best other rows of every block for the anchors that want it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for anchors, ids, scores, own in _read_scores(batches, asked):
            at, col = _first(scores, ~own, k)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[at].astype(np.int32)), ids.take(pa.array(col)), pa.array(scores[at, col])], ["anchor", "vec_id", "score"])

    best = W.partitionBy("anchor").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return read.mapInArrow(run, NEAR).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def held_in_windows(read: DataFrame, shared, least: np.ndarray, top: np.ndarray, k: int) -> DataFrame:
    """(anchor, top, vec_id, score, rank): the k best rows of each window, a window named by its upper end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for anchors, ids, scores, own in _read_scores(batches, asked):
            for w in range(top.shape[1]):
                lo, hi = least[anchors, w][:, None], top[anchors, w][:, None]
                at, col = _first(scores, (scores >= lo) & (scores <= hi) & ~own, k)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors[at].astype(np.int32)), pa.array(top[anchors[at], w].astype(np.int64)), ids.take(pa.array(col)), pa.array(scores[at, col])], ["anchor", "top", "vec_id", "score"]
                    )

    best = W.partitionBy("anchor", "top").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return read.mapInArrow(run, HELD).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def windows_of(positives: pa.Table, n: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of every anchor: whole scores s with share[0] * p <= share[1] * s <= share[1] * p. None where p is negative."""
    per: list[set[int]] = [set() for _ in range(n)]
    for anchor, p in zip(positives.column("anchor").to_pylist(), positives.column("score").to_pylist()):
        if -(-share[0] * p // share[1]) <= p:
            per[anchor].add(p)
    wide = max(1, max(map(len, per), default=1))
    top, least = np.full((n, wide), np.nan), np.full((n, wide), np.nan)
    for i, own in enumerate(per):
        for w, p in enumerate(sorted(own)):
            top[i, w], least[i, w] = p, -(-share[0] * p // share[1])
    return least, top


def hard_negatives(
    table: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    share: tuple[int, int] = SHARE, block_rows: int = BLOCK_ROWS, file_rows: int = FILE_ROWS, per_pass: int = PER_PASS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row where ``anchors`` (on ``id``) holds.

    Scores are inner products of floor(256 * x). A positive is one of the first ``positives`` other rows of the anchor's
    label; its negatives are the first rows of other labels whose score is between ``share`` of the positive's and the
    positive's. Larger scores come first, ties by smaller id, null ids last. All rows come back where there are fewer than
    asked for, and a positive without negatives has no row. Rows with a null label, and null vectors or such with null or
    non-finite components, take no part. Vectors of unequal length do not meet; without components they score 0. Rows
    that share an id are told apart, each may be anchor, positive and negative. An empty table gives no rows; other columns
    are ignored. A score of 2^53 or more may open its window by rounding; one beyond 64 bits raises.
    """
    spark = table.sparkSession
    named = pick(table, id=id_col, x=vector_col, label=label_col).where("label is not null")
    rows = vec.whole_vectors(named.select(F.col("id").cast("long").alias("id"), "x", F.col("label").cast("long").alias("label")))
    blocks = Blocks(rows, block_rows, file_rows)
    mined = vec.Results(spark, "negatives", MINED)
    for asked in vec.passes(rows, anchors, per_pass):
        shared = spark.sparkContext.broadcast(asked)
        probe = nearest(blocks.read(promising_blocks(blocks.zones, shared)), shared, positives).where(F.col("rank") == positives).select("anchor", "score").toArrow()
        floor = np.full(len(asked.row), -np.inf)
        floor[probe.column("anchor").to_numpy()] = probe.column("score").to_numpy()
        chosen = Stage(nearest(blocks.read(reaching_blocks(blocks.zones, shared, floor)), shared, positives), "positives").df
        least, top = windows_of(chosen.select("anchor", "score").toArrow(), len(asked.row), share)
        held = held_in_windows(blocks.read(window_blocks(blocks.zones, shared, least, top)), shared, least, top, negatives)
        own = spark.createDataFrame([(i, int(r), x) for i, (r, x) in enumerate(zip(asked.row, asked.id))], "anchor int, anchor_row long, anchor_id long")
        pairs = chosen.select("anchor", F.col("vec_id").alias("positive_id"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score"))
        found = held.select("anchor", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        mined.add(pairs.join(found, ["anchor", "positive_score"]).join(own, "anchor").select(*[c.split()[0] for c in MINED.split(", ")]))
    return mined.read().select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH {WHOLE_SQL.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,", where="AND label IS NOT NULL")},
s AS (
  SELECT a.rn, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rn <> c.rn AND len(a.v) = len(c.v)
  WHERE a.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.rn, p.nth ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON p.rn = s.rn
  WHERE p.nth <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op11_hard_negatives", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("id") % 100 == 0)
