"""Near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common neighbour within half of it. Every distinct fingerprint therefore
emits all variants within half the radius and meets its partners on a shared variant. A variant meets at most the
fingerprints of its own ball (65 for radius 2), so no bucket grows with the data. All members of a bucket lie within
the radius of each other; a chain through the bucket in sorted order links them without listing all pairs. Links are
deduplicated, verified on the fingerprints and joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm.base import Stage, pick, query, salted_join, ship, table
from lucerna.operators.skew import join_on_hot_key

ship(__name__)

RADIUS = 2
SHINGLE = 3
SEED = 42
_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats counted; zero without words."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    start = [0, *(end[:-shingle] + 1).tolist()]
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(start, end[shingle - 1 :].tolist())], dtype="<u8")
    byte = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    count = np.bincount(byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(((2 * count.ravel() > len(hashes)).astype(object) << np.arange(64).astype(object)).sum())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and signed 64-bit ``fp`` of (doc_id, text). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def ball(half: int) -> list[int]:
    """Masks of at most ``half`` set bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of class ids, a > b, that join all classes within ``radius`` bits. ``classes``: distinct fp, rep."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is the variants' distance")
    ball_rows = classes.select("fp", "rep", F.explode(F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])).alias("mask"))
    variants = ball_rows.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep")
    bucket = W.partitionBy("variant").orderBy("fp")
    met = variants.select("fp", "rep", F.lag("fp").over(bucket).alias("fp2"), F.lag("rep").over(bucket).alias("rep2")).where("fp2 is not null")
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    return near.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """One round on (a, b), a > b: neighbours above a node move to its smallest neighbour, then those below."""
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    smallest = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    # a hub may hold a large share of the edges, so its rows are spread
    up = salted_join(both, smallest, ["node"], F.col("other"), slices=8, how="inner").where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()
    lowest = F.min("b").over(W.partitionBy("a"))
    down = up.select("a", "b", lowest.alias("low"))
    return down.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge but the roots themselves.

    Each round is a table, so lineage stays short.
    """
    now = Stage(edges, "links")
    seen = None
    for _ in range(max_rounds):
        state = tuple(now.df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())
        if state == seen or not state[0]:
            return now.df.toDF("node", "root")
        seen, before = state, now
        now = Stage(_star(before.df), "links")
        before.drop()
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, rows_per_slice: int = 500_000) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id reachable over links of at most ``radius`` bits.

    Null and empty texts and texts without words have fingerprint zero and link like any other. A row without an id
    belongs to no component: its component_id is null. Rows that share an id get a row each. An empty table gives no rows.
    """
    fps = Stage(fingerprints(pick(docs, doc_id=id_col, text=text_col), shingle), "fingerprints").df
    classes = Stage(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes").df
    roots = components(links(classes, radius))
    labelled = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    joined = join_on_hot_key(fps, labelled, ["fp"], "n", "doc_id", rows_per_slice=rows_per_slice)
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group. Of rows that share an id one stays; rows without an id all stay."""
    found = Stage(near_duplicates(docs, id_col, text_col, radius), "groups").df.where("doc_id is not null")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keep_id"))
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(keep.distinct(), named[id_col] == F.col("_keep_id"), "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.union(docs.where(F.col(id_col).isNull()))
