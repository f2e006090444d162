"""Approximate nearest neighbours by NN-descent and greedy graph search.

Vectors that are equal form one class, so copies cost nothing. The neighbour graph of the classes starts from random
hyperplane leaves and is improved in rounds: the neighbours of a node (its own, and those that name it) meet in a Spark
join, are compared with each other, and pairs in which one is new are offered to both. Rounds end when few edges change.

Inner products of vectors of unequal length obey no triangle inequality, so the graph lives in a space with one more
coordinate, which makes all lengths equal; nearness there is the angle. Searches score by the inner product itself. Each
hop expands all unexpanded nodes of every query's beam in one join and ends when no beam has any. A query of the table
starts at its own node. Results are scored again in double precision on the original vectors and expanded to rows.

Every row is indexed. ``k``, ``reverse`` and ``offers`` bound the graph's degree and a round's offers, as the method does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm.base import Stage, join_sources, pick, query, ship, staged, table
from lucerna.operators.skew import join_on_hot_key

ship(__name__)

K = 32
REVERSE = 32
OFFERS = 10
LEAF, TREES, LEAF_OFFERS = 1024, 32, 5
ROUNDS, SETTLED = 6, 0.02
BEAM, EXPAND = 80, 40
HOPS = 12
NEIGHBOUR = "array<struct<score:float,nbr:bigint,fresh:boolean>>"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long float lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(id, x) that take part: finite, not zero, no null in them, and of the commonest length."""
    x = F.col("x").cast("array<double>")
    rows = vectors.where("id is not null and x is not null").select("id", x.alias("x"))
    sound = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists("x", lambda v: v != 0))
    sizes = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return sound.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every distinct id and vector, and (id, x) of the classes of equal vectors, whose ids are hashes of the vector."""
    key = F.sha2(F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))), 256)
    keyed = Stage(vectors.withColumn("key", key).dropDuplicates(["id", "key"]), "vectors").df
    seed = 0
    while True:
        counted = staged(keyed.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n")).withColumn("node", F.xxhash64("key", F.lit(seed))), "classes")
        if counted.groupBy("node").count().where("count > 1").isEmpty():
            break
        seed += 1  # two vectors with one hash: another one parts them
    member = Stage(join_on_hot_key(keyed.select("id", "key"), counted.select("key", "n", "node"), ["key"], "n", "id").select("id", F.col("node").alias("rep")), "members").df
    return member, counted.select(F.col("node").alias("id"), "x")


def prepared(reps: DataFrame) -> DataFrame:
    """(id, vec): 16-bit floats, scaled to length at most one, the last coordinate filling it up to one."""
    longest = reps.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("x")) / longest
                rest = np.sqrt(np.maximum(0.0, 1.0 - (m * m).sum(axis=1)))
                full = np.concatenate([m, np.where(rest < 1e-3, 0.0, rest)[:, None]], axis=1).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in full], pa.binary())], ["id", "vec"])

    return reps.mapInArrow(run, "id long, vec binary")


def _vectors(column) -> np.ndarray:
    """Equally long binary values as a matrix of 32-bit floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float16).reshape(len(values), -1).astype(np.float32)


def _best(scores: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``take`` largest finite entries of each row."""
    take = min(take, scores.shape[1])
    at = np.argpartition(-scores, take - 1, axis=1)[:, :take]
    row = np.repeat(np.arange(len(scores)), take)
    col = at.ravel()
    keep = np.isfinite(scores[row, col])
    return row[keep], col[keep]


def leaf_candidates(vecs: DataFrame, n: int, trees: int = TREES, leaf: int = LEAF, take: int = LEAF_OFFERS) -> DataFrame:
    """(id, nbr, score) of the nearest within leaves of about ``leaf`` vectors, one leaf per tree and vector.

    A leaf is a set of signs against random hyperplanes; a leaf that many vectors share is split at random.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / leaf))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _vectors(batch.column("vec"))
            planes = np.random.Generator(np.random.PCG64(7)).standard_normal((trees, m.shape[1], max(1, bits)))
            for t in range(trees):
                code = ((m @ planes[t] > 0) @ (1 << np.arange(max(1, bits)))).astype(np.int64) if bits else np.zeros(len(m), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, dtype=np.int32)), pa.array(code), batch.column("id"), batch.column("vec")], ["tree", "code", "id", "vec"])

    coded = vecs.mapInArrow(sign, "tree int, code long, id long, vec binary")
    parts = coded.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("parts"))
    split = join_sources(coded, staged(parts, "leaves"), ["tree", "code"], F.col("id")).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))

    def within(group: pa.Table) -> pa.Table:
        ids, m = group.column("id").to_numpy(), _vectors(group.column("vec"))
        if len(ids) < 2:
            return pa.table({"id": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "score": pa.array([], pa.float32())})
        scores = m @ m.T
        np.fill_diagonal(scores, -np.inf)
        row, col = _best(scores, take)
        return pa.table({"id": ids[row], "nbr": ids[col], "score": scores[row, col].astype(np.float32)})

    return split.select("tree", "code", "part", "id", "vec").groupBy("tree", "code", "part").applyInArrow(within, "id long, nbr long, score float")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """(id, nb): the best ``k`` of (id, nbr, score, fresh) per id; an edge known before is not fresh."""
    # one shuffle by id serves both groupings
    once = rows.repartition("id").groupBy("id", "nbr").agg(F.max("score").alias("score"), F.bool_and("fresh").alias("fresh"))
    listed = once.groupBy("id").agg(F.collect_list(F.struct("score", "nbr", "fresh")).alias("nb"))
    return listed.select("id", F.slice(F.sort_array("nb", asc=False), 1, k).cast(NEIGHBOUR).alias("nb"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("id", F.inline("nb"))


def _back(edges: DataFrame, reverse: int) -> DataFrame:
    """The nearest ``reverse`` of the nodes that name a node."""
    return edges.withColumn("place", F.row_number().over(W.partitionBy("nbr").orderBy(F.desc("score"), "id"))).where(F.col("place") <= reverse)


def descend(graph: DataFrame, vecs: DataFrame, k: int, reverse: int, offers: int) -> DataFrame:
    """One round: neighbours of a node meet, and what they find better than their worst neighbour is merged in."""
    edges = _edges(graph)
    back = _back(edges, reverse)
    meet = edges.select(F.col("id").alias("node"), F.col("nbr").alias("id"), "fresh").union(back.select(F.col("nbr").alias("node"), "id", "fresh"))
    meet = meet.groupBy("node", "id").agg(F.bool_or("fresh").alias("fresh"))
    worst = F.when(F.size("nb") < k, F.lit(float("-inf"))).otherwise(F.element_at("nb", -1)["score"]).cast("float")
    known = vecs.join(graph.select("id", worst.alias("worst")), "id")
    met = meet.join(known, "id").groupBy("node").agg(F.collect_list(F.struct("id", "vec", "worst", "fresh")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            ids, worst = flat.field("id").to_numpy(), flat.field("worst").to_numpy()
            fresh, m = flat.field("fresh").to_numpy(zero_copy_only=False), _vectors(flat.field("vec"))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out: list[list] = [[], [], []]
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                scores = m[a:b] @ m[a:b].T
                new = fresh[a:b, None] | fresh[None, a:b]
                scores[~new | (scores <= worst[a:b, None])] = -np.inf
                np.fill_diagonal(scores, -np.inf)
                row, col = _best(scores, offers)
                out[0].append(ids[a:b][row]), out[1].append(ids[a:b][col]), out[2].append(scores[row, col])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(np.float32))], ["id", "nbr", "score"])

    offered = met.select("members").mapInArrow(compare, "id long, nbr long, score float").withColumn("fresh", F.lit(True))
    return _top(edges.select("id", "nbr", "score", F.lit(False).alias("fresh")).union(offered), k)


def build_graph(vecs: DataFrame, k: int = K, reverse: int = REVERSE, offers: int = OFFERS, rounds: int = ROUNDS, settled: float = SETTLED, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(id, nb) of (id, vec): approximately the ``k`` nearest of every node, best first."""
    n = vecs.count()
    now = Stage(_top(leaf_candidates(vecs, n, trees, leaf).withColumn("fresh", F.lit(True)), k), "graph")
    for _ in range(rounds):
        before, now = now, Stage(descend(now.df, vecs, k, reverse, offers), "graph")
        before.drop()
        changed = _edges(now.df).where("fresh").count()
        if changed <= settled * n * k:
            break
    return now.df


def search(starts: DataFrame, graph: DataFrame, vecs: DataFrame, beam: int = BEAM, expand: int = EXPAND, reverse: int = REVERSE, hops: int = HOPS) -> DataFrame:
    """(query, nbr) of each query's beam after a greedy search. ``starts``: query, vec, start (nodes to begin at).

    Edges are followed both ways. A hop expands the unexpanded nodes among the best ``expand`` of the beam.
    """
    edges = _edges(graph)
    both = edges.select("id", "nbr").union(_back(edges, reverse).select(F.col("nbr").alias("id"), F.col("id").alias("nbr")))
    adjacent = Stage(both.groupBy("id").agg(F.collect_set("nbr").alias("to")), "adjacent").df

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _vectors(batch.column("qvec"))[:, :-1], _vectors(batch.column("vec"))[:, :-1]
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array((a * b).sum(axis=1))], ["query", "id", "score"])

    def scored(asked: DataFrame) -> DataFrame:
        """(query, id, score) of (query, qvec, id)."""
        return asked.join(vecs, "id").select("query", "qvec", "id", "vec").mapInArrow(score, "query long, id long, score float")

    def listed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("query").agg(F.collect_list(F.struct("score", F.col("id").alias("nbr"), F.lit(True).alias("fresh"))).alias("found"))

    first = starts.select("query", F.col("vec").alias("qvec"), F.explode("start").alias("id"))
    empty = F.array().cast(NEIGHBOUR)
    state = Stage(
        starts.join(listed(scored(first)), "query", "left").select("query", F.col("vec").alias("qvec"), F.coalesce(F.slice(F.sort_array("found", asc=False), 1, beam), empty).alias("beam"), F.col("start").alias("seen")), "search"
    )
    for _ in range(hops):
        open_nodes = state.df.select("query", F.explode(F.filter(F.slice("beam", 1, expand), lambda e: e["fresh"])).alias("e")).select("query", F.col("e.nbr").alias("id"))
        reached = open_nodes.join(adjacent, "id").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("reached"))
        step = state.df.join(reached, "query").withColumn("new", F.array_except("reached", "seen"))
        step = Stage(step.select("query", "qvec", "beam", F.concat("seen", "new").alias("seen"), "new"), "hop")
        found = listed(scored(step.df.select("query", "qvec", F.explode("new").alias("id"))))
        # what the hop expanded is no longer fresh; what lies beyond the best stays so
        old = F.transform("beam", lambda e, i: F.struct(e["score"].alias("score"), e["nbr"].alias("nbr"), (e["fresh"] & (i >= expand)).alias("fresh")))
        merged = F.slice(F.sort_array(F.concat(old, F.coalesce("found", empty)), asc=False), 1, beam).cast(NEIGHBOUR)
        moved = step.df.join(found, "query", "left").select("query", "qvec", merged.alias("beam"), "seen")
        done = state.df.join(step.df.select("query"), "query", "left_anti").select("query", "qvec", old.cast(NEIGHBOUR).alias("beam"), "seen")
        before, state = state, Stage(moved.union(done), "search")
        before.drop(), step.drop()
        if state.df.where(F.exists(F.slice("beam", 1, expand), lambda e: e["fresh"])).isEmpty():
            break
    return state.df.select("query", F.explode("beam").alias("e")).select("query", F.col("e.nbr").alias("nbr"))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, k: int = K, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows found nearest (by inner product) to each row that ``is_query`` marks.

    Candidates are all rows but the query's own; ties go to the smaller id. Rows without an id, and vectors that are null,
    zero, of another length than most, or hold null or non-finite components, take no part. Rows that share an id and a
    vector count once; those that share an id and differ in the vector are candidates and queries each. Fewer candidates
    give fewer rows, an empty table none. ``is_query`` is a condition on a column ``id``.
    """
    member, reps = classes_of(valid_vectors(pick(vectors, id=id_col, x=vector_col)))
    reps = Stage(reps, "reps").df
    vecs = Stage(prepared(reps), "vecs").df
    graph = build_graph(vecs, k=k, rounds=rounds)
    asked = Stage(member.where(is_query), "asked").df
    # a query starts at its own node
    query_classes = asked.select("rep").distinct()
    starts = query_classes.join(vecs, query_classes["rep"] == vecs["id"]).select(F.col("rep").alias("query"), "vec", F.array("rep").alias("start"))
    beams = search(starts, graph, vecs, beam)
    pairs = beams.union(query_classes.select("rep", F.col("rep"))).distinct()
    ours, theirs = reps.select(F.col("id").alias("query"), F.col("x").alias("qx")), reps.select(F.col("id").alias("nbr"), "x")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = np.einsum("ij,ij->i", _matrix(batch.column("qx")), _matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("nbr"), pa.array(value)], ["query", "nbr", "score"])

    scored = pairs.join(theirs, "nbr").join(ours, "query").select("query", "nbr", "qx", "x").mapInArrow(exact, "query long, nbr long, score double")
    # of a class only its first ids can be among the nearest of a query
    first = member.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("place") <= top + 1).select(F.col("rep").alias("nbr"), F.col("id").alias("vec_id"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "nbr")
    rows = scored.join(first, "nbr").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1)
    lists = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "nbr"))).alias("list"), F.count(F.lit(1)).alias("one"))
    sizes = asked.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("rep", "query")
    weighed = staged(lists.drop("one").join(sizes, "query").select(F.col("query").alias("rep"), "list", "n"), "lists")
    own = join_on_hot_key(asked, weighed, ["rep"], "n", "id", how="inner")
    others = F.slice(F.filter("list", lambda e: (e["vec_id"] != F.col("id")) | (e["nbr"] != F.col("rep"))), 1, top)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.minus")).alias("score"))


@query("op1_nn_descent")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
