"""The registered queries on the given tables: SQL, and the pipeline's stages one after another."""

import duckdb

from lucerna.llm import queries as llm

TABLES = ["documents", "pages", "embeddings", "labels", "benchmark", "conversations"]


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in llm.ORACLES.items():
        got = llm.QUERIES[name](spark, sf)
        want = con.execute(sql)
        columns = sorted(got.columns)
        assert columns == sorted(c[0] for c in want.description)
        order = [c[0] for c in want.description]
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[order.index(c)] for c in columns) for r in want.fetchall())


def shingles(text):
    words = text.lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(a, b):
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, lines, near, mix, pack = [f for _, f in corpus_pipeline.STAGES]
    kept = quality(spark, docs, sf)
    cut = lines(spark, kept, sf)
    rows = cut.collect()
    assert cut.columns == docs.columns and len(rows) == kept.count() <= docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    one = near(spark, cut, sf).collect()
    assert len({r["doc_id"] for r in one}) == len(one)
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    stay = sorted(r["doc_id"] for r in one)
    assert not any(near_copies(sets[i], sets[j]) for k, i in enumerate(stay) for j in stay[:k])
    for i in set(sets) - set(stay):  # what went has a near copy of a smaller id, or one through others
        assert any(near_copies(sets[i], x) for j, x in sets.items() if j != i)
    mixed = mix(spark, spark.createDataFrame(one, docs.schema), sf)
    assert mixed.columns == docs.columns
    packed = pack(spark, mixed, sf)
    assert packed.where("start = 0").count() == mixed.count() and packed.agg({"length": "sum"}).first()[0] > 0
    assert len(llm.QUERIES) == 13
