"""Work that grows with the tables: how it is dealt out, and what it must not lose or repeat."""

from pyspark.sql import functions as F


def test_heavy_rows_are_dealt_out_by_their_number(spark, tmp_path):
    from lucerna.operators.skew import HEAVY_ROWS_PER_TASK, ensure_parallelism

    rows = 8 * HEAVY_ROWS_PER_TASK
    # one file of one row group: many splits, one of them with all rows
    spark.range(rows).selectExpr("id as page_id", "repeat(cast(id as string), 20) as html").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scan = spark.read.parquet(str(tmp_path / "one"))
        assert scan.rdd.getNumPartitions() >= 4
        dealt = ensure_parallelism(scan, "page_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in dealt) == rows and max(r["count"] for r in dealt) < 2 * HEAVY_ROWS_PER_TASK


def test_pages_are_dealt_out_before_they_are_edited(spark, tmp_path):
    from lucerna.operators.skew import HEAVY_ROWS_PER_TASK
    from lucerna.plans import corpus

    rows = 8 * HEAVY_ROWS_PER_TASK
    spark.range(rows).selectExpr("id as page_id", "concat('https://a.example/', id) as url", "'<html><body>x</body></html>' as html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    for source in (corpus.mutated, corpus.earlier, corpus.later, corpus.with_statements):
        pages = source(spark, str(tmp_path))
        dealt = pages.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in dealt) < 2 * HEAVY_ROWS_PER_TASK
    assert corpus.mutated(spark, str(tmp_path)).select("page_id").distinct().count() == rows


def test_letters_are_counted_one_by_one(spark):
    from lucerna.functions import patterns as P
    from lucerna.operators.evidence import _count_re

    texts = ["", "abc", "שלום abc", "a1 b2\nc3", "\U0001f600x\U0001f600", "مرحبا é A", "123"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for letters in (P.HEBREW, P.ARABIC, P.LATIN):
        got = df.selectExpr("s", f"{_count_re('s', letters)} as n", f"regexp_count(s, {P.lit(letters)}) as want").collect()
        assert all(r["n"] == r["want"] for r in got)


def test_statement_flags_without_their_letters(spark):
    from lucerna.functions import patterns as P
    from lucerna.operators.site import statement_flags

    pad = " filler" * 20
    texts = ["WCAG AA" + pad, "mail a@b.co" + pad, "רכז נגישות: ישראל ישראלי 03-1234567" + pad, "מגבלות נגישות, ניתן לנווט, נבדק 2024, עודכן ההצהרה 2023" + pad, "נבדק@" + pad, "short"]
    plain = [f"t rlike {P.lit(p)} as {k}" for k, p in P.STATEMENT_AUDIT]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{statement_flags('t')} as f", *plain).collect():
        assert r["f"] is None if r["t"] == "short" else all(r["f"][k] == r[k] for k, _ in P.STATEMENT_AUDIT)


def test_documents_are_searched_only_where_a_match_can_be(spark):
    from lucerna.functions import patterns as P
    from lucerna.operators.documents import text_facts

    texts = ["", "no match", "mail a@b.co and c.d@e.org", "ראה בטבלה מימין\n- item", "לחצו הכפתור האדום, x@y.org\r\nהכפתור האדום", "@ only", None]
    facts = text_facts(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = facts.selectExpr("text", "transform(links, x -> x.text) as links", "transform(sensory_phrases, x -> x.match) as phrases", f"regexp_extract_all(text, {P.lit('(' + P.EMAIL + ')')}, 1) as mails", f"regexp_extract_all(text, {P.lit('(' + P.DOC_SENSORY + ')')}, 1) as found")
    rows = got.collect()
    assert all(r["links"] == r["mails"] and r["phrases"] == r["found"] for r in rows) and sum(len(r["found"]) for r in rows[:-1]) == 3
    plan = facts.select("links", "sensory_phrases")._jdf.queryExecution().optimizedPlan().toString()
    assert "instr(" in plan and "NOT RLIKE" in plan.upper()


def test_domain_standing_meets_proofs_by_domain(spark):
    from lucerna.operators.policy import allow_listed, domain_standing

    hosts = spark.range(600).selectExpr("id as page_id", "case id % 3 when 0 then 'a.x.org' when 1 then 'x.org' else 'evilx.org' end as host")
    proofs = spark.range(500).selectExpr("id + 5 as created_at", "if(id % 2 = 0, 'x.org', 'a.x.org') as domain", "if(id < 3, null, timestamp '2024-06-01') as verified_at")
    got = domain_standing(hosts, proofs, ["page_id"], "timestamp '2024-07-01'")
    rows = got.groupBy("host", "verified", "matched_domain").count().collect()
    assert {(r["host"], r["verified"], r["matched_domain"], r["count"]) for r in rows} == {("a.x.org", True, "a.x.org", 200), ("x.org", True, "x.org", 200), ("evilx.org", False, None, 200)}
    assert allow_listed(hosts, proofs.select("domain"), ["page_id"]).count() == 400


def test_pages_of_one_address_are_planned_apart(spark):
    from lucerna.operators.plan import unplanned

    fails = spark.createDataFrame([(1, "u", "R04", 1.0), (2, "u", "R04", 0.0), (3, "v", "R04", 0.0)], "page_id long, target_url string, item_id string, confidence double")
    steps = spark.createDataFrame([(1, "u", "R04")], "page_id long, target_url string, item_id string")
    got = unplanned(fails, steps, "page_id").select("page_id", "reason").collect()
    assert {(r["page_id"], r["reason"]) for r in got} == {(2, "not verified: check by hand"), (3, "not verified: check by hand")}


def test_a_rival_of_a_shared_address_is_one_page(spark):
    from lucerna.operators.site import nav_conflicts

    rows = [(1, "u", ["a", "b"]), (2, "w", ["b", "a"]), (3, "u", ["a", "c", "b"])]
    pages = spark.createDataFrame([(i, "s", u, "en", None, seq) for i, u, seq in rows], "crawl_order long, site string, url string, lang string, load_error string, nav_seq array<string>")
    got = nav_conflicts(pages).where("nav_seq = array('b', 'a')").collect()
    assert len(got) == 1 and got[0]["nav_conflict"]["other_url"] == "u" and got[0]["nav_conflict"]["shared"] == ["b", "a"]


def test_the_first_other_page_of_a_title_may_share_the_address(spark, tmp_path, monkeypatch):
    from lucerna.plans import queries_site
    from lucerna.plans.registry import load_all

    head = "<html lang=\"en\"><head><title>Same</title></head><body><p>x</p></body></html>"
    rows = [(2, "https://a.example/u", head), (4, "https://a.example/w", head), (7, "https://a.example/u", head)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(queries_site, "_MEMO", {})
    got = load_all()["x_title_first_other"][0](spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["others"], r["first_other"]) for r in got} == {2: (2, "https://a.example/w"), 4: (2, "https://a.example/u"), 7: (2, "https://a.example/u")}


def test_unjudged_rows_are_priced_by_their_texts(spark, tmp_path):
    from lucerna.plans import registry

    events = spark.range(600).selectExpr("id * 4 as event_id", "'view' as event_type", "7.0D as value", "id as user_id")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = registry.load_all()["j10_not_judged"][0](spark, str(tmp_path)).groupBy("j_note").count().collect()
    # a text of four tokens costs (4 + 900) * 5 + 200 000 millionths: 488 calls fit into 100
    assert {r["j_note"]: r["count"] for r in got}["budget used up before this row"] == 600 - 100_000_000 // 204_520
