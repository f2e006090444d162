"""Sources, sinks, streams and the shape of the plans."""

import json

import pytest
from pyspark.sql import functions as F

from lucerna.operators import ops, site
from lucerna.operators.catalogue import expand
from lucerna.operators.plan import fix_order
from lucerna.plans.corpus import earlier, mutated, table
from lucerna.plans.review import page_facts, parsed, review
from lucerna.sources import tables as IO
from lucerna.streaming import jobs as W


@pytest.fixture(scope="module")
def results(spark, sf):
    return review(mutated(spark, sf).where("page_id < 40")).cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_sinks_round_trip(spark, results, tmp_path):
    IO.write_report_json(results, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report"))
    assert back.count() == results.select("url").distinct().count()
    assert back.selectExpr("sum(size(results))").first()[0] == results.count()
    IO.write_check_sheet(results, str(tmp_path / "sheet"))
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(str(tmp_path / "sheet"))
    assert sheet.count() == results.count()
    assert sheet.columns[:4] == ["url", "ordinal", "guideline", "criterion"]
    text = IO.remediation_text(fix_order(results, "page_id", "url")).first().value
    assert text.startswith("### 1 ")


def test_artifact_sink_is_partitioned(spark, sf, tmp_path):
    art = table(spark, sf, "events").limit(20).selectExpr("concat('run-', user_id % 3) as run_id", "if(event_id % 2 = 0, 'screenshot', 'json') as format", "'a b.png' as filename", "ts as created_at")
    IO.write_artifacts(art, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert {"prefix", "run_id"} <= set(back.columns) and {r.prefix for r in back.select("prefix").distinct().collect()} == {"screenshots", "data"}
    assert {r.object_key.split("/")[-1] for r in back.collect()} == {"a_b.png"}


def test_recorded_evidence_reader(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"page_id": 1, "timers": [{"kind": "setTimeout", "delay_ms": 9000}], "zoom": {"clipped": [], "lost": [{"selector": "#a", "text": "t"}]}}) + "\n")
    r = IO.read_recorded(spark, str(tmp_path)).first()
    assert r.timers[0].delay_ms == 9000 and r.zoom.lost[0].selector == "#a" and r.keyboard is None


def test_robots_and_sitemap_readers(spark, tmp_path):
    (tmp_path / "robots").mkdir()
    (tmp_path / "robots" / "a.org.txt").write_text("User-agent: *\nDisallow: /x")
    assert IO.read_robots(spark, str(tmp_path / "robots")).first().site == "a.org"
    (tmp_path / "sm" / "a.org").mkdir(parents=True)
    (tmp_path / "sm" / "a.org" / "s.xml").write_text("<urlset><url><loc>https://a.org/1</loc></url></urlset>")
    assert IO.read_sitemaps(spark, str(tmp_path / "sm" / "*" / "*.xml")).first().site == "a.org"


def test_page_evidence_has_no_shuffle(spark, sf):
    pages = table(spark, sf, "pages").repartition(4)
    facts = page_facts(pages)
    assert plan_of(facts).count("Exchange") == 1  # the repartition of this test


def test_link_jobs_never_read_html(spark, sf):
    p = plan_of(table(spark, sf, "pages").selectExpr("page_id", "url"))
    assert "html" not in p.split("ReadSchema")[1]


def test_first_k_ranks_limit_before_the_shuffle(spark, sf):
    facts = page_facts(table(spark, sf, "pages"), [])
    facts = facts.sparkSession.createDataFrame([], facts.schema)
    for df in (site.title_duplicates(facts), site.component_rivals(facts)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString() or "WindowGroupLimit" in plan_of(df)


def test_catalogue_expansion_is_an_equality_join(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", "if(doc_id % 2 = 0, 'pdf', 'page') as kind")
    p = plan_of(expand(docs))
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p


def test_judged_and_unjudged_rows_are_the_same_rows(spark, sf):
    pages = earlier(spark, sf).where("page_id < 20")
    a = review(pages, items=["R30", "R44", "IL01"]).select("page_id", "item_id")
    b = review(pages, items=["R30", "R44", "IL01"], use_ai=True).select("page_id", "item_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_streams_agree_with_batch(spark, sf):
    events = table(spark, sf, "events")
    spend = W.collected(spark, W.daily_spend(W.job_stream(spark, sf)), "update", "t-spend", ["day"])
    assert spend.agg(F.sum("scans")).first()[0] == events.count()
    once = W.collected(spark, W.rescan_cooldown(W.job_stream(spark, sf)), "append", "t-cool")
    assert once.count() == once.select("url").distinct().count() == events.select("user_id").distinct().count()
    active = W.collected(spark, W.active_jobs(W.job_stream(spark, sf)), "update", "t-active")
    assert active.where("active < 0").count() == 0 and active.count() > 0
    batch = review(table(spark, sf, "pages"), items=["R27", "R30", "R34", "R35", "R44"]).select("page_id", "item_id", "verdict", "confidence")
    stream = W.incremental_review(spark, f"{sf}/pages*.parquet", ["R27", "R30", "R34", "R35", "R44"]).select("page_id", "item_id", "verdict", "confidence")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    late = W.late_ledger(events, 4_000_000_000_000)
    assert late.count() == events.count() and W.late_ledger(events, 0).count() == 0


def test_carried_forward_scans_match_a_plain_join(spark, sf):
    ev = table(spark, sf, "events")
    jobs = ev.selectExpr("event_id as id", "concat('u', user_id % 3) as url", "'done' as status", "timestampadd(SECOND, 30, ts) as finished_at").where("id % 4 = 0")
    req = ev.selectExpr("event_id as request_id", "concat('u', user_id % 3) as url", "ts as requested_at").where("request_id % 4 = 1")
    got = {(r.request_id, r.reuse_job) for r in ops.recent_scan(req, jobs).collect()}
    j = req.join(jobs, "url").where("finished_at <= requested_at and finished_at >= requested_at - interval 60 minutes").groupBy("request_id").agg(F.expr("max_by(id, finished_at)").alias("j"))
    want = {(r.request_id, r.j) for r in req.join(j, "request_id", "left").collect()}
    assert got == want


def test_parser_output_is_flushed_by_size(spark):
    from lucerna.functions.html import with_dom

    df = spark.range(50).selectExpr("id as page_id", "repeat('<p>x</p>', 100) as html").coalesce(1)
    out = with_dom(df, flush_chars=2000)
    assert out.count() == 50 and out.selectExpr("min(size(dom.elements))").first()[0] == 102
    assert parsed(df.withColumn("url", F.lit("https://a/"))).count() == 50


def test_shared_stages_follow_the_files(spark, tmp_path):
    from lucerna.plans import queries_site

    def build():
        return spark.read.parquet(f"{tmp_path}/t.parquet")

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    first = queries_site.once(spark, str(tmp_path), "t", build)
    assert first.count() == 3 and queries_site.once(spark, str(tmp_path), "t", build) is first
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert queries_site.once(spark, str(tmp_path), "t", build).count() == 8


def test_politeness_refuses_gaps_beyond_a_bucket(spark):
    rows = spark.createDataFrame([], "event_id long, host string, ts timestamp")
    with pytest.raises(ValueError):
        W.politeness_gaps(rows, 3_600_001)


def test_review_of_changes_equals_the_full_review(spark, sf):
    """Only changed pages are parsed; ids and crawl order may move, and another review's facts are taken over where nothing changed."""
    from pyspark.sql import functions as F

    from lucerna.plans import corpus
    from lucerna.plans.review import facts_after, kept_facts, review, review_changes

    items = ["R04", "R13", "R27", "R29", "R39", "R40"]
    before = corpus.earlier(spark, sf).limit(60)
    after = corpus.later(spark, sf).where("page_id < 70").withColumn("page_id", F.col("page_id") + 500).withColumn("crawl_order", -F.col("page_id"))
    kept = kept_facts(before, items=items)

    def rows(df):
        return sorted((r["page_id"], r["item_id"], r["verdict"], r["confidence"], str(r["findings"])) for r in df.collect())

    assert rows(review_changes(after, kept, items=items)) == rows(review(after, items=items))
    took = facts_after(after, kept, items=items).join(kept.select("content"), "content", "left_semi").count()
    assert 0 < took < after.count()
    # recorded evidence is part of the content
    timed = after.withColumn("timers", F.expr("array(named_struct('kind', 'timeout', 'delay_ms', 5.0D, 'stack', ''))"))
    assert facts_after(timed, kept, items=items).join(kept.select("content"), "content", "left_semi").count() == 0


def split_events(spark, sf, tmp_path, files=6):
    """The given events in time order, a file each for six stretches of time."""
    import time

    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*[c.split()[0] for c in W.EVENT_SCHEMA.split(", ")])
    lo, hi = ev.selectExpr("min(unix_micros(ts))", "max(unix_micros(ts))").first()
    for k in range(files):
        part = ev.where(f"cast(floor((unix_micros(ts) - {lo}) * {files} / ({hi} - {lo} + 1)) as int) = {k}")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events{k}.parquet")
        time.sleep(1.1)  # files are taken in order of their times
    return ev


def test_site_rows_follow_every_batch(spark, sf, tmp_path):
    """Pages in four batches: after the last one all rows equal the batch review, the rows that compare pages too."""
    pages = earlier(spark, sf).where("page_id < 80")
    pages.repartition(4, "page_id").write.parquet(f"{tmp_path}/pages")
    items = ["R27", "R29", "R39", "R40", "IL01", "IL02"]
    stream = spark.readStream.schema("page_id bigint, url string, html string").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/pages")
    got = W.incremental_review(spark, stream, items).select("page_id", "item_id", "verdict", "confidence")
    want = review(pages, items=items).select("page_id", "item_id", "verdict", "confidence")
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_sessions_closed_and_open_are_all_sessions(spark, sf, tmp_path):
    ev = split_events(spark, sf, tmp_path)
    closed, still = W.session_outputs(spark, W.job_stream(spark, str(tmp_path), maxFilesPerTrigger="1"))
    rows = sorted((r.user_id, r.us) for r in ev.selectExpr("user_id", "unix_micros(ts) as us").collect())
    want = []
    for user, us in rows:
        if want and want[-1][0] == user and us < want[-1][2]:
            want[-1] = [user, want[-1][1], us + 1_800_000_000, want[-1][3] + 1]
        else:
            want.append([user, us, us + 1_800_000_000, 1])
    shape = "site", "unix_micros(session_start) as a", "unix_micros(session_end) as b", "n"
    shut, alive = ([list(r) for r in df.selectExpr(*shape).collect()] for df in (closed, still))
    assert sorted(shut + alive) == sorted(want) and shut and alive
    mark = max(us for _, us in rows) - 600_000_000
    assert all(b <= mark for _, _, b, _ in shut) and all(b > mark - 1000 for _, _, b, _ in alive)


def test_late_rows_and_rows_in_time_are_the_input(spark, sf, tmp_path):
    ev = split_events(spark, sf, tmp_path, files=3)
    ev.where("event_id % 10 = 0").withColumn("ts", F.expr("ts - interval 400 days")).coalesce(1).write.parquet(f"{tmp_path}/events9.parquet")
    raw = spark.readStream.schema(W.EVENT_SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/events*.parquet")
    in_time, late = W.delta_with_ledger(spark, raw, table(spark, sf, "customer").selectExpr("c_custkey as user_id", "true as was_broken"))
    total = ev.count()
    assert late.count() == ev.where("event_id % 10 = 0").count() and in_time.count() == total
    assert late.selectExpr("max(unix_micros(ts))").first()[0] < ev.selectExpr("min(unix_micros(ts))").first()[0]


def test_state_of_windows_stays_bounded(spark, sf, tmp_path):
    """In update mode a window leaves the state once the watermark passes it; its last row stays in the output."""
    ev = split_events(spark, sf, tmp_path)
    progress = []
    out = W.collected(spark, W.job_progress(W.job_stream(spark, str(tmp_path), maxFilesPerTrigger="1")), "update", "t-progress", ["window_start", "phase"], progress)
    want = ev.groupBy(F.window("ts", "10 minutes", "1 minute").alias("w"), "event_type").count()
    assert out.count() == want.count() and out.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(kept) >= 6 and kept[-1] < 0.5 * want.count()
