"""Table-driven cases for policy, obligation, delta, judgement, documents, robots and operations."""

import pytest
from pyspark.sql import functions as F

from lucerna.functions import patterns as P
from lucerna.operators import applicability as A
from lucerna.operators import catalogue as K
from lucerna.operators import crawl, delta, documents, judgement, ops, plan, policy
from lucerna.operators import verdict as V
from lucerna.operators.page_rules import FINDING


def test_catalogue_invariants():
    by = {p: [r for r in K.CATALOGUE if r.part == p] for p in ("1", "2", "IL")}
    assert {k: len(v) for k, v in by.items()} == {"1": 42, "2": 12, "IL": 6}
    assert {m: sum(r.method == m for r in K.CATALOGUE) for m in ("auto", "hybrid", "llm")} == {"auto": 5, "hybrid": 40, "llm": 15}
    row = {r.item_id: r for r in K.CATALOGUE}
    assert row["R08"].level == "AA" and row["R34"].level == "AA" and row["R12"].effective_level == "AAA" and row["R36"].cancelled
    assert len(K.rows_for("page")) == 47 and len(K.rows_for("txt")) == 12 and all(r.effective_level == "A" for r in K.rows_for("page", "A"))


def test_unknown_checker_rule_raises(spark):
    known = K.checker_map(spark).select("rule_id").distinct()
    assert K.unknown_checker_rules(spark, known).count() == 0
    short = known.where("rule_id <> 'blink'")
    assert [r.rule_id for r in K.unknown_checker_rules(spark, short).collect()] == ["blink"]
    with pytest.raises(Exception, match="unknown checker rule blink"):
        K.assert_known_rules(K.checker_map(spark), short).collect()


def test_level_parse_raises(spark):
    with pytest.raises(Exception, match="unexpected level"):
        spark.sql("select 'AAA' as l").select(K.parse_level(F.col("l"))).collect()


ADDRESSES = [
    ("127.0.0.1", False), ("10.0.0.5", False), ("172.16.0.1", False), ("172.31.255.255", False), ("172.15.0.1", True), ("172.32.0.1", True), ("192.168.1.1", False), ("169.254.169.254", False), ("100.64.0.1", False),
    ("0.0.0.0", False), ("224.0.0.1", False), ("255.255.255.255", False), ("93.184.216.34", True), ("::ffff:127.0.0.1", False), ("::ffff:93.184.216.34", True), ("::1", False), ("fe80::1", False), ("fc00::1", False), ("fd12:3456::1", False),
    ("ff02::1", False), ("2606:2800:220:1:248:1893:25c8:1946", True), ("[::1]", False), ("999.1.1.1", False), ("x", False),
]


def test_address_guard(spark):
    df = spark.createDataFrame([(a, a, ok) for a, ok in ADDRESSES], "host string, address string, ok boolean")
    assert policy.guard_addresses(df).where("ok <> (blocked is null)").select("address", "blocked").collect() == []
    mixed = spark.createDataFrame([("h", "93.184.216.34"), ("h", "10.0.0.1"), ("g", "93.184.216.34")], "host string, address string")
    assert {r.host: r.allowed for r in policy.guard_hosts(mixed).collect()} == {"h": False, "g": True}


def test_proofs_stop_at_dots(spark):
    hosts = spark.createDataFrame([(1, "example.co.il"), (2, "shop.example.co.il"), (3, "example.co.il.attacker.com"), (4, "notexample.co.il"), (5, "Example.CO.IL.")], "id int, host string")
    proofs = spark.createDataFrame([("example.co.il",)], "domain string")
    assert sorted(r.id for r in policy.covering_proofs(hosts, proofs, ["id"]).collect()) == [1, 2, 5]


OBLIGATION = [  # authority, turnover, video, before 2017 -> site, row
    (None, None, None, None, None, None), (False, 100000.0, None, None, "small-turnover", "video-turnover"), (False, 100001.0, None, True, "legacy-site", "video-turnover"),
    (False, 100001.0, None, None, None, "video-turnover"), (True, 5.0, False, True, None, None), (False, 5000001.0, None, None, None, None), (None, None, False, None, None, "no-video-production"), (None, 5000000.0, True, None, None, "video-turnover"),
]


def test_obligation(spark):
    df = spark.createDataFrame(OBLIGATION, "public_authority boolean, turnover double, edits_video boolean, before_2017 boolean, site string, line string").withColumn("criterion", F.lit("1.2.5"))
    got = df.selectExpr("site", "line", f"{V.site_exemption()} as s", f"{V.row_exemption()} as r")
    assert got.where("not (s <=> site) or not (r <=> line)").collect() == []
    assert df.withColumn("criterion", F.lit("2.4.4")).selectExpr(f"{V.row_exemption()} as r").where("r is not null").count() == 0


def test_counts_are_never_defaulted(spark):
    keys = A.PAGE_COUNT_KEYS
    good = ", ".join(f"'{k}', 1" for k in keys)
    bad = ", ".join(f"'{k}', {'cast(null as int)' if k == 'links' else 1}" for k in keys)
    assert A.checked_counts(spark.sql(f"select named_struct({good}) as counts")).count() == 1
    with pytest.raises(Exception, match="did not report these counts: links"):
        A.checked_counts(spark.sql(f"select named_struct({bad}) as counts")).collect()
    with pytest.raises(ValueError, match="links"):
        A.checked_counts(spark.sql("select named_struct('images', 1) as counts"))
    with pytest.raises(KeyError):
        A.condition("noSuchProbe")


def side(spark, rows):
    return spark.createDataFrame(rows, "target_url string, item_id string, verdict string, confidence double, locators array<string>")


@pytest.mark.parametrize(
    "base, now, outcome",
    [
        (("FAIL", 1.0, ["a"]), ("PASS", 1.0, []), "fixed"), (("FAIL", 1.0, ["a"]), ("FAIL", 0.0, []), "unverified"), (("FAIL", 1.0, ["a"]), None, "unverified"), (("PASS", 1.0, []), ("FAIL", 1.0, ["b"]), "newlyBroken"),
        (("FAIL", 1.0, ["a", "b"]), ("FAIL", 1.0, ["b", "c"]), "stillBroken"), (("NA", 1.0, []), ("FAIL", 1.0, ["b"]), "newlyBroken"), (("FAIL", 1.0, ["a"]), ("NA", 1.0, []), "unchanged"), (None, ("FAIL", 1.0, ["b"]), "newlyBroken"),
    ],
)
def test_delta_outcomes(spark, base, now, outcome):
    r = delta.delta_rows(side(spark, [("u", "R04", *base)] if base else []), side(spark, [("u", "R04", *now)] if now else [])).first()
    assert r.outcome == outcome
    if outcome == "stillBroken":
        assert (r.cleared, r.added) == (["a"], ["c"])
    if outcome == "fixed":
        assert r.cleared == ["a"]
    if outcome == "unverified":
        assert r.note and r.cleared == []


def test_delta_needs_one_catalogue_version(spark):
    runs = spark.createDataFrame([("1", "1"), ("1", "2"), (None, "1")], "base_version string, now_version string")
    assert [r.comparable for r in delta.comparability(runs).collect()] == [True, False, False]


F1 = [("#a", None, "c", "real")]


@pytest.mark.parametrize(
    "prior, satisfied, verdict, conf, found, want",
    [
        (F1, False, None, None, None, ("FAIL", 1.0, "auto")), ([], False, None, None, None, ("FAIL", 0.0, "auto")), (F1, False, "PASS", 0.9, [], ("FAIL", 1.0, "auto+ai")), ([], True, "FAIL", 0.95, [("body", None, "c", "x")], ("PASS", 0.8, "ai")),
        ([], True, "FAIL", 0.9, [("#b", None, "c", "x")], ("FAIL", 0.9, "ai")), ([], False, "FAIL", 0.9, [], ("FAIL", 0.9, "ai")), ([], False, "NA", 0.7, [], ("NA", 0.7, "ai")), ([], False, "PASS", 0.6, [], ("PASS", 0.6, "ai")),
    ],
)
def test_merge_judgement(spark, prior, satisfied, verdict, conf, found, want):
    arr = f"array<{FINDING}>"
    schema = f"item_id string, findings {arr}, incomplete {arr}, rule_satisfied boolean, has_checker_rules boolean, j_verdict string, j_confidence double, j_findings {arr}, j_note string"
    r = V.merge_judgement(spark.createDataFrame([("R30", prior, [], satisfied, False, verdict, conf, found, None)], schema)).first()
    assert (r.verdict, r.confidence, r.method) == want


def test_sanitise(spark):
    arr = f"array<{FINDING}>"
    rows = [("links", '{"s":"#a"}', "FAIL", 3.0, [("#a", None, "c", "r"), ("#ghost", None, "c", "r")], None), ("links", "{}", "FAIL", 0.9, [("#ghost", None, "c", "r")], "n"), ("siteConsistency", "{}", "odd", -1.0, [("#z", None, "c", "r")], None)]
    df = spark.createDataFrame(rows, f"slice string, json string, j_verdict string, j_confidence double, j_findings {arr}, j_note string")
    a, b, c = judgement.sanitise(df).collect()
    assert (a.j_confidence, len(a.j_findings)) == (1.0, 1) and "1 findings" in a.j_note
    assert (b.j_confidence, b.j_findings, b.j_note.startswith("n ")) == (0.4, [], True)
    assert (c.j_verdict, c.j_confidence, len(c.j_findings)) == ("FAIL", 0.0, 1)


def test_truncation_shortens_the_largest_array_first(spark):
    arrays = "array(named_struct('name', 'big', 'items', transform(sequence(1, 60), i -> repeat('x', 100))), named_struct('name', 'small', 'items', transform(sequence(1, 10), i -> repeat('y', 100))))"
    full = spark.sql(f"select {judgement.truncate(arrays, repr('{}'), 100000)} as j").first().j
    cut = spark.sql(f"select {judgement.truncate(arrays, repr('{}'), 1500)} as j").first().j
    assert full.count("x" * 100) == 60 and cut.count("x" * 100) == 25 and cut.count("y" * 100) == 10 and "35 more left out" in cut
    tiny = spark.sql(f"select {judgement.truncate(arrays, repr('{}'), 100)} as j").first().j
    assert len(tiny) == 251


ROBOTS = "User-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nAllow: /t\nDisallow: /t\nAllow:\nCrawl-delay: 3\nSitemap: https://s/m.xml\n"


def test_robots(spark):
    robots = spark.createDataFrame([("s", ROBOTS), ("e", "User-agent: *\nDisallow:\n")], "site string, text string")
    cases = [("s", "https://s/private/x", False), ("s", "https://s/private/open/y", True), ("s", "https://s/a.pdf", False), ("s", "https://s/a.pdf?x=1", True), ("s", "https://s/t", True), ("s", "https://s/other", True), ("e", "https://e/x", True), ("none", "https://n/x", True)]
    urls = spark.createDataFrame(cases, "site string, url string, want boolean")
    assert crawl.robots_decisions(urls, robots, "LucernaBot").where("want <> allowed").collect() == []
    groups = crawl.robots_groups(robots)
    assert {(r.site, r.crawl_delay_ms) for r in crawl.robots_choice(groups, "LucernaBot").collect()} == {("s", 3000.0), ("e", None)}
    assert [r.sitemap for r in crawl.robots_sitemaps(robots).collect()] == ["https://s/m.xml"]
    other = crawl.robots_decisions(urls.where("site = 's'"), robots, "Other/2").select("allowed").distinct().collect()
    assert [r.allowed for r in other] == [False]


def test_reachability_and_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 5)], "src int, dst int")
    got = {r.node: r.depth for r in crawl.reachable(edges, spark.createDataFrame([(1,)], "node int"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    steps = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("x", ["y"]), ("y", ["x"]), ("d", ["gone"])], "id string, depends_on array<string>")
    assert {r.id: r.level for r in plan.dependency_levels(steps).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None}


ARTIFACTS = [
    ("run-1", "screenshot", "home.png", "screenshots/run-1/home.png"), ("run-1", "json", "report.json", "data/run-1/report.json"), ("run-1", "fix_plan", "plan.json", "data/run-1/plan.json"), ("run-1", "html", "../../etc/passwd", "reports/run-1/etc_passwd"),
    ("run-1", "html", "---rf.html", "reports/run-1/rf.html"), ("run-1", "html", ".bashrc", "reports/run-1/bashrc"), ("run-1", "html", "...", "reports/run-1/artifact"),
]


def test_artifact_keys(spark):
    df = spark.createDataFrame(ARTIFACTS, "run string, f string, n string, want string")
    assert df.selectExpr("want", f"{ops.artifact_key('run', 'f', 'n')} as got").where("want <> got").collect() == []


def test_document_rules(spark):
    base = documents.with_counts(documents.with_facts(documents.text_facts(spark.createDataFrame([(1, "1 One\n1.2.1.1. Deep\n- item\nראה בטבלה מימין\nמייל a@b.org\n" + "text " * 20)], "doc_id int, text string")).withColumn("url", F.lit("u")).withColumn("file_name", F.lit("scan 3.txt"))))
    r = base.first()
    assert [h.level for h in r.headings] == [1, 5] and len(r.lists) == 1 and r.links[0].uri == "mailto:a@b.org" and [s.line for s in r.sensory_phrases] == [4]
    got = {x.rule: None if x.findings is None else [f.code for f in x.findings] for x in documents.rule_results(base).collect()}
    assert got["doc-heading-structure"] == ["doc-heading-jump"] and got["doc-list-structure"] == ["doc-typed-list"] and got["doc-title"] == ["doc-untitled"] and got["doc-color-only"] == []
    v = {x.item_id: x for x in documents.evaluate_documents(base.withColumn("notes", F.expr("array('n1', 'n2')"))).collect()}
    assert v["D01"].verdict == "NA" and v["D01"].note.endswith("n1 | n2") and v["D07"].verdict == "PASS" and v["D03"].confidence == 1.0 and v["D05"].confidence == 0.0
    broken = {x.item_id: (x.verdict, x.confidence) for x in documents.evaluate_documents(base.withColumn("download_error", F.lit("HTTP 404"))).collect()}
    assert set(broken.values()) == {("FAIL", 0.0)}


def test_phrase_context_has_the_right_place(spark):
    text = "a" * 100 + " chart " + "b" * 30 + " graph\nend"
    rows = documents.phrases(spark.createDataFrame([(1, text)], "doc_id int, text string"), P.DOC_COMPLEX).orderBy("pos").collect()
    assert [(r.match, r.at) for r in rows] == [("chart", 102), ("graph", 139)]
    assert rows[0].context == text[41:166].replace("\n", " ")[: len(rows[0].context)] and rows[1].context.endswith("graph end")


def test_delta_refuses_other_catalogue_versions(spark):
    rows = spark.createDataFrame([("u", "R04", "FAIL", 1.0, ["a"])], "target_url string, item_id string, verdict string, confidence double, locators array<string>")
    assert delta.compare_reviews(rows, rows, "1", "1").first()["outcome"] == "stillBroken"
    for versions in (("1", "2"), (None, "1"), ("1", None), (None, None)):
        with pytest.raises(ValueError):
            delta.compare_reviews(rows, rows, *versions)


def test_budget_gate_is_greedy(spark):
    """A refused or cached call spends nothing, so a smaller one behind it may fit; several runs, blocks smaller than a run."""
    import random

    rng = random.Random(4)
    rows = [(run, no * 3, rng.choice([10, 5_000, 60_000, 400_000]), rng.random() < 0.3) for run in ("a", "b", None) for no in range(60)]
    for budget in (0.1, 3.0, 9.5, 1000.0):
        spent, want = {}, {}
        for run, no, tokens, cached in rows:
            cost = (tokens + 900) * 5 + 200_000
            ok = not cached and spent.get(run, 0) + cost <= budget * 1e6
            want[run, no] = ok
            spent[run] = spent.get(run, 0) + (cost if ok else 0)
        got = judgement.budget_gate(spark.createDataFrame(rows, "run_id string, task_no long, tokens long, cached boolean"), budget, bucket_rows=7).collect()
        assert {(r.run_id, r.task_no): r.fits for r in got} == want
