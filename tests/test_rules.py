"""Golden pages: one with the planted defects, one that may fail only the preferences-widget row."""

import pytest
from pyspark.sql import functions as F

from lucerna.operators.evidence import template_hash
from lucerna.operators.page_rules import PAGE_RULES, rule_results, rule_sql, with_site_defaults
from lucerna.operators.recorded import keyboard_struct
from lucerna.operators.verdict import quality_gates
from lucerna.plans.review import evidence, review

BROKEN = """<!DOCTYPE html><html><head><title>Shop</title><meta name="viewport" content="width=device-width, maximum-scale=1"><meta http-equiv="refresh" content="900">
<script src="https://cdn.userway.org/widget.js"></script></head><body><div class="menu"><a href="/a">לחץ כאן</a> <a href="/b">לחץ כאן</a> <a href="/c"></a></div>
<img src="x.png"><img src="y.jpg" alt="photo.jpg"><center><font size="3">שלום לכולם ברוכים הבאים לאתר שלנו</font></center><marquee>sale</marquee>
<p>טלפון 03-1234567 לבירורים</p><p>לחצו על הכפתור האדום</p><h2>א</h2><h4>ב</h4><div onclick="go()">buy now</div><form><input type="text" placeholder="name" required><select onchange="x()"><option>1</option></select></form>
<div id="dup"></div><div id="dup"></div><button><i class="icon"></i></button><iframe src="https://youtube.com/embed/1"></iframe><label for="gone">x</label><input aria-describedby="nowhere">
<table><tr><td>1</td></tr><tr><td>2</td></tr></table><p>• one</p><p>• two</p><a href="#nope">דלג לתוכן</a></body></html>"""

GOOD = """<!DOCTYPE html><html lang="he" dir="rtl"><head><title>אודות העמותה</title><meta property="og:site_name" content="העמותה"><meta name="viewport" content="width=device-width"></head><body>
<a href="#main">דלג לתוכן הראשי</a><header><a href="/">העמותה לקידום הנגישות</a></header><nav aria-label="ראשי"><ul><li><a href="/about">אודות</a></li><li><a href="/contact">צור קשר</a></li></ul></nav>
<main id="main" tabindex="-1"><h1>אודות העמותה</h1><h2>מה אנחנו עושים</h2><p>אנחנו פועלים למען נגישות מלאה לכל אדם בכל מקום ובכל זמן, ומציעים ליווי והדרכה.</p>
<img src="team.png" alt="צוות העמותה סביב שולחן"><p>טלפון: <bdi>03-1234567</bdi></p><form><label for="q">שם מלא</label><input id="q" type="text"></form></main><footer><a href="/accessibility">הצהרת נגישות</a></footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.co.il/broken", BROKEN), (2, "https://b.co.il/", GOOD), (3, "https://c.co.il/", None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def found(pages):
    rows = rule_results(with_site_defaults(evidence(pages))).collect()
    return {(r.page_id, r.rule): (None if r.findings is None else [f.code for f in r.findings]) for r in rows}


EXPECT = {
    "hebrew-alt-text": {"alt-is-filename"}, "presentational-markup": {"presentational"}, "generic-link-text": {"link-ambiguous", "link-empty"}, "landmark-coverage": {"no-main"},
    "fake-heading-detect": {"typed-list", "no-h1"}, "layout-table-detect": {"layout-table"}, "section-heading-coverage": {"heading-jump"}, "skip-link-functional": {"skip-target-missing"},
    "placeholder-as-label": {"placeholder-only"}, "error-announcement": {"describedby-missing", "no-error-surface"}, "click-handler-no-keyboard": {"pseudo-control"}, "context-change-on-input": {"select-onchange"},
    "timeout-detect": {"meta-refresh"}, "moving-content-detect": {"moving-tag"}, "markup-validity": {"duplicate-id", "broken-reference", "orphan-label"}, "custom-widget-state": {"icon-unnamed"},
    "embedded-media-name": {"media-unnamed"}, "caption-track-present": {"player-captions"}, "hebrew-lang-dir": {"lang-missing", "dir-not-rtl"}, "ltr-island-marked": {"ltr-island"}, "overlay-antipattern": {"overlay"},
    "accessibility-notice-visible": {"notice-missing"}, "a11y-widget-present": {"widget-missing"},
}


@pytest.mark.parametrize("rule", sorted(EXPECT))
def test_broken_page(found, rule):
    assert set(found[(1, rule)]) == EXPECT[rule]


def test_good_page_has_no_false_findings(found):
    bad = {rule: codes for (page, rule), codes in found.items() if page == 2 and codes}
    # without a crawl the statement page itself cannot be loaded
    bad.pop("accessibility-statement", None)
    assert bad == {"a11y-widget-present": ["widget-missing"]}


def test_no_opinion_is_not_clean(found):
    for rule in ("keyboard-walk", "keyboard-trap", "focus-visible-check", "zoom-200-reflow", "color-only-meaning", "multiple-ways-site", "captcha-detect", "coordinator-contact"):
        assert found[(2, rule)] is None, rule
    assert found[(2, "markup-validity")] == []
    assert all(found[(3, rule)] is None for rule in PAGE_RULES)


def test_unknown_rule_raises():
    with pytest.raises(KeyError):
        rule_sql("no-such-rule")


def test_failed_rule_is_a_finding(pages):
    df = with_site_defaults(evidence(pages, {"presentational"}).withColumn("rule_errors", F.expr("map('presentational-markup', 'boom')"))).where("page_id = 2")
    f = rule_results(df, ["presentational-markup"]).first().findings
    assert [(x.locator, x.reason) for x in f] == [("engine", "rule-failed: boom")]


def test_review_discipline(pages):
    results = review(pages).cache()
    assert results.count() == 3 * 47
    assert quality_gates(results, pages, "page_id").count() == 0
    by = {(r.page_id, r.item_id): r for r in results.collect()}
    assert by[(3, "R30")].verdict == "FAIL" and by[(3, "R30")].confidence == 0
    assert by[(1, "R36")].verdict == "NA" and "cancels" in by[(1, "R36")].note
    assert (1, "R12") not in by
    # only automatic rows can pass while no judgement is available
    assert by[(2, "R44")].verdict == "PASS" and by[(2, "R35")].verdict == "PASS"
    assert by[(2, "R30")].verdict == "FAIL" and by[(2, "R30")].confidence == 0
    assert by[(1, "R06")].verdict == "FAIL" and by[(2, "R06")].verdict == "NA"
    real = {i for (p, i), r in by.items() if p == 2 and r.verdict == "FAIL" and r.confidence > 0}
    assert real == {"IL01", "IL05"}


def test_partitioning_does_not_change_results(pages):
    def rows(df):
        return sorted((r.page_id, r.item_id, r.verdict, r.confidence, len(r.findings)) for r in df.collect())

    assert rows(review(pages.repartition(1))) == rows(review(pages.repartition(7)))


def test_template_hash_uses_signed_double_arithmetic(spark):
    df = spark.sql("select '0div.wrap|1nav|2ul|3li' as skeleton union all select '' ")
    assert [r[0] for r in df.select(template_hash()).collect()] == ["19b59e6c", "811c9dc5"]


def test_wide_containers_keep_their_whole_text(spark):
    long = "<p>" + "מילה " * 3000 + "</p>"
    html = f'<html lang="he" dir="rtl"><body><main><a href="/x"><div>{long}</div></a><h1>t</h1></main></body></html>'
    df = spark.createDataFrame([(1, "https://a.org/", html)], "page_id bigint, url string, html string")
    r = evidence(df, {"text_length", "links"}).selectExpr("text_length", "links[0].name as name").first()
    assert r.text_length == 3000 * 5 - 1 + 2
    assert r.name == ("מילה " * 3000).strip()


STOP_SCHEMA = "page_id bigint, index int, selector string, name string, tag string, contains_frame boolean, visible boolean, indicator_changed boolean, top int, left int, right int, rtl boolean, context_kind string, context_detail string"


def stop(page, i, sel, frame=False, changed=True, top=None, kind=None):
    return (page, i, sel, sel, "a", frame, True, changed, i * 50 if top is None else top, 0, 10, False, kind, None)


def test_keyboard_walk_outcomes(spark):
    rows = [stop(1, i, s) for i, s in enumerate(["#a", "#b", "#b", "#b", "#c"])]
    rows += [stop(2, i, s, frame=s == "#f") for i, s in enumerate(["#a", "#f", "#f", "#f"])]
    rows += [stop(3, i, s, changed=s != "#c", kind="navigation" if s == "#d" else None) for i, s in enumerate(["#a", "#b", "#c", "#d", "#a", "#z"])]
    stops = spark.createDataFrame(rows, STOP_SCHEMA)
    cand = spark.createDataFrame([(3, "#a", 0, "x", "r"), (3, "#lost", 1, "y", "r")], "page_id bigint, selector string, pos int, text string, reason string")
    kb = {r.page_id: r.keyboard for r in keyboard_struct(stops, cand).collect()}
    assert kb[1].trap.selector == "#b" and kb[1].trap.repeats == 3 and kb[1].frame_boundary is None
    assert kb[2].trap is None and kb[2].frame_boundary.selector == "#f"
    assert [s.selector for s in kb[3].stops] == ["#a", "#b", "#c", "#d"] and kb[3].trap is None
    assert [s.selector for s in kb[3].no_indicator] == ["#c"] and [u.selector for u in kb[3].unreachable] == ["#lost"]
