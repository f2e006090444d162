import itertools
import random

import pytest

from lucerna.operators import site as S
from lucerna.operators.skew import join_on_hot_key
from lucerna.operators.verdict import is_page_locator

FACTS = "page_id bigint, url string, site string, crawl_order bigint, load_error string, lang string, nav_seq array<string>, components map<string,string>, title string"


def make(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def brute_nav(rows):
    base = lambda v: (v or "").split("-")[0].lower()
    out = {}
    for p in rows:
        for o in sorted(rows, key=lambda r: r[3]):
            if o[0] == p[0] or o[2] != p[2] or o[4] or not o[6] or not p[6] or (base(p[5]) and base(o[5]) != base(p[5])):
                continue
            a, b = [x for x in p[6] if x in o[6]], [x for x in o[6] if x in p[6]]
            if len(a) >= 2 and "|".join(a) != "|".join(b):
                out[p[0]] = o[1]
                break
    return out


@pytest.mark.parametrize("slices", [2, 500_000])
def test_nav_conflicts_match_brute_force(spark, slices):
    rng = random.Random(7)
    rows = []
    for i in range(160):
        seq = [rng.choice("abcdef") for _ in range(rng.randint(0, 5))]
        rows.append((i, f"https://s/{i}", "big" if i % 3 else "small", i, "x" if i % 29 == 0 else None, rng.choice(["he", "he-IL", "en", None]), seq, {}, ""))
    got = {}
    conf = S.nav_conflicts(make(spark, rows), slices)
    pages = {(r[2], (r[5] or "").split("-")[0].lower(), tuple(r[6])): [] for r in rows if not r[4]}
    for r in rows:
        if not r[4]:
            pages[(r[2], (r[5] or "").split("-")[0].lower(), tuple(r[6]))].append(r[0])
    for c in conf.collect():
        for pid in pages[(c.site, c.lang, tuple(c.nav_seq))]:
            got[pid] = c.nav_conflict.other_url
    want = {k: v for k, v in brute_nav([r for r in rows if not r[4]]).items()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("slices", [3, 500_000])
def test_component_conflicts_match_brute_force(spark, slices):
    rng = random.Random(3)
    rows = [
        (i, f"https://s/{i}", "big", i, None, rng.choice(["he", "en", None]), [], {k: rng.choice("xyz") for k in rng.sample(["search", "menu", "cart"], rng.randint(0, 3))}, "")
        for i in range(60)
    ]
    got = {r.page_id: [(c.key, c.other_name, c.other_url) for c in r.component_conflicts] for r in S.component_conflicts(make(spark, rows), slices).collect()}
    for p in rows:
        want = []
        for key, name in p[7].items():
            for o in rows:
                if o[0] != p[0] and (not p[5] or o[5] == p[5]) and o[7].get(key) not in (None, name):
                    want.append((key, o[7][key], o[1]))
        mine = got.get(p[0], [])
        assert len(mine) == min(5, len(want)) and set(mine) <= set(want)
        per_key = {k: [w for w in want if w[0] == k] for k in p[7]}
        for k, g in itertools.groupby(mine, key=lambda c: c[0]):
            g = list(g)
            assert g == per_key[k][: len(g)]


def test_language_sets(spark):
    def names(*langs):
        rows = [(i, f"u{i}", "s", i, None, lang, [], {"skip": name}, "") for i, (lang, name) in enumerate(langs)]
        return {r.page_id: len(r.component_conflicts) for r in S.component_conflicts(make(spark, rows), 500_000).collect()}

    assert names(("he", "דלג"), ("he", "דלג"), ("en", "Skip")) == {}
    assert names(("he", "a"), ("he", "b"), ("en", "c")) == {0: 1, 1: 1}
    assert names((None, "a"), (None, "b")) == {0: 1, 1: 1}
    assert names(("he-IL", "a"), ("he", "b")) == {0: 1, 1: 1}


def test_hot_key_join_is_the_plain_join(spark):
    big = spark.range(1000).selectExpr("id", "if(id % 3 < 2, 'hot', concat('k', id % 7)) as k")
    small = big.groupBy("k").count().selectExpr("k", "count as n", "concat(k, '!') as v")
    want = sorted((r.id, r.v) for r in big.join(small, "k").collect())
    for size in (10, 100, 10_000):
        assert sorted((r.id, r.v) for r in join_on_hot_key(big, small, ["k"], "n", "id", "left", size).collect()) == want


LOCATORS = [
    ('componentNamesPerPage[url="https://x/he"].names', False), ("accessibilityWidget.candidates", False), ("titlesAcrossSite", False), ("navigationSequences[2]", False), ("", False), ("   ", False), ("body", False), ("html", False),
    (None, False), ("#a11y-widget-trigger", True), (".a11y-trigger", True), ('a[href="/x"]', True), ('input[type="search"]', True), ("div.card > p", True), ("body > aside > div:nth-of-type(1) > p > a", True), ("main#content", True),
    ("ul li:first-child + li", True), ("https://x.co.il/he/accessibility", True),
]


def test_page_locators(spark):
    df = spark.createDataFrame(LOCATORS, "v string, want boolean")
    assert df.selectExpr("v", "want", f"{is_page_locator('v')} as got").where("want <> got").collect() == []
