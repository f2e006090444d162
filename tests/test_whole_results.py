"""Nothing is cut: long pages, many findings, keys without a partner."""

from pyspark.sql import functions as F

from lucerna.operators.page_rules import rule_results, with_site_defaults
from lucerna.operators.skew import join_on_hot_key
from lucerna.operators.verdict import dedupe
from lucerna.plans.review import evidence


def test_every_link_counts(spark):
    links = "".join(f'<a href="/p{i}">{"click here" if i % 2 else f"item {i}"}</a>' for i in range(900))
    page = spark.createDataFrame([(1, "https://a.example/", f"<html><body>{links}</body></html>")], "page_id bigint, url string, html string")
    got = evidence(page).selectExpr("counts.links as links", "counts.focusable as focusable", "size(filter(links, l -> l.ambiguous)) as ambiguous").first()
    assert (got.links, got.focusable, got.ambiguous) == (900, 900, 450)
    rules = rule_results(with_site_defaults(evidence(page)), ["generic-link-text"]).first()
    assert {f.locator for f in rules.findings} and len(rules.findings) >= 450


def test_dedupe_keeps_order_and_every_kind(spark):
    fs = [("b", "x"), ("a", "x"), ("b", "x"), (None, "x"), (None, "x"), ("a", "y" * 80 + "1"), ("a", "y" * 80 + "2")] + [(f"l{i}", "r") for i in range(50)]
    df = spark.createDataFrame([(fs,)], "fs array<struct<locator:string,reason:string>>")
    got = [(r.locator, r.reason) for r in df.selectExpr(f"inline({dedupe('fs')})").collect()]
    assert got == [fs[0], fs[1], fs[3], fs[4], fs[5], *fs[7:]]
    empty = spark.createDataFrame([([],)], "fs array<struct<locator:string,reason:string>>")
    assert empty.selectExpr(f"size({dedupe('fs')}) as n").first().n == 0


def test_keys_without_partner_are_split(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(60_000).select("id", F.expr("case when id % 10 = 0 then null when id % 10 < 8 then 'lonely' else concat('k', id % 97) end as k"))
        small = spark.createDataFrame([(f"k{i}", i) for i in range(97)], "k string, v int")
        out = join_on_hot_key(big, small, ["k"], None, "id", "left", rows_per_slice=1000)
        want = big.join(small, "k", "left").agg(F.count("*"), F.sum("v"), F.count("v")).first()
        assert out.agg(F.count("*"), F.sum("v"), F.count("v")).first() == want
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 60_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
