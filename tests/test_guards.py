"""Refused addresses, rows that nothing judged, and dependency chains of any length."""

from pyspark.sql import functions as F

from lucerna.functions import urls as U
from lucerna.operators.judgement import not_judged
from lucerna.operators.plan import dependency_levels
from lucerna.operators.policy import guard_addresses
from lucerna.operators.verdict import merge_judgement


def test_literal_hosts(spark):
    want = {
        "http://10.0.0.1/": "private", "http://169.254.169.254/latest": "link-local", "http://[::1]/": "loopback", "http://8.8.8.8/": None, "http://example.com/": None,
        "http://[2606:4700::1111]/x": None, "http://[::ffff:10.0.0.1]/": "private", "http://[abc:def]/": "not an address", "http://localhost/": "local-host",
        "http://2130706433/": "loopback", "http://0x7f.1/": "loopback", "http://127.1/": "loopback", "http://0177.0.0.1/": "loopback", "http://[::ffff:7f00:1]/": "loopback", "http://localhost./": "local-host",
        "http://0x7F000001:80/": "loopback", "http://10.0x10.257/": "private", "http://134744072/": None, "http://8.8.2056/": None, "http://1.2.3.4.5/": "invalid", "http://08.1.1.1/": "invalid",
        "http://256.1.1.1/": "invalid", "http://4294967296/": "invalid", "http://0x/": "this network", "http://127.0.0.1./": "loopback", "http://a.1/": "invalid", "http://1.a/": None,
        "http://[fd12::1]/": "unique local", "http://[0:0:0:0:0:0:0:1]/": "loopback", "http://[::ffff:8.8.8.8]/": None, "http://[64:ff9b::10.0.0.1]/": "nat64", "http://[::1.2.3]/": "not an address",
        "http://printer.local/": "local-host", "http://99999999999999999999999/": "invalid", "http://0xffffffffffffffffffff/": "invalid",
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string").selectExpr("u", f"{U.shape_guard('u')} as refused").collect()
    assert {r["u"]: r["refused"] for r in rows} == want


def test_addresses(spark):
    want = {
        "abc:def": "not an address", ":": "not an address", "1:2:3": "not an address", "1::2::3": "not an address", "::": "unspecified", "2606:4700::1111": None,
        "1:2:3:4:5:6:7:8": None, "1:2:3:4:5:6:7:8:9": "not an address", "10.0.0.1": "private", "8.8.8.8": None, "::ffff:192.168.0.1": "private", "fe80::1": "link-local", "[2001:db8::1]": "documentation",
        "::ffff:c0a8:1": "private", "0:0:0:0:0:ffff:a00:1": "private", "::ffff:808:808": None, "febf::1": "link-local", "fec0::1": None, "100::1": "discard", "100:0:1::": "discard", "100:1::": None,
        "1:2:3:4:5:6:1.2.3.4": None, "::ffff:1.2.3.400": "not an address", "fe80::1%eth0": "not an address", "127.1": "not an address",
    }
    rows = guard_addresses(spark.createDataFrame([("h", a) for a in want], "host string, address string")).collect()
    assert {r["address"]: r["blocked"] for r in rows} == want


def test_unjudged_never_passes(spark):
    finding = "array<struct<locator:string,snippet:string,code:string,reason:string>>"
    work = spark.createDataFrame([(1, False, False), (2, True, True)], "task int, fits boolean, failed boolean")
    rows = not_judged(work).withColumn("rule_satisfied", F.lit(True)).withColumn("has_checker_rules", F.lit(False)).withColumn("findings", F.expr(f"cast(array() as {finding})"))
    rows = rows.withColumn("incomplete", F.expr(f"cast(array(struct('a', 'b', 'c', 'd')) as {finding})")).withColumn("j_findings", F.expr(f"cast(null as {finding})"))
    got = merge_judgement(rows).collect()
    assert {(r["verdict"], r["confidence"], len(r["findings"])) for r in got} == {("FAIL", 0.0, 1)}
    assert {r["note"] for r in got} == {"budget used up before this row", "judgement failed; check by hand"}


def test_long_chain_and_cycle(spark):
    steps = [(i, [i - 1] if i else []) for i in range(22)] + [(100, [101]), (101, [100]), (102, [101])]
    got = {r["id"]: r["level"] for r in dependency_levels(spark.createDataFrame(steps, "id long, depends_on array<long>")).collect()}
    assert got == {**{i: i for i in range(22)}, 100: None, 101: None, 102: None}
