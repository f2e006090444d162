import hashlib
import hmac

import pytest

from lucerna.functions import urls as U

CANON = [
    ("https://a.co.il/p?utm_source=x&id=42&fbclid=y", "https://a.co.il/p?id=42"),
    ("https://a.co.il/index.html", "https://a.co.il/"),
    ("https://a.co.il/a/", "https://a.co.il/a"),
    ("https://a.co.il/a/index.html", "https://a.co.il/a/"),
    ("HTTPS://A.co.il:443/x#frag", "https://a.co.il/x"),
    ("http://a.co.il:8080/", "http://a.co.il:8080/"),
    ("https://a.co.il/?b=2&a=1&b=1", "https://a.co.il/?a=1&b=2&b=1"),
    ("https://a.co.il/?q=a%20b", "https://a.co.il/?q=a+b"),
    ("https://a.co.il/x/../y/./z", "https://a.co.il/y/z"),
    ("mailto:a@b.c", None),
    ("javascript:void(0)", None),
    ("nonsense", None),
]


@pytest.fixture(scope="module")
def row(spark):
    def one(sql, **values):
        cols = ", ".join(f"{'null' if v is None else repr(v)} as {k}" for k, v in values.items()) or "1 as one"
        return spark.sql(f"select {cols}").selectExpr(f"{sql} as x").first()[0]

    return one


def test_canonicalize(spark):
    df = spark.createDataFrame(CANON, "raw string, want string")
    bad = df.selectExpr("raw", "want", f"{U.canonicalize('raw')} as got").where("not (got <=> want)").collect()
    assert bad == []


def test_domains_and_kinds(spark, row):
    for host, want in [("www.shop.example.co.il", "example.co.il"), ("sub.gov.il", "sub.gov.il"), ("a.b.example.com", "example.com"), ("localhost", "localhost")]:
        assert row(U.registrable_domain("h"), h=host) == want
    for url, kind in [("https://a.co.il/f.pdf", "document"), ("https://a.co.il/f.DOCX", "document"), ("https://a.co.il/style.css", "ignore"), ("https://a.co.il/page", "page")]:
        assert row(U.link_kind("u"), u=url) == kind


def test_resolve(row):
    base = "https://a.org/x/y?q=1#f"
    for href, want in [("z", "https://a.org/x/z"), ("/z", "https://a.org/z"), ("?p=2", "https://a.org/x/y?p=2"), ("//b.org/z", "https://b.org/z"), ("#t", "https://a.org/x/y?q=1#t"), ("mailto:q", "mailto:q")]:
        assert row(U.resolve("h", "b"), h=href, b=base) == want


def test_scope(row):
    start = "'https://a.org/'"
    assert row(U.in_scope("u", start), u="https://www.a.org/x") is True
    assert row(U.in_scope("u", start, "array('b[.]org')"), u="https://b.org/x") is True
    assert row(U.in_scope("u", start, "array('b[.]org')", "array('/x')"), u="https://b.org/x") is False


def test_slugs(row):
    assert row(U.slug("u"), u="https://a.org/") == "home"
    assert row(U.slug("u"), u="https://a.org/x/y.html?p=1") == "x-y-html-p-1"
    assert len(row(U.slug("u"), u="https://a.org/" + "a" * 200)) == 80


def test_strip_html(row):
    html = "<script>x</script><style>y</style><p>a&nbsp;b &amp; &quot;c&quot; &#1488;</p>"
    assert row(U.strip_html("h"), h=html) == 'a b & "c" א'


def test_token_matches_the_standard_library(row):
    want = hmac.new(b"k" * 80, b"example.org:acct", hashlib.sha256).hexdigest()[:32]
    assert row(U.ownership_token("d", "a", "k" * 80), d="Example.org", a="acct") == want


def test_normalise_domain(row):
    for raw, want in [("HTTPS://Example.org/x", "example.org"), ("example.org:80", "example.org"), ("nodots", None), ("-a.org", None), ("a b.org", None), ("", None)]:
        assert row(U.normalise_domain("r"), r=raw) == want
