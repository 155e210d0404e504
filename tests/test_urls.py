"""URL operators (C1, C2, C15, B10) on literal URLs."""
from pyspark.sql import functions as F

from quarry.functions import urls as U


def _eval(spark, fn, vals):
    df = spark.createDataFrame([(v,) for v in vals], "u string")
    return [r[0] for r in df.select(fn(F.col("u"))).collect()]


def test_canonical_guess(spark):
    cases = {"https://example.com/a/": "https://example.com/a", "https://example.com/a//": "https://example.com/a/",
             "https://example.com/a#a": "https://example.com/a", "https://example.com/#/route": "https://example.com#/route",
             "https://example.com/a?b=2&a=1": "https://example.com/a?b=2&a=1",
             "HTTPS://Example.COM:8080/x/": "https://Example.COM:8080/x", "not a url": None}
    got = _eval(spark, U.canonical_guess, list(cases))
    assert got == list(cases.values())


def test_hostname(spark):
    got = _eval(spark, U.hostname, ["https://User@Example.COM:8080/x", "http://a.b/c", "nope"])
    assert got == ["Example.COM", "a.b", None]


def test_levels(spark):
    got = _eval(spark, U.levels, ["https://a.com/x//y/"])[0]
    assert [(r.url, r.text) for r in got] == [("https://a.com", "a.com"), ("https://a.com/x", "x"),
                                              ("https://a.com/x/y", "y")]


def test_resolve(spark):
    df = spark.createDataFrame([("https://a.com/d/p?q#f", r) for r in
                                ["/x", "//b.com/y", "z", "?k", "#h", "", "http://c.com/"]], "b string, r string")
    got = [r[0] for r in df.select(U.resolve(F.col("b"), F.col("r"))).collect()]
    assert got == ["https://a.com/x", "https://b.com/y", "https://a.com/d/z", "https://a.com/d/p?k",
                   "https://a.com/d/p?q#h", "https://a.com/d/p?q", "http://c.com/"]
