"""Column functions and gates on small literal rows."""

from pyspark.sql import functions as F

from pagelens.functions.url import resolve_href
from pagelens.operators.gate import auth_check, refusal


def test_resolve_href(spark):
    rows = [("/für", "https://B.example.net:443/x/y", "https://b.example.net/f%C3%BCr"),
            ("rel/a/../b", "http://h/d1/d2/f", "http://h/d1/d2/rel/b"),
            ("?q=1", "http://h/p?x#f", "http://h/p?q=1"),
            ("#top", "http://h/p?x#f", "http://h/p?x#top"),
            ("//o.test/x y", "https://h/", "https://o.test/x%20y"),
            ("mailto:a@b", "http://h/", "mailto:a@b"),
            ("HTTP://X.COM/./a/../b/.", "http://h/", "http://x.com/b/")]
    df = spark.createDataFrame(rows, "h string, b string, want string")
    got = df.select("want", resolve_href(F.col("h"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_allow_list_cases(spark):
    hosts = ["staging.app.test", "*.corp.test", "localhost:3000"]
    urls = [("http://staging.app.test/x", True), ("https://STAGING.app.test:8443/", True),
            ("http://a.b.corp.test/", True), ("http://corp.test/", True), ("http://evilcorp.test/", False),
            ("http://localhost:3000/", True), ("http://localhost:4000/", False), ("ftp://staging.app.test/", False),
            ("https://localhost:443/", False)]
    df = spark.createDataFrame(urls, "url string, ok boolean")
    got = df.select("url", "ok", refusal(F.col("url"), hosts).alias("r")).collect()
    for r in got:
        assert (r["r"] is None) == r["ok"], r
    scheme = [r for r in got if r["url"].startswith("ftp")][0]["r"]
    assert scheme == "Only http/https URLs are allowed (got scheme 'ftp')."
    none = df.select(refusal(F.col("url"), []).alias("r")).first()["r"]
    assert none.startswith("allowed_hosts is empty.")


def test_auth_check(spark):
    log = spark.createDataFrame([(1, "http://h/app", "http://h/auth/login?next=1"), (2, "http://h/app", "http://h/app/")],
                                "page_id long, requested_url string, final_url string")
    got = {r["page_id"]: r for r in auth_check(log).collect()}
    assert got[1]["looks_logged_out"] is True and got[1]["redirected"] is True
    assert got[2]["looks_logged_out"] is False and got[2]["redirected"] is False
