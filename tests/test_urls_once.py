"""URL parts are computed one time, and are taken apart only where something changes."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions.url import resolve_href

CASES = [("/a.b/c", "http://x.test/"), ("../.a/./b", "http://x.test/p/q/r"), ("..", "http://x.test/p/q/r"), ("é b?é'", "https://X.test:443/é/d"),
         ("#a`", "http://x.test/a?b#c"), ("", "http://x.test/.a"), ("x", None), (None, "http://x.test"), ("mailto:a", "http://x.test")]
WANT = ["http://x.test/a.b/c", "http://x.test/p/.a/b", "http://x.test/p/", "https://x.test/%C3%A9/%C3%A9%20b?%C3%A9%27",
        "http://x.test/a?b#a%60", "http://x.test/.a", None, None, "mailto:a"]


@pytest.mark.parametrize("whole", [False, True])
def test_resolved(spark, whole):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, h string, b string")
    if whole:  # as constants, without generated code
        got = [spark.range(1).select(resolve_href(F.lit(h).cast("string"), F.lit(b).cast("string"))).first()[0] for h, b in CASES]
    else:
        got = [r[0] for r in df.orderBy("i").select(resolve_href(F.col("h"), F.col("b"))).collect()]
    assert got == WANT


def test_target_is_written_once(spark):
    plan = spark.range(1).select(resolve_href(F.col("id").cast("string"), F.lit("http://x.test/")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("http://x.test/") < 60
