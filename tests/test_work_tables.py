"""Work tables: compressed, bucketed, read by columns; what reads them often does not compute them again."""

import os

from pyspark.sql import functions as F

from pagelens.operators import lint
from pagelens.plans.extract import Extraction, ExtractOptions, persist


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_work_table_is_small_and_keeps_the_deal(spark):
    df = spark.range(20000).select(F.col("id").alias("page_id"), F.repeat(F.lit("<button>Save</button>"), 20).alias("text"),
                                   F.create_map(F.lit("id"), F.lit(None).cast("string")).alias("attrs"), F.array(F.lit(1), F.lit(None)).alias("key"))
    df = df.unionByName(df.limit(3)).unionByName(df.limit(2).withColumn("page_id", F.lit(None).cast("long")))  # repeated and null keys stay
    folder = spark.sparkContext.getCheckpointDir()
    folder = folder.removeprefix("file:")
    before = _size(folder)
    kept = persist(df)
    assert _size(folder) - before < 20000 * 420 / 10  # rows as they are: 8.4 MB of text
    assert kept.columns == df.columns and kept.count() == 20005
    assert kept.filter("page_id is null").count() == 2 and kept.filter("page_id = 0").count() >= 2
    counts = kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in _plan(counts)
    by_text = persist(df.select("text"))  # no page: plain rows
    assert by_text.count() == 20005


def test_nodes_are_resolved_once(spark):
    html = "<html><body><button>Save</button><button>Save</button><a href='/x'>Go</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.test/", html), (2, "http://a.test/2", html)], "page_id long, url string, html string")
    ex = Extraction(pages, ExtractOptions(max_nodes=None))
    assert ex.kept_nodes.count() == 6
    plan = _plan(ex.page_meta)
    assert "MapInArrow" not in plan and "posexplode" not in plan and "primary_locator" not in plan  # only counts are read
    capped = ex.with_options(max_nodes=2)
    assert capped.resolved is ex.resolved
    assert [(r.node_count, r.truncated) for r in capped.page_meta.orderBy("page_id").collect()] == [(2, True), (2, True)]


def test_diff_reads_numbered_nodes_once(spark):
    html = "<html><body><button>Save</button>%s</body></html>"
    sides = []
    for more in ("", "<button>New</button>"):
        pages = spark.createDataFrame([(1, "http://a.test/", html % more)], "page_id long, url string, html string")
        ex = Extraction(pages, ExtractOptions(max_nodes=None))
        sides.append(ex.kept_nodes.join(ex.pages.select("page_id", "url"), "page_id"))
    kept = []

    def keep(df, by):
        kept.append(by)
        return persist(df, by)

    diff = lint.state_diff(*sides, keep)
    assert kept == ["url", "url"]
    assert "primary_locator" not in _plan(diff)
    assert [(r.change, r.accessible_name) for r in diff.collect()] == [("added", "New")]
