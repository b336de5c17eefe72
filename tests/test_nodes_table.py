"""The nodes table: runs replaced as a whole, reads by page without an exchange, newest captures, streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from pagelens.operators.nodes_table import read_nodes, write_rows
from pagelens.plans.extract import ExtractOptions
from pagelens.streaming.stream import extract_batch


def captures(spark, rows, day):
    return (spark.createDataFrame([(i, f"http://app.test/{i}", html) for i, html in rows], "page_id long, url string, html string")
            .withColumn("captured_at", F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00"))))


@pytest.fixture()
def table(spark, tmp_path):
    name = f"nodes_{uuid.uuid4().hex}"
    yield name, str(tmp_path / "nodes")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def nodes(spark, keys, day, name="n"):
    rows = [(i, "0", k, k + 1, name) for i, n in keys for k in range(n)]
    return (spark.createDataFrame(rows, "page_id long, frame_key string, doc_order int, node_no long, role string")
            .withColumn("captured_at", F.lit(f"2024-01-0{day}")))


def test_runs_and_buckets(spark, table):
    name, path = table
    write_rows(nodes(spark, [(i, 2) for i in range(20)], 1), name, "one", buckets=4, path=path)
    write_rows(nodes(spark, [(i, 2) for i in range(20)], 1), name, "one", buckets=4, path=path)  # the same run again
    assert read_nodes(spark, name).count() == 40
    write_rows(nodes(spark, [(3, 1), (None, 1)], 2, "new"), name, "two", path=path)
    assert read_nodes(spark, name).count() == 42 and read_nodes(spark, name, runs=["two"]).count() == 2
    newest = read_nodes(spark, name, latest=True)
    assert newest.count() == 40
    assert [(r.role, r.run_id, r.node_no) for r in newest.where("page_id = 3").collect()] == [("new", "two", 1)]
    rows = read_nodes(spark, name)
    assert exchanges(rows.groupBy("role").count()) == 1
    assert exchanges(rows.groupBy("page_id").count()) == 0
    per_page = rows.groupBy("page_id").agg(F.count("*").alias("n"))
    assert exchanges(rows.hint("merge").join(per_page, "page_id")) == 0  # no broadcast: it would be an exchange too
    assert exchanges(newest.groupBy("page_id", "role").count()) == 0
    pruned = read_nodes(spark, name, runs=["two"])._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in pruned.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_run_and_refused_names(spark, table):
    name, path = table
    none = nodes(spark, [(1, 1)], 1).limit(0)
    write_rows(none, name, "none", buckets=2, path=path)
    assert read_nodes(spark, name).count() == 0 and read_nodes(spark, name, latest=True).count() == 0
    with pytest.raises(ValueError):
        write_rows(none, name, "a'b")


def test_stream_writes_runs(spark, table):
    name, path = table
    batch = captures(spark, [(1, "<button>a</button><a href='/x'>l</a>"), (2, None)], 1)
    extract_batch(batch, 7, path + "-sink", ExtractOptions(), nodes_table=name, nodes_path=path)
    got = read_nodes(spark, name).orderBy("node_no").collect()
    assert [(r.run_id, r.page_id, r.node_no, r.tag, r.url, r.schema_version) for r in got] == [("batch-7", 1, 1, "button", "http://app.test/1", "1.1"), ("batch-7", 1, 2, "a", "http://app.test/1", "1.1")]
