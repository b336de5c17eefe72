"""Streaming wrapper, state diff (J13), action checks (Q4) and lint (J12) on fixtures."""

import os
import tempfile

from pyspark.sql import functions as F

from pagelens.operators.lint import check_actions, lint_locators, state_diff
from pagelens.plans.extract import ExtractOptions, Extraction

BEFORE = """<form id="desk"><label for="badge">Badge number</label><input id="badge" placeholder="six digits">
<button id="open" type="button">Open the desk</button></form>"""
AFTER = BEFORE + """<div role="alert" data-testid="desk-open">The desk is open</div>"""


def test_state_diff_added_toast(spark):
    pages = spark.createDataFrame([(1, "http://app.test/toast", BEFORE), (2, "http://app.test/toast", AFTER)],
                                  "page_id long, url string, html string")
    ex = Extraction(pages, ExtractOptions())
    n = ex.kept_nodes.join(pages.select("page_id", "url"), "page_id")
    d = state_diff(n.filter("page_id = 1"), n.filter("page_id = 2")).collect()
    assert len(d) == 1
    assert d[0]["change"] == "added" and d[0]["role"] == "alert"
    assert d[0]["locator"] == "getByTestId('desk-open')"
    assert d[0]["accessible_name"] == "The desk is open"


def test_actions_and_lint(spark):
    pages = spark.createDataFrame([(1, "http://app.test/toast", BEFORE)], "page_id long, url string, html string")
    ex = Extraction(pages, ExtractOptions())
    acts = spark.createDataFrame(
        [(1, 1, "fill", "placeholder", "six digits", None, None, "s3cret-pass", None, None),
         (1, 2, "click", "role", "Open the desk", "button", None, None, None, None),
         (1, 3, "click", "role", "Nope", "button", None, None, None, None),
         (1, 4, "wait", None, None, None, None, None, None, 20000),
         (1, 5, "press", "id", "open", None, None, None, "x" * 31, None),
         (1, 6, None, "id", "open", None, None, None, None, None),
         (1, 7, "click", None, "open", None, None, None, None, None),
         (1, 8, "fill", "id", "badge", None, None, None, None, None)],
        "page_id long, step int, type string, strategy string, value string, role string, nth int, text string, "
        "key string, ms int")
    codes = {r["step"]: r["code"] for r in check_actions(acts).collect()}
    assert codes == {1: None, 2: None, 3: None, 4: "wait_out_of_range", 5: "key_too_long", 6: "invalid_type", 7: "invalid_strategy",
                     8: "missing_text"}
    lint = lint_locators(acts, ex)
    status = {r["step"]: r["status"] for r in lint.collect()}
    assert status[1] == "ok" and status[2] == "ok" and status[3] == "missing" and status[5] == "ok"
    assert "s3cret-pass" not in str(lint.collect())


def test_streaming_available_now(spark):
    from pagelens.streaming import start
    src = tempfile.mkdtemp(prefix="pagelens-stream-src-")
    out = tempfile.mkdtemp(prefix="pagelens-stream-out-")
    ck = tempfile.mkdtemp(prefix="pagelens-stream-ck-")
    spark.createDataFrame([(1, "http://app.test/a", BEFORE), (2, "http://app.test/b", AFTER)],
                          "page_id long, url string, html string").write.mode("overwrite").parquet(src + "/part1")
    q = start(spark, src + "/part1", out, checkpoint_location=ck, available_now=True)
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(out, "batch_id=0", "extracts"))
    assert got.count() == 2
    assert got.filter(F.col("page_id") == 2).select(F.size("interactive_nodes")).first()[0] == 4


def test_drift_stream_across_captures(spark):
    """Three captures of one url through the streaming extractor (one batch each),
    then the stateful drift stream: first, same, changed."""
    from pagelens.streaming import drift_stream, extract_batch
    out = tempfile.mkdtemp(prefix="pagelens-drift-")
    ck = tempfile.mkdtemp(prefix="pagelens-drift-ck-")
    caps = [BEFORE, BEFORE, AFTER]
    for i, html in enumerate(caps):
        df = spark.createDataFrame([(i, "http://app.test/toast", html)], "page_id long, url string, html string")
        extract_batch(df, i, out, ExtractOptions())
    name = "drift_" + os.path.basename(out).replace("-", "_")
    q = (drift_stream(spark, out).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()  # availableNow: returns once every available file is processed
    got = [r["status"] for r in spark.sql(f"SELECT * FROM {name}").orderBy("captured_at").collect()]
    assert sorted(got) == ["changed", "first", "same"]
