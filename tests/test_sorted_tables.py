"""Work tables are read in document order without a sort; variant runs build only what is read; parse output by columns."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagelens.operators.select import FRAME, covered
from pagelens.plans.extract import Extraction, ExtractOptions, persist
from pagelens.sources import pages as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    rows = [(p, f, e, e + 2) for p in (3, 1, None, 2) for f in (1, 0) for e in (4, 0, 2)]
    return spark.createDataFrame([*rows, *rows[:5]], "page_id long, frame_id int, eid int, last_eid int")  # repeated rows, null pages


def test_no_sort_by_page_frame_and_element(spark):
    kept, df = persist(_rows(spark)), _rows(spark)
    inside = lambda t: t.withColumn("inside", covered(F.col("eid") == 0))
    listed = lambda t: t.groupBy(*FRAME).agg(F.sort_array(F.collect_list("eid")).alias("eids"))
    paired = lambda t: t.hint("merge").join(t.select(*FRAME, "eid", F.col("last_eid").alias("l2")), [*FRAME, "eid"])
    for use in (inside, listed, paired):
        plan = _plan(use(kept))
        assert "Sort [" not in plan and "Exchange" not in plan and "ObjectHashAggregate" not in plan
        assert sorted(map(str, use(kept).collect())) == sorted(map(str, use(df).collect()))


def test_variant_builds_what_is_read(spark):
    html = "<html><body><button>Save</button><button>Save as</button><iframe src='/2'></iframe></body></html>"
    pages = spark.createDataFrame([(1, "http://a.test/1", html), (2, "http://a.test/2", "<button>Inner</button>")], "page_id long, url string, html string")
    base = Extraction(pages, ExtractOptions(max_nodes=None))
    exact = base.with_options(match="exact")
    pairs = lambda ex: ex.match_pairs.filter("strategy = 'role' and value = 'Save'").count()
    assert pairs(exact) == 1
    assert "frame_tree" not in vars(base) and "frame_tree" not in vars(exact)  # matches read no frame tree
    assert exact.candidates is base.candidates and pairs(base) == 2
    assert exact.frame_tree is base.frame_tree and exact.with_options(max_nodes=1).frame_tree is base.frame_tree
    assert exact.locators is not base.locators


def test_urls_of_pages_are_rendered_once(spark):
    pages = spark.range(3).groupBy(F.col("id").alias("page_id")).agg(F.concat(F.lit("http://a.test/"), F.max("id")).alias("url"), F.lit("<button>Go</button>").alias("html"))
    ex = Extraction(pages, ExtractOptions(max_nodes=None))
    assert "Aggregate" not in _plan(ex.page_urls) and ex.page_urls.count() == 3
    assert ex.kept_nodes.count() == 3


def test_parse_output_by_columns(monkeypatch):
    real = P.parse_page

    def parse(doc, url):
        if "fail" in doc:
            raise ValueError("no\nmore")
        return real(doc, url)

    monkeypatch.setattr(P, "parse_page", parse)
    docs = ["<p id='a' class>x</p><iframe srcdoc='<b>i</b>'></iframe>", "fail", None]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array([7, None, 9], pa.int64()), "url": pa.array(["u", None, "w"]), "html": pa.array(docs)})
    out = [r for b in P._parse_batches(iter([batch])) for r in b.to_pylist()]
    assert [(r["page_id"], r["frame_id"], r["eid"]) for r in out if r["eid"] in (0, -1)] == [(7, 0, 0), (7, 1, 0), (None, 0, -1), (9, 0, 0)]
    p = next(r for r in out if r["tag"] == "p")
    assert p["attrs"] == [("id", "a"), ("class", "")] and p["text"] is None and p["parent_eid"] == 2
    failed = next(r for r in out if r["eid"] == -1)
    assert failed["attrs"] is None and failed["tag"] is None and failed["error_message"] == "no"
    assert out[0]["attrs"] == [] and out[0]["parent_eid"] is None and out[0]["text"] == "x" and out[0]["frame_url"] == "u"
