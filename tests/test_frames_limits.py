"""Pages of the second review."""

from pagelens.plans import queries
from pagelens.plans.extract import Extraction, ExtractOptions


def test_frames_inside_embedded_pages(spark):
    """src frames are followed through several pages, srcdoc children included; a cycle stops at the ancestor's url."""
    pages = spark.createDataFrame([
        (1, "http://b.test/1", '<iframe src="/2"></iframe><button>one</button>'),
        (2, "http://b.test/2", '<iframe srcdoc="<button>inner</button><iframe src=\'/3\'></iframe>"></iframe><button>two</button>'),
        (3, "http://b.test/3", '<iframe src="/4"></iframe><iframe src="/1"></iframe><button>three</button>'),
        (4, "http://b.test/4", '<button>four</button><iframe src="http://o.test/"></iframe>')],
        "page_id long, url string, html string")
    e = Extraction(pages, ExtractOptions())
    rows = [r for r in e.kept_nodes.collect() if r["page_id"] == 1]
    got = {r["accessible_name"]: len(r["frame_path"]) for r in rows if r["tag"] == "button"}
    assert got == {"one": 0, "two": 1, "inner": 2, "three": 3, "four": 4}
    assert [len(r["frame_path"]) for r in rows if r["kind"] == "cross_origin_frame"] == [4]
    # main, 2, its srcdoc, 3, 4, the page of the other origin, and page 1 again without a document
    assert {m["page_id"]: m["frame_count"] for m in e.page_meta.collect()}[1] == 7


def test_queries_set_no_limits(spark, tmp_path):
    """Nodes after the 5,000th and below level 50 are in the rows of the registered queries; cap_depth still cuts."""
    doc = "".join(f'<a href="/{i}">l{i}</a>' for i in range(5010)) + "<div>" * 60 + '<a href="/deep">deep</a>'
    spark.createDataFrame([(1, "http://b.test/1", doc)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    nodes = queries.extraction(spark, str(tmp_path)).raw_nodes
    assert nodes.count() == 5011
    from pagelens.operators.assemble import cap_nodes
    opts = queries.extraction(spark, str(tmp_path)).opts
    assert cap_nodes(nodes.withColumn("frame_key", nodes["frame_id"]), opts.max_nodes).filter("within_budget").count() == 5011
    assert queries.extraction(spark, str(tmp_path), max_depth=50).elements.filter("depth_hit").count() == 1
