"""Two captures are extracted at the same time."""

import threading

from pagelens.session import together


def test_two_captures_are_extracted_at_the_same_time():
    meet = threading.Barrier(2, timeout=20)
    assert together(lambda: meet.wait() >= 0, lambda: meet.wait() >= 0) == [True, True]


def test_diff_runs_both_extractions_together(spark):
    from pagelens.plans import queries
    meet = threading.Barrier(2, timeout=60)

    class Run:
        page_urls = spark.createDataFrame([(1, "u")], "page_id long, url string")

        @property
        def kept_nodes(self):
            meet.wait()
            return spark.createDataFrame([(1, 7)], "page_id long, eid int")

    assert [n.select("url", "eid").collect() for n in queries._nodes_of_captures(Run(), Run())] == [[("u", 7)]] * 2
