"""Print the physical-plan shape of the main extraction stages: exchanges,
broadcasts, joins and windows of each stage's plan (every stage starts from the
checkpointed output of the previous one). Usage: python tools/explain_plans.py [sf_dir] [--full]"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def shape(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    ops = {
        "shuffle": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "broadcast": len(re.findall(r"BroadcastExchange", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "bhj": len(re.findall(r"BroadcastHashJoin", plan)),
        "window": len(re.findall(r"\bWindow\b", plan)),
        "aggregate": len(re.findall(r"HashAggregate|ObjectHashAggregate|SortAggregate", plan)),
    }
    return ops


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and not sys.argv[1].startswith("--") else "/root/testdata/sf0.01"
    from pagelens.plans.queries import extraction
    from pagelens.session import get_spark

    spark = get_spark("local[8]", 8)
    ex = extraction(spark, sf_dir)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan, not AQE's runtime one
    from pagelens.operators import locate as L
    stages = {
        "locators (resolve over checkpointed candidates / pairs)": L.resolve(ex.candidates, ex.match_pairs, ex.raw_nodes),
        "match pairs (candidate keys x element values)": L.match_pairs(
            ex.candidates.select("page_id", "frame_id", *L.CKEY).distinct(), ex.match_universe, "contains", ex.n_parts),
        "nodes (budget window)": ex.nodes,
        "extracts (nested document per page)": ex.extracts,
    }
    for name, df in stages.items():
        print(f"{name}: {shape(df)}")
        if "--full" in sys.argv:
            df.explain("formatted")


if __name__ == "__main__":
    main()
