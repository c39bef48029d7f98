"""Summarise the final (post-AQE) physical plan of every registered query.

    python tests/plan_summary.py [sf_dir] > docs/PLANS.md

Each query is executed once; its final adaptive plan (after AQE re-planned
with runtime sizes) is then read for shuffles, broadcasts, scans (columns
read), join strategies, aggregate kinds, windows and generators.
"""

from __future__ import annotations

import re
import sys


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "scans": len(re.findall(r"(FileScan|Scan parquet|Scan ExistingRDD|Scan csv)", plan)),
        "read_cols": [len(m.split(",")) for m in re.findall(r"FileScan \w+ \[([^\]]*)\]", plan)],
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:2],
        "joins": sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)"
                                       r"[^\n]*?(Inner|LeftOuter|FullOuter|LeftAnti|LeftSemi|RightOuter)", plan))),
        "aggs": sorted(set(re.findall(r"(HashAggregate|SortAggregate|ObjectHashAggregate)", plan))),
        "windows": plan.count("Window ["),
        "generate": "Generate" in plan,
    }


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from acvlens.plans.registry import QUERIES
    from acvlens.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=16)
    print("# Final physical plans (post-AQE) per query\n")
    print(f"Generated by `tests/plan_summary.py` at `{sf_dir}` on local[8] (final adaptive plans). "
          "At cluster scale AQE decides broadcast vs sort-merge by the measured sizes, so fact-sized "
          "joins that are broadcast here (orders, part at this scale factor) sort-merge there; the "
          "shuffle structure is the same. Materialized intermediates appear as Parquet scans; "
          "shuffles include those of the materialize jobs' inputs only when in "
          "the same plan.\n")
    print("Columns read: the number of columns each Parquet scan reads (after pruning), per scan.\n")
    print("| Query | shuffles | broadcasts | scans (cols read) | joins | aggregates | windows | explode |")
    print("|---|---|---|---|---|---|---|---|")
    for name, q in QUERIES.items():
        qe = q(spark, sf_dir)._jdf.queryExecution()
        qe.toRdd().count()                       # run this QueryExecution so AQE finalizes its plan
        final = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarise(final)
        joins = ", ".join(f"{a} {b}" for a, b in s["joins"]) or "—"
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['scans']} ({','.join(map(str, s['read_cols']))}) "
              f"| {joins} | {', '.join(s['aggs']) or '—'} | {s['windows']} | {'yes' if s['generate'] else ''} |")


if __name__ == "__main__":
    main(sys.argv)
