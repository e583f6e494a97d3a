"""Physical-plan summaries: shuffles, broadcasts, scans, windows, Python nodes.

``python -m ratelens.plans.inspect [sf_dir] > PLANS.md`` writes one row per
registered query, from the plan Spark would run with automatic broadcast
turned off (the shape a large cluster gets for big inputs; explicit,
size-checked broadcasts remain).
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame

_PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                 "MapInPandas", "FlatMapCoGroupsInPandas", "AggregateInPandas")


def plan_summary(df: DataFrame) -> dict[str, object]:
    """Counts of the interesting operators in the executed (pre-AQE) plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    node = lambda name: sum(1 for ln in lines if re.search(rf"[-+:\s]\*?\s*(\(\d+\)\s*)?{name}\b", ln)
                            or ln.lstrip().startswith(name))
    scans = re.findall(r"FileScan parquet[^\[]*\[([^\]]*)\].*?Location: [^\[]*\[([^\]]*)\]", plan)
    names = set()
    for _, loc in scans:
        m = re.search(r"([A-Za-z_]+\.parquet)", loc)
        names.add(m.group(1) if m else "written intermediate")
    tables = sorted(names)
    return {
        "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange RoundRobinPartitioning") + plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "windows": sum(1 for ln in lines if ln.lstrip(" :+-*").startswith("Window ")),
        "scans": len(scans),
        "tables": ", ".join(tables),
        "python": any(p in plan for p in _PYTHON_NODES),
        "pushed_filters": "PushedFilters: [" in plan and "PushedFilters: []" not in plan,
    }


def main(argv: list[str]) -> int:
    from ..plans.catalog import MODEL_QUERIES, QUERIES
    from ..session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    print("# Physical plans per query\n")
    print(f"Generated by `python -m ratelens.plans.inspect {sf_dir}` with automatic broadcast "
          "off (explicit, size-checked broadcasts stay). Counts are from the plan before "
          "adaptive re-planning; `python` is true if any Python/pandas node runs. "
          "Model queries train models and are listed without a plan. Queries that start "
          "from a written intermediate (`materialize`: the split input, the distinct-score "
          "groups of the ranking metrics) show the plan after that write, so their base-table "
          "scans happen once, in the write job.\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | windows | scans | tables | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name in sorted(QUERIES):
        if name in MODEL_QUERIES:
            print(f"| {name} | model | | | | | | | |")
            continue
        s = plan_summary(QUERIES[name](spark, sf_dir))
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['sort_merge_joins']} | "
              f"{s['broadcast_joins']} | {s['windows']} | {s['scans']} | {s['tables']} | "
              f"{s['python']} |")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
