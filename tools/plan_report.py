"""Summarise the final (AQE) physical plans of the headline queries.

usage: python tools/plan_report.py [sf_dir] > PLANS.md

Broadcast joins by size are switched off, so the joins are those of large tables.  Only the final adaptive plan is counted
(its text also holds the initial one).  The jobs that building a query runs before its last plan are counted too.  A cartesian
product, or a nested-loop join without a broadcast of one row, ends the report with an error.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ferrule.plans.queries import QUERIES  # noqa: E402
from ferrule.session import get_session  # noqa: E402

NODES = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "Window", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject",
         "ArrowEvalPython", "BatchEvalPython")


def final_plan(text: str) -> str:
    """The final part of an adaptive plan's text, with the subplans that are not adaptive."""
    return re.sub(r"== Initial Plan ==.*?(?=== Final Plan ==|\Z)", "", text, flags=re.S)


def summarise(plan: str) -> dict:
    out = {n: len(re.findall(r"\b" + n + r"\b", plan)) for n in NODES}
    out["Exchange"] = len(re.findall(r"\bExchange (hash|range|Single|Round)", plan))
    out["BroadcastExchange"] = plan.count("BroadcastExchange")
    out["ReusedExchange"] = plan.count("ReusedExchange") + plan.count("ReusedQueryStage")
    return {k: v for k, v in out.items() if v}


def scans(plan: str):
    for line in plan.split("\n"):
        if "FileScan" not in line:
            continue
        loc = re.search(r"Location: \w+\((?:\d+ paths)?\)\[([^\]]*)\]", line)
        name = os.path.basename(loc.group(1).split(",")[0]) if loc else "?"
        if re.fullmatch(r"[0-9a-f]{32}", name):
            name = "materialised intermediate"
        pushed = re.search(r"PushedFilters: (\[[^\]]*\]?)", line)
        part = re.search(r"PartitionFilters: (\[[^\]]*\]?)", line)
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
        yield name, part.group(1) if part else "", pushed.group(1) if pushed else "", schema.group(1) if schema else ""


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    tracker = spark.sparkContext.statusTracker()
    bad = []
    print(f"# Final physical plans of the headline queries ({os.path.basename(sf_dir)})\n")
    print("Generated by `tools/plan_report.py` with broadcasting by size off: node counts of the final adaptive plan,")
    print("the jobs run before it, and per Parquet scan the partition filters, pushed filters and read schema.\n")
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        df = QUERIES[name](spark, sf_dir)
        eager = len(tracker.getJobIdsForGroup(name))
        df.collect()
        plan = final_plan(df._jdf.queryExecution().executedPlan().toString())
        nodes = summarise(plan)
        if nodes.get("CartesianProduct") or nodes.get("BroadcastNestedLoopJoin"):
            bad.append(name)
        counts = ", ".join(f"{k} {v}" for k, v in nodes.items())
        print(f"## {name}\n\n{counts}\n\nJobs before the last plan: {eager}\n")
        seen = set()
        for row in scans(plan):
            if row in seen:
                continue
            seen.add(row)
            t, part, pushed, schema = row
            print(f"* scan `{t}` — partition filters `{part or '[]'}`; pushed `{pushed or '[]'}`; read `{schema}`")
        print()
    print(f"Cartesian or nested-loop joins: {', '.join(bad) or 'none'}.")
    if bad:
        sys.exit(1)


if __name__ == "__main__":
    main()
