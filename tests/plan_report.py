"""Print a markdown table of the physical plans of every registered query.

    python tests/plan_report.py [sf_dir] [--large] > table.md

Counts are from the plan Spark would run (AQE initial plan): shuffles
(hash / range / single), broadcasts, join strategies, windows, sort
aggregates, and whether any scan carries pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.plan_tools import plan_text  # noqa: E402


def summarize(p: str) -> dict:
    return {
        "hash shuffles": len(re.findall(r"Exchange hashpartitioning", p)),
        "range shuffles": len(re.findall(r"Exchange rangepartitioning", p)),
        "single-partition": len(re.findall(r"Exchange SinglePartition", p)),
        "broadcasts": len(re.findall(r"BroadcastExchange", p)),
        "BHJ": len(re.findall(r"BroadcastHashJoin", p)),
        "SMJ": len(re.findall(r"SortMergeJoin", p)),
        "windows": len(re.findall(r"\bWindow \[", p)),
        "group limit": len(re.findall(r"WindowGroupLimit", p)),
        "sort agg": len(re.findall(r"SortAggregate", p)),
        "pushed filters": "yes" if re.search(r"PushedFilters: \[[^\]]", p) else "no",
    }


def main() -> None:
    from tendril.registry import QUERIES
    from tendril.session import local_session

    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    spark = local_session()
    if "--large" in sys.argv:  # the plan large tables get: only explicit (size-bounded) broadcasts
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = []
    for name, fn in QUERIES.items():
        rows.append((name, summarize(plan_text(fn(spark, sf_dir), "simple"))))
    cols = list(rows[0][1])
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
