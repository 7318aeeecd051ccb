"""Plan audit: the physical shape of every registered query (development aid).

For each query: file scans (Parquet, text), shuffle exchanges, single-partition exchanges, join kinds,
windows, top-k and cached scans of the executed plan — to check that filters and columns reach
the scan, that no raw-log window runs on one partition, and that broadcasts are bounded.
"""

from __future__ import annotations

import re

_PATTERNS = [
    "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
    "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window",
    "TakeOrderedAndProject", "InMemoryTableScan", "ReusedExchange",
]


def audit(spark, sf_dir: str, execute: bool = False) -> list[dict]:
    from encore.plans.registry import QUERIES

    rows = []
    for name, q in QUERIES.items():
        if name.startswith("skip_"):
            continue  # MLlib fits run eagerly; their plans are per-stage
        df = q(spark, sf_dir)
        if execute:
            df.collect()  # the executed (adaptive) plan of this DataFrame; use small test data
        plan = df._jdf.queryExecution().executedPlan().toString()
        rec = {"query": name, "scans": len(re.findall(r"FileScan \w+", plan))}
        for p in _PATTERNS:
            rec[p] = plan.count(p)
        rows.append(rec)
    return rows


def to_markdown(rows: list[dict]) -> str:
    short = {
        "Exchange hashpartitioning": "hash xchg", "Exchange rangepartitioning": "range xchg",
        "Exchange SinglePartition": "single xchg", "BroadcastExchange": "bcast", "BroadcastHashJoin": "BHJ",
        "SortMergeJoin": "SMJ", "BroadcastNestedLoopJoin": "BNLJ", "CartesianProduct": "cartesian",
        "Window": "window", "TakeOrderedAndProject": "top-k", "InMemoryTableScan": "cached",
        "ReusedExchange": "reused",
    }
    head = ["query", "scans"] + [short[p] for p in _PATTERNS]
    out = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows:
        out.append("| " + " | ".join([r["query"], str(r["scans"])] + [str(r[p] or "") for p in _PATTERNS]) + " |")
    return "\n".join(out)
