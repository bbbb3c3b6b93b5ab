"""Print the physical plans of the headline operations (for PLANS.md).

    python plans_report.py [sf_dir]

Builds both written layouts of the index (path layout partitioned by bucket,
and catalog tables bucketed by file_id) under the session's checkpoint folder
and reports, per operation, the exchanges, joins, windows and pushed filters
of ``explain("formatted")``.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

KINDS = (
    "Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
    "Window", "WindowGroupLimit", "HashAggregate", "Generate", "Scan parquet",
)


def summary(df) -> str:
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    ops = [o.strip() for o in re.findall(r"^\(\d+\) (.*)$", plan, re.M)]
    counts = {k: sum(1 for o in ops if o == k or o.startswith(k + " ")) for k in KINDS}
    pushed = sorted(set(re.findall(r"PushedFilters: (\[.*\])", plan)))
    buckets = sorted(set(re.findall(r"SelectedBucketsCount: (.*)", plan)))
    lines = [", ".join(f"{k} {v}" for k, v in counts.items() if v)]
    lines += [f"PushedFilters {p}" for p in pushed if p != "[]"]
    lines += [f"Buckets {b}" for b in buckets]
    return "\n".join("    " + x for x in lines)


def main() -> None:
    from quire.plans.index import TextIndex
    from quire.plans.search import file_matches, search_files
    from quire.session import checkpoint_dir, local_session
    from quire.sources.corpus import corpus_files

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, "quire-plans", 16)
    base = checkpoint_dir(spark) or tempfile.mkdtemp(prefix="quire-plans-")
    base = base[len("file:"):] if base.startswith("file:") else base
    root = os.path.join(base, f"quire-plans-{os.getpid()}-{int(time.time())}")
    built = TextIndex.build(corpus_files(spark, sf_dir))
    layouts = {
        "path layout (partitioned by bucket)": built.write(os.path.join(root, "paths")),
        "catalog tables (bucketed by file_id)": built.write_tables(
            f"quire_plans_{os.getpid()}", buckets=16, path=os.path.join(root, "tables")
        ),
    }
    ops = {
        "E1 fast headline, (of <-> the) | (was & with)": lambda i: search_files(i, "(of <-> the) | (was & with)"),
        "E1 fast headline, with | !the (needs the fragment universe)": lambda i: search_files(i, "with | !the"),
        "E2 built-in headline": lambda i: search_files(i, "(of <-> the) | (was & with)", "logical", "ts_headline"),
        "E5 matches of one book": lambda i: file_matches(i, "of <-> the", "logical", 7),
    }
    for lname, idx in layouts.items():
        print(f"## {lname}\n")
        for oname, fn in ops.items():
            print(f"* {oname}\n")
            print(summary(fn(idx)) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
