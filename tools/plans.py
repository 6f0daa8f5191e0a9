"""Flag physical operators that would not hold at scale in any registered query.

usage: python tools/plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldshift.catalog import QUERIES  # noqa: E402
from fieldshift.session import local_session  # noqa: E402

FLAGS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition", "PythonMapInArrow", "MapInPandas", "FlatMapGroups", "FlatMapCoGroups", "ArrowEvalPython", "SortAggregate")


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.001")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.names or QUERIES:
        plan = QUERIES[name](spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        found = {f: len(re.findall(rf"\b{f}\b", plan)) for f in FLAGS if f in plan}
        print(name, "exchanges", len(re.findall(r"Exchange hashpartitioning", plan)), found or "", flush=True)


if __name__ == "__main__":
    main()
