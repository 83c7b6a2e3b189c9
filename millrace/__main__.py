"""python -m millrace PLAN [--path DIR] [--master URL] [--tree] [--profile]: runs a plan file and prints its rows."""

from __future__ import annotations

import argparse
import datetime
import sys
import time

from pyspark.sql import SparkSession

from .errors import PlanError
from .plans.compiler import compile_plan
from .plans.config import parse


def shown(value) -> str:
    """A value as the rows have it: two digits after the point for decimals, dates without a time where there is none."""
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.2f}"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d" if value.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")
    return str(value)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("plan", help="a plan file")
    parser.add_argument("--path", help="what file names in the plan begin with, in place of its own path setting")
    parser.add_argument("--master", help="Spark's master, where no session is set up otherwise")
    parser.add_argument("--tree", action="store_true", help="print the operator tree after the rows")
    parser.add_argument("--profile", action="store_true", help="and run it up to each cycle_accountant or printer_perfcount for rows, time and task counters")
    given = parser.parse_args(args)
    with open(given.plan, encoding="utf-8") as f:
        text = f.read()
    builder = SparkSession.builder if given.master is None else SparkSession.builder.master(given.master)
    spark = builder.getOrCreate()
    began = time.perf_counter()
    try:
        spec = parse(text)
        plan = compile_plan(spec if given.path is None else {**spec, "path": given.path}, spark)
    except PlanError as e:
        print(f"ERROR: {type(e).__name__}: {e}", file=sys.stderr)
        return 2
    for row in plan.run().toLocalIterator():
        print("|".join(map(shown, row)))
    print(f"ResponseTimeInSec: {time.perf_counter() - began:.6f}")
    for name, seen in plan.observations.items():
        print(f"{name}: {seen.get['rows']} rows", file=sys.stderr)
    if given.tree or given.profile:
        measured = plan.profile() if given.profile else []
        print(plan.tree(measured))
        if measured:
            print(f"Max Memory (bytes): {max(m.most_memory for m in measured)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
