"""``python -m lodestar.cli QUERY --data DIR [-t THREADS]``: run one query document."""

from __future__ import annotations

import argparse
import time

from lodestar.operators.sinks import console
from lodestar.plans import printer
from lodestar.plans.compiler import compile_plan
from lodestar.plans.parser import parse_query
from lodestar.session import local_session
from lodestar.sources.catalog import StarCatalog


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestar", description="Run a star query written as JSON.")
    p.add_argument("query", help="a path, or the name of a query of the corpus such as q2_1")
    p.add_argument("--data", required=True, help="folder with the tables as parquet")
    p.add_argument("-t", "--threads", type=int, help="worker threads (default: all)")
    p.add_argument("--repeat", type=int, default=1, help="run so many times and print each time")
    p.add_argument("--compat", action="store_true", help="drop zero groups, skip unknown names")
    p.add_argument("--explain", action="store_true", help="print the join graph and the physical plan")
    args = p.parse_args(argv)
    spark = local_session(args.threads or "*")
    catalog, plan = StarCatalog(spark, args.data), parse_query(args.query)
    print(printer.render(plan))
    df = compile_plan(catalog, plan, compat=args.compat)
    if args.explain:
        print(catalog.hierarchy.render(), printer.physical(df), sep="\n")
    for k in range(args.repeat):
        began = time.perf_counter()
        text = console(df)
        print(f"Run {k + 1}: {time.perf_counter() - began:.3f} s")
    print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
