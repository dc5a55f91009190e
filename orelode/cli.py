"""Command line: mine a transaction file with a profit file.

    python -m orelode.cli transactions.txt profits.txt 100 0.7 --search depth_first --output out.csv
"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from .functions.shipping import ship
from .model import Collector, Join, Params, Search
from .plans.mine import mine
from .sources.text import load, result_table, sizes, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orelode", description="Top-k high-utility itemsets over uncertain transactions.")
    p.add_argument("transactions")
    p.add_argument("profits")
    p.add_argument("k", type=int)
    p.add_argument("min_prob", type=float)
    p.add_argument("--search", default="breadth_first", help=", ".join(x.name.lower() for x in Search))
    p.add_argument("--join", default="two_pointer", help=", ".join(x.name.lower() for x in Join))
    p.add_argument("--collector", help="by default what spark.orelode.collector names; " + ", ".join(x.name.lower() for x in Collector))
    p.add_argument("--output", "-o", help="write the table as CSV into this folder instead of printing it")
    p.add_argument("--no-parallel", action="store_true", help="one task at a time")
    p.add_argument("--lenient", action="store_true", help="keep quantities of 0 and less when reading")
    p.add_argument("--debug", action="store_true")
    return p


def run(args: argparse.Namespace) -> int:
    """0, or 1 with a message on stderr."""
    try:
        params = Params(args.k, args.min_prob, args.search, args.join, args.collector or Collector.BASELINE, args.debug)
        logging.basicConfig(level=logging.DEBUG if args.debug else logging.WARNING, stream=sys.stderr)
        logging.getLogger("py4j").setLevel(logging.WARNING)
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.appName("orelode")
        spark = (builder.master("local[1]") if args.no_parallel else builder).getOrCreate()
        ship(spark)
        occ, profit = load(spark, args.transactions, args.profits, not args.lenient)
        if args.debug:
            print(sizes(occ, profit).first().asDict(), file=sys.stderr)
        began = time.perf_counter()
        found = mine(occ, profit, params.k, params.min_prob, params.search, params.join, args.collector)
        if args.output:
            write_results(found, args.output)
        else:
            for r in result_table(found).orderBy("rank").collect():
                print(f"{r['rank']:>6}  {r['itemset']}  EU {r['eu']}  EP {r['ep']}")
        if args.debug:
            print(f"{time.perf_counter() - began:.3f} s", file=sys.stderr)
    except Exception as e:  # the command's contract: any error is one line and exit code 1
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(parser().parse_args()))
