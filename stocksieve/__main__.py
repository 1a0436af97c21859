"""Run a registered query by name.

    python -m stocksieve list
    python -m stocksieve q_13f_weights /root/testdata/sf0.01 [--show 20] [--out PATH] [--master local[8]]
    python -m stocksieve explain q_13f_weights /root/testdata/sf0.01
    python -m stocksieve oracle q_13f_weights        # print the DuckDB oracle SQL
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="stocksieve")
    ap.add_argument("command", help="'list', 'explain', 'oracle' or a query name")
    ap.add_argument("args", nargs="*")
    ap.add_argument("--show", type=int, default=20, help="rows to print (a top-n, not the whole result)")
    ap.add_argument("--out", help="write the full result as parquet to this path")
    ap.add_argument("--master", default=None)
    ns = ap.parse_args(argv)

    from .plans import ORACLES, QUERIES
    if ns.command == "list":
        for name in sorted(QUERIES):
            print(name)
        return 0
    if ns.command == "oracle":
        print(ORACLES[ns.args[0]])
        return 0

    from .session import get_spark
    explain = ns.command == "explain"
    name, rest = (ns.args[0], ns.args[1:]) if explain else (ns.command, ns.args)
    if name not in QUERIES:
        print(f"unknown query {name!r}; try 'list'", file=sys.stderr)
        return 2
    sf_dir = rest[0] if rest else "/root/testdata/sf0.01"
    spark = get_spark(ns.master)
    df = QUERIES[name](spark, sf_dir)
    if explain:
        df.explain("formatted")
    elif ns.out:
        df.write.mode("overwrite").parquet(ns.out)
    else:
        df.show(ns.show, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
