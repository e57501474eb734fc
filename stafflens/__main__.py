"""Command line: list the analyses, run one or all, or write the star schema.

    python -m stafflens list
    python -m stafflens run q49_dashboard [--sf DIR] [--show N] [--out PATH]
    python -m stafflens run-all [--sf DIR]
    python -m stafflens load --out PATH [--sf DIR]
    python -m stafflens run q12_flight_risk --as-of 2024-01-01
    python -m stafflens run q04_rate_marital --staging-csv HR.csv [--scores-csv S.csv] [--events-csv E.csv]

``--show`` prints the first N result rows (display only); ``--out`` writes the
whole result as Parquet. A cluster session comes from ``spark-submit``; run
locally, a local session is created.
"""

from __future__ import annotations

import argparse
import time
from datetime import date

from .plans.catalog import CATALOG

DEFAULT_SF = "/root/testdata/sf0.01"


def _session(cores: str):
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import local_session
    return local_session(cores)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="stafflens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the analysis keys")
    run = sub.add_parser("run", help="run one analysis")
    run.add_argument("key", choices=sorted(CATALOG))
    run.add_argument("--sf", default=DEFAULT_SF)
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--out")
    run_all = sub.add_parser("run-all", help="run every analysis, print row counts and seconds")
    run_all.add_argument("--sf", default=DEFAULT_SF)
    load = sub.add_parser("load", help="build and write the six star tables")
    load.add_argument("--sf", default=DEFAULT_SF)
    load.add_argument("--out", required=True)
    for p in (run, run_all, load):
        p.add_argument("--cores", default="*")
        p.add_argument("--as-of", type=date.fromisoformat, help="the date analyses look back from (YYYY-MM-DD)")
        p.add_argument("--staging-csv", help="the HR snapshot as CSV (header names as the staging schema)")
        p.add_argument("--scores-csv", help="optional score history CSV (employee_id, date_key, performance_score)")
        p.add_argument("--events-csv", help="optional event CSV (employee_id, event_date, event_type)")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for key in CATALOG:
            print(key)
        return 0
    spark = _session(args.cores)
    if args.staging_csv:
        from .sources.fixtures import register_csv_source
        args.sf = register_csv_source(spark, args.staging_csv, args.scores_csv, args.events_csv)
    if args.cmd == "run":
        df = CATALOG[args.key](spark, args.sf, as_of=args.as_of)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.show, truncate=False)
    elif args.cmd == "run-all":
        for key, build in CATALOG.items():
            t0 = time.perf_counter()
            n = build(spark, args.sf, as_of=args.as_of).count()
            print(f"{key:32s} {n:>10d} rows {time.perf_counter() - t0:7.2f} s")
    elif args.cmd == "load":
        from .plans.star import Star
        from .sources.fixtures import tables_for
        for name, path in Star(tables_for(spark, args.sf)).write(args.out).items():
            print(f"{name:20s} {path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
