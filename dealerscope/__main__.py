"""Command line: ``python -m dealerscope load|forecast|segment|ask ...``."""

from __future__ import annotations

import argparse
import datetime as dt

from dealerscope.plans import forecast, jobs
from dealerscope.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="dealerscope")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="refresh the tables from CSV files and check them")
    load.add_argument("csv_folder")
    ask = commands.add_parser("ask", help="run one bounded SELECT")
    ask.add_argument("statement")
    ask.add_argument("--as-of", default=str(dt.date.today()))
    fit = commands.add_parser("forecast", help="forecast the best-selling products")
    fit.add_argument("--top", type=int, default=12)
    group = commands.add_parser("segment", help="segment the dealers")
    group.add_argument("--restarts", type=int, default=20)
    for command in (load, ask, fit, group):
        command.add_argument("--tables", required=True, help="folder of the Parquet tables")
        command.add_argument("--master", default=None)
    args = parser.parse_args()

    spark = build_session(args.master)
    if args.command == "load":
        jobs.load(spark, args.csv_folder, args.tables).show(truncate=False)
    elif args.command == "forecast":
        run = jobs.forecast(spark, args.tables, args.top)
        forecast.model_summary(run.scores).show(truncate=False)
    elif args.command == "segment":
        run = jobs.segment(spark, args.tables, args.restarts)
        run.diagnostics.show()
        run.centres.show(truncate=False)
    else:
        jobs.ask(spark, args.tables, args.as_of, args.statement).show(200, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
