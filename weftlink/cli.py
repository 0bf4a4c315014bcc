"""Command line: ``python -m weftlink.cli query|run|find|audit|exact|tokens|qgrams|ranking|neighbours ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from weftlink.plans import experiments, heavy, linkage
from weftlink.plans.pipeline import Options, Pipeline
from weftlink.sources.files import discover
from weftlink.sources.readers import write_json, write_table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftlink")
    commands = parser.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run one named query over Parquet tables and print it")
    q.add_argument("name", choices=sorted(linkage.QUERIES | heavy.QUERIES))
    q.add_argument("--data", required=True)
    q.add_argument("--rows", type=int, default=20)
    r = commands.add_parser("run", help="the whole pipeline over TSV files")
    r.add_argument("--data", required=True)
    r.add_argument("--work", required=True)
    for name, default in Options().__dict__.items():
        r.add_argument(f"--{name.replace('_', '-')}", type=type(default), default=default)
    f = commands.add_parser("find", help="the one data folder below some folders")
    f.add_argument("roots", nargs="+")
    for name in experiments.REPORTS:
        e = commands.add_parser(name, help=f"report on TSV files: {name}")
        e.add_argument("--data", required=True)
        e.add_argument("--per-mille", type=int, default=experiments.SAMPLED.get(name), help="part of the S1 ids asked, 1 to 10; the holdout where not given")
        e.add_argument("--out", help="folder for a summary.json and the candidates")
    args = parser.parse_args(argv)
    if getattr(args, "per_mille", None) is not None and not 1 <= args.per_mille <= 10:
        parser.error("--per-mille must be between 1 and 10")
    spark = SparkSession.builder.appName("weftlink").getOrCreate()
    if args.command == "query":
        (linkage.QUERIES | heavy.QUERIES)[args.name](spark, args.data).show(args.rows, truncate=False)
    elif args.command == "find":
        print(discover(spark, args.roots))
    elif args.command == "run":
        options = Options(**{k: getattr(args, k) for k in Options().__dict__})
        print(json.dumps(Pipeline(spark, args.data, args.work, options).run(), indent=2, default=str))
    else:
        tables = experiments.REPORTS[args.command](experiments.load(spark, args.data, per_mille=args.per_mille))
        found = tables.pop("candidates", None)
        report = {k: [row.asDict() for row in t.collect()] for k, t in tables.items()}
        if args.out:
            write_json(spark, report, f"{args.out}/summary.json")
            if found is not None:
                write_table(found, f"{args.out}/candidates")
        print(json.dumps(report, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
