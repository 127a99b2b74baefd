"""python -m millrace.cli validate|plan|run FILE [--param name=value ...]"""

from __future__ import annotations

import argparse
import sys

from millrace.plans.document import DocumentError, load


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("command", choices=["validate", "plan", "run"])
    p.add_argument("file")
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    args = p.parse_args(argv)
    try:
        doc = load(args.file)
    except DocumentError as e:
        for x in e.problems:
            print(f"error: {x}", file=sys.stderr)
        return 1
    if args.command == "validate":
        print(f"{doc.name}: valid")
        return 0
    from pyspark.sql import SparkSession

    from millrace.plans.runner import Runner

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    runner = Runner(spark, doc, dict(x.split("=", 1) for x in args.param))
    if args.command == "plan":
        for s in doc.stages:
            if s["type"] == "dataflow":
                for port, df in runner.frames(s["steps"]).items():
                    print(f"-- {s['id']}.{port}")
                    df.explain("formatted")
        return 0
    for stage, state in runner.run():
        print(f"{stage}: {state}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
