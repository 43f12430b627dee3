"""Command line: ``python -m assayer.cli audit TABLE --key K [--target T] [--out FOLDER] [--fail-on POLICY]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from assayer import core, sources
from assayer.operators import quality
from assayer.plans import audit


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="assayer")
    command = parser.add_subparsers(dest="command", required=True).add_parser("audit")
    command.add_argument("table")
    command.add_argument("--key", required=True)
    command.add_argument("--target")
    command.add_argument("--out")
    command.add_argument("--fail-on", choices=("never", "warning", "review", "error"), default="error")
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("assayer").getOrCreate()
    try:
        document = audit.audit(sources.load_table(spark, args.table).df, args.key, args.target)
        if args.out:
            print(audit.publish(spark, document, args.out))
    except core.AssayError as refused:
        print(f"refused: {refused}", file=sys.stderr)
        return 1
    print(document["verdict"])
    for f in document["findings"]:
        print(f"{f['severity']:8}{f['code']} {f['column'] or ''}")
    return quality.exit_code(document["verdict"], args.fail_on)


if __name__ == "__main__":
    sys.exit(main())
