"""Command line: verdicts or records of the files under a folder, as JSON lines on standard output."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.verdict import verdict_json
from .sources import files


def main() -> None:
    parser = argparse.ArgumentParser(prog="provquill", description=__doc__)
    parser.add_argument("what", choices=("identify", "records"))
    parser.add_argument("folder")
    parser.add_argument("--out", help="write JSON there instead of printing")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("provquill").getOrCreate()
    rows = verdict_json(files.identify(spark, args.folder)) if args.what == "identify" else files.records(files.walk(files.read_files(spark, args.folder)))
    if args.out:
        rows.write.mode("error").json(args.out)
    else:
        for line in rows.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
