"""Command line: ``python -m loam focused FAMILY FILES... --store DIR`` and ``python -m loam general FILES... --csv DIR``.

Under ``spark-submit`` or with ``--master`` it runs on that cluster, else locally.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from loam.operators.graph import GraphStore
from loam.plans.families import FAMILIES, focused
from loam.plans.general import general
from loam.session import outer_session
from loam.sources.files import read_files, read_listed, validate_dir, validate_file
from loam.storage import spool


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loam", description=__doc__)
    modes = top.add_subparsers(dest="mode", required=True)
    known = modes.add_parser("focused", help="lineage of samples of a known family")
    known.add_argument("family", choices=sorted(FAMILIES))
    known.add_argument("--artifacts", type=validate_dir, help="Parquet folder (parent_sha256, content) of collected artifacts; dark-watchmen only")
    unknown = modes.add_parser("general", help="clustering sweep of labelled samples")
    unknown.add_argument("--csv", default=".", type=validate_dir, help="folder for the CSV output")
    for mode in (known, unknown):
        mode.add_argument("files", nargs="+", type=validate_file)
        mode.add_argument("--master", help="cluster to run on, where the environment names none")
        mode.add_argument("--store", help="warehouse folder of the graph store")
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = outer_session(args.master)
    store = GraphStore.open(spark, args.store, args.mode) if args.store else None
    if args.mode == "general":
        general(read_files(spark, args.files, on_error="fail"), args.csv, store)
        return 0
    listed = spool(read_listed(spark.createDataFrame([(f,) for f in args.files], "path string")), "files")
    files, unread = listed.where("error is null"), listed.where("error is not null")
    options = {}
    if args.family == "dark-watchmen":
        if not args.artifacts:
            raise SystemExit("dark-watchmen needs --artifacts: samples are never executed")
        options["artifacts"] = spark.read.parquet(args.artifacts)
    errors = focused(args.family, files.select("path", "content"), store, **options).errors
    errors = errors.unionByName(unread.select("path", F.lit("read").alias("stage"), F.col("error").alias("message")))
    for row in errors.orderBy("path").toLocalIterator():
        print(f"{row['path']}: {row['stage']}: {row['message']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
