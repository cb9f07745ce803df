"""Command line: ``python -m fieldlead.cli convert|run ...``."""

from __future__ import annotations

import argparse
from pathlib import Path

from fieldlead import config, pipeline
from fieldlead.operators.fields import WIDTHS
from fieldlead.session import local_session
from fieldlead.sources import delimited


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldlead")
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="zipped delimited text to Parquet")
    convert.add_argument("archives", nargs="+")
    convert.add_argument("--out", required=True)
    convert.add_argument("--split", action="store_true", help="read each file in several tasks; its quotes must be sound")
    run = commands.add_parser("run", help="all stages from Parquet tables")
    run.add_argument("--config")
    run.add_argument("--data", help="folder with documents, listings, codes and, if there, edges, identity_documents, release, records, years, names and contributor_names as Parquet; defaults to the configuration's")
    run.add_argument("--out")
    for p in (convert, run):
        p.add_argument("--force", action="store_true", help="build again what exists")
    args = parser.parse_args(argv)
    spark = local_session()
    if args.command == "convert":
        Path(args.out).mkdir(parents=True, exist_ok=True)
        for archive in args.archives:
            path, rows = delimited.convert_archive(spark, archive, args.out, args.force, args.split)
            print(f"{path}: {'kept' if rows is None else f'{rows:,} rows'}")
        return 0
    cfg = config.load(args.config) if args.config else config.build(known_widths=lambda: set(WIDTHS))
    spark.conf.set("spark.sql.shuffle.partitions", str(cfg["runtime.shuffle_partitions"]))
    data = args.data or delimited.data_root(cfg["paths.data"])
    optional = ("edges", "identity_documents", "release", "records", "years", "names", "contributor_names")
    tables = {n: spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "listings", "codes", *[n for n in optional if Path(f"{data}/{n}.parquet").exists()])}
    print(pipeline.run(spark, cfg, tables, args.out or cfg["paths.output"], args.force))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
