"""Command line over plans.books: `python -m quire html|glyphs|diff ...`. Prints one JSON line; a fault is told on one line, with exit code 1."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("html", help="a folder of HTML pages to files and an index")
    one.add_argument("folder")
    one.add_argument("out")
    one.add_argument("--profile", help="JSON file of the book's profile")
    one = sub.add_parser("glyphs", help="a book's glyphs in Parquet to files and an index")
    one.add_argument("glyphs")
    one.add_argument("out")
    one.add_argument("--rules", help="ruled lines in Parquet")
    one.add_argument("--profile")
    one = sub.add_parser("diff", help="the difference table of two command indexes")
    for name in ("left", "right", "sections", "folder", "out"):
        one.add_argument(name)
    one.add_argument("--derived", help="difference rows given by hand")
    return p


def run(spark, args: argparse.Namespace) -> dict:
    from quire.plans import books
    from quire.sources import readers

    if args.command == "diff":
        return {"rows": books.difference(spark, args.left, args.right, args.sections, args.folder, args.out, args.derived)}
    profile = readers.profile(spark, args.profile) if args.profile else readers.PROFILE
    if args.command == "html":
        return books.convert(spark, args.folder, profile, args.out)
    return books.convert_glyphs(spark, args.glyphs, args.rules, profile, args.out)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    try:
        print(json.dumps(run(spark, args), ensure_ascii=False))
    except Exception as x:  # noqa: BLE001
        print(f"quire: {str(x).splitlines()[0][:500]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
