"""Command line: packs, templates, scan and check. Exit codes: 0 fine, 1 over the threshold, 2 bad input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward import __version__
from glyphward.functions.severity import SEVERITIES
from glyphward.operators.registry import DEFAULT, all_packs, get_pack, packs_df
from glyphward.operators.reports import check, exit_code, report, status_line
from glyphward.operators.scanning import scan_by
from glyphward.sources.files import read_texts, route
from glyphward.sources.templates import templates_df, user_templates
from glyphward.sources.traces import trace_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphward", description="Lint texts with rule packs.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("packs", help="list the packs")
    t = sub.add_parser("templates", help="list the templates")
    t.add_argument("-p", "--pack")
    t.add_argument("--path", help="folder of user templates")
    for name in ("scan", "check"):
        s = sub.add_parser(name)
        s.add_argument("text", nargs="?", default="")
        s.add_argument("-f", "--file", action="append", default=[])
        s.add_argument("-p", "--pack")
        s.add_argument("-d", "--designer", action="store_true")
        s.add_argument("--trace", action="store_true")
        s.add_argument("-j", "--json", action="store_true")
        if name == "check":
            s.add_argument("--fail-on", choices=SEVERITIES, default="high")
            s.add_argument("-q", "--quiet", action="store_true")
    return p


def _input(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.file:
        rows = read_texts(spark, *args.file)
    else:
        text = args.text or ("" if sys.stdin.isatty() else sys.stdin.read())
        rows = spark.createDataFrame([(None, text)], "file_path string, text string")
    return route(rows, path_col="file_path", pack=args.pack)


def _scanned(rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    """All rows in one pass, each by its pack; traces in the texts of the default pack are read as such if asked for."""
    if not args.trace:
        return scan_by(rows, force_optional=args.designer)
    joined = F.when(F.col("pack") == DEFAULT, trace_text(F.col("text"))).otherwise(F.col("text"))
    return scan_by(rows.withColumn("trace_text", joined), text_col="trace_text", force_optional=args.designer).drop("trace_text")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("glyphward").getOrCreate()
    if args.command == "packs":
        get_pack("personal-info").reload()
        packs_df(spark).show(truncate=False)
        return 0
    if args.command == "templates":
        names = [args.pack] if args.pack else sorted(all_packs())
        shown = templates_df(spark).where(F.col("pack").isin(names)).select("pack", "id", "title")
        for name in names:
            shown = shown.unionByName(user_templates(spark, name, args.path).select(F.lit(name).alias("pack"), "id", "title"))
        shown.show(truncate=False)
        return 0
    if args.pack and args.pack not in all_packs():
        print(f"no pack {args.pack!r}", file=sys.stderr)
        return 2
    rows = _input(spark, args)
    if not rows.where("blank_input").isEmpty() or rows.isEmpty():
        print("no text to scan", file=sys.stderr)
        return 2
    done = _scanned(rows, args)
    if args.command == "check" and args.quiet:
        return exit_code(done, args.fail_on)
    if args.command == "check":
        failed = False
        for r in check(done, args.fail_on).select("failed", status_line(F.col("findings")).alias("status"), "pack").toLocalIterator():
            failed |= r["failed"]
            print(f"{'FAIL' if r['failed'] else 'OK'}: {r['status']} (pack: {r['pack']}, threshold: {args.fail_on})")
        return int(failed)
    line = F.to_json(F.struct(*done.columns)) if args.json else report(F.col("findings"), F.col("overall_risk"), F.col("token_count"), F.col("pack"))
    for r in done.select(line.alias("line")).toLocalIterator():
        print(r["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
