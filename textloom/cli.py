"""Command line: ``search``, ``scan``, ``index`` and ``sites``.

Exit codes: 0 with hits, 1 without, 2 for a wrong request, 3 for an error.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.filters import parse_date, parse_size, until_date
from .operators.search import LIMIT, SCAN_LIMIT, SearchRequest, hits, live_scan
from .plans.compile import InvalidQuery
from .session import ship_package
from .sinks.export import COLUMNS, csv_cell, result_rows
from .sources.extract import extract_files
from .store.catalog import Catalog
from .store.index import SearchIndex, _generations, _has
from .store.sync import documents_of_files, sync_folder


def extracted_documents(spark: SparkSession, root: str, site_id: str = "") -> DataFrame:
    """The documents table of a folder."""
    return documents_of_files(extract_files(spark, root), site_id)


def is_index(spark: SparkSession, folder: str) -> bool:
    return _has(spark, f"{folder}/g000000") or bool(_has(spark, folder) and _generations(spark, folder))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("search", "scan"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("where", help="an index or a Parquet documents table, or a folder for scan")
        for flag in ("--regex", "--fuzzy", "--case", "--partial", "--name-only"):
            p.add_argument(flag, action="store_true")
        for option in ("--kind", "--lang", "--detect"):
            p.add_argument(option, action="append", default=[])
        for option in ("--name", "--folder", "--since", "--until", "--min-size", "--max-size"):
            p.add_argument(option, default="")
        p.add_argument("--limit", type=int, default=LIMIT if name == "search" else SCAN_LIMIT)
        p.add_argument("--format", choices=("text", "json", "jsonl", "csv"), default="text")
    p = sub.add_parser("index")
    p.add_argument("folder")
    p.add_argument("index", help="the folder of the index; only what changed since the last time is read")
    p.add_argument("--site", default="site")
    p = sub.add_parser("sites")
    p.add_argument("catalog")
    p.add_argument("--format", choices=("text", "json", "jsonl", "csv"), default="text")
    return top


def request_of(args: argparse.Namespace) -> SearchRequest:
    return SearchRequest(
        args.query, args.regex, args.fuzzy, args.case, not args.partial, args.name_only, args.kind, args.lang, names=args.name, folder=args.folder, detectors=args.detect, limit=args.limit,
        size=(parse_size(args.min_size) if args.min_size else None, parse_size(args.max_size) if args.max_size else None),
        dates=(parse_date(args.since) if args.since else None, until_date(args.until) if args.until else None),
    )


def show(rows: list[dict], form: str, columns: tuple[str, ...] = COLUMNS) -> str:
    if form == "json":
        return json.dumps(rows, ensure_ascii=False, indent=1, default=str)
    if form == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in rows)
    if form == "csv":
        return "\n".join([",".join(columns), *[",".join(csv_cell(r.get(c)) for c in columns) for r in rows]])
    return "\n".join("\t".join(str(r.get(c, "")) for c in columns if r.get(c) not in (None, "")) for r in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "sites":
        rows = [{"id": s.id, "name": s.name, "roots": ";".join(s.roots)} for s in Catalog(args.catalog).sites()]
        print(show(rows, args.format, ("id", "name", "roots")))
        return 0 if rows else 1
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    ship_package(spark)
    try:
        if args.command == "index":
            sync_folder(spark, args.folder, args.index, args.site)
            return 0
        request = request_of(args)
        if args.command == "search":
            listed = result_rows(SearchIndex(spark, args.where).hits(request) if is_index(spark, args.where) else hits(spark.read.parquet(args.where), request))
        else:
            listed = live_scan(extracted_documents(spark, args.where), request, args.limit).select(*[c for c in COLUMNS if c != "snippet"])
        rows = [r.asDict(recursive=True) for r in listed.collect()]  # at most the limit's rows
    except (InvalidQuery, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    print(show(rows, args.format))
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
