"""python -m quirework query QUESTION | ingest --dataset FOLDER ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quirework")
    top.add_argument("--store", default="data/store", help="folder of the knowledge base")
    way = top.add_subparsers(dest="way", required=True)
    query = way.add_parser("query", help="search the knowledge base")
    query.add_argument("question")
    query.add_argument("--no-hyde", action="store_true")
    query.add_argument("--no-rerank", action="store_true")
    ingest = way.add_parser("ingest", help="ingest files")
    ingest.add_argument("--dataset", action="append", default=[])
    ingest.add_argument("--file", action="append", default=[])
    ingest.add_argument("--include-glob", action="append", default=[])
    ingest.add_argument("--exclude-glob", action="append", default=[])
    ingest.add_argument("--no-recursive", action="store_true")
    ingest.add_argument("--dry-run", action="store_true")
    ingest.add_argument("--reset", action="store_true")
    ingest.add_argument("--skip-quality-failures", action="store_true")
    ingest.add_argument("--report-output")
    ingest.add_argument("--no-progress", action="store_true")
    return top


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators.quality import report
    from .plans.config import settings
    from .plans.knowledge import KnowledgeBase

    spark = SparkSession.builder.appName("quirework").getOrCreate()
    if args.way == "query":
        own = settings(use_hyde=not args.no_hyde, use_rerank=not args.no_rerank)
        for d in KnowledgeBase(spark, args.store, own).retrieve(args.question)["documents"]:
            print(f"[{d['citation_id']}] {d['title']} > {d['section_path']}\n{d['text'][:500]}\n")
        return 0
    kb = KnowledgeBase(spark, args.store, settings())
    done = kb.ingest([*args.dataset, *args.file] or ["dataset"], args.include_glob, args.exclude_glob, not args.no_recursive, args.dry_run, args.reset, args.skip_quality_failures)
    text = report(done["counters"], done["statuses"], done["warnings"])
    print(text)
    if args.report_output:
        Path(args.report_output).write_text(text + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
