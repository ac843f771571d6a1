"""Command line: download a dataset, add a folder of texts, search."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vecspark.embed import HashingEmbedder
from vecspark.engine import Engine
from vecspark.sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vecspark")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("download", help="fetch a known dataset")
    d.add_argument("name", choices=sorted(files.DATASETS))
    d.add_argument("folder")
    d.add_argument("--overwrite", action="store_true")
    a = sub.add_parser("add", help="add all text files below a folder")
    a.add_argument("store")
    a.add_argument("folder")
    s = sub.add_parser("search", help="the best chunks for a text")
    s.add_argument("store")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=3)
    for q in (a, s):
        q.add_argument("--dimensions", type=int, default=64)
    args = p.parse_args(argv)
    if args.command == "download":
        print(files.download_dataset(args.name, args.folder, overwrite=args.overwrite))
        return 0
    spark = SparkSession.builder.appName("vecspark").getOrCreate()
    engine = Engine(args.store, HashingEmbedder(args.dimensions), spark=spark)
    if args.command == "add":
        print(engine.add(files.text_documents(spark, args.folder)))
    else:
        for point, document, score in engine.search(args.query, args.top_k):
            print(f"{score:.4f}  {document.document_id}  {document.name}  ({point.point_id})")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
