"""python -m quillmill: list, inspect, sample, lock, build and validate the views of a catalog file."""

from __future__ import annotations

import argparse
import hashlib
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import artifacts
from .plans import build
from .sources.catalog import update_lock
from .sources.registry import Catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quillmill")
    parser.add_argument("--catalog", default="catalog.json", help="sources, views and lock as JSON")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    lock = commands.add_parser("lock")
    lock.add_argument("source")
    lock.add_argument("--files", nargs="*", default=["*"])
    inspect = commands.add_parser("inspect")
    inspect.add_argument("key")
    sample = commands.add_parser("sample")
    sample.add_argument("view")
    sample.add_argument("--count", type=int, default=3)
    make = commands.add_parser("build")
    make.add_argument("view")
    make.add_argument("--tokenizer", required=True)
    make.add_argument("--data-dir", default="data")
    make.add_argument("--max-train-tokens", type=int, default=10_000_000)
    make.add_argument("--max-val-tokens", type=int, default=1_000_000)
    make.add_argument("--add-bos", action="store_true")
    check = commands.add_parser("validate")
    check.add_argument("path")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "validate":
        found = artifacts.verify(spark, args.path)
        print(f"{args.path}: {found['documents']} documents, {found['tokens']} tokens")
        return 0
    catalog = Catalog.from_json(artifacts.read_text(spark, args.catalog))
    if args.command == "list":
        for r in catalog.listing(spark).collect():
            print(f"{r.source}\t{r.pin}\t{r['views']}")
    elif args.command == "inspect":
        try:
            for name, value in catalog.inspect(args.key).items():
                print(f"{name}: {value}")
        except KeyError as e:
            raise SystemExit(e.args[0]) from e
    elif args.command == "sample":
        for i, text in enumerate(catalog.sample(spark, args.view, args.count)):
            print(f"--- {i}\n{text}")
    elif args.command == "lock":
        source = catalog.source(args.source)
        there = artifacts.files(spark, source.path)
        chosen = update_lock(catalog.lock.get(args.source, {}).get("files", []), args.files, [n for n, _ in there])
        revision = hashlib.sha1(json.dumps(there).encode()).hexdigest()  # names and sizes stand for a revision
        data = json.loads(artifacts.read_text(spark, args.catalog)) | {"lock": catalog.locked(args.source, revision, chosen).lock}
        Path(args.catalog).write_text(json.dumps(data, indent=1))
        print(f"{args.source}\t{revision}\t{len(chosen)} files")
    else:
        tokenizer = build.resolve(spark, None, 0, args.tokenizer)
        for split, cap in (("train", args.max_train_tokens), ("validation", args.max_val_tokens)):
            path, made = build.compile_view(spark, catalog, args.view, split, tokenizer, args.data_dir, cap, args.add_bos)
            print(f"{split}\t{path}\t{made['documents']} documents\t{made['tokens']} tokens")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
