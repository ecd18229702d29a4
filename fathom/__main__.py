"""Command line: python -m fathom index|search|answer|status STORE ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from fathom.api import Engine


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="fathom")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="bring the index to the state of a directory")
    index.add_argument("store")
    index.add_argument("directory")
    index.add_argument("--chunk-size", type=int, default=1000)
    index.add_argument("--no-summary", action="store_true")
    index.add_argument("--flat", action="store_true", help="only the directory's own files")
    for name in ("search", "answer"):
        s = sub.add_parser(name)
        s.add_argument("store")
        s.add_argument("query")
        s.add_argument("-n", type=int, default=5)
        s.add_argument("--no-rerank", action="store_true")
    sub.add_parser("status").add_argument("store")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    engine = Engine(SparkSession.builder.appName("fathom").getOrCreate(), a.store)
    if a.command == "index":
        engine.index(a.directory, not a.flat, a.chunk_size, not a.no_summary).groupBy("status").count().show()
        engine.verify().show()
    elif a.command == "status":
        engine.status().show()
    elif a.command == "answer":
        print(engine.answer(a.query, a.n))
    else:
        for hit in engine.search(a.query, a.n, not a.no_rerank).orderBy("rank").collect():  # n rows
            inside = f" in {hit.parent.name} ({hit.parent.type})" if hit.parent else ""
            print(f"{hit.rank}. {hit.snippet.name}{inside} at {hit.snippet.file_path}:{(hit.snippet.start_line or 0) + 1}")
            for r in hit.relations:
                print(f"   {r.type} {r.target}")


if __name__ == "__main__":
    main()
