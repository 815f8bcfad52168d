"""Command line: build the graph of a file or folder and print or write it as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .graph import BUILDERS, DocumentGraph


def main(argv: list[str] | tuple[str, ...] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("path")
    p.add_argument("--graph", default="knowledge", choices=[*sorted(BUILDERS), "all"])
    p.add_argument("-o", "--output")
    p.add_argument("--pretty", action="store_true")
    a = p.parse_args(argv)
    graph = DocumentGraph.from_document(SparkSession.builder.getOrCreate(), a.path, a.graph).to_dict()
    text = json.dumps(graph, indent=2 if a.pretty else None, sort_keys=a.pretty, ensure_ascii=False)
    if a.output:
        with open(a.output, mode="w", encoding="utf8") as out:
            print(text, file=out)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    main()
