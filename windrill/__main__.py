"""Command line: python -m windrill compile|run|catalog.

compile    query text on stdin, the plan as JSON on stdout
run        query text in a file over a delimited or Parquet input; rows on stdout, separated by |
catalog    checks a catalog and writes one template file per table
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.compiler import Query
from .plans.language import parse
from .sources.catalog import Catalog


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="windrill")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("compile", help="query text on stdin -> plan as JSON")
    run = sub.add_parser("run", help="runs a query")
    run.add_argument("query", help="file with the query text")
    run.add_argument("input", help="a .csv or .parquet file or folder")
    run.add_argument("--catalog", help="catalog JSON, for delimited input")
    run.add_argument("--order-by", default="", help="arrival order: names separated by commas")
    run.add_argument("--explain", action="store_true", help="shows the physical plan instead")
    cat = sub.add_parser("catalog", help="checks a catalog and writes templates")
    cat.add_argument("json")
    cat.add_argument("--templates", help="folder for the template files")
    a = p.parse_args(argv)
    if a.command == "compile":
        print(json.dumps(parse(sys.stdin.read()).to_json(), indent=2))
    elif a.command == "catalog":
        c = Catalog.from_json(Path(a.json))
        if a.templates:
            c.write_templates(a.templates)
        print(c.to_json())
    else:
        from pyspark.sql import SparkSession

        from .sources import files

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        q = Query.parse(Path(a.query).read_text())
        if a.catalog:
            df = files.read_delimited(spark, a.input, Catalog.from_json(Path(a.catalog)).table(q.plan.source))
        else:
            df = files.read_parquet(spark, a.input)
        out = q.run(df, order_by=[x for x in a.order_by.split(",") if x] or None)
        if a.explain:
            out.explain("formatted")
        else:
            for row in out.toLocalIterator():
                print("|".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
