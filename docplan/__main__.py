"""Commands over a database: python -m docplan PATH COMMAND [ARGUMENTS], JSON lines to standard output.

    find COLLECTION [FILTER] [--sort JSON] [--limit N]      aggregate COLLECTION PIPELINE      sql TEXT
    insert COLLECTION JSON...      import COLLECTION FILE [--form ndjson|json|parquet]      export FOLDER [--form ...]
    count COLLECTION [FILTER]      collections      versions COLLECTION      backup FOLDER      restore FOLDER"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .database import Database


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docplan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("path")
    p.add_argument("command", choices=["find", "aggregate", "sql", "insert", "import", "export", "count", "collections", "versions", "backup", "restore"])
    p.add_argument("arguments", nargs="*")
    p.add_argument("--sort")
    p.add_argument("--limit", type=int)
    p.add_argument("--form", default="ndjson")
    return p


def run(db: Database, a: argparse.Namespace) -> Any:
    x = a.arguments
    if a.command == "find":
        return db[x[0]].find(json.loads(x[1]) if len(x) > 1 else None, sort=json.loads(a.sort) if a.sort else None, limit=a.limit)
    if a.command == "aggregate":
        return db[x[0]].aggregate(json.loads(x[1]))
    if a.command == "sql":
        return db.sql(x[0])
    if a.command == "insert":
        return db[x[0]].insert_many([json.loads(d) for d in x[1:]])
    if a.command == "import":
        return db.import_file(x[0], x[1], a.form)
    if a.command == "export":
        return db.export_files(x[0], a.form)
    if a.command == "count":
        return db[x[0]].count(json.loads(x[1]) if len(x) > 1 else None)
    if a.command in ("collections", "backup", "restore"):
        return getattr(db, a.command)(*x)
    return db[x[0]].versions()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("docplan").getOrCreate()
    out = run(Database(spark, a.path), a)
    if isinstance(out, DataFrame):
        for line in out.toJSON().toLocalIterator():
            print(line)
    elif out is not None:
        for line in out if isinstance(out, list) else [out]:
            print(json.dumps(line))
    return 0


if __name__ == "__main__":
    sys.exit(main())
