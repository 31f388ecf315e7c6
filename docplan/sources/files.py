"""Reading and writing documents: JSON arrays, JSON lines, Parquet; exports, backups with a manifest, and blobs in chunks."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a blob's chunk. A fixed value.
CHUNK = 256 * 1024


# ---- small files through Hadoop's file systems, so that any store will do


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _beside(spark: SparkSession, path: str, text: str) -> tuple[Any, Any, Any]:
    fs, p = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    return fs, p, beside


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole text, or tells that there is one already. Of several writers one succeeds: a local file is linked
    to its name, which fails where the name is taken; elsewhere the store's rename must refuse a name that is taken, as HDFS does."""
    fs, p, beside = _beside(spark, path, text)
    try:
        if fs.getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), p.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(p) and bool(fs.rename(beside, p))
    finally:
        fs.delete(beside, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and put in place in one step where the store can, so that a reader sees the old text or the new."""
    fs, p, beside = _beside(spark, path, text)
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(beside, p, options)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def move(spark: SparkSession, path: str, to: str) -> None:
    """A folder under another name; left where it is if the name is taken."""
    fs, p = _fs(spark, path)
    _, q = _fs(spark, to)
    fs.mkdirs(q.getParent())
    if fs.exists(q) or not fs.rename(p, q):
        fs.delete(p, True)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


# ---- documents from Python


def kind_of(value: Any) -> T.DataType:
    import datetime
    from decimal import Decimal

    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, bytes | bytearray):
        return T.BinaryType()
    if isinstance(value, datetime.datetime):
        return T.TimestampType()
    if isinstance(value, datetime.date):
        return T.DateType()
    if isinstance(value, Decimal):
        return T.DecimalType(38, 18)
    if isinstance(value, list | tuple):
        return T.ArrayType(merged_kind(kind_of(v) for v in value))
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, kind_of(v)) for k, v in value.items()])
    return T.NullType()


def merged_kind(kinds: Iterable[T.DataType]) -> T.DataType:
    out: T.DataType = T.NullType()
    for k in kinds:
        if isinstance(out, T.NullType):
            out = k
        elif isinstance(k, T.NullType) or out == k:
            continue
        elif isinstance(out, T.StructType) and isinstance(k, T.StructType):
            names = list(dict.fromkeys([*out.fieldNames(), *k.fieldNames()]))
            out = T.StructType([T.StructField(n, merged_kind(s[n].dataType for s in (out, k) if n in s.fieldNames())) for n in names])
        elif isinstance(out, T.ArrayType) and isinstance(k, T.ArrayType):
            out = T.ArrayType(merged_kind([out.elementType, k.elementType]))
        elif isinstance(out, T.NumericType) and isinstance(k, T.NumericType):
            out = T.DoubleType()
        else:
            raise TypeError(f"values of {out.simpleString()} and {k.simpleString()} in one field")
    return out


def _fit(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StructType):
        return tuple(_fit(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    return value


def solid(kind: T.DataType) -> T.DataType:
    """Where a field was null in all documents, text."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, solid(f.dataType)) for f in kind.fields])
    return T.ArrayType(solid(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def documents(spark: SparkSession, many: Iterable[dict]) -> DataFrame:
    """A DataFrame of dicts, their fields merged; integers and floats in one field become floats."""
    rows = list(many)
    kind = solid(merged_kind(kind_of(r) for r in rows))
    if not isinstance(kind, T.StructType):
        kind = T.StructType([])
    return spark.createDataFrame([_fit(r, kind) for r in rows], kind)


# ---- interchange


def export_object(tables: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """Everything in one object; for small databases, as all of it goes to the driver."""
    return {name: [json.loads(x) for x in df.toJSON().toLocalIterator()] for name, df in tables.items()}


def export_files(tables: dict[str, DataFrame], path: str, form: str = "ndjson") -> None:
    """A folder for each table: JSON lines, Parquet, or one JSON array in a text file."""
    for name, df in tables.items():
        if form == "ndjson":
            df.write.mode("overwrite").json(f"{path}/{name}")
        elif form == "parquet":
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        elif form == "json":
            whole = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]"))
            df.agg(whole.alias("value")).write.mode("overwrite").text(f"{path}/{name}")
        else:
            raise ValueError(f"unknown form {form}")


def write_indexed(df: DataFrame, path: str, bloom: list[str] = (), sort: list[str] = (), distinct: int = 1_000_000) -> None:
    """Parquet whose row groups can be skipped: bloom filters of columns that are looked up by value, and rows sorted within their
    files by columns that are looked up by range, so that their zones are narrow."""
    w = (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    w.parquet(path)


def import_file(spark: SparkSession, path: str, form: str = "ndjson") -> DataFrame:
    """Documents of a file or folder; lines that aren't JSON are skipped."""
    if form == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("mode", "DROPMALFORMED").option("multiLine", form == "json").json(path)


def row_hash(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of row hashes that no order changes."""
    h = F.xxhash64(*[F.to_json(c) if isinstance(f.dataType, T.MapType) else c for f in df.schema for c in [F.col(f"`{f.name}`")]]) if df.columns else F.lit(0)
    n, total = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Parquet copies and a manifest of rows and hashes."""
    manifest: dict[str, Any] = {"format": 1, "tables": {}}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        n, h = row_hash(spark.read.parquet(f"{path}/{name}"))
        manifest["tables"][name] = {"rows": n, "hash": str(h)}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def verify_backup(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables that aren't what the manifest tells."""
    text = read_text(spark, f"{path}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"{path} has no manifest")
    return [name for name, m in json.loads(text)["tables"].items() if (lambda r: (r[0], str(r[1])) != (m["rows"], m["hash"]))(row_hash(spark.read.parquet(f"{path}/{name}")))]


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if bad := verify_backup(spark, path):
        raise ValueError(f"damaged: {', '.join(bad)}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(read_text(spark, f"{path}/manifest.json") or "{}")["tables"]}


def backups(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in listing(spark, folder) if "manifest.json" in listing(spark, f"{folder}/{n}")]


def prune_backups(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes all but the last by name; the names of those that went."""
    gone = backups(spark, folder)[: -keep or None] if keep else backups(spark, folder)
    for n in gone:
        delete(spark, f"{folder}/{n}")
    return gone


# ---- blobs


def chunked(blobs: DataFrame, key: str = "blob_id", data: str = "data") -> DataFrame:
    """(blob_id, chunk_no, data): binaries in chunks. An empty one has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / CHUNK).cast("int"))
    each = blobs.select(F.col(key).alias("blob_id"), F.col(data).alias("data"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return each.select("blob_id", "chunk_no", F.substring("data", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("data"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """(blob_id, data): each blob's chunks in order; as hex inside, for binaries have no array_join."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", F.hex("data").alias("h"))))
    return chunks.groupBy("blob_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("data"))
