"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes and rows that an operator takes at a time, whatever Arrow brings; at least one row. As Python words and arrays a text is some
#: twenty times as large, so this bounds a worker's memory. Results don't depend on it.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package's source to the executors' Python workers, which need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="docplan-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))


def prepare(spark: SparkSession) -> SparkSession:
    """Give the workers their code; the session's settings stay as they are."""
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine will do for a
    local master, where all is one machine, and for no other."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docplan-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the shared folder is swept by its owner
        pass


_kept: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. Its lineage ends there, so a lost executor costs only a new read. forget() deletes it, the
    session's end does so at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docplan/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._docplan_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "_docplan_path", None)
        if path in _kept:
            _delete(_kept.pop(path), path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_kept.items()):
        _delete(spark, path)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, whatever else df has; null texts become empty."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def struct(**kinds: str | T.DataType) -> T.StructType:
    """A schema; kinds are types or their names."""
    return T.StructType([T.StructField(k, v if isinstance(v, T.DataType) else T._parse_datatype_string(v)) for k, v in kinds.items()])


def kind_of(df: DataFrame, column: str = "doc_id") -> T.DataType:
    return df.schema[column].dataType


def cut(batches: Iterable[pa.RecordBatch], most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes and rows, one row at least. Batches without rows are left out."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.full(b.num_rows, 8 * b.num_columns, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
                size += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        ends = np.cumsum(size)
        while start < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
            stop = min(max(stop, start + 1), start + rows, b.num_rows)
            yield b.slice(start, stop - start)
            start = stop


def to_frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as pandas has it, but integers with nulls among them stay integers (and None), for as floats they would lose digits."""
    return pd.DataFrame({n: c.to_pandas(integer_object_nulls=True) for n, c in zip(batch.schema.names, batch.columns, strict=True)})


def to_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(frame[f.name], type=f.type, from_pandas=True) for f in schema], schema=schema)


def rows_of(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Tuples as a frame of plain objects: integers beside None stay integers."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def release() -> None:
    """Gives the memory that a task has freed back to the system: a Python worker serves many tasks, and its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow over batches of bounded size. Columns travel by number, so their names may be any."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(b.rename_columns(names) for b in cut(batches))
        finally:
            release()

    ship(df.sparkSession)
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def map_frames(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> DataFrame:
    """mapInPandas with batches of bounded size and exact integers."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in f(to_frame(b) for b in batches):
            if len(x):
                yield to_batch(x, arrow)

    return map_batches(df, run, schema)


def map_text(df: DataFrame, f: Callable[[list[str | None], pa.RecordBatch], list[str | None]], text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """df with another text in each row: f gets the texts and the batch. All other columns pass untouched, whatever their types and
    names; those in `also`, which f reads from the batch, are left out of the result."""
    out = T.StructType([T.StructField(x.name, T.StringType() if x.name == text else x.dataType) for x in df.schema if x.name not in also])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now = pa.array(f(b.column(text).to_pylist(), b), pa.string())
            yield pa.RecordBatch.from_arrays([now if x.name == text else b.column(x.name).cast(x.type) for x in arrow], schema=arrow)

    return map_batches(df.withColumn(text, F.col(text).cast("string")), run, out)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def partitions(df: DataFrame) -> int:
    """As many as the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an undirected graph the smallest node that it reaches.

    Alternates large-star and small-star steps, each a groupBy with a minimum and a join, until the edges are stars around their
    smallest nodes. No neighbourhood is ever gathered in one task: a hot node's edges are only ever joined to its minimum."""
    e = stored(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("hi"), F.col("lo"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        # large star: larger neighbours of u to the smallest of its neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # small star: u and its smaller neighbours to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("m", F.explode(F.array("lo", "hi")).alias("v")).where("m < v").toDF("lo", "hi").distinct()
        new = stored(small, "edges")
        # done when every hi has one lo, and no lo is itself a hi
        his = new.groupBy("hi").agg(F.count("*").alias("n"))
        if not new.select(F.col("lo").alias("hi")).join(his, "hi", "left_semi").take(1) and not his.where("n > 1").take(1):
            forget(e)
            return new.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        forget(e)
        e = new
