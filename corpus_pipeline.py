"""A corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut, personal data is covered,
and what is left is packed into training sequences. Each stage takes all documents that its predecessor kept.

Null texts stay null to the last stage, where they are an end mark. Rows without an identifier are judged like any other. Tables may
have more columns than `documents`, of any type and name; `n_chars` is counted anew where it is one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docplan.llm import jaccard_join, packing, pii, superkmer, toxicity
from docplan.llm.common import prepare, stored
from docplan.llm.queries import RANKS

#: The identifier of a text within its document's: rows that repeat an identifier may hold different texts.
DIGEST = "__docplan_digest"


def _counted(df: DataFrame) -> DataFrame:
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores under its cut; those without an identifier are judged as well, and null texts stay."""
    prepare(spark)
    tagger = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, tagger)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest identifier, where several rows have it the one whose text
    has the least digest. A document is an identifier with a text, so different texts under one identifier are different documents, and a
    null identifier is one like any other, the last. Rows without words link with nothing and all stay."""
    prepare(spark)
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(DIGEST, F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest")))
    found = jaccard_join.link(rows.select(F.col(DIGEST).alias("doc_id"), "text"), n=5, percent=80)
    keep = found.where("doc_id = component_id AND n_shingles > 0").select(F.col("doc_id").alias(DIGEST)).distinct()
    first = rows.join(keep, DIGEST, "left_semi").dropDuplicates([DIGEST])
    wordless = docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return first.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(wordless)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated windows; those that have none stay as they are, letter by letter."""
    prepare(spark)
    return _counted(superkmer.cut_repeats(docs))


def cover_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data covered."""
    prepare(spark)
    return _counted(pii.redact(docs, pii.train(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: token ids and the boundaries of their documents."""
    prepare(spark)
    return packing.pack_documents(docs, RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("PII", cover_personal_data),
    ("best-fit packing", pack_sequences),
]

#: The stages learn models and pack; SQL can't express them. tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again as the next one's documents."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
