"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, arc_warc, bpe, jaccard_join, matroska, packing, pii, quality, superkmer, toxicity
from .common import prepare

#: The folder of the public tokenizers' files; their package tells it where the variable is unset.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or next(iter((s := find_spec("public_tokenizers")) and s.submodule_search_locations or ["/opt/tokenizers"]))

#: The byte-level vocabulary that sequences are packed with.
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tagger = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, tagger).select("doc_id", "held_out", "score", "predicted", "spans")


def op2_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = pii.find(documents, pii.train(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), RANKS)


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op8_super_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = superkmer.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_arc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.encode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_crf": op1_toxicity_crf,
    "op2_ivf_pq": op2_ivf_pq,
    "op3_pii_skip_chain": op3_pii_skip_chain,
    "op4_bpe_pair_index": op4_bpe_pair_index,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_nbsvm": op6_quality_nbsvm,
    "op7_set_relation_join": op7_set_relation_join,
    "op8_super_kmer": op8_super_kmer,
    "op9_matroska": op9_matroska,
    "op10_arc_converter": op10_arc_converter,
}
#: DuckDB SQL for those that SQL can express.
ORACLE: dict[str, str] = {
    "op7_set_relation_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY 1), k AS (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(links, 0) AS n_links FROM m LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_super_kmer": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k FROM w, unnest(generate_series(1, len(w) - 34)) AS t(i)),
r AS (SELECT doc_id, i FROM s WHERE md5(k) IN (SELECT md5(k) FROM s GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, unnest(generate_series(0, 34)) AS t(j)),
e AS (SELECT doc_id, i, w[i] AS x FROM w, unnest(generate_series(1, len(w))) AS t(i)),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op10_arc_converter": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM g""",
}
