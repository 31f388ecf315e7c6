"""Full-text search: tokens, stems, scores, autocomplete, and fused rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes in the order in which they are tried, with the length that a word must exceed. Fixed values.
SUFFIXES = (("ing", 5), ("tion", 6), ("ness", 6), ("ment", 6), ("ly", 4), ("es", 4), ("ed", 4))


def tokens(text: Column) -> Column:
    """Lower case, split at what isn't a letter or digit, tokens of two bytes at least."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def stem(word: Column) -> Column:
    """The word without the first suffix that fits; a plural s goes, ss stays."""
    out = F.when(word.endswith("s") & ~word.endswith("ss") & (F.octet_length(word) > 3), word.substr(F.lit(1), F.char_length(word) - 1)).otherwise(word)
    for suffix, least in reversed(SUFFIXES):
        out = F.when(word.endswith(suffix) & (F.octet_length(word) > least), word.substr(F.lit(1), F.char_length(word) - len(suffix))).otherwise(out)
    return out


def terms(text: Column) -> Column:
    return F.transform(tokens(text), stem)


#: A token as `tokens` makes it: of two bytes at least, so of two letters or of one beyond ASCII.
TOKEN = r"[\p{L}\p{N}]{2,}|[\p{L}\p{N}&&[^\p{ASCII}]]"


def query_terms(df: DataFrame, query: str) -> dict[str, tuple[int, list[str]]]:
    """The query's terms, how often each stands in it, and the tokens that have it as their stem: the term with one suffix or none.
    As many as the query has words, so they are kept in the driver and the corpus' words needn't be stemmed."""
    one = df.sparkSession.range(1).select(F.explode(terms(F.lit(query))).alias("term"))
    ends = F.array(*[F.lit(x) for x in ("", "s", *(x for x, _ in SUFFIXES))])
    forms = one.groupBy("term").agg(F.count("*").alias("times")).select("term", "times", F.explode(F.transform(ends, lambda e: F.concat("term", e))).alias("form"))
    out: dict[str, tuple[int, list[str]]] = {}
    for r in forms.where((stem(F.col("form")) == F.col("term")) & (F.octet_length("form") >= 2)).collect():
        out.setdefault(r["term"], (r["times"], []))[1].append(r["form"])
    return out


def _counted(df: DataFrame, query: str, key: str, text: str, sizes: bool) -> tuple[DataFrame, list[int]]:
    """Key, how often each of the query's terms stands in the text (tf0, tf1, ...), and the text's tokens; how often the query has
    each. One pass of patterns over each text: nothing is exploded or shuffled."""
    found = query_terms(df, query)
    low = F.lower(F.col(text))
    counts = [F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(forms))})(?![\p{{L}}\p{{N}}])")).alias(f"tf{i}") for i, (_, forms) in enumerate(found.values())]
    size = [F.regexp_count(low, F.lit(TOKEN)).alias("size")] if sizes else []
    return df.where(F.col(text).isNotNull()).select(F.col(key), *counts, *size), [t for t, _ in found.values()]


def _scored(t: DataFrame, key: str, terms: int, whole: list[Column], score: Column) -> DataFrame:
    one = t.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(terms)], *whole)
    hit = t.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(terms)], F.lit(False)))
    return hit.join(F.broadcast(one)).select(key, score.alias("score"))  # one row


def tf_idf(df: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of rows with a query term: sum over terms of (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1); N counts rows with text."""
    t, times = _counted(df, query, key, text, False)
    parts = [F.when(F.col(f"tf{i}") > 0, k * (1 + F.ln(f"tf{i}")) * (F.ln((F.col("n") + 1) / (F.col(f"df{i}") + 1)) + 1)).otherwise(0.0) for i, k in enumerate(times)]
    return _scored(t, key, len(times), [], reduce(lambda a, b: a + b, parts, F.lit(0.0)))


def bm25(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    t, times = _counted(df, query, key, text, True)
    parts = []
    for i, k in enumerate(times):
        tf, idf = F.col(f"tf{i}"), F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        parts.append(k * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean"))))
    return _scored(t, key, len(times), [F.avg("size").alias("mean")], reduce(lambda a, b: a + b, parts, F.lit(0.0)))


def phrase(df: DataFrame, words: str, text: str = "text") -> DataFrame:
    """Rows whose tokens hold the phrase's tokens one after the other."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    return df.where(joined.contains(F.concat(F.lit(" "), F.array_join(tokens(F.lit(words)), " "), F.lit(" "))))


def boolean(df: DataFrame, query: str, text: str = "text") -> DataFrame:
    """+word must be there, -word must not, word* is a prefix; of the others one at least, if nothing must be there."""
    t = tokens(F.col(text))

    def has(word: str) -> Column:
        return F.exists(t, lambda x: x.startswith(word[:-1].lower())) if word.endswith("*") else F.array_contains(t, word.lower())

    must = [has(w[1:]) for w in query.split() if w.startswith("+")]
    must += [~has(w[1:]) for w in query.split() if w.startswith("-")]
    may = [has(w) for w in query.split() if w[0] not in "+-"]
    if may and not any(w.startswith("+") for w in query.split()):
        must.append(reduce(lambda a, b: a | b, may))
    return df.where(F.coalesce(reduce(lambda a, b: a & b, must), F.lit(False))) if must else df


def fuzzy(df: DataFrame, word: str, distance: int = 1, text: str = "text") -> DataFrame:
    """Rows with a token within an edit distance."""
    return df.where(F.coalesce(F.exists(tokens(F.col(text)), lambda x: F.levenshtein(x, F.lit(word.lower()), distance) >= 0), F.lit(False)))


def suggest(df: DataFrame, word: str, text: str = "text", distance: int = 2, limit: int = 5) -> DataFrame:
    """(term, n, distance): the corpus's words nearest to one, frequent ones first."""
    w = df.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    d = F.levenshtein("term", F.lit(word.lower()))
    return w.withColumn("distance", d).where(F.col("distance") <= distance).orderBy("distance", F.desc("n"), "term").limit(limit)


def autocomplete(df: DataFrame, field: str, prefix: str, limit: int = 10, key: str | None = None) -> DataFrame:
    """Rows whose field starts with the prefix, whatever the case; the first by key, or by the field."""
    return df.where(F.lower(F.col(field)).startswith(prefix.lower())).orderBy(key or field).limit(limit)


def ranked(df: DataFrame, key: str = "doc_id", ranges: int = 256) -> DataFrame:
    """df with `rank`, from 1, by score, higher first, ties by key. Rows are dealt out by ranges of scores and numbered within theirs,
    behind the rows of the ranges before; edges come from a bounded sketch, so no task sees all rows unless their scores are equal."""
    edges = df.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000).alias("__edges"))
    # both sides of these joins are bounded: one row of edges, a row for each range
    cut = F.when(F.col("score").isNull(), ranges + 1).otherwise(F.size(F.filter(F.coalesce("__edges", F.array().cast("array<double>")), lambda e: e > F.col("score"))))
    dealt = df.join(F.broadcast(edges)).withColumn("__range", cut).drop("__edges")
    sizes = F.broadcast(dealt.groupBy("__range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("__range", "n")).alias("__sizes")))
    before = F.aggregate("__sizes", F.lit(0).cast("long"), lambda s, x: s + F.when(x["__range"] < F.col("__range"), x["n"]).otherwise(F.lit(0).cast("long")))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("score"), key))
    return dealt.withColumn("__own", own).join(sizes).withColumn("rank", F.col("__own") + before).drop("__own", "__range", "__sizes")


def rrf(rankings: list[DataFrame], key: str = "doc_id", k: int = 60) -> DataFrame:
    """(key, score): the sum over rankings of 1 / (k + rank). rankings: key and score, higher first; ties by key."""
    parts = [ranked(r.select(key, F.col("score").cast("double").alias("score")), key).select(key, (1 / (F.lit(k) + F.col("rank"))).alias("s")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("s").alias("score"))


def near(df: DataFrame, words: list[str], within: int, text: str = "text") -> DataFrame:
    """Rows where all words stand within so many tokens of each other, in any order."""
    t = tokens(F.col(text))
    low = [w.lower() for w in words]
    spots = F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i")))

    def places(some: list[str]) -> Column:
        return F.transform(F.filter(spots, lambda s: s["t"].isin(some)), lambda s: s["i"])

    every = [places([w]) for w in low]
    # a window of tokens holds all of them if it starts at one and each has a place in it
    fits = F.exists(places(low), lambda a: reduce(lambda p, q: p & q, [F.exists(w, lambda x: (x >= a) & (x < a + within)) for w in every]))
    return df.where(F.coalesce(fits, F.lit(False)))


def wildcard(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows with a token that matches *, ? and [...]."""
    from .stores import glob

    return df.where(F.coalesce(F.exists(tokens(F.col(text)), lambda x: x.rlike(glob(pattern.lower()))), F.lit(False)))


def facets(df: DataFrame, fields: list[str], limit: int = 10) -> DataFrame:
    """(field, value, n): of each field its most frequent values, in one pass over the rows."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = each.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("__r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("__r") <= limit).drop("__r")


def top(scored: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(n)
