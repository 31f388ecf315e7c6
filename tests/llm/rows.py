"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

LONG = " ".join(f"w{k % 911}x{k % 7}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score double, bucket int, set binary, row string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("an", "the", "or", "ing", "ed", "th", "on")) for _ in range(r.randint(1, 4))) for _ in range(n))


def hard_documents() -> list[tuple]:
    base = prose(1, 120)
    texts = [
        base, base, base.upper(), base + " and so on", prose(2, 90), "", None, "one", "one two three", "one two three", "one two four",
        "  spaced\tout\n text  ", "word " * 400, prose(3, 60) + " " + prose(4, 50), prose(5, 40) + " " + prose(4, 50), LONG, "\x00nul \x1c odd", "ünï cödé ΑΣ 日本 😀 " * 9,
        "write bob@example.com or 10.0.0.1, call +1 (555) 010-9999, card 4111 1111 1111 1111 and 4111.1111.1111.1111",
    ]
    rows = [(k, t, "en", "s", len(t or ""), "x", k, 0.5, 1, None, "r") for k, t in enumerate(texts)]
    rows.append(rows[4])  # a row twice
    rows.append((None, prose(9, 50), None, None, None, None, None, None, None, None, None))
    return rows


def hard(spark):
    return spark.createDataFrame(hard_documents(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
