"""Small tables with awkward rows."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    w = words(seed, n)
    return " ".join(x + "." if i % 7 == 6 else x for i, x in enumerate(w)) + "."


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns whose names clash."""
    long_text = prose(99, 60_000)
    rows = [
        (1, prose(1, 80), "en", "a", 5), (1, prose(1, 80), "en", "a", 5), (2, None, "en", "a", None), (3, "", "fr", None, 0),
        (None, prose(2, 60), None, "b", 1), (None, prose(2, 60), None, "b", 1), (4, long_text, "en", "b", 9), (5, "   \n\t ", None, None, 3),
        (6, prose(1, 80), "fr", "c", 5), (7, "one", "en", "a", 1), (8, "12 34 !!", "en", "c", 1), (9, "日本語のテキスト 🙂 é", "ja", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["_row", "size", "p", "grp", "rank", "tie", "score", "copies", "path", "sid", "h", "id", "n", "spans", "leaks", "data", "start", "part", "doc", "draw", "__text"]
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


def count_of(df) -> int:
    return len(df.collect())
