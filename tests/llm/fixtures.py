"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, other columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # columns that a query or an operator also uses
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("sig", T.StringType()),
])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(seed=1, n=60):
    """doc_id, text, lang, source of ordinary, copied, nearly copied, short, empty and null documents."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randrange(40, 160))) for _ in range(12)]
    passage = " ".join(words(rng, 70, 5000))
    out = []
    for i in range(n):
        text = rng.choice(base).split(" ")
        kind = i % 6
        if kind == 1:
            text[rng.randrange(len(text))] = f"edit{i}"
        elif kind == 2:
            text = words(rng, 30, 100000) + passage.split(" ") + words(rng, 30, 100000)
        elif kind == 3:
            text = words(rng, 80, 100000)
        elif kind == 4:
            text = text + [f"tail{i}"] * 3
        out.append((i * 3 + 1, " ".join(text), "en", f"s{rng.randrange(3)}"))
    out += [(1000, None, None, None), (1001, "", "en", None), (1002, " \t\n ", "en", "s0"), (1003, "one", "en", "s1"),
            (1004, "One", "en", "s1"), (1005, "two words", "en", "s2"), (None, base[0], "en", "s0"),
            (None, None, None, "s1"), (1006, "x" * 300, "en", "ß"), (1007, "ab " * 30000, "en", "s0"),
            (1008, "é" * 150, "en", "s0")]
    return out + [out[4], out[4]]


def docs(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame(
        [(i, t, lang, s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, lang, s in data], DOCS).repartition(3)
