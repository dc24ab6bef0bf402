"""A documents table with the awkward cases, and plain reference implementations."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("id", T.StringType()), T.StructField("h", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("row", T.LongType()),
])


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows():
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    base = words(rng, 400)
    near = base.split()
    near[200] = "changed"
    texts += [base, base, base, " ".join(near), None, "", " ", "\n\n", "x", "Éa ÀB cd", "a\u00a0b c", "<|endoftext|> a<|endoftext|>", words(rng, 30000)]
    texts += ["same text here"] * 5
    out = [(i, t, rng.choice(["en", "fr", None]), "s", None if t is None else len(t), "z", "q", 1.0, 7) for i, t in enumerate(texts)]
    return [*out, out[0], out[1], (None, "no id", None, None, None, None, None, None, None), (7, "other text, same id", "en", "s", 1, "z", "q", 1.0, 7)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
