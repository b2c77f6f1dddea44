"""Inputs with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def awkward(spark, texts, extra=()):
    """A documents table of the texts, from id 0, with columns whose names clash with those that operators use."""
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("id", "n", "s", "a", "b", "w", "pos", "h", "key", "__text", "score", *extra):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def collected(df, key="doc_id"):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r[key] is None, r[key]))


def rng(seed=0):
    return random.Random(seed)
