"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    *(T.StructField(c, T.StringType()) for c in ("row", "rep", "bucket", "chunk", "place", "n", "key", "size", "label", "rank", "seq", "a")),
])


def prose(seed, n, words=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(vocab) + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def rows():
    texts = [prose(i, 60 + 7 * i) for i in range(25)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(100, texts[3]), (101, texts[3]), (102, texts[5]), (103, None), (104, ""), (105, " \n\t"), (106, "a"), (107, prose(99, 30_000)), (108, "é" * 5000)]
    out += [(109, texts[7] + " changed end"), (110, "same line here\n" * 40), (111, prose(98, 30) * 12), (None, texts[9]), (None, None)]
    out += [(5, texts[5]), (5, texts[5]), (112, "# * $ % & | < > !! \x1c x \x0b y   z <|endoftext|> \\ ### User: </turn>")]
    return out


def ugly(spark):
    data = [(i, t, None if (i or 0) % 7 == 0 else "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", *["x"] * 12) for i, t in rows()]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
