"""Rows that every operator must survive, and plain versions of shared rules."""

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")

LINE = "This very line is a passage that many documents share, word by word"
DOCS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "  \n\t \n", None, None, 5),
    (4, "Hello World. " * 30 + "\n" + LINE, "en", "a", 1),
    (5, "Hello World. " * 30 + "\n" + LINE, "en", "a", 1),
    (6, "été " * 60 + "\n" + LINE + "\n" + LINE.upper() + " ", "fr", "b", 1),
    (7, "one two three four five " + LINE + "\r\nx", "en", "b", 1),
    (8, LINE + "\n\n" + " ".join(f"w{i}" for i in range(80)), "en", "b", 1),
    (9, " \u00a0" + LINE + "\u00a0\n" + LINE + "\n" + "z" * 5000, "en", None, 1),
    (9, LINE + "\n" + " ".join(f"q{i % 7}" for i in range(300)), "en", "c", 1),
    (9, LINE + "\n" + " ".join(f"q{i % 7}" for i in range(300)), "en", "c", 1),
    (None, LINE + "\n😀 emoji 𝒳 " + "word " * 3, "en", "c", 1),
    (12, " ".join(f"v{i}" for i in range(30_000)), "de", "d", 1),
]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that an operator might use for its own columns.
CLASH = ("row", "host", "key", "kept", "shard", "slot", "fp", "b", "h", "n", "rank", "keys", "n_lines", "component_id", "a.b c")


def docs(spark, rows=DOCS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in CLASH:
            df = df.withColumn(c, df["lang"])
    return df


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
