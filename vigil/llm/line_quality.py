"""Quality rules: cross-document line frequency.

Normalised lines are hashed; for every host the distinct documents (distinct texts,
so plain copies of one document do not make its lines look like boilerplate) that
hold a line are counted.  Lines that more than ``min_docs`` of a host's texts hold are
boilerplate, whatever the size of the host: they are removed, and a document left with
less than ``min_left`` of its words is rejected.

A host's boilerplate has no bound, so it is no array a row: the lines of the documents
are joined to the frequent ones, and each distinct text gets those that it holds.
Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm._common import SPACE, ascii_lower, durable, name, settled, small_side

WORDS = f"[{SPACE}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORDS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Window hashes are sorted with their places; the places of equal neighbours are
    sorted again and the union of their spans measured, so the cost is n log n.
    """
    last = F.size(words) - 2
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))


def base_columns(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (null text: none)."""
    body = F.coalesce(name(text), F.lit(""))
    df = (
        df.withColumn("__words", words_of(body))
        .withColumn("__windows", F.sort_array(repeated_words(F.col("__words"))))
        .withColumn("__lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    )
    same = lambda a, b: F.get(F.col("__windows"), a)["h"] == F.get(F.col("__windows"), b)["h"]
    df = df.withColumn(
        "__again",
        F.sort_array(
            F.transform(
                F.filter("__windows", lambda x, j: F.coalesce(same(j, j + 1), F.lit(False)) | (F.coalesce(same(j, j - 1), F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )
    again = F.col("__again")
    df = df.withColumn(
        "n_repeat_words",
        F.aggregate(
            F.transform(again, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(again, j + 1) - x), F.lit(3)).cast("long")),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )
    n = F.size("__words").cast("long")
    df = (
        df.withColumn("n_words", n)
        .withColumn("word_chars", F.length(F.regexp_replace(body, WORDS, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )
    return df.drop("__words", "__windows", "__again", "__lines")


def line_keys(text: Column) -> Column:
    """128-bit hash (in hexadecimal) of every \\n-split line after trimming, lower-casing A-Z and folding digits; null for blank lines."""
    bare = lambda x: F.regexp_replace(ascii_lower(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), "[0-9]+", "0")
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(f"[^{SPACE}]"), digest(bare(x))))


def digest(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def documents_of(df: DataFrame, text: str, host: str) -> DataFrame:
    """host, doc (128-bit hash of the text), keys (see ``line_keys``) of every row."""
    body = F.coalesce(name(text), F.lit(""))
    return df.select(name(host).cast("string").alias("host"), digest(body).alias("doc"), line_keys(body).alias("keys"))


def held_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """host, key, held: the lines that more than ``min_docs`` distinct texts of a host hold, and how many do."""
    return (
        docs.select("host", "doc", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        .groupBy("host", "key", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("held"))
        .where(F.col("held") > min_docs)
    )


def frequent_by_text(df: DataFrame, *, text: str, host: str, min_docs: int, broadcast_lines: int = 200_000, salts: int = 16) -> DataFrame:
    """host, doc, frequent: for every distinct text that holds any, its lines held by more than ``min_docs`` texts of the host."""
    docs = documents_of(df, text, host)
    frequent = durable(held_lines(docs, min_docs).select(F.col("host").alias("h"), F.col("key").alias("k")))
    salted = small_side(frequent, broadcast_lines)
    own = docs.select("host", "doc", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k"))
    if salted is frequent:  # a line that most of a host's texts hold is no single task
        salted = frequent.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same &= F.pmod(F.xxhash64("doc"), F.lit(salts)) == F.col("s")
    return own.join(salted, same).groupBy("host", "doc").agg(F.collect_set("key").alias("frequent"))


def judge_lines(
    df: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    min_docs: int = 20,
    min_left: float = 0.2,
    broadcast_keys: int = 500_000,
    broadcast_lines: int = 200_000,
) -> DataFrame:
    """All columns of ``df`` plus clean_text, n_removed_lines, n_left_words, the base columns, base_failed and kept.

    Null text counts as empty, has no words and fails the base rule; blank lines are
    never boilerplate.  ``kept`` is false where the base rule fails or where fewer than
    ``min_left`` of the words stay once frequent lines are gone.  A null host is a host
    of its own; repeated rows are one text to the counts, and each gets its verdict; texts
    of any length are taken whole; an empty table gives no rows.  Input columns named like
    the outputs are replaced.
    """
    added = (
        "clean_text", "n_removed_lines", "n_left_words", "n_words", "word_chars",
        "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )
    kept = [c for c in df.columns if c not in added]
    lines = durable(frequent_by_text(df, text=text, host=host, min_docs=min_docs, broadcast_lines=broadcast_lines))
    rows = df.select(
        F.struct(*[name(c) for c in kept]).alias("row"),
        F.coalesce(name(text), F.lit("")).alias("body"),
        name(host).cast("string").alias("at"),
    )
    same = F.col("at").eqNullSafe(F.col("host")) & (digest(F.col("body")) == F.col("doc"))
    keys = lines.agg(F.coalesce(F.sum(F.size("frequent")), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(lines) if keys <= broadcast_keys else lines, same, "left")  # beyond the bound the texts are shuffled
    none = F.array().cast("array<string>")
    rows = rows.withColumn("keys", line_keys(F.col("body"))).withColumn("frequent", F.coalesce("frequent", none))
    gone = lambda i: F.coalesce(F.array_contains(F.col("frequent"), F.get(F.col("keys"), i)), F.lit(False))
    hit = F.arrays_overlap("keys", "frequent")
    left = F.filter(F.split("body", "\n", -1), lambda x, i: ~gone(i))
    rows = (
        rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
        .withColumn("left", F.when(F.col("hit"), left))
        .withColumn("clean_text", F.when(F.col("hit"), F.array_join("left", "\n")).otherwise(F.col("body")))
        .withColumn("n_removed_lines", F.when(F.col("hit"), F.size("keys") - F.size("left")).otherwise(0).cast("long"))
    )
    rows = base_columns(rows, "body")
    rows = rows.withColumn(
        "n_left_words", F.when(F.col("hit"), F.size(words_of(F.col("clean_text")))).otherwise(F.col("n_words")).cast("long")
    )
    verdict = ~F.col("base_failed") & (F.col("n_left_words") >= min_left * F.col("n_words"))
    return settled(rows.select(*[F.col("row")[c].alias(c) for c in kept], *added[:-1], verdict.alias("kept")))
