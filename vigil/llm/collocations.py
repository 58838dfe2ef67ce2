"""Phrase collocations: n-grams counted per language, scored by their weakest cut.

All 1..max_words-grams become rows and are hash-aggregated per language, in passes over
the texts, since an n-gram can only be frequent if all that it contains is:

1. words, counted in full (their sum is the language's n);
2. pairs of frequent words, first as counters of hash buckets of three bytes or so an
   entry, then those of the buckets that reach the limit;
3. longer n-grams, all of whose pairs are frequent.

What is frequent reaches the next pass as a bitmap of hashes of fixed size.  A hash that
collides lets a rare n-gram through, which its exact count then removes: the bitmap only
saves rows, it decides nothing.  Equal n-grams of a block of text are one row before
anything is shuffled, so a hot phrase is one row a block and a few a task.

Scores are exact decimals.  A phrase is joined to the counts of the two parts of each of
its cuts, and dropped if a one-word extension occurs (nearly) as often: an extension by
more words never occurs more often than the one-word extension inside it.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm._common import bitmap_of, durable, in_bitmap, name, small_side

#: Characters that end a piece of text; a phrase never crosses one.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands for an end: no byte of UTF-8.
END = b"\xff"
TABLE = bytes.maketrans(string.ascii_uppercase.encode() + ENDS + b"\t", string.ascii_lowercase.encode() + END * len(ENDS) + b" ")
COUNTS = "lang string, size int, phrase string, n long"


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[str, bytes]]:
    """(language, joined texts) of about ``size`` bytes; texts are never cut."""
    held, sizes = defaultdict(list), defaultdict(int)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        held[lang].append(text)
        sizes[lang] += len(text)
        if sizes[lang] >= size:
            yield lang, END.join(held.pop(lang))
            sizes[lang] = 0
    for lang, texts in held.items():
        yield lang, END.join(texts)


def numbered(body: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a block as numbers (0 is an end, also first and last), and the words."""
    vocabulary = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    vocabulary[END]
    words = body.translate(TABLE).replace(END, b" \xff ").split()
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    return np.concatenate([[0], ids, [0]]), list(vocabulary)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def rows_of(lang: str, size: int, columns: list[np.ndarray], words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each phrase; column i has the number of its i-th word."""
    parts = [words.take(pa.array(c)) for c in columns]
    phrase = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
    n = len(counts)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrase.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "size", "phrase", "n"])


def frequent_bits(frequent: DataFrame, bits: int) -> np.ndarray:
    """The hashes of (lang, phrase) of one or two words as a bitmap of ``bits`` bits (a power of two)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = word_hashes(lang, phrase.encode().split(b" "))
                own = pair_hashes(own[:1], own[1:]) if len(own) == 2 else own
                found[i] = int(own[0] & np.uint64(bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["place"])

    return bitmap_of(frequent.select("lang", "phrase").mapInArrow(places, "place long"), bits)


def packed_counts(places: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Places and their counts, equal places summed, as a row for each range of 2^16 places."""
    if not places:
        return
    own, at = np.unique(np.concatenate(places), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts)).astype("<u4")
    ranges, starts = np.unique(own >> np.uint64(16), return_index=True)
    low = [x.astype("<u2").tobytes() for x in np.split(own & np.uint64(0xFFFF), starts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), pa.array(low, pa.binary()), pa.array([x.tobytes() for x in np.split(sums, starts[1:])], pa.binary())], ["range", "low", "counts"])


def full_buckets(packed: DataFrame, min_count: int, bits: int) -> np.ndarray:
    """A bitmap of the places whose counts (see ``packed_counts``) sum up to ``min_count``: bits / 65536 rows of 8 kB come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(number: int, held: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(held >= min_count, bitorder="little").tobytes()], pa.binary())], ["range", "bits"])

        at, held = None, None
        for batch in batches:
            for number, low, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    if at is not None:
                        yield row(at, held)
                    at, held = number, np.zeros(1 << 16, np.int64)
                held[np.frombuffer(low, "<u2")] += np.frombuffer(counts, "<u4")  # a row has each place once
        if at is not None:
            yield row(at, held)

    dealt = packed.repartition("range").sortWithinPartitions("range")
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(sums, "range long, bits binary").collect():
        part = np.frombuffer(r.bits, np.uint8)
        bitmap[r.range * 8192 : r.range * 8192 + 8192] = part[: len(bitmap) - r.range * 8192]
    return bitmap


def phrase_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 5, min_count: int = 100, filter_bits: int = 1 << 26, block_bytes: int = 4_000_000
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times or more, and (lang, n) of all words.

    Null texts are empty, a null language is ``und``; repeated rows count again; texts of
    any length are taken whole.  Other columns, whatever their names, are not read.
    """
    if filter_bits < 1 << 15 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two from 32768 on")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(name(lang).cast("string"), F.lit("und")).alias("lang"), name(text).cast("string").alias("text")).where("text is not null")

    def counted(emit) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, body in blocks(batch, block_bytes):
                    ids, words = numbered(body)
                    yield from emit(own, ids, words, pa.array(words, pa.binary()))

        return rows.mapInArrow(run, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))

    def words_in(own: str, ids: np.ndarray, words: list[bytes], named: pa.Array) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(ids, minlength=len(words))[1:]
        yield rows_of(own, 1, [np.arange(1, len(words))], named, counts)
        total = pa.array([int(counts.sum())], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([0], pa.int32()), pa.array([None], pa.string()), total], ["lang", "size", "phrase", "n"])

    first = durable(counted(words_in).where((F.col("n") >= min_count) | (F.col("size") == 0)))
    words = first.where("size = 1")
    totals = first.where("size = 0 and n > 0").select("lang", "n")
    if max_words < 2:
        return words, totals
    word_bits = spark.sparkContext.broadcast(frequent_bits(words, filter_bits))

    def pairs(own: str, ids: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs of frequent words stand, and the hashes of all words."""
        hashes = word_hashes(own, words)
        often = in_bitmap(word_bits.value, hashes)
        often[0] = False
        return np.flatnonzero(often[ids[:-1]] & often[ids[1:]]), hashes

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts, n = [], [], 0
        for batch in batches:
            for own, body in blocks(batch, block_bytes):
                ids, words = numbered(body)
                at, hashes = pairs(own, ids, words)
                found = np.unique(pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]) & np.uint64(filter_bits - 1), return_counts=True)
                places, counts, n = [*places, found[0]], [*counts, found[1]], n + len(found[0])
                if n > 4_000_000:
                    yield from packed_counts(places, counts)
                    places, counts, n = [], [], 0
        yield from packed_counts(places, counts)

    packed = rows.mapInArrow(buckets, "range long, low binary, counts binary")
    full = spark.sparkContext.broadcast(full_buckets(packed, min_count, filter_bits))

    def pairs_in(own: str, ids: np.ndarray, words: list[bytes], named: pa.Array) -> Iterator[pa.RecordBatch]:
        at, hashes = pairs(own, ids, words)
        at = at[in_bitmap(full.value, pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))]
        found, counts = np.unique(ids[at] * len(words) + ids[at + 1], return_counts=True)
        yield rows_of(own, 2, [found // len(words), found % len(words)], named, counts)

    second = durable(counted(pairs_in).where(F.col("n") >= min_count))
    found = words.unionByName(second)
    if max_words < 3:
        return found, totals
    pair_bits = spark.sparkContext.broadcast(frequent_bits(second, filter_bits))

    def longer_in(own: str, ids: np.ndarray, words: list[bytes], named: pa.Array) -> Iterator[pa.RecordBatch]:
        at, hashes = pairs(own, ids, words)
        at = at[in_bitmap(pair_bits.value, pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))]
        often, code = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        often[at] = True
        code[at] = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True)[1]
        for size in range(3, max_words + 1):  # code: the number of the phrase one word shorter that starts there
            at = at[often[np.minimum(at + size - 2, len(ids) - 1)]]
            _, one, code[at], counts = np.unique(code[at] * len(words) + ids[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
            yield rows_of(own, size, [ids[at[one] + i] for i in range(size)], named, counts)

    third = durable(counted(longer_in).where(F.col("n") >= min_count))
    return found.unionByName(third), totals


def cut_score(a: Column, n: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * n / (left * right)), exact: products are decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(5,0)") * whole(a) * whole(n), whole(left) * whole(right))


def mine(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 5, min_count: int = 100, top: int = 2000, scale: int = 1000, percent: int = 100,
    broadcast_rows: int = 200_000, **counting,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words.

    a counts the phrase, n all words of the language, l and r the two parts of the cut
    with the lowest ``cut_score`` (ties: the first cut).  Phrases inside a longer one that
    occurs at least ``percent`` % as often are dropped.  Order: score and a descending,
    then the phrase by its bytes.  Odd rows as in ``phrase_counts``; an empty table, or
    one without frequent phrases, gives no rows.
    """
    counts, totals = phrase_counts(docs, text=text, lang=lang, max_words=max_words, min_count=min_count, **counting)
    counts = durable(counts)
    phrases = counts.where("size > 1")
    words = F.split("phrase", " ")
    joined = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    # Sub-phrases one word shorter, with the count of their most frequent extension.
    inner = phrases.where("size > 2").select("lang", "size", "n", words.alias("words"))
    inner = inner.select("lang", "n", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("inner"))
    inner = inner.groupBy(F.col("lang").alias("in"), "inner").agg(F.max("n").alias("most"))
    covered = (F.col("lang") == F.col("in")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("most") >= percent * F.col("n"))
    free = phrases.join(inner, covered, "left_anti")
    cuts = free.select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    few = counts.count() <= broadcast_rows
    for side, short in (("left", "l"), ("right", "r")):  # beyond the bound the joins shuffle, and a part that begins many phrases is split as a skewed partition
        part = counts.select(F.col("lang").alias("in"), F.col("phrase").alias("part"), F.col("n").alias(short))
        part = F.broadcast(part) if few else part
        cuts = cuts.join(part, (F.col("lang") == F.col("in")) & (F.col(side) == F.col("part"))).drop("in", "part", side)
    cuts = cuts.join(small_side(totals.select(F.col("lang").alias("in"), "n"), broadcast_rows), F.col("lang") == F.col("in")).drop("in")
    scored = cuts.withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"), scale))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("cut.a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
