"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A ``LineIndex`` holds three tables:

* ``postings`` (hi, lo, doc_id): which document holds which line key, exactly;
* ``refs`` (hi, lo, n, last): exact reference count and largest document of a key;
* ``filters`` (shard, bits): one cuckoo filter per shard with the keys whose count has
  reached the limit.  Keys enter and leave their filter as documents are inserted and
  deleted, which a Bloom filter could not undo.

A key is the 128-bit hash of a line stripped at both ends with A-Z lower-cased.  Lines
are first held against the filters, where those fit a fixed size, and only the few
that hit meet the exact table; beyond that size every line meets the exact table, so a
filter never decides anything by itself.  Counts are aggregated before any row moves,
so a line that a third of all documents hold is one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import durable, name

BLANKS = " \t\n\x0b\x0c\r"
SLOTS = 4


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; supports deletion."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        return CuckooFilter(1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8)))) + 1))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def from_bytes(bits: bytes) -> CuckooFilter:
        table = np.frombuffer(bits, np.uint16).reshape(-1, SLOTS).copy()
        return CuckooFilter(len(table), table)

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo.view(np.uint64) >> np.uint64(48)).astype(np.int64)
        mark = np.where(mark == 0, 1, mark)
        one = hi.astype(np.int64) & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995 & self.mask)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hi, lo)
        mark = mark.astype(np.uint16)[:, None]
        return ((self.table[one] == mark) | (self.table[two] == mark)).any(axis=1)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if a key found no place (the filter must then be built anew, larger)."""
        table, mask = self.table, self.mask
        for mark, one, two in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            for at in (one, two):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = mark
                    break
            else:
                at = two
                for kick in range(500):
                    slot = kick % SLOTS
                    mark, table[at, slot] = int(table[at, slot]), mark
                    at ^= mark * 0x5BD1E995 & mask
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


def key_of(line: str, min_chars: int) -> bytes | None:
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None


def line_keys(docs: DataFrame, *, key: str, text: str, min_chars: int) -> DataFrame:
    """doc_id, hi, lo: the distinct keys of each row's lines of at least ``min_chars`` code points."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for value in batch.column(1).to_pylist():
                own = {key_of(x, min_chars) for x in (value or "").split("\n")} - {None}
                found.extend(own)
                counts.append(len(own))
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "hi", "lo"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])
    return docs.select(name(key), name(text).cast("string")).mapInArrow(keys, schema)


@dataclass
class LineIndex:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _count(postings: DataFrame) -> DataFrame:
    """Exact references of each key; a null doc_id is one document, smaller than all others."""
    return postings.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def _update_filters(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: shard, hi, lo, present (of that key, before), wanted.  A shard has a bounded number of keys."""

    def update(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int((rows if len(rows) else old)["shard"].iloc[0])
        was, now = rows["present"].to_numpy(bool), rows["wanted"].to_numpy(bool)
        hi, lo = rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64)
        table, ok = None, False
        if len(old):
            table = CuckooFilter.from_bytes(old["bits"].iloc[0])
            table.remove(hi[was & ~now], lo[was & ~now])
            ok = table.add(hi[now & ~was], lo[now & ~was])
        size = int(now.sum())
        while not ok:  # rows then holds all keys of the shard that are wanted
            table = CuckooFilter.sized(size)
            ok = table.add(hi[now], lo[now])
            size = 2 * size + 1
        return pd.DataFrame({"shard": [shard], "bits": [table.to_bytes()]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, "shard int, bits binary")


def _filters(old: DataFrame, refs: DataFrame, before: DataFrame | None, shards: int, min_docs: int) -> DataFrame:
    wanted = refs.where(F.col("n") >= min_docs).select("hi", "lo", F.lit(True).alias("wanted"))
    if before is None:
        both = wanted.withColumn("present", F.lit(False))
    else:
        present = before.where(F.col("n") >= min_docs).select("hi", "lo", F.lit(True).alias("present"))
        both = wanted.join(present, ["hi", "lo"], "full")
    no = F.lit(False)
    both = both.select(
        F.expr(f"cast(pmod(hi, {shards}) as int)").alias("shard"), "hi", "lo",
        F.coalesce("present", no).alias("present"), F.coalesce("wanted", no).alias("wanted"),
    )
    return durable(_update_filters(old, both))


def build(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, keys_per_shard: int = 50_000
) -> LineIndex:
    """An index of all ``docs``.  A null or empty text has one empty line, which has no key.

    Texts of any length are taken whole; repeated rows are one document; other columns,
    whatever their names, are not read; an empty table gives an empty index.
    """
    postings = durable(line_keys(docs, key=key, text=text, min_chars=min_chars)).distinct()
    refs = durable(_count(postings).where(F.col("n") > 1))  # single keys are only in postings
    shards = max(8, -(-refs.where(F.col("n") >= min_docs).count() // keys_per_shard))
    empty = docs.sparkSession.createDataFrame([], "shard int, bits binary")
    return LineIndex(postings, refs, _filters(empty, refs, None, shards, min_docs), shards, min_docs, min_chars)


def insert(index: LineIndex, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with ``docs`` added; a document that is there already gains the lines it lacks."""
    new = line_keys(docs, key=key, text=text, min_chars=index.min_chars).distinct()
    return _replaced(index, durable(index.postings.unionByName(new).distinct()))


def delete(index: LineIndex, doc_ids: DataFrame, *, key: str = "doc_id") -> LineIndex:
    """The index without the documents of ``doc_ids``; ids that it does not hold change nothing."""
    gone = doc_ids.select(name(key).alias("gone")).distinct()
    return _replaced(index, durable(index.postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")))


def _replaced(index: LineIndex, postings: DataFrame) -> LineIndex:
    refs = durable(_count(postings).where(F.col("n") > 1))
    filters = _filters(index.filters, refs, index.refs, index.shards, index.min_docs)
    return LineIndex(postings, refs, filters, index.shards, index.min_docs, index.min_chars)


def suspects(index: LineIndex, rows: DataFrame, *, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """Rows (doc_id, hi, lo) that the cuckoo filters let through; all rows if the filters are too large to send."""
    size = index.filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size > max_filter_bytes:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast({r.shard: r.bits for r in index.filters.collect()})
    shards = index.shards

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: CuckooFilter.from_bytes(bits) for s, bits in sent.value.items()}
        for batch in batches:
            hi, lo = (batch.column(i).to_numpy() for i in (1, 2))
            at, hit = hi % shards, np.zeros(len(hi), bool)
            for shard, table in tables.items():
                own = np.flatnonzero(at == shard)
                hit[own] = table.contains(hi[own], lo[own])
            yield batch.filter(pa.array(hit))

    return rows.mapInArrow(probe, rows.schema)


def apply(index: LineIndex, docs: DataFrame, *, key: str = "doc_id", text: str = "text", **filters) -> DataFrame:
    """All columns of ``docs`` with the text cut down, plus n_lines and n_dropped.

    ``docs`` must be in the index.  A key that at least ``min_docs`` documents hold
    loses all its lines except in the largest doc_id that holds it.  Null texts stay
    null and count as one empty line.  Rows with the same doc_id are one document; a
    null doc_id is smaller than any other.  Input columns named n_lines and n_dropped
    are replaced.
    """
    common = index.refs.where(F.col("n") >= index.min_docs)
    drops = (
        suspects(index, index.postings, **filters)
        .join(common, ["hi", "lo"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.collect_list(F.struct("hi", "lo")).alias("__drops"))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(
        name(key).alias("id"), F.struct(*[name(c) for c in kept if c != text]).alias("row"), name(text).cast("string").alias("text")
    )
    rows = rows.join(drops, F.col("id").eqNullSafe(F.col("__doc")), "left").select("row", "text", F.col("__drops").alias("drops"))
    min_chars = index.min_chars

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, dropped = [], [], []
            drops = batch.column(2)
            offsets, none = drops.offsets.to_numpy(), drops.is_null().to_numpy(zero_copy_only=False)
            halves = np.stack([drops.values.field(i).to_numpy() for i in (0, 1)], axis=1) if len(drops.values) else np.zeros((0, 2), np.int64)
            for i, value in enumerate(batch.column(1).to_pylist()):
                lines = (value or "").split("\n")
                before.append(len(lines))
                if not none[i]:
                    gone = {x.tobytes() for x in halves[offsets[i] : offsets[i + 1]]}
                    lines = [x for x in lines if key_of(x, min_chars) not in gone]
                    value = "\n".join(lines)
                texts.append(value)
                dropped.append(before[-1] - len(lines))
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.mapInArrow(cut, schema).select(
        *[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept], "n_lines", "n_dropped"
    )
