"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments so that two fingerprints within the distance limit
agree in some segment up to two small radii.  Every distinct fingerprint enumerates the
Hamming ball of one radius within each of its segments, so two of them meet under a key
when their segments differ by no more than twice the radius; those that meet are
verified by their complete distance.  With radius 1 and four bits in all, two segments
of 32 bits are enough, so strangers hardly meet even among 10^9 fingerprints (a key has
33 n / 2^32 of them).  Only links are wanted, not all pairs:
within a key a breadth-first search over what is not linked yet emits a spanning
forest, so a dense group of near copies costs about its size, and no key can emit more
links than it has fingerprints.  Equal texts share a fingerprint and are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import durable, name, tasks_for

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 65_536
#: Keys with no more fingerprints than this are compared by shifted arrays, all keys at once.
SHORT = 48


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(words_in_shingle, len(words))
    begins = [0, *ends[:-1].tolist()][: len(words) - k + 1]
    hashes = [hashed(body[a:b], SEED) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)]
    return fingerprint_of(np.array(hashes, np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), a row for each row of ``docs``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fp", T.LongType())])
    return docs.select(name(key), name(text).cast("string")).mapInArrow(hashed, schema)


def spanning_links(values: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the fingerprints within ``limit`` bits of each other."""
    out, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= limit
            if near.any():
                hits = left[near]
                out.append((np.full(len(hits), x), hits))
                queue.extend(hits)
                left = left[~near]
    return out


def links_in(keys: np.ndarray, values: np.ndarray, limit: int) -> np.ndarray:
    """Verified links (pairs of unsigned fingerprints) within runs of equal keys; keys are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []
    for i in np.flatnonzero(sizes > SHORT):
        found += spanning_links(np.unique(values[starts[i] : starts[i] + sizes[i]]), limit)
    size_at = np.repeat(sizes, sizes)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    short = (size_at <= SHORT) & (size_at > 1)
    for lag in range(1, SHORT):
        i = np.flatnonzero(short & (place + lag < size_at))
        if not len(i):
            break
        a, b = values[i], values[i + lag]
        near = np.bitwise_count(a ^ b) <= limit
        near &= a != b
        found.append((a[near], b[near]))
    if not found:
        return np.zeros((0, 2), np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def links(points: DataFrame, *, max_distance: int = 4, radius: int = 1) -> DataFrame:
    """a, b: links that join all of ``points`` (distinct fp) within ``max_distance`` bits, transitively.

    Over s segments two fingerprints agree somewhere within ``max_distance // s`` bits,
    and balls of ``radius`` around both meet within twice the radius.
    """
    segments = max(2, -(-(max_distance + 1) // (2 * radius + 1)))
    keys = []
    for s in range(segments):
        low, high = s * BITS // segments, (s + 1) * BITS // segments
        own = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for r in range(radius + 1):
            keys += [own.bitwiseXOR(F.lit(sum(1 << i for i in c))) + F.lit(s << 40) for c in combinations(range(high - low), r)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v, enough = [], [], 200_000  # rows of a key may go on in the next batch

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held_k, held_v, enough
            k, v = np.concatenate(held_k), np.concatenate(held_v)
            cut = len(k) if last else int(np.searchsorted(k, k[-1]))
            pairs = links_in(k[:cut], v[:cut], max_distance).view(np.int64)
            held_k, held_v, enough = [k[cut:]], [v[cut:]], max(200_000, 2 * (len(k) - cut))
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held_k.append(batch.column(0).to_numpy())
                held_v.append(batch.column(1).to_numpy().view(np.uint64))
                if sum(map(len, held_k)) >= enough:
                    yield from ready(False)
        if held_k:
            yield from ready(True)

    met = points.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(verify, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node that has an edge but roots.

    Alternating large-star and small-star rounds; each is checkpointed, and the rounds
    end when a round changes nothing (about log of the longest chain).
    """

    def pair(u: str, v: str) -> Column:
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    def each(e: DataFrame, *pairs: Column) -> DataFrame:
        """u, v of every pair that is not null, in one reading of ``e``."""
        return e.select(F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("x.u", "x.v")

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def kept(e: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
        """Checkpointed, with what tells one round's links from another's (counted on the way); few links are few tasks."""
        seen = Observation()
        e = durable((e.coalesce(tasks_for(rows)) if rows is not None else e).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return e, (seen.get["n"], seen.get["h"])

    u, v = F.greatest("a", "b"), F.least("a", "b")
    e, seen = kept(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct())
    while seen[0]:
        both = each(e, pair("u", "v"), pair("v", "u"))
        large = both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = large.join(lowest(large), "u")
        e, now = kept(each(small, F.when(F.col("v") != F.col("m"), pair("v", "m")), pair("u", "m")).distinct(), seen[0])
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_in_shingle: int = 4, max_distance: int = 4
) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, a row for each row of ``docs``.

    Fewer words than a shingle: the whole sequence is hashed; no words (null or blank
    text): fingerprint zero, linked like any other.  A null doc_id never names a
    component unless all of its component's are null.  Repeated rows are one node and get
    a row each; texts of any length are taken whole; other columns, whatever their names,
    are not read.  An empty table gives no rows.
    """
    prints = durable(fingerprints(docs, key=key, text=text, words_in_shingle=words_in_shingle))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(classes.select("fp"), max_distance=max_distance))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(joined.join(names, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
