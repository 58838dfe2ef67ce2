"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash proposals, exact verification.

Texts that differ in ASCII case and white space only are one node.  A link joins nodes
whose sets of shingles reach the similarity limit, exactly.  Who is compared:

1. SimHash links by multi-index hashing (``simhash_mih``), a spanning forest of the
   fingerprints within a few bits.  They propose light edits, but a pair at similarity
   0.8 differs in about 10 of 64 bits, which no table of segments finds.
2. So MinHash bands propose the rest: 24 bands of 5 hashes miss a pair at 0.8 with
   probability 0.00007.

Nodes that proposals connect form a pool.  A pool's sets meet in prefix trees
(``jaccard_trie``), which find a spanning forest of the links among all of them: no pair
of a pool is left out, none is emitted that is connected already, and no pair is a row
of a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import SPACE, ascii_lower, compact, durable, name, small_side
from vigil.llm.jaccard_trie import hub_pairs, pool_roots, pools_of
from vigil.llm.simhash_mih import fingerprint_of, links

SEED = 42
#: Shingles that are permuted at once.
BLOCK = 4096


def plain_text(text: Column) -> Column:
    """ASCII lower case, words apart by one blank; null is empty."""
    return F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), f"[{SPACE}]+", " "), F.lit(" "))


def shingles(body: str, size: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer words than a shingle are one, no words none."""
    raw = body.encode("utf-8", "surrogatepass")
    words = raw.split(b" ") if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(size, len(words))
    begins = [0, *ends[:-1].tolist()][: len(words) - k + 1]
    return np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, bands * rows, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK, None] * factors + offsets
        least = np.minimum(least, part.min(axis=0))
    signature = least.reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(own.tobytes(), i) for i, own in enumerate(signature)], np.uint64).view(np.int64)


def components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, max_distance: int = 4, bands: int = 24, rows: int = 5,
    broadcast_rows: int = 200_000, **tasks: int,
) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over links, a row for each row of ``docs``.

    A link joins texts whose sets of ``size``-word shingles have a Jaccard similarity of
    at least ``percent`` %.  Texts without words (null, blank) are one node; fewer words
    than a shingle are one shingle; texts of any length are taken whole; a null doc_id
    never names a component unless all of its component's are null.  Other columns,
    whatever their names, are not read.  An empty table gives no rows.
    """
    source = docs.select(name(key).alias("doc_id"), plain_text(name(text)).alias("body")).withColumn("node", F.md5(F.col("body").cast("binary")))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, prints = [], [], []
            for body in batch.column(2):
                every = shingles(body.as_py(), size)
                own = np.unique(every)
                sizes.append(len(own))
                prints.append(fingerprint_of(every))
                keys.append(band_keys(own, bands, rows))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(flat))
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), fps, lists], ["doc_id", "node", "n", "fp", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(b.as_py(), size)).view(np.int64) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "own"])

    fields = {"node": T.StringType(), "n": T.LongType(), "fp": T.LongType(), "keys": T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *(T.StructField(c, t) for c, t in fields.items())])
    prints = durable(source.select("doc_id", "node", "body").mapInArrow(signed, schema))
    nodes = prints.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = compact(nodes.withColumn("nid", F.xxhash64("node")))
    # Pairs of hashes of nodes: what shares a band key or a fingerprint, and fingerprints that SimHash links.
    first = compact(nodes.groupBy("fp").agg(F.min("nid").alias("hub")))
    near = links(first.select("fp"), max_distance=max_distance).select(F.col("a").alias("f"), F.col("b").alias("g"))
    near = near.join(first.select(F.col("fp").alias("f"), F.col("hub").alias("a")), "f").join(first.select(F.col("fp").alias("g"), F.col("hub").alias("b")), "g")
    alike = F.explode(F.concat("keys", F.array(F.xxhash64("fp", F.lit("fingerprint"))))).alias("key")
    pairs = durable(hub_pairs(nodes.select("nid", alike), "key")).unionByName(durable(near.select("a", "b")))
    pooled = pools_of(nodes.select("node", "nid", "n"), pairs)
    wanted = compact(pooled.select(F.col("node").alias("want")))
    held = source.select("node", "body").join(small_side(wanted, broadcast_rows), F.col("node") == F.col("want"), "left_semi")
    sets = held.dropDuplicates(["node"]).mapInArrow(sets_of, "node string, own array<bigint>")
    roots = pool_roots(pooled, sets, percent, broadcast_rows=broadcast_rows, **tasks)

    named = prints.select("doc_id", "node").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(names, "root").select("doc_id", "component_id")
