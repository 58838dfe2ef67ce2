"""Best-fit packing: best-fit decreasing over all documents, exactly, from a histogram.

Lengths are integers up to the capacity, so the whole packing follows from how many
pieces have each length.  That histogram (at most ``capacity`` rows, whatever the
corpus) goes to the driver, which runs best-fit decreasing on counts: a segment tree
over remaining capacities finds the tightest open bin that still fits in logarithmic
time, and all bins with the same remaining capacity are filled together, as each
takes ``room // length`` pieces of a length before a looser bin would be chosen.  The
result is a short table of placements ("ranks a to b of this length go to bins c and
on, at this offset"), which is joined to the pieces by their rank within their length.
Ranks come from hash buckets and prefix sums, never from one window over a length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import durable, name, text_blocks

BLANK_RUN = re.compile(r"\s\s")
#: The split of byte-level BPE before merges (fixed by the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task remembers, and characters of text encoded at once.
MEMORY, BLOCK = 600_000, 4 << 20
RANK_BUCKETS = 1024


class SegmentTree:
    """Which remaining capacities (0 to n) have open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.used = [False] * (2 * self.size)

    def set(self, room: int, used: bool) -> None:
        at = room + self.size
        self.used[at] = used
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest used capacity that is at least ``need``."""
        at = need + self.size
        if self.used[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.used[at + 1]:  # the subtree to the right is larger
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, rank after the last, first bin, pieces a bin, offset in the bin)."""
    tree, rooms = SegmentTree(capacity), defaultdict(list)
    out, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                put(room, bins, -(-left // (room // length)))
                bins += rooms[room][-1][1]
            first, n = rooms[room].pop()
            tree.set(room, bool(rooms[room]))
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:  # fewer than a bin takes
                    out.append((length, rank, rank + left, first + full, left, capacity - room))
                    put(room - left * length, first + full, 1)
                    put(room, first + full + 1, n - full - 1)
                    left = 0
                else:
                    put(room, first + full, n - full)
    return out


class ByteBpe:
    """Texts to little-endian 32-bit ids, for a byte-level BPE file of the tokenizers library.

    The ids are those of that library without added special tokens.  Words repeat, so
    ids are remembered by blank-separated word and only new words are encoded, together;
    texts with runs of white space, where words are not independent, are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of_char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.after_blank = np.zeros(self.core.n_vocab, bool)
        self.after_blank[[i for t, i in ranks.items() if t[0] == 0x20]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.core.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if BLANK_RUN.search(t) else t.split(" ") for t in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        known = self.known
        words = set().union(*(x[1:] for x in split if x))
        new = [w for w in words if w not in known]
        odd = {w for w in new if not w or w[-1].isspace()}  # only at the end of a text
        known |= {w: self.whole(" " + w) for w in odd}
        new = [w for w in new if w not in odd]
        if new:  # a blank comes before each word and nowhere else, so it marks the words' first tokens
            ids = self.core.encode_to_numpy(" " + " ".join(new), allowed_special="all")
            starts = (4 * np.flatnonzero(self.after_blank[ids])).tolist()
            data = ids.astype("<u4").tobytes()
            known |= {w: data[a:b] for w, a, b in zip(new, starts, [*starts[1:], len(data)], strict=True)}
        get = known.__getitem__
        return [self.whole(t) if x is None else self.whole(x[0]) + b"".join(map(get, x[1:])) for t, x in zip(texts, split, strict=True)]


def token_pieces(
    docs: DataFrame, *, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and ``end_id``, cut to the capacity.

    Only documents longer than the capacity are cut; all their pieces are full but the
    first, which takes the rest.  A null text counts as empty: its one piece is ``end_id``.
    Texts of any length are taken whole; repeated rows give their pieces again; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """

    def cut(ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        at, stop, piece = 0, (n - 1) % capacity + 1, 0
        while at < n:
            part = ids[4 * at : 4 * stop]
            yield piece, at, stop - at, zlib.crc32(part), part if with_ids else None
            at, stop, piece = stop, stop + capacity, piece + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            for first, texts in text_blocks(batch.column(1), BLOCK):
                made = [[*cut(ids + end)] for ids in bpe.encode(texts)]
                rows = np.repeat(np.arange(first, first + len(texts)), [len(x) for x in made])
                columns = list(zip(*(x for own in made for x in own), strict=True))
                arrays = [batch.column(0).take(pa.array(rows)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
                if with_ids:
                    ends = np.cumsum([0, *columns[2]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(columns[4]), "<i4")))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = [T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in names[1:5]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *fields])
    return docs.select(name(key), name(text).cast("string")).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """All columns of ``pieces`` plus sequence_id and offset.

    ``pieces`` has a row per piece with its length (1 to ``capacity``).  Pieces of a
    sequence follow each other without a gap from offset 0.  An empty table gives no
    rows; rows that are equal in all columns are each placed once.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[name(c) for c in kept])
    rows = durable(pieces.select(row.alias("row"), F.col("length").cast("int").alias("size"), F.xxhash64(row).alias("h")))
    rows = rows.withColumn("b", F.pmod("h", F.lit(RANK_BUCKETS)).cast("int"))
    sizes = durable(rows.groupBy("size", "b").agg(F.count("*").alias("n")))
    counts = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError(f"piece lengths must lie in 1 to {capacity}")
    spark = pieces.sparkSession
    places = spark.createDataFrame(
        plan(counts, capacity), "size int, first long, after long, bin long, each long, at long"
    )  # at most a few placements for each length and remaining capacity
    starts = sizes.select("size", "b", (F.sum("n").over(Window.partitionBy("size").orderBy("b")) - F.col("n")).alias("before"))
    order = Window.partitionBy("size", "b").orderBy("h", "row")
    ranked = rows.join(starts, ["size", "b"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    placed = ranked.join(F.broadcast(places.withColumnRenamed("size", "of")), (F.col("size") == F.col("of")) & inside)
    nth = F.col("rank") - F.col("first")
    return placed.select(
        *[F.col("row")[c].alias(c) for c in kept],
        (F.col("bin") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("size")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids, ids: the packed sequences themselves (pieces made with ids)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
    )
