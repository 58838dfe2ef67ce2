"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks whose borders depend on the
content alone, so a passage that many documents share falls into the same chunks
wherever it stands.  A chunk is encoded once: its whole words become the body, the
bytes before its first and after its last white space stay open.  Joins are then
repaired: the open ends on both sides of a border are put together, over further
chunks if one has no white space, and encoded again as one word.  White space never
lies inside a token of this kind of tokenizer, so both sides of the repaired word
agree exactly with encoding the whole text.

Documents are first dealt out by the smallest hash of their lines, so copies and
documents with a passage in common tend to meet in one task and its memory.  The deal
is a rebalance: a task that a large group of copies would fill is split by Spark.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import name, text_blocks

#: Bytes that the rolling hash sees, and sizes of chunks.
WINDOW, LEAST, MOST = 16, 256, 8192
MASK = np.uint64(0x3FF)
WORDS_KEPT, CHUNK_BYTES_KEPT = 350_000, 24 << 20
SPACES = re.compile(rb"[\x20\x09-\x0d]")
MULTIPLIER = 0x9E3779B97F4A7C15
BLOCK = 1 << 20


def borders(data: bytes) -> list[int]:
    """Where chunks end: polynomial rolling hash over WINDOW bytes, lengths LEAST to MOST."""
    n = len(data)
    if n <= LEAST:
        return [n]
    out, begin = [], 0
    for at in range(0, n, BLOCK):  # bounded memory for any length
        low = max(0, at - WINDOW)
        view = np.frombuffer(data, np.uint8, min(n, at + BLOCK) - low, low).astype(np.uint64)
        rolled, step, m = view * np.uint64(MULTIPLIER), 1, MULTIPLIER
        while step < WINDOW:  # doubling: the hash of 2k bytes from two hashes of k
            rolled[step:] += rolled[:-step] * np.uint64(m)
            m, step = m * m % 2**64, 2 * step
        for cut in (np.flatnonzero(((rolled >> np.uint64(40)) & MASK) == 0) + low + 1).tolist():
            if cut <= at and at:
                continue
            while cut - begin > MOST:
                begin += MOST
                out.append(begin)
            if cut - begin >= LEAST:
                begin = cut
                out.append(cut)
    while n - begin > MOST:
        begin += MOST
        out.append(begin)
    return out if out and out[-1] == n else [*out, n]


class ChunkEncoder:
    """Encodes texts with memories of words and of chunks, both bounded.  Ids are held as 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold more memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token[i] = token.encode()
        self.decimal = [str(i).encode() for i in range(len(self.token))]
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0

    def learn(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)
        self.words |= {w: array("I", e.ids).tobytes() for w, e in zip(words, found, strict=True)}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        cut, new, ready = [], {}, {}
        for data in texts:
            own, begin = [], 0
            for end in borders(data):
                chunk = data[begin:end]
                digest = xxhash.xxh3_128_digest(chunk)
                if digest in self.chunks:
                    ready[digest] = self.chunks[digest]
                elif digest not in new:
                    new[digest] = opened(chunk)
                own.append(digest)
                begin = end
            cut.append(own)
        joins = [[*repairs(own, new, ready)] for own in cut]
        wanted = set().union(*(words for _, words, _ in new.values() if words), *joins)
        known = self.words
        if missing := [w for w in wanted if w not in known]:
            self.learn(missing)
        get = known.__getitem__
        for digest, (head, words, tail) in new.items():
            ready[digest] = (head, None if words is None else b"".join(map(get, words)), tail)
            self.keep(digest, ready[digest])
        out = []
        for own, open_ends in zip(cut, joins, strict=True):
            ends = iter(open_ends)
            parts = [get(next(ends))]
            for digest in own:
                if (body := ready[digest][1]) is not None:
                    parts += (body, get(next(ends)))
            out.append(b"".join(parts))
        return out

    def keep(self, digest: bytes, entry: tuple) -> None:
        size = 200 + sum(len(x) for x in entry if x)
        while self.chunks and self.chunk_bytes + size > CHUNK_BYTES_KEPT:
            old = self.chunks.pop(next(iter(self.chunks)))
            self.chunk_bytes -= 200 + sum(len(x) for x in old if x)
        self.chunks[digest] = entry
        self.chunk_bytes += size


def process_encoder(path: str) -> ChunkEncoder:
    """The one encoder of this worker process for a tokenizer file: tasks after the first find its memories filled."""
    import tokenizers

    held = vars(tokenizers).setdefault("_vigil_encoders", {})
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


def opened(chunk: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
    """A chunk's open head, whole words and open tail; no words (None) where it has no white space."""
    first = SPACES.search(chunk)
    if first is None:
        return chunk, None, b""
    last = max(chunk.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    return chunk[: first.start()], chunk[first.start() : last].split(), chunk[last + 1 :]


def repairs(chunks: list[bytes], *entries: dict[bytes, tuple]) -> Iterator[bytes]:
    """The words to encode again: the text's start, what meets at each border, the text's end (may be empty)."""
    part = []
    for digest in chunks:
        head, body, tail = next(e[digest] for e in entries if digest in e)
        part.append(head)
        if body is not None:
            yield b"".join(part)
            part = [tail]
    yield b"".join(part)


def encode_documents(docs: DataFrame, *, tokenizer: str, key: str = "doc_id", text: str = "text", outputs: str = "both") -> DataFrame:
    """doc_id and, by ``outputs``, ids and decoded (``texts``), or n_tokens, ids_sha256 and decoded_sha256 (``digests``), or ``both``.

    ``tokenizer`` is a file of the tokenizers library without a decoder, whose decode
    joins tokens by blanks.  Whole texts; null counts as empty (no ids, empty text);
    repeated rows are encoded as often as they stand there.  Other columns, whatever
    their names, are not read; an empty table gives no rows.
    """
    full, digest = outputs in ("both", "texts"), outputs in ("both", "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_encoder(tokenizer)
        token, decimal = encoder.token, encoder.decimal
        for batch in batches:
            for first, texts in text_blocks(batch.column(1), BLOCK):
                made = [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode([t.encode("utf-8", "surrogatepass") for t in texts])]
                columns = [batch.column(0).slice(first, len(texts))]
                decoded = [b" ".join([token[i] for i in ids]) for ids in made]
                if full:
                    columns.append(pa.array(made, pa.list_(pa.int32())))
                    columns.append(pa.array([x.decode() for x in decoded], pa.string()))
                if digest:
                    columns.append(pa.array([len(ids) for ids in made], pa.int64()))
                    columns.append(pa.array([sha256(b" ".join([decimal[i] for i in ids])).hexdigest() for ids in made], pa.string()))
                    columns.append(pa.array([sha256(x).hexdigest() for x in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("doc_id", docs.schema[key].dataType)]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    if digest:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = [f.name for f in fields]
    body = name(text).cast("string")
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n", -1), lambda x: F.xxhash64(x))
    dealt = docs.select(name(key).alias("doc_id"), body.alias("text"), F.array_min(lines).alias("lead")).hint("rebalance", "lead")
    return dealt.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
