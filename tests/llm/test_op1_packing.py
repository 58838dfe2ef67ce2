import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import DOCS, docs
from vigil.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["x'S  it'll<|endoftext|>end", " a", "a ", "a\n", "b <|endoftext|> c<|endoftext|>", "\n", " ", "two  blanks\n\nnl \t", "😀 𝒳 é́  nb"]


def expected_pieces(rows, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
        while at < len(ids):
            part = np.array(ids[at:stop], "<u4")
            out.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
            at, stop, piece = stop, stop + capacity, piece + 1
    return out


def best_fit(lengths, capacity):
    """Bins that plain best-fit decreasing opens."""
    rooms = Counter()
    bins = 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r, c in rooms.items() if c and r >= n]
        room = min(fit) if fit else capacity
        bins += not fit
        rooms[room] -= bool(fit)
        rooms[room - n] += 1
    return bins


def check_layout(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark):
    rows = queries.op1_packing(spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(expected_pieces(texts))
    assert check_layout(rows) == best_fit([r.length for r in rows], 2048)


def test_odd_rows_and_whole_sequences(spark):
    rows = [*DOCS, *((100 + i, t, "en", "a", 1) for i, t in enumerate(ODD))]
    pieces = packing.token_pieces(docs(spark, rows, clash=True), tokenizer=PATH, with_ids=True)
    packed = packing.pack(pieces)
    got = packed.collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(repr(p) for p in expected_pieces([r[:2] for r in rows]))
    assert check_layout(got) == best_fit([r.length for r in got], 2048)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
    empty = packing.token_pieces(docs(spark, []), tokenizer=PATH)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65 if seed % 2 else 20, 4000).tolist() + [64] * 100 + [1] * 50
    counts = Counter(lengths)
    rows = packing.plan(dict(counts), 64)
    fill, used = Counter(), Counter()
    for length, a, b, first, each, at in rows:
        for i in range(b - a):
            where = first + i // each
            assert fill[where] == at + i % each * length
            fill[where] += length
        used[length] += b - a
    assert used == counts and max(fill.values()) <= 64
    assert len(fill) == best_fit(lengths, 64)


def test_segment_tree_finds_the_tightest():
    rng = np.random.default_rng(0)
    tree, held = packing.SegmentTree(100), set()
    for _ in range(3000):
        room = int(rng.integers(0, 101))
        held.symmetric_difference_update({room})
        tree.set(room, room in held)
        need = int(rng.integers(0, 101))
        assert tree.tightest(need) == min((r for r in held if r >= need), default=None)
