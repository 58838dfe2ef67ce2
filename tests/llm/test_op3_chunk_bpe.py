from hashlib import sha256

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.cases import DOCS, docs
from tests.llm.test_op1_packing import ODD
from vigil.llm import chunk_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(tokenizer, doc, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return doc, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()


def test_query_matches_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op3_bpe_coding(spark, SF).collect()) == sorted(expected(tokenizer, *x) for x in texts)


def test_odd_rows(spark):
    tokenizer = Tokenizer.from_file(PATH)
    more = [*ODD, "x" * 700 + " " + "y" * 9000 + " z", "漢字かな " * 500, "q" * 30_000 + "<|startoftext|>" + "é" * 9000, "ΟΔΟΣ İ \x1c\x1d z"]
    rows = [*DOCS, *((100 + i, t, "en", "a", 1) for i, t in enumerate(more))]
    out = chunk_bpe.encode_documents(docs(spark, rows, clash=True), tokenizer=PATH).collect()
    got = sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in out)
    assert got == sorted(repr(expected(tokenizer, *r[:2])) for r in rows)
    assert all(len(r.ids) == r.n_tokens and sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in out)
    assert chunk_bpe.encode_documents(docs(spark, []), tokenizer=PATH).count() == 0


def test_shared_passages_fall_into_the_same_chunks_and_are_encoded_once():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice([*"abcdefgh"], rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(4000))
    texts = [(" ".join(word() for _ in range(300)) + " " + passage + " " + word()).encode() for _ in range(5)]
    ends = [chunk_bpe.borders(t) for t in texts]
    chunks = [{t[a:b] for a, b in zip([0, *e], e, strict=False)} for t, e in zip(texts, ends, strict=True)]
    shared = set.intersection(*chunks)
    assert sum(map(len, shared)) > 0.8 * len(passage)
    assert all(chunk_bpe.borders(t)[-1] == len(t) for t in texts)
    encoder = chunk_bpe.ChunkEncoder(PATH)
    encoder.encode(texts[:1])
    held = set(encoder.chunks)
    encoder.encode(texts[1:])
    assert len(set(encoder.chunks) - held) < 0.5 * sum(map(len, chunks[1:]))


def test_bounded_memories_change_nothing(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "WORDS_KEPT", 10)
    monkeypatch.setattr(chunk_bpe, "CHUNK_BYTES_KEPT", 3000)
    tokenizer = Tokenizer.from_file(PATH)
    encoder = chunk_bpe.ChunkEncoder(PATH)
    texts = [" ".join(f"w{i * j % 97}" for j in range(900)) for i in range(1, 9)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encoder.encode([t.encode()])[0], np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert encoder.chunk_bytes <= 20_000
