import numpy as np
import xxhash

from tests.llm.cases import DOCS, WORD, docs
from vigil.llm import queries, simhash_mih

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points, limit=4):
    """points: (doc_id or None, fingerprint)"""
    prints = np.array(sorted({f for _, f in points}), np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= limit
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            break
        label = new
    of = dict(zip(prints.tolist(), label.tolist(), strict=True))
    first = {}
    for d, f in points:
        if d is not None:
            first[of[f]] = min(d, first.get(of[f], d))
    return sorted((repr(d), f, first.get(of[f])) for d, f in points)


def test_query_matches_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((repr(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in queries.op9_simhash(spark, SF).collect())
    assert got == components([(d, fingerprint(t)) for d, t in rows])
    assert len({x[2] for x in got}) < len(got)


def test_odd_rows(spark):
    got = simhash_mih.near_duplicates(docs(spark, clash=True)).collect()
    got = sorted((repr(r.doc_id), r.fp % 2**64, r.component_id) for r in got)
    assert got == components([(d[0], fingerprint(d[1])) for d in DOCS])
    assert simhash_mih.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_planted_neighbours_and_dense_groups(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64 - 1, 300, np.uint64)
    points = set(seeds.tolist())
    for s in seeds[:200].tolist():
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            points.add(s ^ sum(1 << int(b) for b in flips))
    dense = int(seeds[250])
    for a in range(16):
        for b in range(16):
            points.add(dense ^ (a << 30) ^ (b << 5))  # 256 fingerprints, most pairs within 4 bits
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    edges = simhash_mih.links(df).collect()
    pairs = [(e.a % 2**64, e.b % 2**64) for e in edges]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash_mih.connected(simhash_mih.links(df)).collect()}
    groups = {}
    for p in points:
        groups.setdefault(roots.get(p, p), []).append(p)
    expected = {}
    for i, (_, f, c) in enumerate(components([(i, p) for i, p in enumerate(sorted(points))])):
        expected.setdefault(c, []).append(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
