import hashlib
import zlib
from collections import Counter, defaultdict

from tests.llm.cases import DOCS, docs
from vigil.llm import queries, shard_mix

SF = "/root/testdata/sf0.01"


def check(rows, shards, sources):
    sizes = Counter(r.shard for r in rows)
    full = [sizes.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1 and set(sizes) <= set(range(shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = Counter(sources)
    for shard in sizes:
        own = Counter(r.source for r in rows if r.shard == shard)
        for s, n in total.items():
            assert abs(own[s] - n * sizes[shard] / len(rows)) <= 2


def test_query(spark):
    rows = queries.op7_sharding(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check(rows, 40, [r.source for r in rows])
    for r in rows:
        text = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    again = queries.op7_sharding(spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_hot_source_odd_rows_and_clashes(spark):
    rows = [(i, "x", "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(900)]
    out = shard_mix.proportional_shards(docs(spark, rows, clash=True), shards=7).collect()
    check(out, 7, [r[3] for r in rows])
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    odd = shard_mix.proportional_shards(docs(spark), shards=4)
    assert sorted(repr(r[0]) for r in odd.collect()) == sorted(repr(d[0]) for d in DOCS)
    check(odd.collect(), 4, [d[3] for d in DOCS])
    assert shard_mix.proportional_shards(docs(spark, []), shards=4).count() == 0


def plain_shards(rows, shards, seed="mix-1"):
    """(doc_id, shard, slot) by one sort within each source and one over all fractional ranks."""
    groups = defaultdict(list)
    for doc, source in rows:
        groups[source is None, source or ""].append((hashlib.md5(f"{seed}:{doc}".encode()).hexdigest(), doc))
    merged = []
    for (none, source), own in groups.items():
        merged += [((2 * rank - 1) / (2 * len(own)), none, source, rank, doc) for rank, (_, doc) in enumerate(sorted(own), 1)]
    out, slots = [], Counter()
    for place, (*_, doc) in enumerate(sorted(merged)):
        shard = place * shards // len(merged)
        out.append((doc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def test_query_matches_plain_fractional_ranks(spark):
    rows = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()]
    assert sorted((r.doc_id, r.shard, r.slot) for r in queries.op7_sharding(spark, SF).collect()) == plain_shards(rows, 40)
