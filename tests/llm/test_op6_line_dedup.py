import hashlib
from collections import defaultdict

import numpy as np

from tests.llm.cases import DOCS, docs, plain
from vigil.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return line.encode().lower() if len(line) >= 40 else None


def dedup(rows, min_docs=5):
    low = lambda d: -1 if d is None else d
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders[key(line)].add(low(doc))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= min_docs and low(doc) != max(holders[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


def test_query_matches_plain_dedup(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in dedup(rows))
    assert sorted(tuple(r) for r in queries.op6_line_dedup(spark, SF).collect()) == expected
    assert any(r[2] for r in expected)


def test_odd_rows_clashes_and_a_filter_too_large_to_send(spark):
    df = docs(spark, clash=True)
    index = line_dedup.build(df)
    assert result(line_dedup.apply(index, df)) == dedup(DOCS)
    assert result(line_dedup.apply(index, df, max_filter_bytes=0)) == dedup(DOCS)
    empty = docs(spark, [])
    assert line_dedup.apply(line_dedup.build(empty), empty).count() == 0


def test_insert_and_delete_are_reversible(spark):
    first, second = docs(spark, DOCS[:8]), docs(spark, DOCS[8:])
    a = line_dedup.build(first)
    ab = line_dedup.insert(a, second)
    assert plain(ab.refs) == plain(line_dedup.build(docs(spark)).refs)
    assert result(line_dedup.apply(ab, docs(spark))) == dedup(DOCS)
    ids = second.select("doc_id")
    back = line_dedup.delete(ab, ids)
    assert plain(back.refs) == plain(a.refs) and plain(back.postings) == plain(a.postings)
    assert result(line_dedup.apply(back, first)) == dedup(DOCS[:8])


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    table = line_dedup.CuckooFilter.sized(10_000)
    assert table.add(keys[:10_000, 0], keys[:10_000, 1])
    assert table.contains(keys[:10_000, 0], keys[:10_000, 1]).all()
    assert table.contains(keys[10_000:, 0], keys[10_000:, 1]).mean() < 0.01
    table = line_dedup.CuckooFilter.from_bytes(table.to_bytes())
    table.remove(keys[:5_000, 0], keys[:5_000, 1])
    assert table.contains(keys[5_000:10_000, 0], keys[5_000:10_000, 1]).all()
    assert table.contains(keys[:5_000, 0], keys[:5_000, 1]).mean() < 0.01
