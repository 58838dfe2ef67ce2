import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from vigil.llm import prefix_trie, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: heads[c]] + x[heads[c] :] for c, x in own.items()}


def trie(conversations):
    """By the definition: a node for each distinct sequence of first turns."""
    members = defaultdict(set)
    for c, x in conversations.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].add(c)
    out, below = [], {}
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below[node] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def of_rows(spark, rows):
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    return prefix_trie.build(prefix_trie.rebuilt(turns), turns.select("conv_id").distinct())


def test_query_matches_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op11_prefix_trie(spark, SF)
    assert dict(df.dtypes)["conv_id"] == "bigint" and all(t in ("bigint", "string") for _, t in df.dtypes)
    assert got(df) == trie(rebuild(rows))


@pytest.mark.parametrize("block,piece", [(4096, 4096), (3, 2)])
def test_odd_rows_shared_openings_and_long_conversations(spark, monkeypatch, block, piece):
    """Nulls, ties, repeated rows, turnless rebuilt conversations, no base, one hot opening and one long conversation."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(4)
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 0, "user", ""), (5, 0, "bot", "é😀"), (5, 0, "bot", "é"), (250, 1, None, "alone")]
    for c in range(100, 230):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 else "bot", "same" if t < 3 or rng.random() < 0.4 else f"t{rng.randrange(3)}"))
    rows += [(c, 0, "user", "only") for c in range(1001, 1020)]
    rows += [(400, t, "user", "ab" if t % 7 else "c") for t in range(60)]
    rows += [(c, t, "user", "ab" if t % 7 else "c") for c in (460, 499) for t in range(45)]
    rng.shuffle(rows)
    expected = trie(rebuild(rows))
    assert any(not x for x in rebuild(rows).values())
    assert got(of_rows(spark, rows)) == expected


def test_empty_table_and_clashing_names(spark):
    assert of_rows(spark, []).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], SCHEMA + ", place string, `a.b` string")
    turns = prefix_trie.ordered_turns(df)
    assert [r.size for r in turns.collect()] == [1]
    assert isinstance(turns.schema["place"].dataType, T.LongType)
