import random

import corpus_pipeline
from tests.llm.cases import docs
from vigil.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def components(rows):
    """doc_id -> smallest doc_id reachable over links of similarity 0.8, by all pairs."""
    sets = [(d, shingle_set(t or "") if (t or "").split() else frozenset()) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if (not x and not y) or (both and 5 * both >= 4 * len(x | y)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def test_dense_and_mixed_groups_against_all_pairs(spark):
    """Variants of variants: chains, a dense group and one whose members mostly stay under the limit."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for edits, members in ((1, 60), (6, 60), (9, 60), (14, 40)):
        seed = [word() for _ in range(300)]
        made = [seed]
        for _ in range(members):
            own = list(rng.choice(made[-5:]) if edits == 9 else seed)
            for at in rng.sample(range(300), edits):
                own[at] = word()
            made.append(own)
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate(made)]
    rows += [(5000, None), (5001, " "), (5002, "a b"), (5003, "A  B"), (5004, "a c")]
    df = docs(spark, [(d, t, "en", "a", 1) for d, t in rows], clash=True)
    expected = components(rows)
    for tasks in ({}, {"task_tokens": 9000, "leaders": 4}):
        got = {r.doc_id: r.component_id for r in near_copies.components(df, broadcast_rows=50, **tasks).collect()}
        assert got == expected
    assert 2 < len({c for d, c in expected.items() if d >= 122 and d < 183}) < 61 or len(set(expected.values())) > 10


def test_stage_takes_near_copies_and_leaves_clean_documents(spark):
    rng = random.Random(3)
    rows, goes, stays = [], [], []
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = list(words)
        for at in rng.sample(range(2, 398), rng.randrange(1, 14)):
            other[at] = f"x{rng.randrange(10**6)}"
        texts = " ".join(words), "  ".join(other).upper()
        rows += [(2 * i, texts[0], "en", "a", 1), (2 * i + 1, texts[1], "en", "a", 1)]
        (goes if jaccard(*texts) >= 0.8 else stays).append(2 * i + 1)
    assert len(goes) > 40 and len(stays) > 20
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs(spark, rows), SF).collect()}
    assert kept == {2 * i for i in range(120)} | set(stays)
