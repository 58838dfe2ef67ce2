import random

import numpy as np
import pytest

from tests.llm.cases import DOCS, WORD, docs
from vigil.llm import jaccard_trie, queries

SF = "/root/testdata/sf0.01"


def ngrams(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(3, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def components(rows):
    """rows: (doc_id or None, text); by the definition, over pairs that share an n-gram."""
    sets = [ngrams(t) for _, t in rows]
    root, held = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        seen = {}
        for w in x:
            for j in held.get(w, ()):
                seen[j] = seen.get(j, 0) + 1
            held.setdefault(w, []).append(i)
        for j, both in seen.items():
            if 100 * both >= 90 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def groups(rng):
    """Near copies of a text, copies of copies, a group mostly under the limit, texts inside others, and texts that share a passage."""
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for length, edits, members in ((300, 1, 50), (300, 4, 60), (300, 7, 60), (60, 1, 40), (12, 1, 20), (900, 12, 30)):
        seed = [word() for _ in range(length)]
        made = [seed]
        for i in range(members):
            own = list(rng.choice(made[-4:]) if edits == 4 else seed)
            for at in rng.sample(range(length), edits):
                own[at] = word()
            made.append(own + [word() for _ in range(i % 3)])
        texts += [" ".join(x) for x in made]
        texts += [" ".join(seed[: length - i * length // 40]) for i in range(6)]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(80))} {passage}" for _ in range(60)]
    rng.shuffle(texts)
    return texts + texts[:5] + ["a b", "A  B", "a c", None, "", " \t"]


def test_query_matches_definition(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op13_ngram_jaccard(spark, SF)
    assert dict(df.dtypes)["n_shingles"] == "bigint"
    found = got(df)
    assert found == components(rows)
    assert len({x[2] for x in found}) < len(found)


@pytest.mark.parametrize("options", [{}, {"task_tokens": 3000, "leaders": 8, "broadcast_rows": 10}, {"task_tokens": 20_000, "leaders": 2, "filter_bits": 1 << 15}, {"sample_texts": 0}])
def test_planted_groups_whole_and_in_slices(spark, options):
    rows = list(enumerate(groups(random.Random(5))))
    df = docs(spark, [(d, t, "en", "a", 1) for d, t in rows], clash=True)
    expected = components(rows)
    assert 50 < len({x[2] for x in expected}) < len(rows) - 100
    assert got(jaccard_trie.components(df, **options)) == expected


def test_low_limits_take_single_ngrams(spark):
    rng = random.Random(9)
    seed = [f"w{i}" for i in range(40)]
    texts = [" ".join(seed[: 40 - i] + [f"x{rng.randrange(99)}" for _ in range(i)]) for i in range(0, 39, 3)]
    df = docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    sets, root = [ngrams(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 2 * len(x & sets[j]) >= len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    found = {r.doc_id: r.component_id for r in jaccard_trie.components(df, percent=50).collect()}
    assert [found[i] for i in range(len(texts))] == [min(k for k, r in enumerate(root) if r == root[i]) for i in range(len(texts))]


def test_linked_sets_share_neighbours_in_their_prefixes():
    rng = np.random.default_rng(7)
    for percent in (75, 80, 90, 95):
        linked = 0
        for _ in range(4000):
            n = int(rng.integers(1, 150))
            drop, add = (int(x) for x in rng.integers(0, 2 + n * (100 - percent) // 100, 2))
            x = rng.choice(10**6, n, replace=False)
            y = np.union1d(x[min(drop, n - 1) :], rng.choice(10**6, add) + 10**6 if rng.random() < 0.5 else rng.choice(10**6, add))
            both = len(np.intersect1d(x, y))
            if set(x.tolist()) == set(y.tolist()) or 100 * both < percent * (len(x) + len(y) - both):
                continue
            linked += 1
            prefixes = [np.sort(s)[: jaccard_trie.prefix_size(len(s), percent)].tolist() for s in (x, y)]
            shared = set(prefixes[0]) & set(prefixes[1])
            for s in (x, y):
                assert len(shared) >= jaccard_trie.least_shared(-(-percent * len(s) // 100), percent)
            pairs = [set(zip(p, p[1:], strict=False)) for p in prefixes]
            assert pairs[0] & pairs[1]
        assert linked > 200


def test_odd_rows(spark):
    assert got(jaccard_trie.components(docs(spark, clash=True))) == components([(d[0], d[1]) for d in DOCS])
    assert jaccard_trie.components(docs(spark, [])).count() == 0


def test_trie_against_all_pairs():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 90, 100):
        for _ in range(30):
            base = rng.choice(4000, 120, replace=False)
            sets = {}
            for _ in range(40):
                own = np.setdiff1d(base, rng.choice(base, rng.integers(0, 25), replace=False))[: rng.integers(1, 120)]
                own = np.union1d(own, rng.choice(4000, rng.integers(0, 6))).astype(np.uint64)
                sets[own.tobytes()] = own
            sets = list(sets.values())
            asked = [True] * len(sets) if rng.random() < 0.5 else (rng.random(len(sets)) < 0.3).tolist()
            root = list(range(len(sets)))

            def find(i):
                while root[i] != i:
                    i = root[i]  # noqa: B023
                return i

            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    if asked[i] and 100 * both >= percent * (len(x) + len(y) - both):
                        root[find(i)] = find(j)
            expected = [find(i) for i in range(len(sets))]
            links = jaccard_trie.forest(list(range(len(sets))), sets, list(range(len(sets))), asked, percent)
            root = list(range(len(sets)))
            for a, b in links:
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
                root[find(a)] = find(b)
            same = lambda r: np.equal.outer(r, r)
            assert (same(expected) == same([find(i) for i in range(len(sets))])).all()
