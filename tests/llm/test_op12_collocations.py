import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import docs
from vigil.llm import collocations, queries

SF = "/root/testdata/sf0.01"


def plain(rows, max_words=5, min_count=100, top=2000):
    """rows: (lang, text)"""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= min_count and len(p) > 1}
        best = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and c >= a and inside(q) for q, c in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_matches_sql_and_definition(spark):
    df = queries.op12_collocations(spark, SF)
    assert [t for c, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    rows = got(df)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    twin = con.execute(queries.ORACLES["op12_collocations"]).fetchall()
    assert rows == sorted(twin)
    assert len(rows) > 50
    assert rows == plain([(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


@pytest.mark.parametrize("options", [{}, {"filter_bits": 1 << 15, "block_bytes": 50}, {"broadcast_rows": 0}, {"max_words": 2}, {"max_words": 3, "top": 5}])
def test_small_corpora_against_definition(spark, options):
    """Overlaps, ends, odd blanks, hot phrases, ties, null and empty texts, a null language beside ``und``."""
    rng = random.Random(6)
    words = ["a", "b", "B", "c", "é", "ü x", "\x00", "𝒳", "dd"]
    rows = [("en", "a b a b a b a b"), ("en", None), (None, "x y. x y, x\ty\x0bx y"), ("und", "X  Y"), ("en", ""), ("de", " .,;\n ")]
    for i in range(120):
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " "]) for _ in range(rng.randrange(40)))))
    rows += [("fr", "one two three four five six seven")] * 30
    df = docs(spark, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)], clash=True)
    shape = {k: v for k, v in options.items() if k in ("max_words", "top")}
    assert got(collocations.mine(df, min_count=4, **options)) == plain(rows, min_count=4, **shape)


def test_scores_beyond_64_bits(spark):
    cases = [(10**12, 10**15, 10**12, 10**12), (3, 7, 2, 5), (9 * 10**13, 10**16 + 1, 9 * 10**13, 10**14 + 7), (100, 10**15, 100, 100)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    scores = df.select("*", collocations.cut_score(*map(F.col, ("a", "n", "l", "r")), 1000).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in scores)


def test_empty_table(spark):
    assert collocations.mine(docs(spark, [])).count() == 0
