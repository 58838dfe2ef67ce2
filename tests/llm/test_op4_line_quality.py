from collections import Counter

from tests.llm.cases import DOCS, LINE, WORD, docs
from vigil.llm import line_quality, queries

SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def values(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_matches_plain_counts(spark):
    rows = queries.op4_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert values(r) == base(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_odd_rows_and_clashes(spark):
    rows = line_quality.judge_lines(docs(spark, clash=True)).collect()
    assert sorted(map(values, rows)) == sorted(base(d[1]) for d in DOCS)
    assert {c for c in rows[0].asDict()} >= {"row", "host", "a.b c", "kept"}
    assert line_quality.judge_lines(docs(spark, [])).count() == 0


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    word = lambda i, j: "w" + chr(97 + i // 26) + chr(97 + i % 26) + chr(97 + j // 26) + chr(97 + j % 26)
    rows = [(i, f"{LINE} {7 * i}\n" + " ".join(word(i, j) for j in range(60)), "en", "a", 1) for i in range(60)]
    rows += [(100, "\n".join([LINE + " 5"] * 6 + ["one more line"]), "en", "a", 1)]
    rows += [(200 + i, LINE + " 1\n" + " ".join(word(99, j) for j in range(60)), "en", "b", 1) for i in range(60)]  # one text
    out = {r.doc_id: r for r in line_quality.judge_lines(docs(spark, rows)).collect()}
    assert all(out[i].kept and out[i].n_removed_lines == 1 and out[i].n_left_words == 60 for i in range(60))
    assert not out[100].kept and out[100].n_removed_lines == 6 and out[100].clean_text == "one more line"
    assert all(out[200 + i].kept and out[200 + i].n_removed_lines == 0 for i in range(60))
    same = line_quality.judge_lines(docs(spark, rows), broadcast_keys=0)
    assert {r.doc_id: r.kept for r in same.collect()} == {k: r.kept for k, r in out.items()}


def test_planted_depleted_documents_are_rejected_through_the_query(spark, tmp_path):
    """21 texts of a source share a boilerplate of 60 words: those that have little else go, a plain copy of one of them too."""
    word = lambda i, j: "v" + "".join(chr(97 + x) for x in (i // 26, i % 26, j // 26, j % 26))
    boiler = "\n".join(" ".join(word(300 + k, j) for j in range(20)) for k in range(3))
    rows = [(i, boiler + "\n" + " ".join(word(i, j) for j in range(5 if i % 3 else 90)), "en", None, 1) for i in range(21)]
    rows += [(100, rows[1][1], "en", None, 1), (101, rows[1][1], "en", "other", 1)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.kept, r.n_removed_lines, r.base_failed) for r in queries.op4_quality_rules(spark, str(tmp_path)).collect()}
    assert out == {i: (i % 3 == 0, 3, False) for i in range(21)} | {100: (False, 3, False), 101: (True, 0, False)}
