import corpus_pipeline
from tests.llm.cases import LINE, docs
from vigil.llm import line_quality

SF = "/root/testdata/sf0.001"


def test_limit_does_not_grow_with_the_source(spark):
    body = lambda i: "\n".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)} {chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(40))
    rows = [(i, (LINE + "\n") * (i < 30) + body(i), "en", None, 1) for i in range(600)]
    rows += [(1000 + i, LINE + "\n" + body(i), "en", "b", 1) for i in range(20)]
    rows += [(2000 + i, LINE + "\n" + body(i), "en", "c", 1) for i in range(21)]
    out = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs(spark, rows), SF).collect()}
    text = {i: t for i, t, *_ in rows}
    for i in text:
        gone = i < 30 or i >= 2000
        assert out[i] == (text[i].removeprefix(LINE + "\n") if gone else text[i]), i
    spread = line_quality.judge_lines(docs(spark, rows), broadcast_keys=0, broadcast_lines=0)
    assert {r.doc_id: r.clean_text for r in spread.collect()} == out
