import os
import re

import corpus_pipeline
from tests.llm.cases import DOCS, docs
from tests.llm.test_op1_packing import check_layout, expected_pieces
from tests.llm.test_op4_line_quality import base
from tests.llm.test_op6_line_dedup import dedup
from tests.llm.test_near_copies import components
from vigil.llm import pii_boost

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_it_kept(spark, tmp_path):
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs_in.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs_in, SF).write.parquet(str(tmp_path / name))
        docs_in = spark.read.parquet(str(tmp_path / name))
        held.append(docs_in.collect())
    start, quality, lines, near, private, packed = held
    assert sorted(r.doc_id for r in quality) == sorted(r.doc_id for r in start if not base(r.text)[-1])
    assert sorted((r.doc_id, r.text) for r in lines) == sorted((d, t) for d, _, _, t in dedup([(r.doc_id, r.text) for r in quality]))
    assert sorted(r.doc_id for r in near) == sorted(set(components([(r.doc_id, r.text) for r in lines]).values()))
    assert sorted(r.doc_id for r in private) == sorted(r.doc_id for r in near)
    text = {r.doc_id: r.text for r in near}
    mark = re.compile(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|SSN|SECRET)\]")
    for r in private:
        assert r.n_chars == len(r.text)
        assert (r.text == text[r.doc_id]) or mark.search(r.text)
    assert sorted(tuple(r)[:5] for r in packed) == sorted(expected_pieces([(r.doc_id, r.text) for r in private]))
    check_layout(packed)


def test_run_leaves_no_stage_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100
    check_layout(out.collect())
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("pipeline-")]


def test_odd_and_empty_tables(spark, tmp_path):
    for rows, clash in ((DOCS, False), (DOCS, True), ([], True)):
        df = docs(spark, rows, clash=clash)
        if clash:  # more names that a stage might use for itself
            for c in ("first", "id", "node", "at", "body", "text_", "spans", "base", "__s", "doc", "kept_sha256"):
                df = df.withColumn(c, df["source"])
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{len(rows)}{clash}")
            stage(spark, df, SF).write.parquet(path)
            out = spark.read.parquet(path)
            if name != "pack":
                assert out.columns == df.columns
                assert not clash or {r[5:] for r in map(tuple, out.collect())} <= {r[5:] for r in map(tuple, df.collect())}
            df = out
        assert df.count() == 0 or rows
    assert pii_boost.KINDS == ("email", "ip", "card", "phone")
