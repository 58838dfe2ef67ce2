"""Versioned tables, their writers, recorded sources and caches."""

import json
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import experiments, metrics, models, sinks, tables
from vigil.sources import recorded

NOW = "2024-01-20 00:00:00"


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_versions_replacement_and_conflict(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "k long, policy string")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, policy string")
    assert table.version() == 0 and table.read().count() == 0
    table.append(rows((1, "a"), (2, "b"), (3, None)))
    table.append(rows((4, "a")))
    table.replace("policy = 'a'", rows((9, "a")))
    assert plain(table.read(), "k") == [(2,), (3,), (9,)]
    assert plain(table.read(2), "k") == [(1,), (2,), (3,), (4,)]
    table.replace("policy = 'a'", rows())
    table.compact()
    assert plain(table.read(), "k") == [(2,), (3,)] and len(table.parts()) == 1 and table.version() == 5
    late = tables.VersionedTable(spark, str(tmp_path / "t"), "k long, policy string")
    with pytest.raises(tables.Conflict):
        late.commit(4, [])
    assert table.version() == 5


def test_a_run_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "k long")
    table.append(spark.range(3).selectExpr("id k"))

    def dies(self, began, parts):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables.VersionedTable, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            table.append(spark.range(5).selectExpr("id k"))
    bad = spark.range(3).selectExpr("raise_error('broken') k")
    with pytest.raises(Exception, match="broken"):
        table.append(bad)
    assert table.version() == 1 and table.read().count() == 3
    assert len(table.clean()) == 2 and table.read().count() == 3 and table.clean() == []


def test_exploit_writer_counts_and_overwrites(spark, tmp_path):
    vulns = spark.createDataFrame([(1, "CVE-1"), (2, "CVE-2"), (3, None)], "vuln_id long, cve_id string")
    rows = [(10, "CVE-1", "2024-01-05", False, 0), (11, "CVE-1", "2024-01-02", True, 1), (12, "CVE-2", None, True, 2), (13, "CVE-9", "2024-01-01", False, 3)]
    exploits = spark.createDataFrame(rows, "exploit_id long, cve_id string, published string, msf boolean, pos long").withColumn("published", F.col("published").cast("date"))
    table = sinks.tables(spark, str(tmp_path))["signal"]
    dry = sinks.write_exploit_signals(table, exploits, vulns, NOW, dry_run=True)
    assert table.version() == 0
    first = sinks.write_exploit_signals(table, exploits, vulns, NOW)
    assert first == dry == {"poc_inserted": 2, "msf_inserted": 2, "cves_matched": 2, "cves_in_edb": 3, "cves_in_db": 2}
    again = sinks.write_exploit_signals(table, exploits, vulns, NOW)
    assert again["poc_inserted"] == again["msf_inserted"] == 0 and again["cves_matched"] == 2 and table.read().count() == 4
    got = {(r.vuln_id, r.signal_type): (str(r.observed_at)[:10], r.value_num, r.value_text, r.evidence_ref) for r in table.read().collect()}
    assert got[1, "poc_exploitdb"] == ("2024-01-02", 2.0, "EDB-IDs: 10,11", "https://www.exploit-db.com/exploits/10")
    assert got[1, "metasploit"][0] == "2024-01-02" and got[2, "poc_exploitdb"][0] == got[2, "metasploit"][0] == "2024-01-20"
    table.append(spark.createDataFrame([(1, "kev", "feed")], "vuln_id long, signal_type string, source string").selectExpr("vuln_id", "signal_type", "cast(null as timestamp_ntz) observed_at", "cast(null as double) value_num", "true value_bool", "cast(null as string) value_text", "source", "cast(null as string) evidence_ref"))
    over = sinks.write_exploit_signals(table, exploits.where("cve_id = 'CVE-2'"), vulns, NOW, overwrite=True)
    assert (over["poc_inserted"], over["msf_inserted"]) == (1, 1)
    assert plain(table.read(), "vuln_id", "signal_type") == [(1, "kev"), (2, "metasploit"), (2, "poc_exploitdb")]
    none = sinks.write_exploit_signals(table, exploits.where("false"), vulns, NOW)
    assert none == {"poc_inserted": 0, "msf_inserted": 0, "cves_matched": 0, "cves_in_edb": 0, "cves_in_db": 2}


def test_label_snapshot_and_inventory_writers(spark, tmp_path):
    all_ = sinks.tables(spark, str(tmp_path))
    sinks.create_tables(spark, str(tmp_path))
    assert all(t.version() == 1 and t.read().count() == 0 for t in all_.values())
    labels = spark.createDataFrame([(i, "a", i % 2, "r") for i in range(6)], "vuln_id long, policy string, label_value int, rationale string")
    assert sinks.write_labels(all_["label"], labels, "a", "2024-01-20", dry_run=True) == {"total": 6, "positive": 3, "negative": 3, "created": 0, "skipped": 0}
    assert sinks.write_labels(all_["label"], labels.where("vuln_id < 4"), "a", "2024-01-20")["created"] == 4
    assert sinks.write_labels(all_["label"], labels, "a", "2024-01-20") == {"total": 2, "positive": 1, "negative": 1, "created": 2, "skipped": 4}
    assert sinks.write_labels(all_["label"], labels.where("vuln_id = 1"), "a", "2024-01-20", overwrite=True)["created"] == 1
    assert plain(all_["label"].read(), "vuln_id", "label_value") == [(1, 1)]
    features = spark.createDataFrame([(1, 0.5, None), (2, None, "x")], "vuln_id long, f double, g string")
    for persisted in (2, 0):
        rows, counts = sinks.write_snapshots(all_["snapshot"], features, "2024-01-20")
        assert rows.count() == 2 and counts == {"total": 2, "persisted": persisted}
    assert [json.loads(r.features) for r in all_["snapshot"].read().orderBy("vuln_id").collect()] == [{"f": 0.5, "g": None}, {"f": None, "g": "x"}]
    vulns = spark.createDataFrame([(1, "CVE-1")], "vuln_id long, cve_id string")
    said = spark.createDataFrame([("CVE-1", "fixed"), ("CVE-2", "fixed")], "cve_id string, status string")
    assert sinks.append_vex(all_["vex"], said, vulns, NOW, "openvex") == {"statements": 2, "appended": 1, "unknown": 1}
    assert [(r.vuln_id, r.asset_id, r.vendor) for r in all_["vex"].read().collect()] == [(1, None, "unknown")]


def test_recorded_pages_push_the_severity(spark, tmp_path):
    for severity, n in (("HIGH", 5), ("LOW", 3)):
        folder = tmp_path / "pages" / f"severity={severity}"
        folder.mkdir(parents=True)
        for start in range(0, n + 2, 2):  # the last page lies beyond totalResults
            page = {"totalResults": n, "startIndex": start, "vulnerabilities": [{"cve": {"id": f"CVE-{severity}-{i}"}} for i in range(start, start + 2)][: max(1, n - start)]}
            (folder / f"page-{start}.json").write_text(json.dumps(page) + "\n\n")
    (tmp_path / "pages" / "severity=LOW" / "page-0.json").write_text("no JSON: only opened without the filter")
    provider = recorded.PageProvider(str(tmp_path / "pages"), ("HIGH",), files_per_partition=1)
    high = provider.pages(spark)
    assert high.rdd.getNumPartitions() == 4  # files of the other severity are no input partitions
    assert plain(high, "place", "total_results") == [(i, 5) for i in range(5)]
    assert plain(provider.fetch(spark).select(provider.dedupe_key().alias("k")), "k") == [(f"CVE-HIGH-{i}",) for i in range(5)]
    with pytest.raises(Exception):
        recorded.PageProvider(str(tmp_path / "pages")).pages(spark).count()
    assert recorded.PageProvider(str(tmp_path / "none")).pages(spark).count() == 0


def test_latest_report(spark, tmp_path):
    schema = "check string, passed boolean, detail string"
    folder = str(tmp_path / "reports")
    assert recorded.latest_report(spark, folder, schema).count() == 0
    os.makedirs(folder)
    assert recorded.latest_report(spark, folder, schema).count() == 0
    for name, at in (("b.json", 100), ("a.json", 200), ("c.json", 200), ("d.json", 50)):
        path = tmp_path / "reports" / name
        path.write_text(json.dumps({"check": name, "passed": True}) + "\n" + json.dumps({"check": "overall", "passed": False}))
        os.utime(path, (at, at))
    assert plain(recorded.latest_report(spark, folder, schema), "check", "report") == [("c.json", "c.json"), ("overall", "c.json")]


def test_cache_is_valid_for_what_it_was_made_from(spark, tmp_path):
    made = []

    def compute(df):
        made.append(1)
        return df.selectExpr("id", "id * 2 twice")

    one = spark.range(10)
    assert tables.cached(one, str(tmp_path), "k", compute)[1] == "miss"
    out, came = tables.cached(one.orderBy(F.desc("id")).repartition(3), str(tmp_path), "k", compute)
    assert came == "hit" and out.count() == 10 and len(made) == 1
    assert tables.cached(spark.range(1, 11), str(tmp_path), "k", compute)[1] == "stale"  # as many rows, others
    assert tables.cached(one, str(tmp_path), "other", compute)[1] == "miss"

    def breaks(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        tables.cached(one, str(tmp_path), "k", breaks)
    assert tables.cached(spark.range(1, 11), str(tmp_path), "k", compute)[1] == "hit"


def test_text_encoding_against_its_definition(spark):
    texts = ["the cat and the dog", "The CAT sat; the mat", "ünï-code 42 cat", None, "  ...", "unseen words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.where("doc_id < 5")
    encoder = models.text_encoder(train, width=1 << 12)
    rows = {r.doc_id: dict(zip(r.indices, r["values"], strict=True)) for r in models.sparse_parts(models.encoded(df, encoder).select("doc_id", "encoding"), "encoding").collect()}
    words = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in enumerate(texts)}
    place = {w: encoder.stages[1].indexOf(w) for c in words.values() for w in c}
    assert len(set(place.values())) == len(place)
    df_of = Counter(w for i in range(5) for w in words[i])
    for i, counts in words.items():
        plain_ = {place[w]: n * math.log(6 / (df_of[w] + 1)) for w, n in counts.items() if df_of[w] >= 2}
        norm = math.sqrt(sum(x * x for x in plain_.values()))
        expected = {k: x / norm for k, x in plain_.items()} if norm else {}
        got = {k: x for k, x in rows[i].items() if x}
        assert got.keys() == {k for k, x in expected.items() if x} and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
        assert not got or abs(sum(x * x for x in got.values()) - 1) < 1e-12


def test_text_head_and_evaluation_of_the_whole(spark):
    rows = [(i, "good fine text" if i % 3 else "bad poor words", int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    data = models.encoded(df, models.text_encoder(df, width=1 << 10))
    out = experiments.evaluate(models.vector_scores(data, models.vector_head(data, "y")), [])
    (r,) = out.collect()
    assert r.roc_auc == 1.0 and r.average_precision == 1.0 and r.f1 == 1.0 and r.n == 60
    assert {x.p for x in models.vector_scores(data, None).collect()} == {0.5}


def test_cross_validation_picks_what_a_plain_loop_picks(spark):
    df = spark.range(240).selectExpr("id doc_id", "(id * 37 % 100) / 100 a", "(id * 61 % 97) / 97 b").withColumn("y", ((F.col("a") + F.col("b") + F.pmod(F.xxhash64("doc_id"), F.lit(50)) / 50) > 1.6).cast("int"))
    found, inputs = models.cross_validated(df, ["a", "b"], folds=3)
    assert len(found.avgMetrics) == 4 and all(0 < m <= 1 for m in found.avgMetrics)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    meta = models.weighted(models.meta_features(df, ["a", "b"]), "y").withColumn("fold", F.pmod(F.xxhash64("doc_id", "y"), F.lit(3)))
    total = 0.0
    for fold in range(3):
        stages = [VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), models.Logistic(featuresCol="x", labelCol="y", weightCol="weight", regParam=1 / 240)]
        model = Pipeline(stages=stages).fit(meta.where(F.col("fold") != fold))
        out = model.transform(meta.where(F.col("fold") == fold)).select("y", vector_to_array("probability")[1].alias("p"))
        total += metrics.ranking_metrics(out, [], "y", "p").first().average_precision
    assert abs(found.avgMetrics[0] - total / 3) < 1e-6
    model, scores = models.stack(df, ["a", "b"], folds=3)
    assert scores.count() == 240 and metrics.ranking_metrics(scores, []).first().roc_auc > 0.7


def test_percentiles_without_a_groups_buffer(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 1, 9, 2)] + [("b", 3.0), ("c", None), (None, 1.0), (None, 2.0)], "g string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    found = metrics.percentiles(df, ["g"], "x", shares)
    expected = {r.g: r.p for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", shares).alias("p")).collect()}
    assert {r.g: r.percentiles for r in found.collect()} == expected
    assert "percentile(" not in found._jdf.queryExecution().toString()


def test_written_pages_are_read_whole_whatever_their_places(spark, tmp_path):
    """Places with gaps, beyond a severity's total, and several pages in one file in any order."""
    rows = spark.range(40).select(F.when(F.col("id") % 4 == 0, "HIGH").otherwise("LOW").alias("severity"), (F.col("id") * 10).alias("place"), F.format_string('{"cve":{"id":"C%d"}}', "id").alias("record"))
    recorded.write_pages(rows.repartition(3), str(tmp_path / "pages"), page_size=70)
    found = recorded.PageProvider(str(tmp_path / "pages")).pages(spark)
    for severity, ids in (("HIGH", range(0, 40, 4)), ("LOW", [i for i in range(40) if i % 4])):
        got = plain(found.where(F.col("severity") == severity).select("place", "total_results", F.get_json_object("record", "$.cve.id").alias("c")), "place", "total_results", "c")
        assert got == [(at, len(ids), f"C{i}") for at, i in enumerate(ids)]
    folder = tmp_path / "mixed" / "severity=LOW"
    folder.mkdir(parents=True)
    pages = [{"totalResults": 1, "startIndex": 1, "vulnerabilities": [{}]}, {"totalResults": 1, "startIndex": 0, "vulnerabilities": [{}]}]
    (folder / "p.txt").write_text("\n".join(map(json.dumps, pages)))
    assert recorded.PageProvider(str(tmp_path / "mixed")).pages(spark).count() == 1
