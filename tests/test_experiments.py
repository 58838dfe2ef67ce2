"""Operators that tie others together, and the feed parsers on single documents."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import assets, experiments, metrics, models, sinks, signals
from vigil.plans.queries import REGISTRY
from vigil.sources import feeds


def test_policy_configuration():
    merged = experiments.merged_policy({"thresholds": {"cvss_high": 8.0}, "policy": {"name": "strict"}, "more": 1})
    assert merged["thresholds"] == experiments.DEFAULT_POLICY["thresholds"] | {"cvss_high": 8.0}
    assert merged["policy"] == {"name": "strict", "version": "1.0"} and merged["more"] == 1
    for odd in (None, [], "x"):
        assert experiments.merged_policy(odd) == experiments.DEFAULT_POLICY
    assert experiments.policy_description({"sla_hours": {"monitor": 1}})["actions"]["monitor"] == 1


def test_audit_report(spark):
    rows = [(i, f"2024-0{1 + i % 6}-01 00:00:00", float(i), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "vuln_id long, published_at string, epss_score double, kev_flag double").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    labels = df.select("vuln_id", F.col("kev_flag").cast("int").alias("exploited"))
    out = {r.check: r for r in experiments.audit_report(df, labels, "2024-05-31", "kev_strict", df.where("vuln_id < 25"), df.where("vuln_id > 20")).collect()}
    assert not out["temporal"].passed and out["temporal"].detail == "6 of 40"
    assert out["label"].detail == "kev_flag" and out["entity"].detail == "4 of 19"
    assert not out["correlation"].passed and out["correlation"].detail == "kev_flag" and not out["overall"].passed
    clean = experiments.audit_report(df.drop("kev_flag"), labels, "2025-01-01", "kev_strict").where("check = 'overall'").first()
    assert clean.passed
    assert experiments.label_leakage_report(["has_waf"], "control_gap")["leaked"] == ["has_waf"]
    assert experiments.label_leakage_report(["has_waf"], "none") == {"leaked": [], "passed": True, "note": "unknown policy none"}
    assert experiments.label_column(["a", "exploited", "y"]) == "exploited" and experiments.label_column([]) is None


def test_labels_fan_out_only_without_a_policy(spark):
    features = spark.range(3).selectExpr("id vuln_id")
    labels = features.crossJoin(spark.createDataFrame([("a",), ("b",)], "policy string")).withColumn("label_value", F.lit(1))
    assert experiments.training_frame(features, labels, "a").count() == 3
    assert features.join(experiments.label_frame(labels, None), "vuln_id").count() == 6
    assert sinks.label_rows(labels, labels.where("policy = 'a'").withColumn("label_value", F.lit(0)), overwrite=True).where("label_value = 0").count() == 3


def test_products_by_name_and_cpe(spark):
    schema = "vuln_id long, products array<struct<vendor:string,product:string>>"
    v = spark.createDataFrame([(1, [("Apache", "HTTP_Server"), ("", "x")]), (3, [("a", None)]), (4, None)], schema)
    named = assets.product_keys(v, F.col("products"))
    assert [tuple(r) for r in named.collect()] == [(1, "apache", "http_server")]
    texts = spark.createDataFrame([(2, ["cpe:2.3:a:apache:http_server:2.4.49:*", "cpe:x", "no name"]), (5, [])], "vuln_id long, products array<string>")
    coded = assets.product_keys(texts, F.col("products"))
    assert [tuple(r) for r in coded.collect()] == [(2, "apache", "http_server")]
    rows = [(7, "Apache", "http_server", None, None), (8, "other", "x", "cpe:2.3:a:apache:http_server:2", 0.4), (9, "apache", "http_server", "cpe:2.3:a:apache:http_server:2", 0.3), (6, "apache", "http server", None, 0.9)]
    sbom = spark.createDataFrame(rows, "asset_id long, vendor string, product string, cpe string, confidence double")
    software = assets.software_keys(sbom)
    assert software.where("asset_id = 9").count() == 1
    hits = experiments.product_matches(named.unionByName(coded), software).collect()
    assert sorted(tuple(r) for r in hits) == [(a, i, c) for a, c in ((7, 0.8), (8, 0.4), (9, 0.3)) for i in (1, 2)]
    pairs = spark.createDataFrame([(a, i) for a in (6, 7, 8, 9) for i in (1, 2)], "asset_id long, vuln_id long")
    assert sorted(tuple(r) for r in assets.software_matches(pairs, v, sbom).collect()) == [(7, 1, 1, None), (8, 1, 1, 0.4), (9, 1, 1, 0.3)]
    assert {r.asset_id for r in assets.software_matches(pairs, texts, sbom).collect()} == {7, 8, 9}
    assert [r.vuln_id for r in experiments.items_to_score(v, named, software).collect()] == [1]
    only_coded = assets.software_keys(sbom.where("asset_id = 8"))
    assert experiments.items_to_score(v, named, only_coded).count() == 3  # a CPE is no match here: all are scored
    assert experiments.items_to_score(v.withColumn("cve_id", F.lit("C")), named, software, []).count() == 1


def test_entity_keys_and_audit_of_pairs(spark):
    assert experiments.entity_key(["a", "cve_id"]) == ["cve_id"] and experiments.entity_key(["vuln_id", "asset_id", "cve_id"]) == ["asset_id", "vuln_id"]
    with pytest.raises(KeyError):
        experiments.entity_key(["a"])
    rows = [(i % 4, i, f"2024-0{1 + i % 3}-01 00:00:00", float(i), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "asset_id long, vuln_id long, published_at string, has_waf double, y int").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    features = df.drop("y").withColumn("copy", F.col("vuln_id") % 2 + 0.0)
    out = {r.check: r for r in experiments.audit_experiment(features, df.select("asset_id", "vuln_id", "y"), df.where("vuln_id < 20"), df.where("vuln_id > 16"), "2024-02-15", "control_gap").collect()}
    assert (out["temporal"].detail, out["temporal"].violators) == ("13 of 40", "0_8,0_20,0_32,1_5,1_17")
    assert out["label"].detail == "has_waf" and (out["entity"].detail, out["entity"].violators) == ("3 of 23", "1_17,2_18,3_19")
    assert out["correlation"].detail == "copy" and not out["overall"].passed
    clean = experiments.audit_experiment(features.drop("has_waf"), df.select("asset_id", "vuln_id", "y"), df.where("vuln_id < 9"), df.where("vuln_id > 16"), "2025-01-01", "control_gap")
    assert {r.check: r.passed for r in clean.collect()} == {"temporal": True, "label": True, "entity": True, "correlation": False, "overall": True}


def test_feed_parsers(spark, tmp_path):
    def read(doc, schema):
        path = tmp_path / "doc.json"
        path.write_text(json.dumps(doc))
        return feeds.read_json(spark, str(path), schema)

    kev = feeds.kev_signals(read({"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02"}]}, "vulnerabilities array<struct<cveID:string,dateAdded:string>>")).first()
    assert (kev.cve_id, str(kev.observed_at), kev.value_bool) == ("CVE-1", "2024-01-02 00:00:00", True)
    epss = feeds.epss_signals(read({"data": [{"cve": "CVE-1", "epss": "0.5", "percentile": "0.9"}, {"cve": "CVE-2", "epss": "x", "percentile": None}]}, "data array<struct<cve:string,epss:string,percentile:string>>"), "2024-01-20").collect()
    assert [(r.cve_id, r.value_num, r.value_text) for r in epss] == [("CVE-1", 0.5, "0.9"), ("CVE-2", None, None)]
    pattern = lambda i, n, **more: {"type": "attack-pattern", "name": n, "external_references": [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": i}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "initial-access"}, {"kill_chain_name": "k", "phase_name": "z"}], **more}
    objects = [pattern("T1", "old"), pattern("T2", "gone", revoked=True), pattern("T1", "new"), {"type": "malware", "name": "m"}]
    stix = "objects array<struct<type:string,name:string,description:string,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,x_mitre_deprecated:boolean,revoked:boolean>>"
    (t,) = feeds.attack_patterns(read({"objects": objects}, stix)).collect()
    assert (t.technique_id, t.name, t.tactics) == ("T1", "new", ["initial-access"])
    cyclone = "components array<struct<group:string,publisher:string,name:string,version:string,purl:string,properties:array<struct<name:string,value:string>>>>"
    c = feeds.cyclonedx_components(read({"components": [{"publisher": "P", "name": "n", "version": "1", "properties": [{"name": "cpe23", "value": "cpe:x"}]}, {"name": "m"}]}, cyclone)).collect()
    assert [tuple(x) for x in c] == [("P", "n", "1", None, "cpe:x"), ("unknown", "m", None, None, None)]
    spdx = "packages array<struct<supplier:string,originator:string,name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>"
    (p,) = feeds.spdx_packages(read({"packages": [{"originator": "O", "name": "n", "externalRefs": [{"referenceType": "purl", "referenceLocator": "a"}, {"referenceType": "purl", "referenceLocator": "b"}]}]}, spdx)).collect()
    assert (p.vendor, p.purl, p.cpe) == ("O", "b", None)
    tail = "status:string,justification:string>>"
    plain = feeds.openvex_statements(read({"statements": [{"vulnerability": "CVE-1", "products": ["p", "q"], "status": "fixed"}]}, "statements array<struct<vulnerability:string,products:array<string>," + tail)).collect()
    full = feeds.openvex_statements(read({"statements": [{"vulnerability": {"name": "CVE-1"}, "products": [{"@id": "p"}], "status": "fixed"}]}, "statements array<struct<vulnerability:struct<name:string>,products:array<struct<`@id`:string>>," + tail)).collect()
    assert [(r.cve_id, r.product) for r in plain] == [("CVE-1", "p"), ("CVE-1", "q")] and [(r.cve_id, r.product, r.vendor) for r in full] == [("CVE-1", "p", "unknown")]


def test_components_sinks_and_tables(spark, tmp_path):
    assets = spark.range(5).selectExpr("id asset_id")
    parts = [(f"v{i}", f"p{i}", "1") for i in range(20)]
    one, two = (sorted(map(tuple, experiments.synthetic_components(spark, assets, parts, 6).collect())) for _ in range(2))
    assert one == two and len(one) == 30 and len(set(one)) == 30
    sinks.write_csv(assets, f"{tmp_path}/csv")
    sinks.write_json(assets, f"{tmp_path}/json")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == spark.read.json(f"{tmp_path}/json").count() == 5


def test_models_blends_and_text_head(spark, tmp_path):
    rows = [(i, float(i % 10), int(i % 10 > 6), [float(i % 10), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, x1 double, y int, embedding array<double>")
    model = models.train_trees(df, ["x1"], "y", rounds=2, depth=2)
    experiments.save(model, str(tmp_path / "m"))
    again = experiments.load(str(tmp_path / "m"))
    assert experiments.score_one(spark, again, ["x1"], {"x1": 9.0}) > 0.5 > experiments.score_one(spark, model, ["x1"], {})
    head = models.text_head(df, "y")
    assert metrics.ranking_metrics(models.text_scores(df, head), []).first().roc_auc == 1.0
    assert {r.p for r in models.text_scores(df, None).collect()} == {0.5}
    scores = spark.createDataFrame([(1, 0.2, 0.4), (2, None, 0.4), (3, None, None)], "doc_id long, a double, b double")
    assert [round(r.p, 9) for r in experiments.blend(scores, ["a", "b"]).orderBy("doc_id").collect()] == [0.3, 0.4, 0.5]


def test_running_sums_do_not_depend_on_the_cuts(spark):
    df = spark.range(500).selectExpr("id % 3 g", "(id * 37 % 500) / 7 p", "id n")
    for parts in (2, 7, 64):
        out = metrics.running(df, ["g"], "p", {"n": "upto"}, parts).collect()
        for r in out[::41]:
            assert r.upto == sum(x.n for x in out if x.g == r.g and x.p >= r.p) and r.total_upto == sum(x.n for x in out if x.g == r.g)
    assert len(out) == 500


def test_single_class_groups_have_their_accuracy_only(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.2)], "g string, y int, p double")
    r = {x.g: x for x in metrics.slice_report(df, ["g"]).collect()}
    assert r["a"].roc_auc == 1.0 and r["b"].accuracy == 1.0 and r["b"].f1 is None and r["b"].average_precision is None


def test_all_features_are_there(spark):
    f = signals.vulnerability_features(*(REGISTRY and [__import__("vigil.sources.bindings", fromlist=["view"]).view(spark, "/root/testdata/sf0.001", n) for n in ("b_vuln", "b_signal")]), "2024-01-20")
    assert len(f.columns) == 40
