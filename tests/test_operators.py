"""Exact cases of single operators."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from vigil.functions import core
from vigil.operators import assets, audit, dashboard, experiments, metrics, models, signals, sinks, text
from vigil.sources import feeds
from vigil.streaming import signal_log

FULL = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"


@pytest.mark.parametrize(
    ("vector", "error", "version"),
    [
        (FULL, None, "3.1"), (FULL.replace("3.1", "3.0"), None, "3.0"), (None, "empty", None), ("", "empty", None), ("not-a-cvss-vector", "pattern", None),
        (FULL.replace("AV:N", "AV:X"), "value", None), ("CVSS:3.1/AV:N/AC:L", "missing", None), (FULL + "/AV:N", "duplicate", None),
        (FULL + "/E", "component", None), (FULL + "/E:P", None, "3.1"), (FULL.replace("C:H", "C:h"), "value", None),
    ],
)
def test_cvss(spark, vector, error, version):
    df = spark.createDataFrame([(vector,)], "v string")
    r = df.select(*[c.alias(k) for k, c in core.cvss_parts(F.col("v")).items()]).first()
    assert (r.error, r.version, r.valid) == (error, version, error is None)
    assert [r[m] for m in core.METRICS] == ([3, 1, 2, 1, 0, 2, 2, 2] if error is None else [-1] * 8)


def test_decision_tree_is_total(spark):
    axes = (
        ("affected", "not_affected", "under_investigation", "unknown"), ("reachable", "unreachable", "partially_reachable", "unknown"), ("active", "poc_public", "theoretical", "none"),
        ("fully_mitigated", "partially_mitigated", "no_controls", "unknown"), ("critical", "high", "medium", "low"), ((9.8, 0.6), (5.0, 0.1), (0.0, 0.0)),
    )
    rows = [(*x[:5], *x[5]) for x in itertools.product(*axes)]
    df = spark.createDataFrame(rows, "affectedness string, reachability string, exploitation string, control_status string, criticality string, cvss double, epss double")
    out = assets.decide_pairs(df.withColumn("control_effectiveness", F.lit(0.5))).collect()
    assert len(out) == len(rows) and all(r.action in core.ACTIONS and r.rationale for r in out)
    for r in out:
        vital = r.criticality in ("critical", "high")
        if r.affectedness == "not_affected":
            assert (r.action, r.confidence) == ("accept", 0.95)
        elif r.exploitation == "active":
            full = r.control_status == "fully_mitigated"
            assert r.action == ("patch_window" if full else "patch_now") if vital else ("monitor" if full else "mitigate_now")
        elif r.exploitation == "poc_public" and r.cvss == 9.8 and vital:
            assert r.action == ("patch_now" if r.reachability == "reachable" else "mitigate_now")


def test_perfect_ranking_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.8), ("a", 0, 0.2), ("b", 1, 0.5), ("b", 0, 0.5), ("c", 0, 0.1)], "g string, y int, p double")
    r = {x.g: x for x in metrics.ranking_metrics(df, ["g"]).collect()}
    assert (r["a"].average_precision, r["a"].roc_auc) == (1.0, 1.0)
    assert (r["b"].average_precision, r["b"].roc_auc) == (0.5, 0.5)
    assert r["c"].roc_auc is None


def test_split_and_leakage(spark):
    df = spark.sql("select cast(d as timestamp_ntz) published_at, i vuln_id from values ('2024-01-01', 1), ('2024-06-01', 2), (null, 3) t(d, i)")
    train, test = audit.time_split(df, "2024-01-01")
    assert (train.count(), test.count()) == (1, 1)
    for cutoff in ("2020-01-01", "2030-01-01"):
        with pytest.raises(ValueError, match="empty"):
            audit.time_split(df, cutoff)
    assert audit.temporal_leakage(df, "2024-05-31").first().future == 1
    assert audit.temporal_leakage(df.drop("published_at"), "2024-05-31").first().passed
    assert audit.entity_leakage(train, test).first().passed and not audit.entity_leakage(df, test).first().passed
    assert audit.label_leakage(["kev_flag", "epss_score"], "kev_strict") == {"kev_flag"} and audit.label_leakage(["kev_flag"], "none") == set()
    assert audit.ablate(spark.range(1).selectExpr("id vuln_id", "1.0 kev_flag", "2.0 cvss_base_score"), "no_circular").columns == ["vuln_id", "cvss_base_score"]
    assert sum(len(g) for g in audit.FEATURE_GROUPS.values()) == 52
    with pytest.raises(KeyError):
        signals.excluded_features("nothing")


def test_asof_modes(spark):
    df = spark.sql("select timestamp_ntz'2024-01-20 10:00:00' observed_at")
    assert [signals.asof_filter(df, "2024-01-20", m).count() for m in ("date", "end_of_day", "midnight")] == [1, 1, 0]
    with pytest.raises(ValueError, match="mode"):
        signals.asof_filter(df, "2024-01-20", "noon")


def test_feeds(spark, tmp_path):
    record = {"id": 5, "cve": "CVE-1", "name": "T", "summary": "S", "publish_date": "2024-02-03T04:05:06Z", "cvss3": {"vectorString": FULL, "baseScore": "9.8"}, "ext_references": [{"url": "u"}], "signals": {"kev_flag": True}}
    (tmp_path / "r.json").write_text(json.dumps([record, {"vuldb_id": "7", "date_published": "soon"}]))
    a, b = feeds.normalise_records(feeds.read_json(spark, str(tmp_path / "r.json"), feeds.RECORD)).orderBy("vuldb_id").collect()
    assert (a.cve_id, a.title, a.description, str(a.published_at), a.cvss_version, a.cvss_base_score, a.kev_flag, a.poc_exploitdb) == ("CVE-1", "T", "S", "2024-02-03 04:05:06", "3.1", 9.8, True, False)
    assert a.references[0].source == "unknown" and (b.published_at, b.description, b.cwe_ids) == (None, "", [])
    cve = {
        "id": "CVE-2", "vulnStatus": "Analyzed", "published": "2024-01-01T00:00:00.000", "descriptions": [{"lang": "fr", "value": "F"}, {"lang": "en", "value": "First. Second"}],
        "metrics": {"cvssMetricV30": [{"type": "Secondary", "cvssData": {"vectorString": "x", "baseScore": 1}}, {"type": "Primary", "cvssData": {"vectorString": FULL, "baseScore": 9.8}}]},
        "weaknesses": [{"description": [{"lang": "en", "value": "CWE-89"}, {"lang": "en", "value": "CWE-79"}, {"lang": "fr", "value": "CWE-1"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:ac_me:web_app:*:*"}, {"vulnerable": False, "criteria": "cpe:2.3:a:x:y:1:*"}]}]}],
    }
    (tmp_path / "n.json").write_text(json.dumps({"totalResults": 2, "vulnerabilities": [{"cve": cve}, {"cve": {"id": "CVE-3", "vulnStatus": "Rejected"}}]}))
    (n,) = feeds.normalise_nvd(feeds.read_json(spark, str(tmp_path / "n.json"), feeds.NVD)).collect()
    assert (n.title, n.description, n.cvss_version, n.cvss_base_score, n.cwe_ids) == ("Ac Me Web App Cross-Site Scripting (XSS) Vulnerability", "First. Second", "3.0", 9.8, ["CWE-79", "CWE-89"])
    assert [tuple(p) for p in n.products] == [("ac me", "web app", "all")]
    assert feeds.date_chunks(spark, "2024-01-01", "2024-01-01").count() == 0
    csaf = spark.createDataFrame([([("CVE-4", {"known_not_affected": ["p", "q"], "odd": ["r"]})],)], "vulnerabilities array<struct<cve string, product_status map<string, array<string>>>>")
    assert sorted(tuple(r) for r in feeds.csaf_statements(csaf).collect()) == [("CVE-4", "p", "not_affected"), ("CVE-4", "q", "not_affected"), ("CVE-4", "r", "under_investigation")]


def test_text(spark):
    df = spark.createDataFrame([("vulnerability in Acme Server before 2.4.1; fixed in 2.5.0, remote code execution",), ("not affected",), (" ",), (None,)], "description string")
    a, b, c, d = text.extract_evidence(df).collect()
    assert (a.status, a.products, a.version_end, a.fixed_version, a.exploit_type, a.network) == ("affected", "Acme Server", "2.4.1", "2.5.0", "rce", True)
    assert (b.status, b.status_confidence, c.status_confidence, d.exploit_confidence) == ("not_affected", 0.6, 0.5, 0.5)
    brief = [(1, "d", 0.5, [("T1", "r" * 20, ["e"])]), (2, "", None, [("T9", "short", [" "]), ("T1", "r" * 20, [])]), (3, "import socket", 0.1, [])]
    briefs = spark.createDataFrame(brief, "brief_id long, description string, p_final double, attck array<struct<technique_id string, rationale string, evidence array<string>>>")
    out = {r.brief_id: r for r in text.verify_briefs(briefs, spark.createDataFrame([("T1",)], "technique_id string")).collect()}
    assert out[1].valid and out[2].errors == "blank_evidence,no_description,no_evidence,no_probability,short_rationale,technique" and out[3].errors == "unsafe"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "CVE-1", "a", "x"), (2, "CVE-1", "b", "y"), (3, None, "a", "x"), (4, "", "a", "x"), (5, "CVE-5", "a", "z")], "pos long, cve_id string, source string, vuldb_id string")
    held = rows.where("pos = 5").withColumn("source", F.lit("other"))
    assert [r.pos for r in sinks.insert_if_absent(held, rows, "pos").orderBy("pos").collect()] == [1, 3]
    path = str(tmp_path / "t")
    sinks.write_partitioned(rows, path, "source")
    sinks.write_partitioned(rows.where("pos = 1"), path, "source", overwrite=True)
    assert sorted(r.pos for r in spark.read.parquet(path).collect()) == [1, 2]
    decided = sinks.append_decisions(spark.createDataFrame([(24,)], "sla_hours int"), "2024-01-01 00:00:00").first()
    assert str(decided.sla_deadline) == "2024-01-02 00:00:00"
    assert dashboard.page_count(41, 20) == 3
    with pytest.raises(ValueError, match="per_page"):
        dashboard.listing(rows, rows, per_page=0)


def test_models(spark):
    rows = [(i, float(i % 10), int(i % 10 > 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, x1 double, y int")
    model = models.train_trees(df, ["x1", "absent"], "y", rounds=3, depth=2)
    out = models.scored(model, df, ["x1", "absent"])
    assert metrics.ranking_metrics(out.withColumn("g", F.lit(1)), ["g"]).first().roc_auc == 1.0
    assert models.importances(model, ["x1", "absent"])[0][0] == "x1"
    iso = models.calibrated(out.select("doc_id", "y", "p"), method="isotonic").collect()
    assert all(0 <= r.calibrated <= 1 for r in iso)


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.sql("select 1L vuln_id, 'kev' signal_type, timestamp'2024-01-01 10:00:00' observed_at, true value_bool union all select 1L, 'kev', timestamp'2024-01-01 10:00:00', true")
    rows.write.parquet(str(tmp_path / "log"))
    log = signal_log.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")))
    run = log.writeStream.format("memory").queryName("unique_signals").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("unique_signals").count() == 1


def test_items_to_score_takes_every_named_asset(spark, tmp_path):
    """A component of any asset counts under its name, whatever the asset's id; a CPE alone does not."""
    vulns = spark.createDataFrame([(1, "CVE-1"), (2, "CVE-2"), (3, "CVE-3")], "vuln_id long, cve_id string")
    products = spark.createDataFrame([(i, f"v{i}", "p") for i in (1, 2, 3)], "vuln_id long, v string, p string")
    sbom = spark.createDataFrame([(7, "v1", "p", "x"), (8, "v2", "p", "x"), (7, "xv3", "p", "cpe:2.3:a:v3:p:1.0")], "asset_id long, vendor string, product string, cpe string").withColumn("confidence", F.lit(1.0))
    assert [r.vuln_id for r in experiments.items_to_score(vulns, products, assets.software_keys(sbom)).orderBy("vuln_id").collect()] == [1, 2]
    from vigil.plans.queries import REGISTRY

    for name, rows in {"part": [(1, "n", "Brand#1", "TIN", 5), (2, "n", "Brand#2", "TIN", 5)], "lineitem": [(8, 2, 1, 0.0, "1995-01-01")]}.items():
        kinds = {"part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int", "lineitem": "l_suppkey long, l_partkey long, l_linenumber int, l_discount double, l_shipdate string"}
        spark.createDataFrame(rows, kinds[name]).withColumns({"l_shipdate": F.to_timestamp_ntz("l_shipdate")} if name == "lineitem" else {}).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [r.vuln_id for r in REGISTRY["j09_items_to_score"][0](spark, str(tmp_path)).collect()] == [2]


def test_risk_is_summed_term_by_term(spark):
    """At a threshold the last bit of the sum decides: 0.3 in this order, just below it in any other."""
    kinds = "affectedness string, reachability string, exploitation string, control_status string, criticality string, cvss double, epss double, control_effectiveness double"
    rows = [("affected", "partially_reachable", "theoretical", "partially_mitigated", "low", c, e, 0.8) for c, e in ((1.2, 0.88), (1.4, 0.86), (4.6, 0.54), (5.0, 0.5))]
    assert {(r.action, r.confidence) for r in assets.decide_pairs(spark.createDataFrame(rows, kinds)).collect()} == {("monitor", 0.6)}


def test_product_matches_shuffle_no_pairs(spark):
    """Items of one product set share its matches: 300 x 300 pairs are made, and no shuffle holds more than the rows they come from."""
    products = spark.range(300).select(F.col("id").alias("vuln_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("p")).withColumn("v", F.lit("v"))
    products = products.unionByName(spark.createDataFrame([(900, "v", "a"), (901, "v", "none")], "vuln_id long, v string, p string"))
    software = spark.range(300).select(F.col("id").alias("asset_id"), F.lit("v").alias("v"), F.when(F.col("id") < 150, "a").otherwise("b").alias("p"), F.when(F.col("id") != 7, F.col("id") / 1000).alias("confidence"))
    software = software.unionByName(spark.createDataFrame([(8, "v", "b", 0.5)], "asset_id long, v string, p string, confidence double"))
    got = {(r.asset_id, r.vuln_id): r.best for r in experiments.product_matches(products, software).collect()}
    best = lambda a: 0.8 if a == 7 else 0.5 if a == 8 else a / 1000
    want = {(a, i): best(a) for a in range(300) for i in range(300)} | {(a, 900): 0.008 if a == 8 else best(a) for a in range(150)}
    assert got == want
    plan = experiments.product_matches(products, software)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = next(line for line in plan if "Join" in line or "Aggregate" in line)
    assert "Join" in first  # the join that makes the pairs is last, no grouping follows


def test_nearest_vectors_of_odd_and_equal_rows(spark):
    """Ties, copies, zeros, nulls, lengths and infinities rank as plain cosines of all pairs do, in any cut into groups."""
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [1e200, 1.0, 0.0], [float("inf"), 1.0, 0.0], [-1.0, -2.0, -3.0]]
    rows = [(i, odd[i // 5] if i % 5 == 0 and i // 5 < len(odd) else [float(i % 4 + 1), float(i % 3), 0.1 * (i % 2)]) for i in range(60)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.where("vec_id % 2 = 0 or vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = e.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", core.cosine(F.col("embedding"), F.col("q")).alias("s"))
    ranked = pairs.selectExpr("query_id", "row_number() over (partition by query_id order by s desc, vec_id) rank", "vec_id", "round(s, 4) score").where("rank <= 5")
    shown = lambda df: sorted((r.query_id, r["rank"], r.vec_id, str(r.score)) for r in df.collect())
    assert shown(text.nearest_vectors(e, q, 5)) == shown(ranked) == shown(text.nearest_vectors(e, q, 5, shard_rows=7, block_queries=9))
    assert "FlatMapCoGroupsInPandas" in text.nearest_vectors(e, q, 5)._jdf.queryExecution().toString()
