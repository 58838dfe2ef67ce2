"""Experiments as a whole: label frames, audits in one report, policies and their configuration, blends, briefs' leftovers."""

from __future__ import annotations

import copy
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import core
from vigil.operators import audit, models
from vigil.operators.metrics import ranking_metrics, threshold_metrics
from vigil.operators.tables import counted, durable

#: Features that an asset label may not be predicted from.
ASSET_EXCLUDED: dict[str, frozenset[str]] = {
    "affected": frozenset({"affected_product_confirmed", "vex_status_enum", "sbom_match_confidence"}),
    "reachable": frozenset({"network_reachable_flag", "code_path_reachable"}),
    "control_gap": frozenset({"has_waf", "has_edr", "has_ips", "has_network_segmentation", "control_coverage_score"}),
    "action_required": frozenset({"kev_flag", "poc_exploitdb_flag", "metasploit_flag", "exploit_signal_count"}),
}
#: Names under which a label column is looked for, in this order.
LABEL_NAMES = ("label_value", "label", "exploited", "y", "target")
#: Documented defaults of a policy file.
DEFAULT_POLICY = {
    "thresholds": {"cvss_high": 9.0, "epss_high": 0.5, "ml_high": 0.7, "control_full": 0.9, "control_partial": 0.3, "risk_high": 0.7, "risk_moderate": 0.3},
    "sla_hours": dict(core.SLA_HOURS),
    "policy": {"name": "default", "version": "1.0"},
}


def label_frame(labels: DataFrame, policy: str | None) -> DataFrame:
    """vuln_id, label_value of one policy; without a policy the rows of all, which multiply in a join."""
    rows = labels if policy is None else labels.where(F.col("policy") == policy)
    return rows.select("vuln_id", "label_value", *([] if policy else ["policy"]))


def training_frame(features: DataFrame, labels: DataFrame, policy: str) -> DataFrame:
    """Features with the labels of one policy, inner by item: a row for each item that has both."""
    return features.join(label_frame(labels, policy), "vuln_id")


def label_column(columns: list[str]) -> str | None:
    return next((c for c in LABEL_NAMES if c in columns), None)


def label_leakage_report(columns: list[str], policy: str) -> dict:
    """Leaked features of a CVE policy or an asset label; an unknown name passes with a note."""
    if policy in ASSET_EXCLUDED:
        leaked = set(columns) & ASSET_EXCLUDED[policy]
    elif policy in audit.POLICIES:
        leaked = audit.label_leakage(columns, policy)
    else:
        return {"leaked": [], "passed": True, "note": f"unknown policy {policy}"}
    return {"leaked": sorted(leaked), "passed": not leaked, "note": ""}


def violators(df: DataFrame, asof: str, n: int = 5, column: str = "published_at") -> DataFrame:
    """The first n rows published after the as-of date, by date and item."""
    return df.where(F.col(column) > F.lit(f"{asof} 00:00:00").cast("timestamp_ntz")).orderBy(column, "vuln_id").limit(n)


def overlaps(train: DataFrame, test: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first n entities of both sides; an entity of several keys is named by all of them."""
    named = lambda df: df.select(F.concat_ws("_", *[F.col(k).cast("string") for k in keys]).alias("entity")).distinct()
    return named(train).join(named(test), "entity", "left_semi").orderBy("entity").limit(n)


def audit_report(features: DataFrame, labels: DataFrame | None, asof: str, policy: str, train: DataFrame | None = None, test: DataFrame | None = None, key: str = "vuln_id") -> DataFrame:
    """check, passed, detail: temporal, label and entity leakage and suspicious correlations; the last never fails the whole."""
    spark, rows = features.sparkSession, []
    t = audit.temporal_leakage(features, asof).first()
    rows.append(("temporal", bool(t.passed), f"{t.future} of {t.n}"))
    found = label_leakage_report(features.columns, policy)
    rows.append(("label", found["passed"], ",".join(found["leaked"]) or found["note"]))
    if train is not None and test is not None:
        e = audit.entity_leakage(train, test, key).first()
        rows.append(("entity", bool(e.passed), f"{e.overlap} of {e.test_ids}"))
    if labels is not None and (y := label_column(labels.columns)):
        names = [c for c, kind in features.dtypes if kind in ("double", "float", "int", "bigint") and c not in audit.META]
        both = features.join(labels.select(key, F.col(y).alias("__y")), key)
        high = sorted(r.feature for r in audit.correlations(both, names, "__y").where("suspicious").collect())  # a row for each feature
        rows.append(("correlation", not high, ",".join(high)))
    rows.append(("overall", all(ok for check, ok, _ in rows if check != "correlation"), policy))
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")


def entity_key(columns: list[str]) -> list[str]:
    """What tells entities apart: asset and item together, else the item, else its CVE id."""
    for key in (["asset_id", "vuln_id"], ["vuln_id"], ["cve_id"]):
        if set(key) <= set(columns):
            return key
    raise KeyError("neither vuln_id nor cve_id is a column")


def audit_experiment(features: DataFrame, labels: DataFrame, train: DataFrame, test: DataFrame, asof: str, policy: str) -> DataFrame:
    """check, passed, detail, violators: all four audits of an experiment; a suspicious correlation alone does not fail it.

    Labels meet features by ``entity_key``; temporal counters are observed in the pass that
    takes all correlations.  Violators are the first of a bounded sort: five late rows (by
    date, then entity), ten shared entities.
    """
    spark, key, late = features.sparkSession, entity_key(features.columns), F.col("published_at") > F.lit(f"{asof} 00:00:00").cast("timestamp_ntz")
    y = label_column(labels.columns)
    names = [c for c, kind in features.dtypes if kind in ("double", "float", "int", "bigint") and c not in (*audit.META, *key)]
    seen_rows, seen = counted(features, n=F.count("*"), future=F.count_if(late))
    met = seen_rows.join(labels.select(*key, F.col(y).alias("__y")), key)
    high = sorted(r.feature for r in audit.correlations(met, names, "__y").where("suspicious").collect())  # a row for each feature
    n, future = seen.values().values()
    entity = lambda df: df.withColumn("entity", F.concat_ws("_", *[F.col(k).cast("string") for k in key]))
    first = [r.entity for r in entity(features.where(late)).orderBy("published_at", *key).limit(5).collect()]
    found = label_leakage_report(features.columns, policy)
    shared = audit.entity_leakage(entity(train), entity(test), "entity").first()
    some = [r.entity for r in overlaps(train, test, key).collect()]
    rows = [
        ("temporal", future == 0, f"{future} of {n}", first),
        ("label", found["passed"], ",".join(found["leaked"]) or found["note"], []),
        ("entity", bool(shared.passed), f"{shared.overlap} of {shared.test_ids}", some),
        ("correlation", not high, ",".join(high), []),
    ]
    rows.append(("overall", all(ok for check, ok, *_ in rows if check != "correlation"), policy, []))
    return spark.createDataFrame([(*r[:3], ",".join(r[3])) for r in rows], "check string, passed boolean, detail string, violators string")


def write_report(report: DataFrame, folder: str) -> None:
    """Add a report to a folder of reports, as one small JSON file (a row for each check)."""
    report.coalesce(1).write.mode("append").json(folder)


def merged_policy(given: Mapping | None) -> dict:
    """The default policy with the given sections laid over it, key by key; what is no mapping of sections changes nothing."""
    out = copy.deepcopy(DEFAULT_POLICY)
    for section, values in (given if isinstance(given, Mapping) else {}).items():
        if isinstance(values, Mapping):
            out.setdefault(section, {}).update(values)
        else:
            out[section] = values
    return out


def policy_description(policy: Mapping | None = None) -> dict:
    """Name, version, thresholds, actions with their hours, and the order of the gates."""
    p = merged_policy(policy)
    gates = ("not affected", "actively exploited", "public exploit", "risk score")
    return {**p["policy"], "thresholds": p["thresholds"], "actions": {a: p["sla_hours"][a] for a in core.ACTIONS}, "gates": list(gates)}


def techniques(patterns: DataFrame) -> DataFrame:
    """A row per technique id: of repeated ids the last in order (column pos) wins."""
    rest = [c for c in patterns.columns if c not in ("technique_id", "pos")]
    return patterns.groupBy("technique_id").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("technique_id", "r.*")


def synthetic_components(spark: SparkSession, assets: DataFrame, components: list[tuple[str, str, str]], most: int, seed: int = 42) -> DataFrame:
    """asset_id, vendor, product, version: up to ``most`` of the given components for each asset, chosen by a seeded hash."""
    listed = spark.createDataFrame(components, "vendor string, product string, version string")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, listed.columns, strict=True)]) for c in components])
    shuffled = F.array_sort(F.transform(rows, lambda c: F.struct(F.xxhash64(F.col("asset_id"), c["vendor"], c["product"], F.lit(seed)).alias("h"), c.alias("c"))))
    return assets.select("asset_id", F.explode(F.slice(shuffled, 1, most)).alias("s")).select("asset_id", "s.c.*")


def items_to_score(vulns: DataFrame, products: DataFrame, software: DataFrame, cve_ids: list[str] | None = None) -> DataFrame:
    """Items worth scoring: the named ones, else those whose product some asset runs by its name (a CPE does not count here), else (if none does) all."""
    if cve_ids:
        return vulns.where(F.col("cve_id").isin(*cve_ids))
    hit = products.join(software.where("by = 'name'").select("v", "p").distinct(), ["v", "p"]).select("vuln_id").distinct()
    matched = vulns.join(hit, "vuln_id", "left_semi")
    return vulns if matched.isEmpty() else matched


#: Tasks of a core that make pairs, and slices that a set's pairs are dealt in.
TASKS_A_CORE, SLICES = 16, 8


def product_matches(products: DataFrame, software: DataFrame) -> DataFrame:
    """asset_id, vuln_id, best: pairs that share a name by either key, with the largest confidence (0.8 where none is known).

    Items with the same set of products have the same matches: software is matched and grouped
    once a set, and the items of a set take its rows in the last join, which nothing shuffles.
    A set is named by its hash and its place among the sets of that hash, so the join that makes
    the pairs reads narrow rows; a set's assets are dealt in slices, each with all of its items.
    """
    spark = products.sparkSession
    tasks, key = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism), ["h", "d", "slice"]
    items = products.groupBy("vuln_id").agg(F.sort_array(F.collect_set(F.struct("v", "p"))).alias("named")).withColumn("h", F.xxhash64("named"))
    items = items.withColumn("d", F.dense_rank().over(Window.partitionBy("h").orderBy("named")))
    kinds = items.select("h", "d", "named").distinct().select("h", "d", F.explode("named").alias("k")).select("h", "d", "k.v", "k.p")
    found = kinds.join(software, ["v", "p"]).select("h", "d", F.pmod(F.hash("asset_id"), F.lit(SLICES)).alias("slice"), "asset_id", "confidence")
    found = found.repartition(tasks, *key).groupBy(*key, "asset_id").agg(F.coalesce(F.max("confidence"), F.lit(0.8)).alias("best"))
    dealt = items.select("h", "d", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), "vuln_id").repartition(tasks, *key)
    return found.hint("merge").join(dealt, key).select("asset_id", "vuln_id", "best")


def latest_by_time(signals: DataFrame, kind: str) -> DataFrame:
    """vuln_id, value_num of the latest signal of a kind by time, ties to the larger id."""
    return signals.where(F.col("signal_type") == kind).groupBy("vuln_id").agg(F.max_by("value_num", F.struct("observed_at", "id")).alias("value_num"))


def top_by_cvss(vulns: DataFrame, k: int) -> DataFrame:
    return vulns.orderBy(F.col("cvss_base_score").desc_nulls_last(), "vuln_id").limit(k)


def recent_years(yearly: DataFrame, n: int = 7) -> DataFrame:
    return yearly.orderBy(F.desc("year")).limit(n)


def shown_text(text: Column, most: int = 120) -> Column:
    """Text cut for a list, with an ellipsis where something is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def evidence_summary(found: DataFrame) -> DataFrame:
    """Pairs with their evidence as one nested summary."""
    asset, threat, control = (F.struct(*c) for c in (("affectedness", "reachability", "criticality"), ("exploitation", "epss", "cvss"), ("control_status", "control_effectiveness")))
    return found.select("asset_id", "vuln_id", F.struct(asset.alias("asset"), threat.alias("threat"), control.alias("controls")).alias("summary"))


def bare_evidence(vulns: DataFrame, known: DataFrame, criticality: str = "medium") -> DataFrame:
    """Evidence of items without an asset: what only an asset could tell is unknown, and exploitation is never theoretical."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = vulns.select("vuln_id", "cvss_base_score").join(known, "vuln_id", "left")
    return df.select(
        F.lit(None).cast("long").alias("asset_id"), "vuln_id", F.lit("unknown").alias("affectedness"), F.lit("unknown").alias("reachability"),
        F.when(on("kev"), "active").when(on("poc") | on("msf"), "poc_public").otherwise("none").alias("exploitation"), F.lit("unknown").alias("control_status"),
        F.lit(0.0).alias("control_effectiveness"), F.lit(criticality).alias("criticality"), F.coalesce("cvss_base_score", F.lit(0.0)).alias("cvss"), F.coalesce("epss_max", F.lit(0.0)).alias("epss"),
    )


def matched_techniques(analysis: DataFrame, known: DataFrame) -> DataFrame:
    """Techniques that an analysis names (brief_id, pos, technique_id), with what is known of them; unknown ones keep nulls."""
    return analysis.join(techniques(known), "technique_id", "left")


# --- models ---------------------------------------------------------------------


def score_one(spark: SparkSession, model: PipelineModel, features: list[str], values: Mapping[str, float]) -> float:
    """The score of one item given as a mapping (absent features are 0)."""
    row = spark.createDataFrame([tuple(float(values.get(f) or 0.0) for f in features)], ", ".join(f"`{f}` double" for f in features))
    return models.scored(model, row, features).first().p


def blend(df: DataFrame, streams: list[str], model: PipelineModel | None = None) -> DataFrame:
    """df plus p: a fitted stack's score, without one the mean of the streams that are there (0.5 if none is)."""
    if model is not None:
        return models.stacked(model, df, streams)
    there = F.array_compact(F.array(*streams))
    mean = F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)
    return df.withColumn("p", F.when(F.size(there) > 0, mean).otherwise(0.5))


def evaluate(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Ranking and threshold metrics of scored rows; without groups, one row."""
    whole = ["__all"] if not by else by
    df = durable(df if by else df.withColumn("__all", F.lit(1)))
    out = threshold_metrics(df, whole, y, p).join(ranking_metrics(df, whole, y, p), whole)
    return out if by else out.drop("__all")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
