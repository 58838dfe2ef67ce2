"""Leakage audits, time split, feature groups, ablations and evaluation slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import core
from vigil.operators.signals import POLICIES

#: Feature groups.
FEATURE_GROUPS: dict[str, tuple[str, ...]] = {
    "cvss_core": ("cvss_base_score", "cvss_version_31"),
    "cvss_vector": (*(f"cvss_{n}" for n in core.METRIC_NAMES), "cvss_is_network", "cvss_no_privs", "cvss_no_interaction", "cvss_scope_changed", "cvss_cia_total"),
    "temporal": ("days_since_published",),
    "enrichment_safe": ("epss_score",),
    "exploit_signals": ("kev_flag", "poc_exploitdb_flag", "metasploit_flag", "exploit_signal_count", "days_since_poc"),
    "cwe": (*(f"cwe_{g}" for g in core.CWE_GROUPS), "cwe_count"),
    "text": ("description_length", "description_word_count"),
    "network": ("product_count", "reference_count"),
    "composite": ("composite_exploit_score",),
    "affectedness": ("affected_product_confirmed", "vex_status_enum", "sbom_match_confidence"),
    "reachability": ("network_reachable_flag", "internet_facing_flag", "code_path_reachable"),
    "controls": ("has_waf", "has_edr", "has_ips", "has_network_segmentation", "control_coverage_score"),
    "decision_context": ("asset_criticality_score", "days_since_disclosure"),
}
_ALL = frozenset(FEATURE_GROUPS)
_CVE = frozenset({"cvss_core", "cvss_vector", "cwe", "text"})
#: The groups of each ablation.
ABLATIONS: dict[str, frozenset[str]] = {
    "full": _ALL,
    "no_circular": _ALL - {"exploit_signals", "composite"},
    "cve_only": _CVE,
    "temporal_only": frozenset({"temporal", "enrichment_safe"}),
    "network_enriched": _CVE | {"network"},
    "text_only": frozenset({"text"}),
    "actionability_full": _ALL,
    "no_controls": _ALL - {"controls"},
    "no_reachability": _ALL - {"reachability"},
    "asset_context_only": frozenset({"affectedness", "reachability", "controls", "decision_context"}),
}
META = ("vuln_id", "asset_id", "cve_id", "asof", "published_at", "label_value")
#: Features that repeat a signal type, for circularity checks.
SIGNAL_FEATURES = {"kev": "kev_flag", "poc_exploitdb": "poc_exploitdb_flag", "metasploit": "metasploit_flag", "epss": "epss_score"}


def ablation_columns(config: str) -> set[str]:
    if config not in ABLATIONS:
        raise KeyError(f"unknown ablation {config}; known: {', '.join(ABLATIONS)}")
    return {f for g in ABLATIONS[config] for f in FEATURE_GROUPS[g]}


def ablate(df: DataFrame, config: str, exclude: frozenset[str] = frozenset(), keep_meta: bool = True) -> DataFrame:
    wanted = ablation_columns(config) - exclude
    return df.select(*[c for c in df.columns if c in wanted or keep_meta and c in META])


def ablation_grid(df: DataFrame) -> DataFrame:
    """group by ablation, 1 where the ablation has the group."""
    rows = [(g, *(int(g in groups) for groups in ABLATIONS.values())) for g in FEATURE_GROUPS]
    return df.sparkSession.createDataFrame(rows, "feature_group string, " + ", ".join(f"{a} int" for a in ABLATIONS))


def time_split(df: DataFrame, cutoff: str, column: str = "published_at") -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff's midnight, and after it; null dates are in neither.  An empty side is an error."""
    at = F.lit(f"{cutoff} 00:00:00").cast("timestamp_ntz")
    train, test = df.where(F.col(column) <= at), df.where(F.col(column) > at)
    for side, part in (("train", train), ("test", test)):
        if part.isEmpty():
            raise ValueError(f"the {side} side of the split at {cutoff} is empty")
    return train, test


def temporal_leakage(df: DataFrame, asof: str, column: str = "published_at") -> DataFrame:
    """One row: rows, future rows and their fraction, passed."""
    if column not in df.columns:
        return df.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("future"), F.lit(0.0).alias("fraction"), F.lit(True).alias("passed"))
    late = F.count_if(F.col(column) > F.lit(f"{asof} 00:00:00").cast("timestamp_ntz"))
    return df.agg(F.count("*").alias("n"), late.alias("future"), F.round(late / F.greatest(F.count("*"), F.lit(1)), 4).alias("fraction"), (late == 0).alias("passed"))


def label_leakage(columns: list[str], policy: str) -> set[str]:
    """Feature columns that the policy excludes; an unknown policy excludes none."""
    return set(columns) & set(POLICIES[policy].excluded) if policy in POLICIES else set()


def circular_features(policy: str) -> set[str]:
    """Features that repeat the policy's positive signals and are not excluded."""
    p = POLICIES[policy]
    return {SIGNAL_FEATURES[s] for s in p.positive if s in SIGNAL_FEATURES} - p.excluded


def label_validation(stats: DataFrame) -> DataFrame:
    """Per policy of ``label_stats``: circular features, sanity of the positive rate, passed (a warning does not pass)."""
    circular = core.lookup(F.col("policy"), {p: ",".join(sorted(circular_features(p))) for p in POLICIES}, "")
    rate = F.col("positive_rate")
    sanity = F.when((rate > 0.20) | ((F.col("policy") == "kev_strict") & (rate > 0.05)), "WARN").otherwise("PASS")
    return stats.select("policy", circular.alias("circular"), sanity.alias("sanity"), ((circular == "") & (sanity == "PASS")).alias("passed"))


def entity_leakage(train: DataFrame, test: DataFrame, key: str = "vuln_id") -> DataFrame:
    """One row: shared ids, ids of the test side, fraction, passed."""
    a, b = train.select(key).distinct().withColumn("in_train", F.lit(1)), test.select(key).distinct()
    n = F.count("*")
    shared = F.count("in_train")
    return b.join(a, key, "left").agg(shared.alias("overlap"), n.alias("test_ids"), F.round(shared / F.greatest(n, F.lit(1)), 4).alias("fraction"), (shared == 0).alias("passed"))


def correlations(df: DataFrame, features: list[str], label: str, limit: float = 0.95) -> DataFrame:
    """feature, correlation (null where undefined), suspicious: all features in one pass over pairwise complete rows."""
    y = F.col(label).cast("double")
    pair = {f: (F.when(y.isNotNull(), F.col(f).cast("double")), F.when(F.col(f).isNotNull(), y)) for f in features}
    sums = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r_{f}") for f, (a, b) in pair.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"r_{f}", 4).alias("correlation")) for f in features])
    return sums.select(F.explode(rows).alias("r")).select("r.feature", "r.correlation", F.coalesce(F.abs("r.correlation") > limit, F.lit(False)).alias("suspicious"))


#: The weaknesses of the yearly top 25.
TOP25 = (
    "CWE-787", "CWE-79", "CWE-89", "CWE-416", "CWE-78", "CWE-20", "CWE-125", "CWE-22", "CWE-352", "CWE-434", "CWE-862", "CWE-476", "CWE-287",
    "CWE-190", "CWE-502", "CWE-77", "CWE-119", "CWE-798", "CWE-918", "CWE-306", "CWE-362", "CWE-269", "CWE-94", "CWE-863", "CWE-276",
)


def slice_masks(columns: list[str]) -> dict[str, Column]:
    """Masks of the evaluation slices; a missing column makes a slice empty (no_kev: full)."""
    c = lambda n, test, missing=False: test(F.col(n)) if n in columns else F.lit(missing)
    top = F.array(*map(F.lit, TOP25))
    if "cwe_list" in columns:
        listed = F.arrays_overlap(F.split("cwe_list", ","), top)
    else:
        near = [f"cwe_{g}" for g in ("injection", "memory_safety", "auth_bypass", "path_traversal", "deserialization", "ssrf", "file_upload", "race_condition")]
        listed = F.greatest(*[F.coalesce(F.col(n), F.lit(0.0)) for n in near if n in columns], F.lit(0.0), F.lit(0.0)) > 0
    return {
        "overall": F.lit(True),
        "cvss_critical": c("cvss_base_score", lambda x: x >= 9.0),
        "cvss_medium_low": c("cvss_base_score", lambda x: x < 7.0),
        "has_kev": c("kev_flag", lambda x: x == 1.0),
        "no_kev": c("kev_flag", lambda x: ~x.eqNullSafe(F.lit(1.0)), True),
        "first_30_days": c("days_since_published", lambda x: x <= 30),
        "after_365": c("days_since_published", lambda x: x > 365),
        "cwe_top25": listed,
        "internet_facing": c("internet_facing_flag", lambda x: x == 1.0),
        "crown_jewel": c("asset_criticality_score", lambda x: x >= 0.75),
        "reachable_confirmed": c("network_reachable_flag", lambda x: x == 1.0),
        "high_control_coverage": c("control_coverage_score", lambda x: x >= 0.5),
    }


LEAST_ROWS = {"overall": 0, "has_kev": 20, "internet_facing": 10, "crown_jewel": 10, "reachable_confirmed": 10, "high_control_coverage": 10}


def apply_slices(df: DataFrame, keep: list[str]) -> DataFrame:
    """slice and the kept columns: a row for each slice that a row belongs to, in one pass."""
    names = F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in slice_masks(df.columns).items()])
    return df.select(F.explode(F.array_compact(names)).alias("slice"), *keep)


def least_rows(name: Column) -> Column:
    return core.lookup(name, LEAST_ROWS, 50)
