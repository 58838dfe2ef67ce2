"""Point-in-time signals: as-of filters, latest values, features and label policies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import core

EXPLOITS = ("kev", "poc_exploitdb", "metasploit")


def asof_filter(df: DataFrame, asof: str, mode: str = "date", column: str = "observed_at") -> DataFrame:
    """Rows known at ``asof``: ``date`` (that day included), ``end_of_day`` (its last microsecond), ``midnight`` (its start)."""
    at = F.col(column)
    if mode == "date":
        return df.where(F.to_date(at) <= F.lit(asof).cast("date"))
    clock = "23:59:59.999999" if mode == "end_of_day" else "00:00:00"
    if mode not in ("end_of_day", "midnight"):
        raise ValueError(f"unknown as-of mode {mode}")
    return df.where(at <= F.lit(f"{asof} {clock}").cast("timestamp_ntz"))


def has(kind: str) -> Column:
    """Whether a true signal of the kind is in the group."""
    return F.coalesce(F.bool_or(F.when(F.col("signal_type") == kind, F.coalesce("value_bool", F.lit(False)))), F.lit(False))


def signal_pivot(signals: DataFrame) -> DataFrame:
    """One row per item: any-true exploit flags, latest and largest EPSS (latest by date, ties to the larger id)."""
    epss = F.when(F.col("signal_type") == "epss", F.col("value_num"))
    order = F.when(F.col("signal_type") == "epss", F.struct(F.to_date("observed_at"), F.col("id")))
    return signals.groupBy("vuln_id").agg(
        has("kev").alias("kev"),
        has("poc_exploitdb").alias("poc"),
        has("metasploit").alias("msf"),
        F.max_by(epss, order).alias("epss_latest"),
        F.max(epss).alias("epss_max"),
    )


def vulnerability_features(vulns: DataFrame, signals: DataFrame, asof: str, mode: str = "date") -> DataFrame:
    """The 39 numeric features of every item; signals are aggregated before the join."""
    known = signal_pivot(asof_filter(signals, asof, mode))
    df = vulns.join(known, "vuln_id", "left")
    df = df.withColumn("__cvss", core.cvss_record(F.col("cvss_vector")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    day, poc = F.lit(asof).cast("date"), F.coalesce(F.col("poc"), F.lit(False))
    age = F.coalesce(F.datediff(day, F.to_date("published_at")), F.lit(0)).cast("double")
    cvss = F.coalesce("cvss_base_score", F.lit(0.0))
    epss = F.coalesce("epss_latest", F.lit(0.0))
    count = flag("kev") + flag("poc") + flag("msf")
    ordinal = {m: F.col("__cvss")[m] for m in core.METRICS}
    cwes = F.split("cwe_list", ",")
    text = F.coalesce(F.col("description"), F.lit(""))
    return df.select(
        "vuln_id",
        cvss.alias("cvss_base_score"),
        (F.coalesce(F.col("cvss_version"), F.lit("")) == "3.1").cast("double").alias("cvss_version_31"),
        *core.cvss_features(F.col("__cvss")["valid"], ordinal),
        age.alias("days_since_published"),
        epss.alias("epss_score"),
        flag("kev").alias("kev_flag"),
        flag("poc").alias("poc_exploitdb_flag"),
        flag("msf").alias("metasploit_flag"),
        count.alias("exploit_signal_count"),
        F.when(poc & F.col("published_at").isNotNull(), age).otherwise(-1.0).alias("days_since_poc"),
        *core.cwe_features(cwes),
        F.length(text).cast("double").alias("description_length"),
        core.word_count(text).cast("double").alias("description_word_count"),
        _count(vulns, "affected_products", F.when(F.col("product").isNull(), 0.0).otherwise(1.0)).alias("product_count"),
        _count(vulns, "references", F.lit(0.0)).alias("reference_count"),
        core.composite_score(cvss, epss, flag("kev"), flag("poc"), flag("msf"), count).alias("composite_exploit_score"),
    )


def _count(df: DataFrame, column: str, otherwise: Column) -> Column:
    """Entries of an array column (null: none), or what holds for tables without that column."""
    return F.coalesce(F.size(column), F.lit(0)).cast("double") if column in df.columns else otherwise


@dataclass(frozen=True)
class LabelPolicy:
    name: str
    excluded: frozenset[str]
    positive: frozenset[str]
    params: dict = field(default_factory=dict)


_CIRCULAR = frozenset({"kev_flag", "poc_exploitdb_flag", "metasploit_flag", "exploit_signal_count", "days_since_poc"})
POLICIES = {
    p.name: p
    for p in (
        LabelPolicy("kev_strict", frozenset({"kev_flag"}), frozenset({"kev"})),
        LabelPolicy("temporal_first_exploit", _CIRCULAR, frozenset(EXPLOITS), {"horizon_days": 90}),
        LabelPolicy("composite_no_leak", _CIRCULAR, frozenset(EXPLOITS)),
        LabelPolicy("epss_derived", frozenset({"epss_score", "kev_flag"}), frozenset({"kev", "epss"}), {"epss_threshold": 0.15}),
    )
}


def excluded_features(policy: str) -> frozenset[str]:
    if policy not in POLICIES:
        raise KeyError(f"unknown policy {policy}; known: {', '.join(POLICIES)}")
    return POLICIES[policy].excluded


def build_labels(vulns: DataFrame, signals: DataFrame, policy: str, asof: str) -> DataFrame:
    """vuln_id, policy, label_value, rationale (sorted contributing types), contributors (ids of contributing rows, sorted, joined)."""
    rule = POLICIES[policy]
    known = asof_filter(signals, asof, "end_of_day")
    if policy == "temporal_first_exploit":
        end = F.expr(f"published_at + interval '{rule.params['horizon_days']}' day")
        stop = F.least(end, F.lit(f"{asof} 23:59:59.999999").cast("timestamp_ntz"))
        known = known.join(vulns.select("vuln_id", "published_at"), "vuln_id").where(F.col("published_at").isNotNull() & (F.col("observed_at") <= stop))
    kind, on = F.col("signal_type"), F.coalesce(F.col("value_bool"), F.lit(False))
    if policy == "epss_derived":
        sums = known.groupBy("vuln_id").agg(
            has("kev").alias("kev"),
            F.max(F.when(kind == "epss", F.col("value_num"))).alias("epss"),
            F.max_by(F.when(kind == "epss", F.col("id")), F.when(kind == "epss", F.struct("value_num", "id"))).alias("top"),
            F.collect_list(F.when((kind == "kev") & on, F.col("id"))).alias("kevs"),
        )
        hit = F.coalesce(F.col("kev") & (F.col("epss") >= rule.params["epss_threshold"]), F.lit(False))
        ids, types = F.concat("kevs", F.array("top")), F.array(F.lit("epss"), F.lit("kev"))
    else:
        wanted = on & kind.isin(*sorted(rule.positive))
        sums = known.where(wanted).groupBy("vuln_id").agg(F.collect_list("id").alias("ids"), F.collect_set("signal_type").alias("types"))
        hit, ids, types = F.col("ids").isNotNull(), F.col("ids"), F.col("types")
    df = vulns.select("vuln_id").join(sums, "vuln_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    text = lambda x: F.when(F.col("hit"), F.array_join(F.sort_array(x), ",")).otherwise("")
    return df.select(
        "vuln_id", F.lit(policy).alias("policy"), F.col("hit").cast("int").alias("label_value"), text(types).alias("rationale"), text(ids).alias("contributors")
    )


def label_provenance(labels: DataFrame, signals: DataFrame) -> DataFrame:
    """Labels of ``build_labels`` with contributing_signals, an array of (observed_at, id, signal_type, value_num, value_bool) by time and id, and excluded_features.

    Only the rows that a label names are gathered: those of one item.
    """
    named = labels.where("contributors <> ''").select("vuln_id", "policy", F.explode(F.split("contributors", ",").cast("array<long>")).alias("id"))
    rows = named.join(signals.select("id", "observed_at", "signal_type", "value_num", "value_bool"), "id")
    found = rows.groupBy("vuln_id", "policy").agg(F.sort_array(F.collect_list(F.struct("observed_at", "id", "signal_type", "value_num", "value_bool"))).alias("contributing_signals"))
    excluded = F.create_map(*[x for p in POLICIES.values() for x in (F.lit(p.name), F.array(*map(F.lit, sorted(p.excluded))))])
    none = F.array().cast(found.schema["contributing_signals"].dataType)
    return labels.join(found, ["vuln_id", "policy"], "left").select(
        "vuln_id", "policy", "label_value", "rationale", F.coalesce("contributing_signals", none).alias("contributing_signals"), excluded[F.col("policy")].alias("excluded_features")
    )


def legacy_labels(vulns: DataFrame, signals: DataFrame, policy: str = "composite") -> DataFrame:
    """Labels from the last signal of each type (by id), without an as-of date."""
    kinds = {"composite": EXPLOITS, "kev_only": ("kev",), "poc_only": ("poc_exploitdb",)}[policy]
    last = signals.groupBy("vuln_id").agg(*[F.max_by(F.when(F.col("signal_type") == k, F.col("value_bool")), F.when(F.col("signal_type") == k, F.col("id"))).alias(k) for k in kinds])
    any_on = F.greatest(*[F.coalesce(F.col(k), F.lit(False)).cast("int") for k in kinds], F.lit(0))
    return vulns.select("vuln_id").join(last, "vuln_id", "left").select("vuln_id", any_on.alias("label_value"))


def label_stats(labels: DataFrame) -> DataFrame:
    n, pos = F.count("*"), F.coalesce(F.sum("label_value"), F.lit(0))
    return labels.groupBy("policy").agg(n.alias("total"), pos.alias("positive"), (n - pos).alias("negative"), F.round(F.try_divide(pos, n), 6).alias("positive_rate"))


def label_conflicts(labels: DataFrame) -> DataFrame:
    """Items on which policies disagree: votes as sorted policy=value pairs; expected if kev_strict takes part."""
    vote = F.concat_ws("=", "policy", "label_value")
    return (
        labels.groupBy("vuln_id")
        .agg(F.count_distinct("label_value").alias("n"), F.array_join(F.sort_array(F.collect_set(vote)), ",").alias("votes"), F.bool_or(F.col("policy") == "kev_strict").alias("expected"))
        .where("n > 1")
        .select("vuln_id", "votes", F.when(F.col("expected"), "expected").otherwise("unexpected").alias("severity"))
    )
