"""Column expressions of the domain: parsing, encodings, scores and the decision tree.

All are ANSI-safe and need no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base metrics in order, with their ordinals.
METRICS: dict[str, dict[str, int]] = {
    "AV": {"N": 3, "A": 2, "L": 1, "P": 0},
    "AC": {"L": 1, "H": 0},
    "PR": {"N": 2, "L": 1, "H": 0},
    "UI": {"N": 1, "R": 0},
    "S": {"C": 1, "U": 0},
    "C": {"H": 2, "L": 1, "N": 0},
    "I": {"H": 2, "L": 1, "N": 0},
    "A": {"H": 2, "L": 1, "N": 0},
}
#: Output names of the metrics.
METRIC_NAMES = ("attack_vector", "attack_complexity", "privileges_required", "user_interaction", "scope", "confidentiality_impact", "integrity_impact", "availability_impact")
#: Weakness to category.
CWE_CATEGORIES = {
    "CWE-79": "injection", "CWE-89": "injection", "CWE-78": "injection", "CWE-77": "injection",
    "CWE-20": "input_validation", "CWE-22": "path_traversal", "CWE-200": "information_disclosure",
    "CWE-287": "auth_bypass", "CWE-288": "auth_bypass", "CWE-306": "auth_bypass", "CWE-425": "auth_bypass",
    "CWE-362": "race_condition", "CWE-434": "file_upload", "CWE-502": "deserialization",
    "CWE-787": "memory_safety", "CWE-122": "memory_safety", "CWE-119": "memory_safety", "CWE-416": "memory_safety",
    "CWE-918": "ssrf",
}
CWE_GROUPS = (*dict.fromkeys(CWE_CATEGORIES.values()), "other")
#: Hours to act, by action.
SLA_HOURS = {"patch_now": 24, "mitigate_now": 24, "patch_window": 720, "monitor": 2160, "accept": 8760}
ACTIONS = tuple(SLA_HOURS)
CRITICALITY = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
VEX_STATUS = {"not_affected": 0.0, "under_investigation": 0.25, "fixed": 0.5, "affected": 1.0}


def lookup(key: Column, values: Mapping[str, object], default: object = None) -> Column:
    """A small fixed map as one CASE expression."""
    cases = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == (k := next(iter(values))), F.lit(values[k])))
    return cases if default is None else cases.otherwise(F.lit(default))


def safe_double(x: Column) -> Column:
    return x.try_cast("double")


def safe_date(x: Column) -> Column:
    return x.try_cast("date")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cvss_record(vector: Column) -> Column:
    """struct of valid, version, error and the eight ordinals (-1 if missing or invalid) of a CVSS 3 vector.

    Errors follow the order of the parts: pattern, component, duplicate, value, then missing metrics.
    """
    names = F.array(*map(F.lit, METRICS))
    fine = F.array(*[F.lit(f"{m}:{v}") for m, vs in METRICS.items() for v in vs])

    def split(body: Column) -> Column:
        parts = F.transform(F.split(body, "/"), lambda p: F.split(p, ":"))
        return F.transform(parts, lambda q: F.struct(F.upper(F.get(q, F.lit(0))).alias("k"), F.get(q, F.lit(1)).alias("v"), F.size(q).alias("n")))

    def failure(text: Column, body: Column, pairs: Column, keys: Column) -> Column:
        def error(p: Column, i: Column) -> Column:
            known = F.array_contains(names, p["k"])
            return (
                F.when(p["n"] != 2, "component")
                .when(known & F.array_contains(F.slice(keys, F.lit(1), i), p["k"]), "duplicate")
                .when(known & ~F.array_contains(fine, F.concat_ws(":", p["k"], p["v"])), "value")
            )

        first = F.get(F.filter(F.transform(pairs, error), lambda e: e.isNotNull()), F.lit(0))
        missing = F.size(F.array_except(names, keys)) > 0
        return (
            F.when(text.isNull() | (text == ""), "empty")
            .when(body == "", "pattern")
            .otherwise(F.coalesce(first, F.when(missing, "missing")))
        )

    def record(text: Column, pairs: Column, failed: Column) -> Column:
        own = lambda m: F.get(F.filter(pairs, _is(m)), F.lit(0))["v"]
        return F.struct(
            failed.isNull().alias("valid"),
            F.when(failed.isNull(), F.when(text.contains("3.0"), "3.0").otherwise("3.1")).alias("version"),
            failed.alias("error"),
            *[F.when(failed.isNull(), F.coalesce(lookup(own(m), values), F.lit(-1))).otherwise(-1).alias(m) for m, values in METRICS.items()],
        )

    def read(text: Column) -> Column:
        body = F.regexp_extract(text, r"(?i)^CVSS:3\.[01]/(.+)$", 1)
        with_keys = lambda body, pairs: _let(F.transform(pairs, lambda p: p["k"]), lambda keys: _let(failure(text, body, pairs, keys), lambda failed: record(text, pairs, failed)))
        return _let(body, lambda body: _let(split(body), lambda pairs: with_keys(body, pairs)))

    return _let(F.trim(vector), read)


def cvss_parts(vector: Column) -> dict[str, Column]:
    """The fields of ``cvss_record`` by name."""
    found = cvss_record(vector)
    return {n: found[n] for n in ("valid", "version", "error", *METRICS)}


def _is(metric: str):
    return lambda p: p["k"] == metric


def cvss_features(valid: Column, ordinal: Mapping[str, Column]) -> list[Column]:
    """The 13 numeric features: 0.0 throughout for an invalid vector."""
    put = lambda c, n: F.when(valid, c.cast("double")).otherwise(0.0).alias(f"cvss_{n}")
    return [
        *(put(ordinal[m], n) for m, n in zip(METRICS, METRIC_NAMES, strict=True)),
        put(ordinal["AV"] == 3, "is_network"),
        put(ordinal["PR"] == 2, "no_privs"),
        put(ordinal["UI"] == 1, "no_interaction"),
        put(ordinal["S"] == 1, "scope_changed"),
        put(ordinal["C"] + ordinal["I"] + ordinal["A"], "cia_total"),
    ]


def cwe_features(cwes: Column) -> list[Column]:
    groups = F.transform(F.coalesce(cwes, F.array().cast("array<string>")), lambda c: lookup(c, CWE_CATEGORIES, "other"))
    return [
        *(F.array_contains(groups, g).cast("double").alias(f"cwe_{g}") for g in CWE_GROUPS),
        F.coalesce(F.size(cwes), F.lit(0)).cast("double").alias("cwe_count"),
    ]


def word_count(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+"))).cast("long")


def severity(cvss: Column) -> Column:
    return F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").when(cvss.isNotNull(), "low").otherwise("N/A")


def composite_score(cvss: Column, epss: Column, kev: Column, poc: Column, msf: Column, count: Column) -> Column:
    return F.round(0.25 * cvss / 10 + 0.30 * epss + 0.15 * kev + 0.15 * poc + 0.10 * msf + 0.05 * F.least(count / 3, F.lit(1.0)), 4)


def risk_score(cvss: Column, epss: Column, ml: Column | None, reachability: Column, control: Column, effectiveness: Column) -> Column:
    """Terms are added one by one from the left where there is no model: a last bit decides at a threshold."""
    scaled = F.least(cvss / 10, F.lit(1.0))
    base = 0.3 * scaled + 0.3 * epss
    if ml is None:
        base = base + 0.15 * scaled + 0.15 * epss
    else:
        base = base + F.when(ml.isNotNull(), 0.3 * ml).otherwise(0.15 * scaled + 0.15 * epss)
    base = base + F.when(reachability == "reachable", 0.10).when(reachability == "partially_reachable", 0.05).otherwise(0.0)
    damped = F.when(control == "fully_mitigated", base * 0.3).when(control == "partially_mitigated", base * (1 - 0.5 * effectiveness)).otherwise(base)
    return F.least(damped, F.lit(1.0))


def decide(affectedness: Column, exploitation: Column, reachability: Column, criticality: Column, control: Column, cvss: Column, epss: Column, ml: Column, risk: Column) -> Column:
    """struct(action, confidence, sla_hours, rationale): the first rule that applies wins."""
    vital, full = criticality.isin("critical", "high"), control == "fully_mitigated"
    active, poc = exploitation == "active", exploitation == "poc_public"
    severe = (cvss >= 9.0) | F.coalesce(ml >= 0.7, F.lit(False)) | (epss >= 0.5)
    leaves: Sequence[tuple[Column, str, float, str]] = (
        (affectedness == "not_affected", "accept", 0.95, "not affected"),
        (active & vital & full, "patch_window", 0.85, "exploited, vital asset, fully mitigated"),
        (active & vital, "patch_now", 0.95, "exploited, vital asset"),
        (active & full, "monitor", 0.80, "exploited, lesser asset, fully mitigated"),
        (active, "mitigate_now", 0.90, "exploited, lesser asset"),
        (poc & severe & vital & (reachability == "reachable"), "patch_now", 0.85, "public exploit, severe, vital and reachable"),
        (poc & severe & vital, "mitigate_now", 0.80, "public exploit, severe, not confirmed reachable"),
        (poc, "patch_window", 0.75, "public exploit, moderate profile"),
        ((risk >= 0.7) & vital, "patch_window", 0.70, "high risk score, vital asset"),
        (risk >= 0.7, "monitor", 0.65, "high risk score, lesser asset"),
        (risk >= 0.3, "monitor", 0.60, "moderate risk score"),
    )

    def leaf(action: str, confidence: float, why: str) -> Column:
        unknown = F.when((affectedness != "affected") & (affectedness != "not_affected"), F.array(F.lit("affectedness unknown"))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(action).alias("action"), F.lit(confidence).alias("confidence"), F.lit(SLA_HOURS[action]).alias("sla_hours"), F.concat(unknown, F.array(F.lit(why))).alias("rationale"))

    tree = F.when(leaves[0][0], leaf(*leaves[0][1:]))
    for test, *rest in leaves[1:]:
        tree = tree.when(test, leaf(*rest))
    return tree.otherwise(leaf("accept", 0.70, "low risk score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
