"""Retrieval and text extraction: nearest vectors, evidence from descriptions, brief checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import core

#: Patterns of the extraction, in order.
VERSION = r"(?i)(?:before|prior to|up to|through|<=?)\s*([\d]+(?:\.[\d]+)+)"
FIXED = r"(?i)(?:fixed in|patched in|resolved in|upgrade to)\s*([\d]+(?:\.[\d]+)+)"
PRODUCT = r"(?i)(?:in|affects?|vulnerability in)\s+([A-Z][\w\s-]{2,30}?)\s+(?:before|version|through|prior)"
NOT_AFFECTED = ("does not affect", "not affected", "not vulnerable", "not exploitable")
EXPLOIT_TYPES = {
    "rce": "remote code execution|arbitrary code|command execution",
    "dos": "denial of service|crash|resource consumption",
    "info_disclosure": "information disclosure|information leak|data exposure|sensitive data",
    "privilege_escalation": "privilege escalation|elevat(?:e|ion)",
    "sqli": "sql injection",
    "xss": "cross-site scripting|xss",
    "ssrf": "server-side request forgery|ssrf",
    "auth_bypass": "authentication bypass|authorization bypass|bypass auth",
}
PREREQUISITES = {
    "network_access": "remote|network|via HTTP|over the network",
    "local_access": r"local\s+(?:attacker|access|user)",
    "authentication": "authenticated|requires? (?:valid )?credentials|login",
    "user_interaction": r"user interaction|click|visit|open(?:s|ing)?\s+a",
    "specific_configuration": "non-default|specific config|when configured|if enabled",
}
WORKAROUND = "workaround|mitigation|disable|turn off|restrict"
#: Patterns of exploit code, held against serialised JSON.
UNSAFE = (
    r"import\s+socket", r"subprocess\.call", r"os\.system\(", r"exec\(", r"eval\(", r"\\x[0-9a-f]{2}",
    r"\\u0000", r"powershell\s+-enc", r"curl\s+.*\|\s*sh", r"wget\s+.*\|\s*bash",
)


def any_case(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i)(?:{pattern})")


def first_named(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern, in order, that the text matches."""
    return F.coalesce(*[F.when(any_case(text, p), n) for n, p in patterns.items()])


def extract_evidence(df: DataFrame, text: str = "description") -> DataFrame:
    """df plus status, status_confidence, products, version_end, fixed_version, exploit_type, prerequisites, network,
    authenticated, interaction, exploit_confidence, patch, workaround, remedy_confidence.

    Blank texts get the defaults: unknown, and confidence 0.5 throughout.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blank = F.trim(body) == ""
    denied = F.coalesce(*[F.when(any_case(body, p), p) for p in NOT_AFFECTED])
    products = F.transform(F.slice(F.regexp_extract_all(body, F.lit(PRODUCT), F.lit(1)), 1, 3), lambda x: F.trim(x))
    first = lambda p: F.get(F.regexp_extract_all(body, F.lit(p), F.lit(1)), F.lit(0))
    found = F.when(denied.isNull(), products).otherwise(F.array().cast("array<string>"))
    kind = first_named(body, EXPLOIT_TYPES)
    needs = F.array_compact(F.array(*[F.when(any_case(body, p), F.lit(n)) for n, p in PREREQUISITES.items()]))
    has = lambda n: F.array_contains(F.col("__needs"), n)
    df = df.withColumns({"__blank": blank, "__denied": denied, "__products": found, "__kind": kind, "__needs": needs})
    some = F.size("__products") > 0
    patch, around = first(FIXED).isNotNull(), any_case(body, WORKAROUND)
    default = lambda c: F.when(F.col("__blank"), 0.5).otherwise(c)
    strength = 0.3 + 0.1 * F.size("__needs") + F.when(F.col("__kind").isNotNull(), 0.2).otherwise(0.0)
    return df.withColumns({
        "status": F.when(F.col("__denied").isNotNull(), "not_affected").when(some, "affected").otherwise("unknown"),
        "status_confidence": default(F.when(F.col("__denied").isNotNull(), 0.6).when(some, 0.7).otherwise(0.3)),
        "products": F.array_join("__products", ";"),
        "version_end": F.when(some, first(VERSION)),
        "fixed_version": F.when(some, first(FIXED)),
        "exploit_type": F.col("__kind"),
        "prerequisites": F.array_join("__needs", ";"),
        "network": has("network_access") | ~has("local_access"),
        "authenticated": has("authentication"),
        "interaction": has("user_interaction"),
        "exploit_confidence": default(F.round(F.least(strength, F.lit(0.85)), 2)),
        "patch": patch,
        "workaround": around,
        "remedy_confidence": default(F.when(patch | around, 0.6).otherwise(0.3)),
    }).drop("__blank", "__denied", "__products", "__kind", "__needs")


def unsafe_hits(json: Column) -> Column:
    """Numbers (from 0) of the exploit-code patterns that a serialised document matches."""
    return F.array_compact(F.array(*[F.when(any_case(json, p), F.lit(i)) for i, p in enumerate(UNSAFE)]))


def verify_briefs(briefs: DataFrame, techniques: DataFrame) -> DataFrame:
    """brief_id, errors (sorted, joined), valid.

    ``briefs``: brief_id, description, p_final and attck, an array of (technique_id, rationale,
    evidence array of text); ``techniques``: technique_id.
    """
    known = techniques.select("technique_id").distinct().withColumn("known", F.lit(True))
    maps = briefs.select("brief_id", F.explode("attck").alias("m")).select("brief_id", "m.*").join(known, "technique_id", "left")
    bad = maps.groupBy("brief_id").agg(
        F.bool_or(F.col("known").isNull()).alias("technique"),
        F.bool_or(F.coalesce(F.size("evidence"), F.lit(0)) < 1).alias("no_evidence"),
        F.bool_or(F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.coalesce(F.trim(e), F.lit("")) == "")).alias("blank_evidence"),
        F.bool_or(F.length(F.coalesce("rationale", F.lit(""))) < 20).alias("short_rationale"),
    )
    names = ("technique", "no_evidence", "blank_evidence", "short_rationale")
    text = F.to_json(F.struct(*briefs.columns))
    errors = F.array_compact(F.array(
        *[F.when(F.col(n), F.lit(n)) for n in names],
        F.when(F.size(unsafe_hits(F.col("__json"))) > 0, F.lit("unsafe")),
        F.when(F.coalesce("description", F.lit("")) == "", F.lit("no_description")),
        F.when(F.col("p_final").isNull(), F.lit("no_probability")),
    ))
    df = briefs.withColumn("__json", text).join(bad, "brief_id", "left")
    return df.select("brief_id", F.array_join(F.sort_array(errors), ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


def query_text(description: Column, cwes: Column, products: Column) -> Column:
    """What a brief's retrieval asks for: description, weakness types, affected software (absent parts left out)."""
    listed = lambda head, xs: F.when(F.coalesce(F.size(xs), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(xs, ", ")))
    return F.concat_ws(" ", F.nullif(description, F.lit("")), listed("Weakness types: ", cwes), listed("Affected software: ", products))


def _block_search(k: int):
    """A cogroup function: k nearest of a shard for each query of a block, with scores summed as ``core.cosine`` sums them."""

    def search(held, asked):
        import numpy as np
        import pandas as pd

        def dense(column, wide):
            sizes = np.array([-1 if x is None else len(x) for x in column])
            out = np.zeros((len(column), max(1, wide)))
            for i, x in enumerate(column):
                if x is not None:
                    out[i, : len(x)] = x
            return out, sizes

        def folded(a, b):  # from the left, as Spark's aggregate does
            total = np.zeros(len(a))
            for d in range(a.shape[1]):
                total = total + a[:, d] * b[:, d]
            return total

        out = []
        if len(held) and len(asked):
            wide = max((len(x) for c in (held.embedding, asked.q) for x in c if x is not None), default=1)
            (v, vn), (q, qn) = dense(held.embedding, wide), dense(asked.q, wide)
            ids, names = held.vec_id.to_numpy(), asked.query_id.to_numpy()
            with np.errstate(all="ignore"):
                vl, ql = np.sqrt(folded(v, v)), np.sqrt(folded(q, q))
                step = max(1, (1 << 21) // len(ids))
                for at in range(0, len(names), step):
                    some = slice(at, at + step)
                    length = ql[some, None] * vl[None, :]
                    near = np.nan_to_num(q[some] @ v.T / length, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                    own = names[some, None] == ids[None, :]
                    near[(length == 0) | (qn[some, None] != vn[None, :]) | (qn[some, None] < 0)] = -9.0  # no score: after all others
                    near[own] = -np.inf
                    last = max(0, len(ids) - k)
                    edge = np.partition(near, last, axis=1)[:, last] - 1e-9  # rows within the error of the product are summed exactly
                    rows, columns = np.nonzero((near >= edge[:, None]) & ~own)
                    for a in range(0, len(rows), 1 << 16):
                        r, c = rows[a : a + (1 << 16)], columns[a : a + (1 << 16)]
                        score = folded(v[c], q[some][r]) / (vl[c] * ql[some][r])
                        none = near[r, c] == -9.0
                        out.append(pd.DataFrame({"query_id": names[some][r], "vec_id": ids[c], "score": score, "none": none}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "none": [], "nan": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "none": "bool", "nan": "bool"})
        found = pd.concat(out)
        high = np.where(found.none, -np.inf, np.where(np.isnan(found.score), np.inf, found.score))
        found = found.assign(high=high, nan=np.isnan(found.score) & ~found.none).sort_values(["query_id", "none", "high", "vec_id"], ascending=[True, True, False, True])
        return found.groupby("query_id", sort=False).head(k)[["query_id", "vec_id", "score", "none", "nan"]]

    return search


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, least: float | None = None, shard_rows: int = 8192, block_queries: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest by cosine; payload filter first, the score limit after the top k.

    Vectors meet ``queries`` (query_id, q; of any number) as (shard, block) groups of
    bounded size, each a matrix product whose best are summed again exactly; each shard
    gives a query its own top k before the last one.  All pairs are compared: the work is
    that of queries times vectors.
    """
    held = vectors if where is None else vectors.where(where)
    shards, blocks = max(1, -(-held.count() // shard_rows)), max(1, -(-queries.count() // block_queries))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>")).alias(c)  # noqa: E731  # a null component: no score
    left = held.select("vec_id", whole("embedding"), place("vec_id", shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("query_id", whole("q"), place("query_id", blocks).alias("block"), every(shards).alias("shard"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double, none boolean, nan boolean"
    own = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_block_search(k), kinds)
    own = own.select("query_id", "vec_id", F.when(F.col("nan"), F.lit(float("nan"))).when(~F.col("none"), F.col("score")).alias("score"))  # pandas has no NaN beside null
    top = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id")))).where(F.col("rank") <= k)
    top = top if least is None else top.where(F.col("score") >= least)
    return top.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def build_briefs(vulns: DataFrame, matches: DataFrame, scores: DataFrame) -> DataFrame:
    """Template briefs: brief_id, description, p_final, confidence note, remediation and attck mappings.

    ``matches``: vuln_id, technique_id, score; ``scores``: vuln_id, p_final.
    """
    text = F.substring(F.coalesce("description", F.lit("")), 1, 500)
    maps = matches.groupBy("vuln_id").agg(F.sort_array(F.collect_list(F.struct(F.round("score", 3).alias("confidence"), "technique_id")), False).alias("m"))
    df = vulns.join(scores, "vuln_id", "left").join(maps, "vuln_id", "left")
    rationale = lambda m: F.format_string("Technique %s matches the description with similarity %.3f", m["technique_id"], m["confidence"])
    evidence = F.when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    note = F.when(F.col("p_final") >= 0.7, "HIGH").when(F.col("p_final") >= 0.4, "MEDIUM").when(F.col("p_final").isNotNull(), "LOW")
    return df.select(
        F.col("vuln_id").alias("brief_id"), F.col("description"), F.col("p_final"), note.alias("confidence"),
        F.when(F.col("cvss_base_score") >= 9, "critical").otherwise("high").alias("priority"),
        F.transform(F.coalesce("m", F.array().cast("array<struct<confidence:double,technique_id:string>>")),
                    lambda m: F.struct(m["technique_id"].alias("technique_id"), rationale(m).alias("rationale"), evidence.alias("evidence"))).alias("attck"),
    )
