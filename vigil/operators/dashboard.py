"""Dashboard and listing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.signals import EXPLOITS


def largest_epss(signals: DataFrame) -> DataFrame:
    return signals.where("signal_type = 'epss'").groupBy("vuln_id").agg(F.max("value_num").alias("epss"))


def top_risk(vulns: DataFrame, signals: DataFrame, n: int = 10) -> DataFrame:
    """Largest CVSS x EPSS (0.01 where EPSS is unknown), ties by id; signals are aggregated before the join."""
    df = vulns.where("cvss_base_score is not null").join(largest_epss(signals), "vuln_id", "left")
    order = F.col("cvss_base_score") * F.coalesce("epss", F.lit(0.01))
    shown = F.col("cvss_base_score") * F.when(F.coalesce("epss", F.lit(0.0)) == 0, 0.01).otherwise(F.col("epss"))
    return df.orderBy(order.desc(), "vuln_id").limit(n).select(
        "vuln_id", "cvss_base_score", F.round("epss", 4).alias("epss_score"), F.round(shown, 3).alias("risk_score"), "published_at"
    )


def stats(vulns: DataFrame, signals: DataFrame, asof: str) -> DataFrame:
    """One row: totals, severities, recency and signal counts, each table read once."""
    cvss = F.col("cvss_base_score")
    since = F.expr(f"timestamp_ntz'{asof} 00:00:00' - interval '30' day")
    a = vulns.agg(
        F.count("*").alias("total"), F.count_if(cvss >= 9).alias("critical"), F.count_if((cvss >= 7) & (cvss < 9)).alias("high"),
        F.count_if((cvss >= 4) & (cvss < 7)).alias("medium"), F.count_if((cvss > 0) & (cvss < 4)).alias("low"),
        F.count_if(F.col("published_at") >= since).alias("recent"),
    )
    kind = F.col("signal_type")
    b = signals.agg(
        F.count_distinct(F.when(kind == "kev", F.col("vuln_id"))).alias("kev"),
        F.count_distinct(F.when(kind.isin("poc_exploitdb", "metasploit"), F.col("vuln_id"))).alias("poc_available"),
        F.nullif(F.round(F.avg(F.when(kind == "epss", F.col("value_num"))), 4), F.lit(0.0)).alias("avg_epss"),
    )
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def yearly(vulns: DataFrame) -> DataFrame:
    return vulns.where("published_at is not null").groupBy(F.year("published_at").cast("long").alias("year")).agg(F.count("*").alias("n"))


def listing(
    vulns: DataFrame, signals: DataFrame, *, search: str | None = None, low: float | None = None, high: float | None = None,
    has_kev: bool | None = None, sort: str = "published_at", descending: bool = True, page: int = 1, per_page: int = 20,
) -> DataFrame:
    """A page of items: substring search in any case, inclusive range, semi or anti join on KEV, nulls first when descending."""
    if not 1 <= per_page <= 100 or page < 1:
        raise ValueError("page starts at 1 and per_page lies in 1 to 100")
    df = vulns
    if search:
        like = f"%{search}%"
        df = df.where(F.col("cve_id").ilike(like) | F.col("title").ilike(like) | F.coalesce(F.col("description").ilike(like), F.lit(False)))
    if low is not None:
        df = df.where(F.col("cvss_base_score") >= low)
    if high is not None:
        df = df.where(F.col("cvss_base_score") <= high)
    if has_kev is not None:
        kev = signals.where("signal_type = 'kev'").select("vuln_id").distinct()
        df = df.join(kev, "vuln_id", "left_semi" if has_kev else "left_anti")
    key = sort if sort in vulns.columns else "published_at"
    order = F.col(key).desc_nulls_first() if descending else F.col(key).asc_nulls_last()
    return df.orderBy(order, "vuln_id").offset((page - 1) * per_page).limit(per_page)


def page_count(matching: int, per_page: int) -> int:
    return -(-matching // per_page)


def resolve(vulns: DataFrame, wanted: str) -> DataFrame:
    """The item whose id is ``wanted``, else whose cve_id is (empty if neither)."""
    own = F.col("vuln_id").cast("string") == wanted
    return vulns.where(own | (F.col("cve_id") == wanted)).orderBy(own.desc(), "vuln_id").limit(1)


def exploit_coverage(signals: DataFrame) -> DataFrame:
    """Distinct items and rows by exploit signal type."""
    return signals.where(F.col("signal_type").isin(*EXPLOITS)).groupBy("signal_type").agg(F.count_distinct("vuln_id").alias("items"), F.count("*").alias("n"))
