"""Idempotent writes as pure functions: (what is there, what comes) -> what to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators.tables import VersionedTable, counted, durable


def dedupe_key(cve: str = "cve_id", vendor_id: str = "vuldb_id") -> Column:
    return F.coalesce(F.nullif(F.col(cve), F.lit("")), F.nullif(F.col(vendor_id), F.lit("")), F.lit(""))


def insert_if_absent(held: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows of ``new`` to add: first of each key in ``order``, whose cve_id is nowhere held and, without one, whose (source, vuldb_id) is not."""
    key = F.when(F.coalesce("cve_id", F.lit("")) != "", F.concat(F.lit("c:"), "cve_id")).otherwise(F.concat_ws(":", F.lit("v"), "source", "vuldb_id"))
    own = new.withColumn("__k", key)
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(order))).where("__n = 1").drop("__n")
    return first.join(held.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def unpivot_signals(records: DataFrame, now: str) -> DataFrame:
    """One row per signal of a record: null and false are skipped, an EPSS of zero stays."""
    rows = records.select(
        "vuln_id",
        F.expr(
            "stack(4, 'epss', epss_score, cast(null as boolean), 'kev', cast(null as double), kev_flag, "
            "'poc_exploitdb', cast(null as double), poc_exploitdb, 'metasploit', cast(null as double), metasploit_module) as (signal_type, value_num, value_bool)"
        ),
    )
    return rows.where("value_num is not null or value_bool").withColumn("observed_at", F.lit(now).cast("timestamp_ntz"))


def ingest_signals(records: DataFrame, vulns: DataFrame) -> DataFrame:
    """Records by cve_id as rows by item; unmatched records drop out, repeated ones stay."""
    return records.join(vulns.select("cve_id", "vuln_id"), "cve_id").drop("cve_id")


def exploit_summary(exploits: DataFrame) -> DataFrame:
    """Per CVE: first date, rows, any Metasploit, first Metasploit date, the first five exploit ids in file order.

    The five are ranked before they are listed, so no group is held whole.
    """
    sums = exploits.groupBy("cve_id").agg(
        F.min("published").alias("first_date"), F.count("*").alias("n"), F.bool_or("msf").alias("msf"), F.min(F.when(F.col("msf"), F.col("published"))).alias("msf_date")
    )
    place = F.row_number().over(Window.partitionBy("cve_id").orderBy("pos", "exploit_id"))
    first = exploits.select("cve_id", "pos", "exploit_id").withColumn("place", place).where("place <= 5")
    ids = first.groupBy("cve_id").agg(F.sort_array(F.collect_list(F.struct("place", "exploit_id"))).alias("five"))
    return sums.join(ids, "cve_id").select("cve_id", "first_date", "n", "msf", "msf_date", F.array_join(F.transform("five", lambda x: x["exploit_id"].cast("string")), ",").alias("ids"))


def missing_rows(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not held (null-safe)."""
    known = held.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    test = same[0]
    for s in same[1:]:
        test = test & s
    return new.join(known, test, "left_anti")


def append_decisions(decisions: DataFrame, now: str, policy: str = "default", version: str = "1.0") -> DataFrame:
    """Decision rows with their time and deadline, for an append."""
    at = F.lit(now).cast("timestamp_ntz")
    return decisions.withColumns({
        "policy_name": F.lit(policy), "policy_version": F.lit(version), "decided_at": at,
        "sla_deadline": at + F.make_dt_interval(hours=F.col("sla_hours")),
    })


def write_partitioned(df: DataFrame, path: str, by: str, overwrite: bool = False) -> None:
    """Append, or replace only the partitions that ``df`` has."""
    writer = df.write.partitionBy(by)
    if overwrite:
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode("append")
    writer.parquet(path)


def exploit_signals(held: DataFrame, exploits: DataFrame, vulns: DataFrame, now: str) -> DataFrame:
    """Signals to add from exploit rows: the earliest of each CVE and kind, of known items, unless (item, kind, source) is held."""
    rows = exploit_summary(exploits).join(vulns.select("cve_id", "vuln_id"), "cve_id")
    at = lambda c: F.coalesce(F.col(c).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"))
    kinds = F.array(
        F.struct(F.lit("poc_exploitdb").alias("signal_type"), at("first_date").alias("observed_at")),
        F.when(F.col("msf"), F.struct(F.lit("metasploit").alias("signal_type"), at("msf_date").alias("observed_at"))),
    )
    new = rows.select("vuln_id", F.explode(F.array_compact(kinds)).alias("s")).select("vuln_id", "s.signal_type", "s.observed_at", F.lit(True).alias("value_bool"), F.lit("exploitdb").alias("source"))
    return missing_rows(held, new, ["vuln_id", "signal_type", "source"])


def label_rows(held: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """The label table after a run: new rows join unless (item, policy) is there; with ``overwrite`` they replace the rows of their policies."""
    if overwrite:
        return held.join(new.select("policy").distinct(), "policy", "left_anti").select(*held.columns).unionByName(new)
    return held.unionByName(missing_rows(held, new, ["vuln_id", "policy"]))


def snapshot_rows(held: DataFrame, features: DataFrame, asof: str, version: str = "v1") -> DataFrame:
    """Snapshots to add: features with asof and version, unless (item, asof, version) is held."""
    rows = features.withColumns({"asof": F.lit(asof).cast("date"), "version": F.lit(version)})
    return missing_rows(held, rows, ["vuln_id", "asof", "version"])


def vex_rows(statements: DataFrame, vulns: DataFrame, now: str) -> DataFrame:
    """Statements (cve_id, ...) as rows by item for an append; unknown CVEs drop out, no asset is named."""
    rows = ingest_signals(statements, vulns)
    return rows.withColumns({"asset_id": F.lit(None).cast("long"), "observed_at": F.lit(now).cast("timestamp_ntz")})


def vector_payload(df: DataFrame, key: str, vector: str, texts: dict[str, int]) -> DataFrame:
    """id, vector and the payload columns cut to their lengths: one row per key (the last by content), as an upsert needs."""
    cut = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), *[F.substring(c, 1, n).alias(c) for c, n in texts.items()])
    rest = F.struct(*[c for c in cut.columns if c != "id"])
    return cut.groupBy("id").agg(F.max(rest).alias("r")).select("id", "r.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a row."""
    df.write.mode("overwrite").json(path)


#: Schemas of the observation tables, for tables that are created empty.
SCHEMAS = {
    "vulnerability": "vuln_id long, source string, cve_id string, vuldb_id string, published_at timestamp_ntz, title string, description string, cvss_version string, cvss_vector string, cvss_base_score double, cwe_ids array<string>, references array<struct<url:string,source:string>>, affected_products array<struct<vendor:string,product:string,version:string,cpe:string>>",
    "signal": "vuln_id long, signal_type string, observed_at timestamp_ntz, value_num double, value_bool boolean, value_text string, source string, evidence_ref string",
    "label": "vuln_id long, policy string, label_value int, label_asof timestamp_ntz, rationale string",
    "snapshot": "vuln_id long, asof date, version string, features string",
    "prediction": "vuln_id long, model string, version string, predicted_at timestamp_ntz, p double",
    "asset": "asset_id long, name string, asset_type string, environment string, criticality string, owner string, internet_facing boolean, network_zone string, tags map<string,string>",
    "software": "asset_id long, vendor string, product string, version string, cpe string, purl string, observed_at timestamp_ntz, confidence double, source string",
    "vex": "vuln_id long, asset_id long, vendor string, product string, status string, justification string, observed_at timestamp_ntz, source string",
    "reachability": "asset_id long, vuln_id long, reachability_type string, is_reachable boolean, confidence double, evidence_detail string, tool string, observed_at timestamp_ntz",
    "control": "asset_id long, vuln_id long, control_type string, control_name string, is_active boolean, effectiveness double, evidence_detail string, observed_at timestamp_ntz, source string",
    "decision": "asset_id long, vuln_id long, action string, confidence double, policy_name string, policy_version string, decided_at timestamp_ntz, sla_deadline timestamp_ntz",
}


def tables(spark: SparkSession, folder: str) -> dict[str, VersionedTable]:
    """Every table of ``SCHEMAS`` in a folder; a table is empty before its first commit."""
    return {name: VersionedTable(spark, f"{folder}/{name}", schema) for name, schema in SCHEMAS.items()}


def create_tables(spark: SparkSession, folder: str) -> None:
    """Every table of ``SCHEMAS`` that has no version yet gets an empty first one."""
    for table in tables(spark, folder).values():
        if table.version() == 0:
            table.append(table.read())


# --- writers: what they add, count and replace ------------------------------------

_OF_EXPLOITS = "source = 'exploitdb' and signal_type in ('poc_exploitdb', 'metasploit')"


def _write(table: VersionedTable, rows: DataFrame, replaced: str | None, dry_run: bool) -> None:
    """Commit ``rows``; in a dry run they are only passed through, which fills their counters."""
    if dry_run:
        rows.write.format("noop").mode("overwrite").save()
    elif replaced:
        table.replace(replaced, rows)
    else:
        table.append(rows)


def write_exploit_signals(table: VersionedTable, exploits: DataFrame, vulns: DataFrame, now: str, overwrite: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Adds the signals of exploit rows (see ``exploit_summary``) and counts them in the pass that writes.

    A known item gets poc_exploitdb at its earliest date and, if any exploit is a Metasploit
    module, metasploit at the earliest of those (no date: the poc date, then ``now``),
    unless (item, kind, source) is held.  With ``overwrite`` the rows of earlier runs
    go in the same version.  Counters: poc_inserted, msf_inserted, cves_matched (known items
    among the exploits' CVEs), cves_in_edb, cves_in_db.
    """
    known, in_db = counted(vulns.where("cve_id is not null").groupBy("cve_id").agg(F.max("vuln_id").alias("vuln_id")), cves_in_db=F.count("*"))
    per, in_edb = counted(exploit_summary(exploits), cves_in_edb=F.count("*"))
    met, matched = counted(per.join(known, "cve_id"), cves_matched=F.count("*"))
    at = F.coalesce(F.col("first_date").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"))
    msf_at = F.coalesce(F.col("msf_date").cast("timestamp_ntz"), at)
    none = F.lit(None).cast("string")
    kind = lambda n, when, num, text: F.struct(F.lit(n).alias("signal_type"), when.alias("observed_at"), num.alias("value_num"), text.alias("value_text"))
    kinds = F.array_compact(F.array(
        kind("poc_exploitdb", at, F.col("n").cast("double"), F.concat(F.lit("EDB-IDs: "), "ids")),
        F.when(F.col("msf"), kind("metasploit", msf_at, F.lit(None).cast("double"), F.lit("Metasploit module (via ExploitDB tags)"))),
    ))
    first = F.concat(F.lit("https://www.exploit-db.com/exploits/"), F.substring_index("ids", ",", 1))
    new = met.select("vuln_id", F.explode(kinds).alias("s"), F.coalesce(first, none).alias("evidence_ref")).select(
        "vuln_id", "s.*", F.lit(True).alias("value_bool"), F.lit("exploitdb").alias("source"), "evidence_ref"
    )
    add = new if overwrite else missing_rows(table.read(), new, ["vuln_id", "signal_type", "source"])
    of = lambda n: F.count_if(F.col("signal_type") == n)
    add, inserted = counted(add, poc_inserted=of("poc_exploitdb"), msf_inserted=of("metasploit"))
    _write(table, add, _OF_EXPLOITS if overwrite else None, dry_run)
    out = inserted.values() | matched.values() | in_edb.values() | in_db.values()
    if not in_db.ran:  # nothing to match, so that side was left out
        out["cves_in_db"] = vulns.where("cve_id is not null").select("cve_id").distinct().count()
    return out


def write_labels(table: VersionedTable, labels: DataFrame, policy: str, asof: str, overwrite: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Adds one policy's labels (vuln_id, policy, label_value, rationale) of items that have none of it; ``overwrite`` replaces the policy's rows.

    Counters: total (labels computed for what is not skipped), positive, negative, created
    (0 in a dry run) and skipped.
    """
    own, seen = counted(labels.where(F.col("policy") == policy), n=F.count("*"))
    add = own if overwrite else missing_rows(table.read(), own, ["vuln_id", "policy"])
    add, kept = counted(add, total=F.count("*"), positive=F.count_if(F.col("label_value") == 1))
    at = F.lit(f"{asof} 23:59:59.999999").cast("timestamp_ntz").alias("label_asof")
    _write(table, add.select("vuln_id", "policy", "label_value", at, "rationale"), f"policy = '{policy}'" if overwrite else None, dry_run)
    n, found = seen.values()["n"], kept.values()
    return {"total": found["total"], "positive": found["positive"], "negative": found["total"] - found["positive"], "created": 0 if dry_run else found["total"], "skipped": n - found["total"]}


def write_snapshots(table: VersionedTable, features: DataFrame, asof: str, version: str = "v1") -> tuple[DataFrame, dict[str, int]]:
    """Adds each item's features as one JSON text unless (item, asof, version) is held; returns every row of ``features``, written or not, and the counters."""
    rows = durable(features)
    texts = rows.select("vuln_id", F.lit(asof).cast("date").alias("asof"), F.lit(version).alias("version"), F.to_json(F.struct(*[c for c in rows.columns if c != "vuln_id"]), {"ignoreNullFields": "false"}).alias("features"))
    add, kept = counted(missing_rows(table.read(), texts, ["vuln_id", "asof", "version"]), persisted=F.count("*"))
    _write(table, add, None, False)
    return rows, {"total": rows.count(), "persisted": kept.values()["persisted"]}


def append_components(table: VersionedTable, components: DataFrame, now: str, source: str, confidence: float = 1.0) -> dict[str, int]:
    """Appends an inventory's components (asset_id, vendor, product, version, purl, cpe) as they are; repeated runs add rows again."""
    rows, seen = counted(components.withColumns({"observed_at": F.lit(now).cast("timestamp_ntz"), "confidence": F.lit(confidence), "source": F.lit(source)}), appended=F.count("*"))
    table.append(rows)
    return seen.values()


def append_vex(table: VersionedTable, statements: DataFrame, vulns: DataFrame, now: str, source: str) -> dict[str, int]:
    """Appends statements of known items; unknown CVEs are counted and dropped, and no asset is named."""
    given, every = counted(statements, statements=F.count("*"))
    rows = vex_rows(given, vulns, now)
    wanted = {"vendor": "unknown", "product": None, "justification": None, "source": source}
    rows = rows.withColumns({c: F.lit(v).cast("string") for c, v in wanted.items() if c not in rows.columns})
    rows, seen = counted(rows, appended=F.count("*"))
    table.append(rows)
    n = every.values() | seen.values()
    return n | {"unknown": n["statements"] - n["appended"]}
