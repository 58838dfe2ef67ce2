"""Readers and normalisers of the input formats, each with an explicit schema and no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.core import safe_double

#: Short names of weaknesses, for titles.
CWE_SHORT_NAMES = {
    "CWE-77": "Command Injection", "CWE-78": "OS Command Injection", "CWE-79": "Cross-Site Scripting (XSS)", "CWE-89": "SQL Injection",
    "CWE-94": "Code Injection", "CWE-119": "Buffer Overflow", "CWE-120": "Buffer Overflow", "CWE-121": "Stack Buffer Overflow",
    "CWE-122": "Heap Buffer Overflow", "CWE-125": "Out-of-Bounds Read", "CWE-190": "Integer Overflow", "CWE-200": "Information Disclosure",
    "CWE-269": "Improper Privilege Management", "CWE-284": "Access Control", "CWE-287": "Authentication Bypass", "CWE-306": "Missing Authentication",
    "CWE-352": "Cross-Site Request Forgery (CSRF)", "CWE-362": "Race Condition", "CWE-400": "Resource Exhaustion", "CWE-416": "Use After Free",
    "CWE-434": "Unrestricted File Upload", "CWE-476": "NULL Pointer Dereference", "CWE-502": "Deserialization", "CWE-522": "Weak Credentials",
    "CWE-611": "XML External Entity (XXE)", "CWE-613": "Insufficient Session Expiration", "CWE-668": "Exposure of Resource",
    "CWE-732": "Incorrect Permission Assignment", "CWE-787": "Out-of-Bounds Write", "CWE-798": "Hard-coded Credentials",
    "CWE-862": "Missing Authorization", "CWE-863": "Incorrect Authorization", "CWE-918": "Server-Side Request Forgery (SSRF)", "CWE-1321": "Prototype Pollution",
}

RECORD = """
id string, vuldb_id string, cve_id string, cve string, title string, name string, description string, summary string,
published_at string, publish_date string, date_published string,
cvss3 struct<version:string,vectorString:string,baseScore:string>, cvss struct<version:string,vectorString:string,baseScore:string>,
cwe_ids array<string>, references array<struct<url:string,source:string>>, ext_references array<struct<url:string,source:string>>,
affected_products array<struct<vendor:string,product:string,version:string>>, products array<struct<vendor:string,product:string,version:string>>,
signals struct<epss_score:string,kev_flag:boolean,poc_exploitdb:boolean,metasploit_module:boolean>
"""
NVD = """
totalResults int, vulnerabilities array<struct<cve:struct<id:string,vulnStatus:string,published:string,lastModified:string,
descriptions:array<struct<lang:string,value:string>>,
metrics:struct<cvssMetricV31:array<struct<type:string,cvssData:struct<vectorString:string,baseScore:double>>>,
cvssMetricV30:array<struct<type:string,cvssData:struct<vectorString:string,baseScore:double>>>,
cvssMetricV40:array<struct<type:string,cvssData:struct<vectorString:string,baseScore:double>>>,
cvssMetricV2:array<struct<type:string,cvssData:struct<vectorString:string,baseScore:double>>>>,
weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,
references:array<struct<url:string,source:string,tags:array<string>>>,
configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,
cisaVulnerabilityName:string>>>
"""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array (or one object) per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def _some(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def iso_time(text: Column) -> Column:
    """ISO time with or without a trailing Z; null if it is none."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def normalise_records(raw: DataFrame) -> DataFrame:
    cvss = lambda f: F.coalesce(F.col("cvss3")[f], F.col("cvss")[f])
    off = F.lit(False)
    refs = F.coalesce("references", "ext_references")
    return raw.select(
        _some("vuldb_id", "id").alias("vuldb_id"), _some("cve_id", "cve").alias("cve_id"), _some("title", "name").alias("title"),
        F.coalesce(_some("description", "summary"), F.lit("")).alias("description"),
        iso_time(_some("published_at", "publish_date", "date_published")).alias("published_at"),
        F.coalesce(F.nullif(cvss("version"), F.lit("")), F.lit("3.1")).alias("cvss_version"), cvss("vectorString").alias("cvss_vector"),
        safe_double(cvss("baseScore")).alias("cvss_base_score"), F.coalesce("cwe_ids", F.array().cast("array<string>")).alias("cwe_ids"),
        F.transform(refs, lambda r: F.struct(r["url"].alias("url"), F.coalesce(r["source"], F.lit("unknown")).alias("source"))).alias("references"),
        F.coalesce("affected_products", "products").alias("products"), safe_double(F.col("signals.epss_score")).alias("epss_score"),
        *[F.coalesce(F.col(f"signals.{n}"), off).alias(n) for n in ("kev_flag", "poc_exploitdb", "metasploit_module")],
    )


def parse_cpe(cpe: Column) -> Column:
    """struct(vendor, product, version) of a CPE 2.3 name; null with fewer than six parts."""
    parts = F.split(cpe, ":")
    at = lambda i: F.get(parts, F.lit(i))
    clean = lambda x: F.translate(x, "_", " ")
    return F.when(F.size(parts) >= 6, F.struct(clean(at(3)).alias("vendor"), clean(at(4)).alias("product"), F.when(at(5) == "*", "all").otherwise(at(5)).alias("version")))


def title(named: Column, cve_id: Column, vendor: Column, product: Column, cwes: Column, description: Column) -> Column:
    """Given name, else vendor, product and weakness, else the description's first sentence (at most 120), else the id."""
    names = F.create_map(*[F.lit(x) for kv in CWE_SHORT_NAMES.items() for x in kv])
    cwe = F.get(F.filter(F.transform(cwes, lambda c: names[c]), lambda n: n.isNotNull()), F.lit(0))
    both = F.when((vendor != "") & (product != ""), F.concat_ws(" ", F.initcap(vendor), F.initcap(product), cwe, F.lit("Vulnerability")))
    sentence = F.nullif(F.substring_index(description, ".", 1), F.lit(""))
    short = F.when(F.length(sentence) > 120, F.concat(F.substring(sentence, 1, 117), F.lit("..."))).otherwise(sentence)
    return F.coalesce(F.nullif(named, F.lit("")), both, short, cve_id)


def normalise_nvd(pages: DataFrame) -> DataFrame:
    """One row per CVE of the REST pages; rows without id and rejected ones drop out."""
    df = pages.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*").where("id is not null and upper(coalesce(vulnStatus, '')) <> 'REJECTED'")
    english = lambda xs: F.filter(xs, lambda d: d["lang"] == "en")
    first = lambda xs: F.get(xs, F.lit(0))
    fine = lambda m: m["cvssData"]["vectorString"].isNotNull() | (F.coalesce(m["cvssData"]["baseScore"], F.lit(0.0)) != 0)

    def pick(version: str, field: str) -> Column:
        m = F.col(f"metrics.{field}")
        best = F.coalesce(first(F.filter(m, lambda x: x["type"] == "Primary")), first(m))
        return F.when(fine(best), F.struct(F.lit(version).alias("version"), best["cvssData"]["vectorString"].alias("vector"), F.nullif(best["cvssData"]["baseScore"], F.lit(0.0)).alias("score")))

    cvss = F.coalesce(pick("3.1", "cvssMetricV31"), pick("3.0", "cvssMetricV30"), pick("4.0", "cvssMetricV40"), pick("2.0", "cvssMetricV2"))
    weak = F.flatten(F.transform("weaknesses", lambda w: F.transform(english(w["description"]), lambda d: d["value"])))
    cwes = F.array_sort(F.array_distinct(F.filter(weak, lambda c: c.startswith("CWE-") | c.startswith("NVD-CWE"))))
    cpes = F.flatten(F.transform("configurations", lambda c: F.flatten(F.transform(c["nodes"], lambda n: n["cpeMatch"]))))
    names = F.array_distinct(F.transform(F.filter(cpes, lambda m: m["vulnerable"]), lambda m: m["criteria"]))
    products = F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), parse_cpe))
    text = F.coalesce(first(english(F.col("descriptions")))["value"], first(F.col("descriptions"))["value"], F.lit(""))
    df = df.withColumns({"cvss": cvss, "cwe_ids": F.coalesce(cwes, F.array().cast("array<string>")), "products": products, "description": text})
    p = first(F.col("products"))
    return df.select(
        F.col("id").alias("cve_id"), title(F.col("cisaVulnerabilityName"), F.col("id"), p["vendor"], p["product"], F.col("cwe_ids"), F.col("description")).alias("title"),
        "description", iso_time(F.col("published")).alias("published_at"), F.col("cvss.version").alias("cvss_version"), F.col("cvss.vector").alias("cvss_vector"),
        F.col("cvss.score").alias("cvss_base_score"), "cwe_ids", "references", "products",
    )


def date_chunks_of(ends: DataFrame, days: int = 120) -> DataFrame:
    """chunk_start, chunk_end: request windows of at most ``days`` days for each (a, b); an empty or one-day range has none."""
    steps = F.sequence("a", F.greatest(F.date_sub("b", 1), "a"), F.expr(f"interval {days} day"))
    return ends.select(F.explode(F.when(F.col("a") < F.col("b"), steps)).alias("chunk_start"), "b").select(
        "chunk_start", F.least(F.date_add("chunk_start", days - 1), "b").alias("chunk_end")
    )


def date_chunks(spark: SparkSession, start: str, end: str, days: int = 120) -> DataFrame:
    return date_chunks_of(spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b")), days)


def kev_signals(catalogue: DataFrame) -> DataFrame:
    """cve_id, observed_at, value_bool of a catalogue (vulnerabilities array of cveID, dateAdded)."""
    return catalogue.select(F.explode("vulnerabilities").alias("v")).select(
        F.col("v.cveID").alias("cve_id"), F.lit("kev").alias("signal_type"), iso_time(F.col("v.dateAdded")).alias("observed_at"), F.lit(True).alias("value_bool")
    )


def epss_signals(pages: DataFrame, asof: str) -> DataFrame:
    return pages.select(F.explode("data").alias("d")).select(
        F.col("d.cve").alias("cve_id"), F.lit("epss").alias("signal_type"), F.lit(asof).cast("timestamp_ntz").alias("observed_at"),
        safe_double(F.col("d.epss")).alias("value_num"), F.col("d.percentile").alias("value_text"),
    )


def attack_patterns(bundle: DataFrame) -> DataFrame:
    """technique_id, name, description, tactics of a STIX bundle's live attack patterns; of repeated ids the last name wins."""
    o = F.col("o")
    ids = F.get(F.filter(o["external_references"], lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    off = F.lit(False)
    live = (o["type"] == "attack-pattern") & ~F.coalesce(o["revoked"], off) & ~F.coalesce(o["x_mitre_deprecated"], off)
    tactics = F.transform(F.filter(o["kill_chain_phases"], lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    rows = bundle.select(F.posexplode("objects").alias("pos", "o")).where(live & ids.isNotNull())
    last = F.max_by(F.struct(o["name"].alias("name"), o["description"].alias("description"), tactics.alias("tactics")), "pos").alias("r")
    return rows.groupBy(ids.alias("technique_id")).agg(last).select("technique_id", "r.name", "r.description", "r.tactics")


def exploit_rows(csv: DataFrame) -> DataFrame:
    """One row per CVE id named in an exploit's codes (repeats stay)."""
    codes = F.regexp_extract_all("codes", F.lit(r"CVE-\d{4}-\d+"), F.lit(0))
    return csv.select(
        F.col("id").alias("exploit_id"), F.explode(codes).alias("cve_id"), F.substring("description", 1, 500).alias("description"),
        F.col("date_published").try_cast("date").alias("published"), F.lower(F.coalesce("tags", F.lit(""))).contains("metasploit").alias("msf"),
    )


def cyclonedx_components(sbom: DataFrame) -> DataFrame:
    c = F.col("c")
    cpe = F.get(F.filter(c["properties"], lambda p: p["name"].contains("cpe")), F.lit(0))["value"]
    vendor = F.coalesce(F.nullif(c["group"], F.lit("")), F.nullif(c["publisher"], F.lit("")), F.lit("unknown"))
    return sbom.select(F.explode("components").alias("c")).select(vendor.alias("vendor"), c["name"].alias("product"), c["version"].alias("version"), c["purl"].alias("purl"), cpe.alias("cpe"))


def spdx_packages(sbom: DataFrame) -> DataFrame:
    p = F.col("p")
    last = lambda kind: F.try_element_at(F.filter(p["externalRefs"], lambda r: r["referenceType"].contains(kind)), F.lit(-1))["referenceLocator"]
    vendor = F.coalesce(F.nullif(p["supplier"], F.lit("")), F.nullif(p["originator"], F.lit("")), F.lit("unknown"))
    return sbom.select(F.explode("packages").alias("p")).select(vendor.alias("vendor"), p["name"].alias("product"), p["versionInfo"].alias("version"), last("purl").alias("purl"), last("cpe").alias("cpe"))


def openvex_statements(doc: DataFrame) -> DataFrame:
    """A row per statement and product: products as strings or as structs with ``@id``, vulnerabilities as strings or with a name."""
    kind = doc.schema["statements"].dataType.elementType
    s, plain = F.col("s"), lambda f: kind[f].dataType.simpleString() == "string"
    product = F.col("product") if kind["products"].dataType.elementType.simpleString() == "string" else F.col("product").getField("@id")
    rows = doc.select(F.explode("statements").alias("s")).select(
        (s["vulnerability"] if plain("vulnerability") else s["vulnerability"]["name"]).alias("cve_id"), F.explode(s["products"]).alias("product"),
        s["status"].alias("status"), s["justification"].alias("justification"),
    )
    return rows.select("cve_id", product.alias("product"), F.lit("unknown").alias("vendor"), "status", "justification")


#: Product status to statement status.
CSAF_STATUS = {"known_not_affected": "not_affected", "known_affected": "affected", "fixed": "fixed", "first_fixed": "fixed", "under_investigation": "under_investigation"}


def csaf_statements(doc: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in CSAF_STATUS.items() for x in kv])
    rows = doc.select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cve").alias("cve_id"), F.explode("v.product_status").alias("s", "ids"))
    return rows.select("cve_id", F.explode("ids").alias("product"), F.coalesce(names[F.col("s")], F.lit("under_investigation")).alias("status"))
