"""Domain tables derived from the star schema: the same SQL for Spark and for the oracle.

``view(spark, sf_dir, name)`` gives a DataFrame, ``oracle(body, *names)`` a statement
with the views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: As-of date of all point-in-time queries (a parameter of every operator).
ASOF = "2024-01-20"

_MATERIAL = "concat(lower(p_type),'_',cast(p_partkey%50 as varchar(8)))"
_SEEN = "l_shipdate + interval '8400' day"

VIEWS: dict[str, tuple[str, str]] = {
    # name: (tables, SQL with {table} and {ts} for a timestamp literal without time zone)
    "b_vuln": ("part", f"""
select p_partkey vuln_id, concat('CVE-2024-', cast(p_partkey as varchar(12))) cve_id, p_name title, lower(p_brand) vendor,
  {_MATERIAL} product, p_size/5e0 cvss_base_score,
  case when p_partkey%17=0 then null else {{ts}}'2024-01-01 00:00:00' + (p_partkey%40)*interval '1' day end published_at,
  case p_partkey%3 when 0 then '3.1' when 1 then '3.0' end cvss_version,
  case p_partkey%8 when 0 then null when 1 then 'not-a-cvss-vector' when 2 then 'CVSS:3.0/AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:L/A:N'
    when 3 then ' CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' when 4 then 'CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H'
    when 5 then 'CVSS:3.1/AV:N/AC:L' when 6 then 'CVSS:3.1/AV:N/AV:N/AC:L/PR:L/UI:N/S:C/C:L/I:L/A:N'
    else 'cvss:3.1/av:N/AC:L/PR:L/UI:N/S:C/C:L/I:N/A:H/E:P' end cvss_vector,
  case p_partkey%6 when 0 then null when 1 then 'CWE-79' when 2 then 'CWE-89,CWE-20' when 3 then 'CWE-9999,CWE-79,CWE-79'
    when 4 then 'CWE-787,CWE-416,CWE-918' else 'CWE-352' end cwe_list,
  case p_partkey%7 when 0 then null when 1 then 'Remote code execution in Acme Server before 2.4.1 allows remote attackers to run code.'
    when 2 then 'This issue does not affect the default build.' when 3 then 'SQL injection vulnerability in Foo Portal through 1.2 lets authenticated users read data; fixed in 1.3.0.'
    when 4 then 'Local user privilege escalation when configured with a non-default option; disable the module as a workaround.'
    when 5 then '  Denial of   service via crafted packets, upgrade to 9.9.9 ' else 'Cross-site scripting where a user must click a link' end description
from {{part}}"""),
    "b_signal": ("events", """
select event_id id, user_id vuln_id, case event_type when 'error' then 'kev' when 'purchase' then 'poc_exploitdb' when 'signup' then 'metasploit'
  when 'click' then 'epss' else 'other' end signal_type, ts observed_at, value>200 value_bool, least(value/500,1e0) value_num from {events}"""),
    "b_asset": ("supplier", """
select s_suppkey asset_id, case s_suppkey%5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' end criticality,
  s_acctbal>5000 internet_facing from {supplier}"""),
    "b_sbom": ("lineitem part", f"""
select l_suppkey asset_id, lower(p_brand) vendor, {_MATERIAL} product, case when l_discount=0 then null else round(1-l_discount*5,2) end confidence,
  {_SEEN} observed_at from {{lineitem}} join {{part}} on p_partkey=l_partkey where l_linenumber=1"""),
    "b_reach": ("lineitem", f"""
select l_suppkey asset_id, l_partkey vuln_id, case l_linenumber%3 when 0 then 'network' when 1 then 'code_path' else 'configuration' end reachability_type,
  l_linestatus='O' is_reachable, round(l_discount*10,2) confidence, {_SEEN} observed_at,
  l_orderkey*1000+l_linenumber*100+cast(l_quantity as int) ord, l_extendedprice price from {{lineitem}} where l_returnflag='R'"""),
    "b_control": ("lineitem", f"""
select l_suppkey asset_id, case when l_tax=0 and l_linenumber=7 then null else l_partkey end vuln_id,
  case l_linenumber%5 when 0 then 'waf' when 1 then 'edr' when 2 then 'ips' when 3 then 'network_segmentation' else 'acl' end control_type,
  l_linestatus='F' is_active, case when l_discount=0 then null else round(l_discount*10,2) end effectiveness, {_SEEN} observed_at
from {{lineitem}} where l_returnflag='A'"""),
    "b_vex": ("lineitem", f"""
select l_partkey vuln_id, case when l_tax=0 then null else l_suppkey end asset_id, case l_linenumber%5 when 0 then 'not_affected' when 1 then 'affected'
  when 2 then 'fixed' when 3 then 'under_investigation' else 'other' end status, {_SEEN} observed_at,
  l_orderkey*1000+l_linenumber*100+cast(l_quantity as int) ord, l_extendedprice price from {{lineitem}} where l_returnflag='N' and l_quantity<10"""),
    "b_pair": ("lineitem", "select distinct l_suppkey asset_id, l_partkey vuln_id from {lineitem}"),
    "b_score": ("labels documents", """
select d.doc_id, l.toxic y, n_chars, (n_chars%100)/100e0 p1, (d.doc_id*7%50)/50e0 p2, ((d.doc_id*13+n_chars)%20)/20e0 p3
from {labels} l join {documents} d on d.doc_id=l.doc_id"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
    return spark.sql(sql.replace("{ts}", "timestamp_ntz"), **frames)


def oracle(body: str, *names: str) -> str:
    ctes = []
    for n in names:
        tables, sql = VIEWS[n]
        ctes.append(f"{n} as ({sql.replace('{ts}', 'timestamp ').format(**{t: t for t in tables.split()})})")
    return f"with {', '.join(ctes)} {body}" if ctes else body
