"""All queries of the engine with their SQL twins: name -> (query, oracle or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import core
from vigil.operators import assets, audit, dashboard, experiments, metrics, models, signals, sinks, tables, text
from vigil.sources import feeds, recorded
from vigil.sources.bindings import ASOF, oracle, view
from vigil.streaming import signal_log

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
LAYERS = ("b_asset", "b_vuln", "b_signal", "b_sbom", "b_vex", "b_reach", "b_control")
STREAMS = ["p1", "p2", "p3"]


def query(name: str, sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        REGISTRY[name] = (f, oracle(sql, *views) if sql else None)
        return f

    return add


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run alone, where all executors reach it."""
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def layer_args(spark: SparkSession, sf: str, names: tuple[str, ...]) -> list[DataFrame]:
    return [view(spark, sf, n) for n in names]


# --- dashboard ---------------------------------------------------------------

@query("l03_top_risk", """, s as (select vuln_id, max(value_num) epss from b_signal where signal_type='epss' group by 1)
select v.vuln_id, cvss_base_score, round(epss,4) epss_score, round(cvss_base_score*case when coalesce(epss,0)=0 then 0.01e0 else epss end,3) risk_score, published_at
from b_vuln v left join s using(vuln_id) where cvss_base_score is not null order by cvss_base_score*coalesce(epss,0.01e0) desc, v.vuln_id limit 10""", "b_vuln", "b_signal")
def l03(spark, sf):
    return dashboard.top_risk(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"))


@query("q06_stats", f"""select * from (select count(*) total, count(*) filter(cvss_base_score>=9) critical, count(*) filter(cvss_base_score>=7 and cvss_base_score<9) high,
count(*) filter(cvss_base_score>=4 and cvss_base_score<7) medium, count(*) filter(cvss_base_score>0 and cvss_base_score<4) low,
count(*) filter(published_at >= timestamp '{ASOF}' - interval 30 day) recent from b_vuln),
(select count(distinct vuln_id) filter(signal_type='kev') kev, count(distinct vuln_id) filter(signal_type in ('poc_exploitdb','metasploit')) poc_available,
nullif(round(avg(value_num) filter(signal_type='epss'),4),0) avg_epss from b_signal)""", "b_vuln", "b_signal")
def q06(spark, sf):
    return dashboard.stats(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), ASOF)


@query("a11_yearly", "select year(published_at) \"year\", count(*) n from b_vuln where published_at is not null group by 1", "b_vuln")
def a11(spark, sf):
    return dashboard.yearly(view(spark, sf, "b_vuln"))


@query("p16_severity", """select case when cvss_base_score>=9 then 'critical' when cvss_base_score>=7 then 'high' when cvss_base_score>=4 then 'medium'
when cvss_base_score is not null then 'low' else 'N/A' end severity, count(*) n from b_vuln group by 1""", "b_vuln")
def p16(spark, sf):
    return view(spark, sf, "b_vuln").groupBy(core.severity(F.col("cvss_base_score")).alias("severity")).agg(F.count("*").alias("n"))


@query("q03_list_search", """select vuln_id, cve_id, cvss_base_score from b_vuln where (cve_id ilike '%SQL%' or title ilike '%SQL%' or description ilike '%SQL%')
and cvss_base_score between 3 and 9.5 order by cvss_base_score desc nulls first, vuln_id limit 25 offset 25""", "b_vuln")
def q03_search(spark, sf):
    return dashboard.listing(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), search="SQL", low=3.0, high=9.5, sort="cvss_base_score", page=2, per_page=25).select("vuln_id", "cve_id", "cvss_base_score")


@query("q03_list_kev", """select vuln_id, published_at from b_vuln where vuln_id in (select vuln_id from b_signal where signal_type='kev')
order by published_at desc nulls first, vuln_id limit 20""", "b_vuln", "b_signal")
def q03_kev(spark, sf):
    return dashboard.listing(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), has_kev=True).select("vuln_id", "published_at")


@query("q03_list_not_kev", """select vuln_id, published_at from b_vuln v where not exists (select 1 from b_signal s where s.vuln_id=v.vuln_id and signal_type='kev')
order by published_at asc nulls last, vuln_id limit 50""", "b_vuln", "b_signal")
def q03_not_kev(spark, sf):
    return dashboard.listing(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), has_kev=False, descending=False, per_page=50).select("vuln_id", "published_at")


@query("q02_resolve", "select vuln_id, cve_id from b_vuln where cve_id='CVE-2024-7'", "b_vuln")
def q02(spark, sf):
    return dashboard.resolve(view(spark, sf, "b_vuln"), "CVE-2024-7").select("vuln_id", "cve_id")


@query("a09_exploit_coverage", "select signal_type, count(distinct vuln_id) items, count(*) n from b_signal where signal_type in ('kev','poc_exploitdb','metasploit') group by 1", "b_signal")
def a09(spark, sf):
    return dashboard.exploit_coverage(view(spark, sf, "b_signal"))


# --- features ----------------------------------------------------------------

_CVSS = """, parts as (select vuln_id, trim(cvss_vector) t, regexp_extract(trim(cvss_vector), '(?i)^CVSS:3\\.[01]/(.+)$', 1) body from b_vuln),
pairs as (select vuln_id, t, body, unnest(string_split(body,'/')) p, unnest(range(1, len(string_split(body,'/'))+1)) i from parts where body<>''),
kv as (select *, upper(string_split(p,':')[1]) k, string_split(p,':')[2] v, len(string_split(p,':')) n from pairs),
known as (select *, k in ('AV','AC','PR','UI','S','C','I','A') kn,
 (k||':'||v) in ('AV:N','AV:A','AV:L','AV:P','AC:L','AC:H','PR:N','PR:L','PR:H','UI:N','UI:R','S:C','S:U','C:H','C:L','C:N','I:H','I:L','I:N','A:H','A:L','A:N') ok,
 row_number() over(partition by vuln_id, k order by i) rn from kv),
errs as (select vuln_id, case when n<>2 then 'component' when kn and rn>1 then 'duplicate' when kn and not ok then 'value' end e, i from known),
firsts as (select vuln_id, arg_min(e, i) filter(e is not null) e from errs group by 1),
counts as (select vuln_id, count(distinct k) filter(kn) nk from known group by 1),
vals as (select vuln_id, """ + ", ".join(
    f"max(case when k='{m}' then case v {' '.join(f'''when '{v}' then {o}''' for v, o in vs.items())} end end) \"{m}\"" for m, vs in core.METRICS.items()
) + """ from known where rn=1 group by 1),
cvss as (select parts.vuln_id, case when t is null or t='' then 'empty' when body='' then 'pattern' when e is not null then e when nk<8 then 'missing' end error,
case when t like '%3.0%' then '3.0' else '3.1' end ver, """ + ", ".join(f'"{m}"' for m in core.METRICS) + """
from parts left join firsts using(vuln_id) left join counts using(vuln_id) left join vals using(vuln_id))"""


@query("p02_cvss_parse", _CVSS + " select vuln_id, error is null as valid, case when error is null then ver end as version, error, "
       + ", ".join(f"cast(case when error is null then \"{m}\" else -1 end as bigint) as \"{m}\"" for m in core.METRICS) + " from cvss", "b_vuln")
def p02(spark, sf):
    parts = core.cvss_parts(F.col("cvss_vector"))
    return view(spark, sf, "b_vuln").select("vuln_id", *[(c.cast("long") if k in core.METRICS else c).alias(k) for k, c in parts.items()])


@query("p08_cwe", ", c as (select vuln_id, cwe_list, unnest(string_split(cwe_list, ',')) w from b_vuln where cwe_list is not null), g as (select vuln_id, case w "
       + " ".join(f"when '{w}' then '{g}'" for w, g in core.CWE_CATEGORIES.items()) + " else 'other' end g from c) select v.vuln_id, "
       + ", ".join(f"cast(coalesce(max(case when g='{g}' then 1 end),0) as double) cwe_{g}" for g in core.CWE_GROUPS)
       + ", cast(coalesce(max(len(string_split(cwe_list, ','))),0) as double) cwe_count from b_vuln v left join g using(vuln_id) group by 1", "b_vuln")
def p08(spark, sf):
    return view(spark, sf, "b_vuln").select("vuln_id", *core.cwe_features(F.split("cwe_list", ",")))


@query("p09_text", """select conv_id, turn, cast(coalesce(length(text),0) as bigint) n_chars,
case when trim(coalesce(text,''), chr(32)||chr(9)||chr(10)||chr(13))='' then 0 else len(regexp_split_to_array(trim(text, chr(32)||chr(9)||chr(10)||chr(13)), '[ \\t\\n\\r]+')) end n_words from conversations""")
def p09(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    return df.select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), core.word_count(F.col("text")).alias("n_words"))


_PIVOT = """select vuln_id, coalesce(bool_or(signal_type='kev' and coalesce(value_bool,false)),false) kev, coalesce(bool_or(signal_type='poc_exploitdb' and coalesce(value_bool,false)),false) poc,
coalesce(bool_or(signal_type='metasploit' and coalesce(value_bool,false)),false) msf,
arg_max(value_num, (cast(observed_at as date), id)) filter(signal_type='epss') epss_latest, max(value_num) filter(signal_type='epss') epss_max from b_signal where {test} group by 1"""
_MODES = {"date": f"cast(observed_at as date) <= date '{ASOF}'", "end_of_day": f"observed_at <= timestamp '{ASOF} 23:59:59.999999'", "midnight": f"observed_at <= timestamp '{ASOF} 00:00:00'"}


@query("a01_signal_pivot", " union all ".join(f"select '{m}' mode, * from ({_PIVOT.format(test=t)})" for m, t in _MODES.items()), "b_signal")
def a01(spark, sf):
    s = view(spark, sf, "b_signal")
    parts = [signals.signal_pivot(signals.asof_filter(s, ASOF, m)).select(F.lit(m).alias("mode"), "*") for m in _MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d16_features", _CVSS + f", sig as ({_PIVOT.format(test=_MODES['date'])})" + """, f as (select v.*, error, "AV","AC","PR","UI","S","C","I","A", coalesce(kev,false)::int::double kv, coalesce(poc,false)::int::double pc,
coalesce(msf,false)::int::double ms, coalesce(epss_latest,0) ep, coalesce(date_diff('day', cast(published_at as date), date '""" + ASOF + """'),0)::double age
from b_vuln v join cvss using(vuln_id) left join sig using(vuln_id))
select vuln_id, coalesce(cvss_base_score,0) cvss_base_score, (coalesce(cvss_version,'')='3.1')::int::double cvss_version_31, case when error is null then "AV"::double else 0e0 end cvss_attack_vector,
case when error is null then ("C"+"I"+"A")::double else 0e0 end cvss_cia_total, case when error is null then ("PR"=2)::int::double else 0e0 end cvss_no_privs, age days_since_published, ep epss_score,
kv kev_flag, kv+pc+ms exploit_signal_count, case when pc=1 and published_at is not null then age else -1e0 end days_since_poc, length(coalesce(description,''))::double description_length,
case when trim(coalesce(description,''))='' then 0e0 else len(regexp_split_to_array(trim(description),'\\s+'))::double end description_word_count,
round(0.25e0*coalesce(cvss_base_score,0)/10+0.30e0*ep+0.15e0*kv+0.15e0*pc+0.10e0*ms+0.05e0*least((kv+pc+ms)/3,1e0),4) composite_exploit_score from f""", "b_vuln", "b_signal")
def d16(spark, sf):
    df = signals.vulnerability_features(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), ASOF)
    return df.select(
        "vuln_id", "cvss_base_score", "cvss_version_31", "cvss_attack_vector", "cvss_cia_total", "cvss_no_privs", "days_since_published", "epss_score", "kev_flag",
        "exploit_signal_count", "days_since_poc", "description_length", "description_word_count", "composite_exploit_score",
    )


# --- labels ------------------------------------------------------------------

_KNOWN = f"known as (select * from b_signal where {_MODES['end_of_day']})"


def _label_sql(policy: str) -> str:
    if policy == "epss_derived":
        return f""", {_KNOWN}, s as (select vuln_id, coalesce(bool_or(signal_type='kev' and value_bool),false) kev, max(value_num) filter(signal_type='epss') epss,
list_sort(list(id) filter(signal_type='kev' and value_bool) || [arg_max(id, (value_num, id)) filter(signal_type='epss')]) ids from known group by 1)
select v.vuln_id, '{policy}' as policy, coalesce(kev and epss>=0.15, false)::int::bigint label_value, case when kev and epss>=0.15 then 'epss,kev' else '' end rationale,
case when kev and epss>=0.15 then list_aggregate(ids, 'string_agg', ',') else '' end contributors from b_vuln v left join s using(vuln_id)"""
    kinds = ",".join(f"'{k}'" for k in sorted(signals.POLICIES[policy].positive))
    extra = " and published_at is not null and observed_at <= least(published_at + interval 90 day, timestamp '" + ASOF + " 23:59:59.999999')" if policy == "temporal_first_exploit" else ""
    return f""", {_KNOWN}, s as (select k.vuln_id, string_agg(distinct signal_type, ',' order by signal_type) types, string_agg(id::varchar, ',' order by id) ids
from known k join b_vuln v using(vuln_id) where value_bool and signal_type in ({kinds}){extra} group by 1)
select v.vuln_id, '{policy}' as policy, (ids is not null)::int::bigint label_value, coalesce(types,'') rationale, coalesce(ids,'') contributors from b_vuln v left join s using(vuln_id)"""


def _labels(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    return signals.build_labels(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), policy, ASOF).withColumn("label_value", F.col("label_value").cast("long"))


for _n, _p in (("d02", "kev_strict"), ("d03", "temporal_first_exploit"), ("d04", "composite_no_leak"), ("d05", "epss_derived")):
    query(f"{_n}_{_p}", _label_sql(_p), "b_vuln", "b_signal")(lambda spark, sf, p=_p: _labels(spark, sf, p))


@query("d07_legacy_labels", """, l as (select vuln_id, arg_max(value_bool, id) filter(signal_type='kev') k, arg_max(value_bool, id) filter(signal_type='poc_exploitdb') p,
arg_max(value_bool, id) filter(signal_type='metasploit') m from b_signal group by 1)
select v.vuln_id, (coalesce(k,false) or coalesce(p,false) or coalesce(m,false))::int::bigint label_value from b_vuln v left join l using(vuln_id)""", "b_vuln", "b_signal")
def d07(spark, sf):
    return signals.legacy_labels(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal")).withColumn("label_value", F.col("label_value").cast("long"))


def _all_labels(spark: SparkSession, sf: str) -> DataFrame:
    first, *rest = [_labels(spark, sf, p) for p in signals.POLICIES]
    for r in rest:
        first = first.unionByName(r)
    return first


_ALL_LABELS = ", labels4 as (" + " union all ".join(f"(with {_label_sql(p)[2:]})" for p in signals.POLICIES) + ")"


@query("d08_label_stats", _ALL_LABELS + " select policy, count(*) total, sum(label_value)::bigint positive, (count(*)-sum(label_value))::bigint negative, round(sum(label_value)/count(*),6) positive_rate from labels4 group by 1", "b_vuln", "b_signal")
def d08(spark, sf):
    return signals.label_stats(_all_labels(spark, sf))


@query("d08_label_validation", _ALL_LABELS + """, r as (select policy, sum(label_value)/count(*) rate, case policy """
       + " ".join(f"when '{p}' then '{','.join(sorted(audit.circular_features(p)))}'" for p in signals.POLICIES)
       + """ end circular from labels4 group by 1), w as (select *, case when round(rate,6)>0.20 or (policy='kev_strict' and round(rate,6)>0.05) then 'WARN' else 'PASS' end sanity from r)
select policy, circular, sanity, circular='' and sanity='PASS' passed from w""", "b_vuln", "b_signal")
def d08_validation(spark, sf):
    return audit.label_validation(signals.label_stats(_all_labels(spark, sf)))


@query("d09_label_conflicts", _ALL_LABELS + """ select vuln_id, string_agg(policy||'='||label_value, ',' order by policy||'='||label_value) votes, 'expected' severity
from labels4 group by 1 having count(distinct label_value)>1""", "b_vuln", "b_signal")
def d09(spark, sf):
    return signals.label_conflicts(_all_labels(spark, sf))


# --- assets and decisions ------------------------------------------------------

_AT = f"observed_at <= timestamp '{ASOF}'"
_ORDER = "(observed_at, ord, price, status)"
_EV = f""", sw as (select p.asset_id, p.vuln_id, count(*) n, max(confidence) best from b_pair p join b_vuln v using(vuln_id) join b_sbom s on s.asset_id=p.asset_id and s.vendor=v.vendor and s.product=v.product
where s.{_AT} group by all),
vo as (select asset_id, vuln_id, arg_max(status, {_ORDER}) own, max(case status when 'not_affected' then 0e0 when 'under_investigation' then 0.25e0 when 'fixed' then 0.5e0 when 'affected' then 1e0 else 0.5e0 end) vex
 from b_vex where {_AT} and asset_id is not null group by all),
va as (select vuln_id, arg_max(status, {_ORDER}) other from b_vex where {_AT} group by all),
rc as (select asset_id, vuln_id, arg_max(is_reachable, (observed_at, ord, price, is_reachable, confidence)) reachable, arg_max(coalesce(confidence,-1), (observed_at, ord, price, is_reachable, confidence)) rconf,
 bool_or(reachability_type='network' and is_reachable) network, bool_or(reachability_type='code_path' and is_reachable) code_path from b_reach where {_AT} group by all),
cr as (select p.asset_id, p.vuln_id, control_type, is_active, effectiveness from b_pair p join b_control c on c.asset_id=p.asset_id and (c.vuln_id=p.vuln_id or c.vuln_id is null) where c.{_AT}),
ct as (select asset_id, vuln_id, count(*) controls, count(*) filter(is_active) active, max(effectiveness) filter(is_active) best, avg(coalesce(effectiveness,0.5e0)) filter(is_active) mean,
 bool_or(is_active and control_type='waf') waf, bool_or(is_active and control_type='edr') edr, bool_or(is_active and control_type='ips') ips, bool_or(is_active and control_type='network_segmentation') seg from cr group by all),
sig as ({_PIVOT.format(test=_MODES['midnight'])}),
j as (select p.asset_id, p.vuln_id, a.criticality, a.internet_facing, v.cvss_base_score, v.published_at, sw.n, sw.best sbest, vo.own, vo.vex, va.other, rc.reachable, rc.rconf, rc.network, rc.code_path,
 ct.controls, ct.active, ct.best cbest, ct.mean, ct.waf, ct.edr, ct.ips, ct.seg, sig.kev, sig.poc, sig.msf, sig.epss_max
 from b_pair p join b_asset a using(asset_id) join b_vuln v using(vuln_id) left join sw using(asset_id,vuln_id) left join vo using(asset_id,vuln_id) left join va using(vuln_id)
 left join rc using(asset_id,vuln_id) left join ct using(asset_id,vuln_id) left join sig using(vuln_id))"""
_EVIDENCE = _EV + """, ev as (select asset_id, vuln_id, case when coalesce(own,other) is not null then case coalesce(own,other) when 'not_affected' then 'not_affected' when 'fixed' then 'not_affected'
 when 'affected' then 'affected' when 'under_investigation' then 'under_investigation' else 'unknown' end when n>0 then 'affected' else 'unknown' end affectedness,
 case when reachable then 'reachable' when not reachable then 'unreachable' when internet_facing then 'partially_reachable' else 'unknown' end reachability,
 case when kev then 'active' when poc or msf then 'poc_public' when epss_max>0 then 'theoretical' else 'none' end exploitation,
 case when active>0 then coalesce(cbest,0.5e0) else 0e0 end control_effectiveness, coalesce(criticality,'medium') criticality, coalesce(cvss_base_score,0) cvss, coalesce(epss_max,0) epss from j),
e2 as (select *, case when control_effectiveness>=0.9 then 'fully_mitigated' when control_effectiveness>=0.3 then 'partially_mitigated' else 'no_controls' end control_status from ev)"""
_PAIRS = ("b_pair", *LAYERS)


def _pairs(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The layers; a pair may come more than once, as every operator on them takes the distinct ones."""
    pair = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey asset_id", "l_partkey vuln_id")
    return [pair, *layer_args(spark, sf, ("b_asset", "b_vuln", "b_signal", "b_sbom", "b_vex", "b_reach", "b_control"))]


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return assets.evidence(*_pairs(spark, sf), ASOF)


@query("d17_asset_features", _EV + """ select asset_id, vuln_id, case when n>0 then 1e0 else 0e0 end affected_product_confirmed, coalesce(vex,-1) vex_status_enum, case when n is null then 0e0 else coalesce(sbest,0.8e0) end sbom_match_confidence,
coalesce(network,false)::int::double network_reachable_flag, coalesce(internet_facing,false)::int::double internet_facing_flag, coalesce(code_path,false)::int::double code_path_reachable,
coalesce(waf,false)::int::double has_waf, coalesce(edr,false)::int::double has_edr, coalesce(ips,false)::int::double has_ips, coalesce(seg,false)::int::double has_network_segmentation,
round(coalesce((coalesce(waf,false)::int+coalesce(edr,false)::int+coalesce(ips,false)::int+coalesce(seg,false)::int)::double/4*mean,0)+1e-9,4) control_coverage_score,
case coalesce(criticality,'medium') when 'low' then 0.25e0 when 'medium' then 0.5e0 when 'high' then 0.75e0 when 'critical' then 1e0 else 0.5e0 end asset_criticality_score,
greatest(coalesce(date_diff('day', cast(published_at as date), date '""" + ASOF + """'),0),0)::double days_since_disclosure from j""", *_PAIRS)
def d17(spark, sf):
    pair, asset, vuln, _, sbom, vex, reach, control = _pairs(spark, sf)
    return assets.actionability_features(pair, asset, vuln, sbom, vex, reach, control, ASOF)


@query("d14_asset_labels", _EV + """ select *, (case when affected=1 and weaponised and (reachable=1 or control_gap=1) then 1 else 0 end)::bigint action_required,
round(case when affected=0 and affected_confidence>=0.8 then affected_confidence*0.9e0 when affected=1 and weaponised and (reachable=1 or control_gap=1) then least(affected_confidence,0.85e0)
 when affected=1 and weaponised then 0.6e0 when affected=1 then 0.5e0 else 0.3e0 end,4) action_confidence from (select asset_id, vuln_id,
(case when own='not_affected' then 0 when own in ('affected','under_investigation') then 1 when own is null and other='not_affected' then 0 when own is null and other='affected' then 1 when n>0 then 1 else 0 end)::bigint affected,
round(case when own='not_affected' then 0.95e0 when own in ('affected','under_investigation') then 0.9e0 when own is null and other in ('not_affected','affected') then 0.8e0 when n>0 then coalesce(sbest,0.7e0) else 0.3e0 end,4) affected_confidence,
(case when reachable then 1 when not reachable then 0 when internet_facing then 1 else 0 end)::bigint reachable,
round(case when reachable is not null then case when rconf>=0 then rconf else 0.8e0 end when internet_facing then 0.4e0 else 0.3e0 end,4) reachable_confidence,
(case when controls is null or active=0 then 1 when cbest>=0.9 then 0 when cbest is not null then 1 else 0 end)::bigint control_gap,
round(case when controls is null then 0.5e0 when active=0 then 0.7e0 when cbest>=0.9 then 0.85e0 when cbest is not null then 0.7e0 else 0.4e0 end,4) control_gap_confidence,
coalesce(kev,false) or coalesce(poc,false) or coalesce(msf,false) or coalesce(epss_max>=0.5,false) weaponised from j)""", *_PAIRS)
def d14(spark, sf):
    df = assets.asset_labels(*_pairs(spark, sf), ASOF)
    return df.withColumns({c: F.col(c).cast("long") for c in ("affected", "reachable", "control_gap", "action_required")})


@query("d31_evidence", _EVIDENCE + " select * from e2", *_PAIRS)
def d31(spark, sf):
    return _evidence(spark, sf)


_DECIDE = _EVIDENCE + """, r as (select *, 0.3e0*least(cvss/10,1e0)+0.3e0*epss+0.15e0*least(cvss/10,1e0)+0.15e0*epss+case reachability when 'reachable' then 0.1e0 when 'partially_reachable' then 0.05e0 else 0e0 end b from e2),
r2 as (select *, least(case control_status when 'fully_mitigated' then b*0.3e0 when 'partially_mitigated' then b*(1-0.5e0*control_effectiveness) else b end,1e0) risk, criticality in ('critical','high') vital, control_status='fully_mitigated' fm,
 cvss>=9 or epss>=0.5 sev from r),
d as (select *, case when affectedness='not_affected' then 'accept|0.95' when exploitation='active' and vital and fm then 'patch_window|0.85' when exploitation='active' and vital then 'patch_now|0.95'
 when exploitation='active' and fm then 'monitor|0.8' when exploitation='active' then 'mitigate_now|0.9' when exploitation='poc_public' and sev and vital and reachability='reachable' then 'patch_now|0.85'
 when exploitation='poc_public' and sev and vital then 'mitigate_now|0.8' when exploitation='poc_public' then 'patch_window|0.75' when risk>=0.7 and vital then 'patch_window|0.7' when risk>=0.7 then 'monitor|0.65'
 when risk>=0.3 then 'monitor|0.6' else 'accept|0.7' end ac from r2),
dd as (select *, string_split(ac,'|')[1] as action, cast(string_split(ac,'|')[2] as double) confidence from d)"""


@query("d29_decide", _DECIDE + """ select asset_id, vuln_id, round(risk+1e-9,4) risk, action, confidence, (case action when 'patch_now' then 24 when 'mitigate_now' then 24 when 'patch_window' then 720 when 'monitor' then 2160 else 8760 end)::bigint sla_hours from dd""", *_PAIRS)
def d29(spark, sf):
    return assets.decide_pairs(_evidence(spark, sf)).select("asset_id", "vuln_id", "risk", "action", "confidence", F.col("sla_hours").cast("long").alias("sla_hours"))


@query("d30_distribution", _DECIDE + " select a.action, count(dd.asset_id) n from (values ('patch_now'),('mitigate_now'),('patch_window'),('monitor'),('accept')) a(action) left join dd on dd.action=a.action group by 1", *_PAIRS)
def d30(spark, sf):
    return assets.action_distribution(assets.decide_pairs(_evidence(spark, sf)))


@query("w08_case_studies", _DECIDE + " select asset_id, vuln_id, action, confidence, place from (select *, row_number() over(partition by action order by confidence desc, asset_id, vuln_id) place from dd) where place<=2", *_PAIRS)
def w08(spark, sf):
    return assets.case_studies(assets.decide_pairs(_evidence(spark, sf))).select("asset_id", "vuln_id", "action", "confidence", F.col("place").cast("long").alias("place"))


_SLA = """select o_orderkey, case o_orderkey%5 when 0 then 'patch_now' when 1 then 'mitigate_now' when 2 then 'patch_window' when 3 then 'monitor' else 'accept' end "action", o_orderdate decided_at,
case when o_orderkey%11=0 then null else o_orderdate + (o_orderkey%97)*interval '10' hour end resolved_at from {orders}"""


@query("a17_sla", "with d as (" + _SLA.format(orders="orders") + """), h as (select *, date_diff('second', decided_at, resolved_at)/3600e0 h, case action when 'patch_now' then 24 when 'mitigate_now' then 24 when 'patch_window' then 720 when 'monitor' then 2160 else 8760 end s from d)
select action, count(*) total, count(*) filter(h<=s) compliant, round(count(*) filter(h<=s)/count(*)::double,4) rate, round(avg(h),1) mean_hours, round(quantile_cont(h,0.5),1) median_hours from h group by 1""")
def a17(spark, sf):
    return assets.sla_compliance(spark.sql(_SLA.replace('"action"', "action"), orders=spark.read.parquet(f"{sf}/orders.parquet")))


@query("d06_provenance", f""", c as (select vuln_id, count(*) n, string_agg(signal_type||'@'||id::varchar, ',' order by observed_at, id) signals, min(observed_at) first_seen from b_signal where signal_type='kev' and coalesce(value_bool,false) and observed_at <= timestamp '{ASOF} 23:59:59.999999' group by 1)
select v.vuln_id, (n is not null)::int::bigint label_value, coalesce(n,0) n, coalesce(signals,'') signals, first_seen, 'kev_flag' excluded from b_vuln v left join c using(vuln_id)""", "b_vuln", "b_signal")
def d06_provenance(spark, sf):
    found = signals.label_provenance(_labels(spark, sf, "kev_strict"), view(spark, sf, "b_signal"))
    each = F.transform("contributing_signals", lambda c: F.concat_ws("@", c["signal_type"], c["id"]))
    return found.select("vuln_id", "label_value", F.size("contributing_signals").cast("long").alias("n"), F.array_join(each, ",").alias("signals"), F.get("contributing_signals", F.lit(0))["observed_at"].alias("first_seen"), F.array_join("excluded_features", ",").alias("excluded"))


# --- audits and slices ---------------------------------------------------------

@query("d20_temporal_leakage", f"""select count(*) n, count(*) filter(published_at > timestamp '{ASOF}') future, round(count(*) filter(published_at > timestamp '{ASOF}')/greatest(count(*),1)::double,4) fraction,
count(*) filter(published_at > timestamp '{ASOF}')=0 passed from b_vuln""", "b_vuln")
def d20(spark, sf):
    return audit.temporal_leakage(view(spark, sf, "b_vuln"), ASOF)


@query("f11_time_split", f"select case when published_at <= timestamp '{ASOF}' then 'train' else 'test' end side, count(*) n, max(published_at) last from b_vuln where published_at is not null group by 1", "b_vuln")
def f11(spark, sf):
    train, test = audit.time_split(view(spark, sf, "b_vuln"), ASOF)
    both = train.select(F.lit("train").alias("side"), "published_at").unionByName(test.select(F.lit("test").alias("side"), "published_at"))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.max("published_at").alias("last"))


@query("d22_entity_leakage", """, tr as (select distinct vuln_id from b_signal where signal_type='kev'), te as (select distinct vuln_id from b_signal where signal_type='epss')
select count(tr.vuln_id) overlap, count(*) test_ids, round(count(tr.vuln_id)/greatest(count(*),1)::double,4) fraction, count(tr.vuln_id)=0 passed from te left join tr using(vuln_id)""", "b_signal")
def d22(spark, sf):
    s = view(spark, sf, "b_signal")
    return audit.entity_leakage(s.where("signal_type = 'kev'"), s.where("signal_type = 'epss'"))


@query("a15_correlations", """select f feature, round(r,4) correlation, coalesce(abs(r)>0.95,false) suspicious from (
select unnest(['n_chars','p1','p2','y_copy']) f, unnest([corr(n_chars,y),corr(p1,y),corr(p2,y),corr(y::double,y)]) r from b_score)""", "b_score")
def a15(spark, sf):
    df = view(spark, sf, "b_score").withColumn("y_copy", F.col("y").cast("double"))
    return audit.correlations(df, ["n_chars", "p1", "p2", "y_copy"], "y")


@query("d25_ablation_grid", "select * from (values " + ", ".join(f"('{g}', {', '.join(f'{int(g in gs)}::bigint' for gs in audit.ABLATIONS.values())})" for g in audit.FEATURE_GROUPS) + f") t(feature_group, {', '.join(f'"{a}"' for a in audit.ABLATIONS)})")
def d25(spark, sf):
    df = audit.ablation_grid(spark.range(1))
    return df.select("feature_group", *[F.col(c).cast("long").alias(c) for c in df.columns[1:]])


_SLICED = """, f as (select vuln_id, cvss_base_score, cwe_list, coalesce(date_diff('day', cast(published_at as date), date '""" + ASOF + """'),0)::double age,
coalesce(kev,false)::int::double kv, (coalesce(kev,false) or coalesce(poc,false))::int y, least(cvss_base_score/10,1e0) p from b_vuln left join sig using(vuln_id)),
x as (select *, unnest(list_filter(['overall', case when cvss_base_score>=9 then 'cvss_critical' end, case when cvss_base_score<7 then 'cvss_medium_low' end, case when kv=1 then 'has_kev' end, case when kv is distinct from 1 then 'no_kev' end,
case when age<=30 then 'first_30_days' end, case when age>365 then 'after_365' end, case when list_has_any(string_split(cwe_list,','), [""" + ",".join(f"'{c}'" for c in audit.TOP25) + """]) then 'cwe_top25' end], lambda e: e is not null)) slice from f)"""
_SIG = f", sig as ({_PIVOT.format(test=_MODES['date'])})"


def _sliced(spark: SparkSession, sf: str) -> DataFrame:
    v, s = view(spark, sf, "b_vuln"), signals.signal_pivot(signals.asof_filter(view(spark, sf, "b_signal"), ASOF))
    on = lambda c: F.coalesce(c, F.lit(False))
    df = v.join(s, "vuln_id", "left").select(
        "vuln_id", "cvss_base_score", "cwe_list", F.coalesce(F.datediff(F.lit(ASOF).cast("date"), F.to_date("published_at")), F.lit(0)).cast("double").alias("days_since_published"),
        on("kev").cast("double").alias("kev_flag"), (on("kev") | on("poc")).cast("int").alias("y"), F.least(F.col("cvss_base_score") / 10, F.lit(1.0)).alias("p"),
    )
    return audit.apply_slices(df, ["y", "p"])


@query("d27_slices", _SIG + _SLICED + " select slice, count(*) n, sum(y)::bigint positives from x group by 1 having count(*) >= case slice when 'overall' then 0 when 'has_kev' then 20 else 50 end", "b_vuln", "b_signal")
def d27(spark, sf):
    return _sliced(spark, sf).groupBy("slice").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives")).where(F.col("n") >= audit.least_rows(F.col("slice")))


_THRESHOLD = """count(*) n, sum(y)::bigint positives, round(avg(((p>=0.5)=(y=1))::int),6) accuracy, round(coalesce(count(*) filter(p>=0.5 and y=1)/nullif(count(*) filter(p>=0.5),0)::double,0),6) "precision",
round(coalesce(count(*) filter(p>=0.5 and y=1)/nullif(count(*) filter(y=1),0)::double,0),6) recall, round(coalesce(2*count(*) filter(p>=0.5 and y=1)/nullif(count(*) filter(p>=0.5)+count(*) filter(y=1),0)::double,0),6) f1,
round(avg((p-y)*(p-y)),6) brier, round(avg(y),6) positive_rate"""


@query("d28_slice_metrics", _SIG + _SLICED + f" select slice, {_THRESHOLD} from x group by 1", "b_vuln", "b_signal")
def d28(spark, sf):
    return metrics.threshold_metrics(_sliced(spark, sf), ["slice"])


# --- metrics -------------------------------------------------------------------

_LONG = ", s as (select doc_id, y, unnest(['p1','p2','p3']) stream, unnest([p1,p2,p3]) p from b_score)"
_CURVE = ", c as (select stream, p, count(*) n, sum(y) pos from s group by 1,2), w as (select *, sum(n) over d cn, sum(pos) over d cp, sum(n) over(partition by stream) tn, sum(pos) over(partition by stream) tp from c window d as (partition by stream order by p desc))"


def _long(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("p")) for s in STREAMS])
    return view(spark, sf, "b_score").select("doc_id", "y", F.explode(rows).alias("r")).select("doc_id", "y", "r.stream", "r.p")


@query("m04_m05_ranking", _LONG + _CURVE + " select stream, round(sum(pos/tp*cp/cn),6) average_precision, round(sum(pos*((tn-cn)-(tp-cp)+(n-pos)/2e0))/max(tp*(tn-tp)),6) roc_auc from w group by 1", "b_score")
def m04(spark, sf):
    return metrics.ranking_metrics(_long(spark, sf), ["stream"])


@query("m06_m07_threshold", _LONG + f" select stream, {_THRESHOLD} from s group by 1", "b_score")
def m06(spark, sf):
    return metrics.threshold_metrics(_long(spark, sf), ["stream"])


@query("m08_top_k", """, r as (select y, row_number() over(order by p1 desc, doc_id) rn from b_score), t as (select count(*) n, sum(y) pos from b_score)
select k::bigint k, coalesce(sum(y) filter(rn<=k),0)::bigint hits, round(coalesce(sum(y) filter(rn<=k),0)/least(max(n),k)::double,6) precision_at_k, round(coalesce(sum(y) filter(rn<=k)/nullif(max(pos),0)::double,0),6) recall_at_k
from r, t, (values (25),(50),(100)) kk(k) group by k""", "b_score")
def m08(spark, sf):
    return metrics.top_k(view(spark, sf, "b_score"), [25, 50, 100], p="p1").withColumn("k", F.col("k").cast("long"))


@query("m09_pr_curve", _LONG + _CURVE + " select stream, p, cn::bigint cum_n, cp::bigint cum_pos, round(cp/cn,6) \"precision\", round(cp/tp,6) recall from w", "b_score")
def m09(spark, sf):
    c = metrics.curve(_long(spark, sf), ["stream"])
    return c.select("stream", "p", "cum_n", "cum_pos", F.round(F.col("cum_pos") / F.col("cum_n"), 6).alias("precision"), F.round(F.try_divide("cum_pos", "positives"), 6).alias("recall"))


@query("m10_baselines", _SIG + """, f as (select coalesce(cvss_base_score,0) c, coalesce(epss_latest,0) e, coalesce(kev,false)::int::double k, (coalesce(kev,false) or coalesce(poc,false) or coalesce(msf,false))::int y
from b_vuln left join sig using(vuln_id)), s as (select y, unnest(['cvss','epss','kev']) stream, unnest([c/10, e, k+c/100]) p from f)""" + _CURVE + """ select * from
(select stream, round(sum(pos/tp*cp/cn),6) average_precision, round(sum(pos*((tn-cn)-(tp-cp)+(n-pos)/2e0))/max(tp*(tn-tp)),6) roc_auc from w group by 1)
join (select stream, round(avg(pow(least(greatest(p,0e0),1e0)-y,2)),6) brier from s group by 1) using(stream)""", "b_vuln", "b_signal")
def m10(spark, sf):
    y = _labels(spark, sf, "composite_no_leak").select("vuln_id", F.col("label_value").alias("y"))
    rows = metrics.baselines(signals.vulnerability_features(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), ASOF).join(y, "vuln_id"), "y")
    return metrics.ranking_metrics(rows, ["stream"]).join(metrics.clipped_brier(rows, ["stream"]), "stream")


@query("m16_calibration", ", b as (select *, least(floor(p1*5),4)::bigint bin from b_score) select bin, count(*) n, round(avg(p1),6) mean_score, round(avg(y),6) observed from b group by 1", "b_score")
def m16(spark, sf):
    return metrics.calibration(view(spark, sf, "b_score"), p="p1").withColumn("bin", F.col("bin").cast("long"))


@query("w09_quantile_bins", """, e as (select list_distinct(quantile_cont(p1, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) e from b_score), b as (select b_score.*, len(list_filter(e, lambda x: x<=p1)) bin from b_score, e)
select bin, count(*) n, round(avg(p1),6) mean_score, round(avg(y),6) observed from b group by 1""", "b_score")
def w09(spark, sf):
    return metrics.quantile_calibration(view(spark, sf, "b_score"), p="p1").withColumn("bin", F.col("bin").cast("long"))


@query("o_rrf", ", r as (select doc_id, " + ", ".join(f"rank() over(order by {s} desc) rank_{s}" for s in STREAMS) + " from b_score) select doc_id, rank_p1, rank_p2, rank_p3, round(1e0/(60+rank_p1)+1e0/(60+rank_p2)+1e0/(60+rank_p3),8) fused from r", "b_score")
def o_rrf(spark, sf):
    return metrics.rank_fusion(view(spark, sf, "b_score"), STREAMS)


@query("p21_meta_features", """select doc_id, p1, p2, p3, greatest(p1,p2,p3) p_max, round((p1+p2+p3)/3,8) p_mean, round(sqrt((pow(p1-(p1+p2+p3)/3,2)+pow(p2-(p1+p2+p3)/3,2)+pow(p3-(p1+p2+p3)/3,2))/3),8) p_std,
round(p1*p2,8) p1_x_p2, round(p1*p3,8) p1_x_p3, round(p2*p3,8) p2_x_p3 from b_score""", "b_score")
def p21(spark, sf):
    return metrics.meta_features(view(spark, sf, "b_score").select("doc_id", *STREAMS), STREAMS)


_CLASSES = """select o_orderkey, case o_orderkey%5 when 0 then 'patch_now' when 1 then 'mitigate_now' when 2 then 'patch_window' when 3 then 'monitor' else 'accept' end y_true,
case (o_orderkey+o_custkey)%6 when 0 then 'patch_now' when 1 then 'mitigate_now' when 2 then 'patch_window' when 3 then 'monitor' when 4 then 'accept' else 'other' end y_pred from {orders}"""


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_CLASSES, orders=spark.read.parquet(f"{sf}/orders.parquet"))


@query("m22_multiclass", "with t as (" + _CLASSES.format(orders="orders") + """), c as (select l label, count(*) filter(y_true=l and y_pred=l) tp, count(*) filter(y_pred=l) p, count(*) filter(y_true=l) t
from t, (values ('patch_now'),('mitigate_now'),('patch_window'),('monitor'),('accept')) ls(l) group by 1), q as (select *, coalesce(tp/nullif(p,0)::double,0) a, coalesce(tp/nullif(t,0)::double,0) b from c)
select label, round(a,6) "precision", round(b,6) recall, round(2*a*b/greatest(a+b,1e-8),6) f1, t support from q""")
def m22(spark, sf):
    return metrics.multiclass(_classes(spark, sf), core.ACTIONS)


@query("m22_triage_shift", "with t as (" + _CLASSES.format(orders="orders") + "), i as (select y_true, y_pred, " + ", ".join(
    f"coalesce(list_position(['patch_now','mitigate_now','patch_window','monitor','accept'], {c}),3) {n}" for c, n in (("y_true", "a"), ("y_pred", "b"))
) + " from t) select count(*) n, round(count(*) filter(y_true=y_pred)/count(*)::double,6) accuracy, round(count(*) filter(b<a)/count(*)::double,6) over_triage, round(count(*) filter(b>a)/count(*)::double,6) under_triage from i")
def m22b(spark, sf):
    return metrics.triage_shift(_classes(spark, sf), core.ACTIONS)


@query("a16_confusion", "with t as (" + _CLASSES.format(orders="orders") + ") select l.y_true, " + ", ".join(f"count(*) filter(y_pred='{a}') {a}" for a in core.ACTIONS)
       + " from (values ('patch_now'),('mitigate_now'),('patch_window'),('monitor'),('accept')) l(y_true) left join t on t.y_true=l.y_true group by 1")
def a16(spark, sf):
    return metrics.confusion(_classes(spark, sf), core.ACTIONS)


# --- retrieval and extraction ----------------------------------------------------

_COS = "select q.vec_id query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) s from embeddings e, (select * from embeddings where vec_id%20=0) q where e.vec_id<>q.vec_id and e.label=3"


def _near(spark: SparkSession, sf: str, k: int, least: float | None, asked: str = "vec_id % 20 = 0") -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return text.nearest_vectors(e, q, k, F.col("label") == 3, least).withColumn("rank", F.col("rank").cast("long"))


@query("r01_nearest", f"select query_id, rn \"rank\", vec_id, round(s,4) score from (select *, row_number() over(partition by query_id order by s desc, vec_id) rn from ({_COS})) where rn<=5")
def r01(spark, sf):
    return _near(spark, sf, 5, None)


@query("r02_min_score", f"select query_id, rn \"rank\", vec_id, round(s,4) score from (select *, row_number() over(partition by query_id order by s desc, vec_id) rn from ({_COS})) where rn<=5 and s>=0.3")
def r02(spark, sf):
    return _near(spark, sf, 5, 0.3)


@query("r01_nearest_all", f"select query_id, rn \"rank\", vec_id, round(s,4) score from (select *, row_number() over(partition by query_id order by s desc, vec_id) rn from ({_COS})) where rn<=5")
def r01_all(spark, sf):
    return _near(spark, sf, 5, None)


@query("r02_min_score_all", f"select query_id, rn \"rank\", vec_id, round(s,4) score from (select *, row_number() over(partition by query_id order by s desc, vec_id) rn from ({_COS})) where rn<=5 and s>=0.3")
def r02_all(spark, sf):
    return _near(spark, sf, 5, 0.3)


def _ci(p: str, col: str = "t") -> str:
    return f"regexp_matches({col}, '(?i)(?:{p})')"


_EXTRACT = ", x as (select vuln_id, coalesce(description,'') t from b_vuln), y as (select *, " + " or ".join(_ci(p) for p in text.NOT_AFFECTED) + f""" dn, list_slice(list_transform(regexp_extract_all(t, '{text.PRODUCT}', 1), lambda e: trim(e)),1,3) pr,
case {' '.join(f"when {_ci(p)} then '{n}'" for n, p in text.EXPLOIT_TYPES.items())} end kind,
list_filter([{', '.join(f"case when {_ci(p)} then '{n}' end" for n, p in text.PREREQUISITES.items())}], lambda e: e is not null) nd,
regexp_extract_all(t, '{text.VERSION}', 1)[1] ve, regexp_extract_all(t, '{text.FIXED}', 1)[1] fv, {_ci(text.WORKAROUND)} wa, trim(t)='' bl from x), z as (select *, not dn and len(pr)>0 found from y)
select vuln_id, case when dn then 'not_affected' when found then 'affected' else 'unknown' end status, case when bl then 0.5e0 when dn then 0.6e0 when found then 0.7e0 else 0.3e0 end status_confidence,
case when dn then '' else array_to_string(pr,';') end products, case when found then ve end version_end, case when found then fv end fixed_version, kind exploit_type, array_to_string(nd,';') prerequisites,
list_contains(nd,'network_access') or not list_contains(nd,'local_access') network, list_contains(nd,'authentication') authenticated, list_contains(nd,'user_interaction') interaction,
case when bl then 0.5e0 else round(least(0.3e0+0.1e0*len(nd)+case when kind is not null then 0.2e0 else 0e0 end,0.85e0),2) end exploit_confidence, fv is not null patch, wa workaround,
case when bl then 0.5e0 when fv is not null or wa then 0.6e0 else 0.3e0 end remedy_confidence from z"""


@query("r07_extract", _EXTRACT, "b_vuln")
def r07(spark, sf):
    return text.extract_evidence(view(spark, sf, "b_vuln").select("vuln_id", "description")).drop("description")


@query("r08_safety_scan", "select page_id, " + " + ".join(f"(case when regexp_matches(html, '(?i)(?:{p})') then 1 else 0 end)" for p in text.UNSAFE) + "::bigint hits from pages")
def r08(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.size(text.unsafe_hits(F.col("html"))).cast("long").alias("hits"))


@query("p23_query_text", """select vuln_id, trim(coalesce(description,'') || case when cwe_list is not null then ' Weakness types: '||array_to_string(string_split(cwe_list,','),', ') else '' end || ' Affected software: '||vendor||' '||product) query from b_vuln""", "b_vuln")
def p23(spark, sf):
    v = view(spark, sf, "b_vuln")
    return v.select("vuln_id", F.trim(text.query_text(F.col("description"), F.split("cwe_list", ","), F.array(F.concat_ws(" ", "vendor", "product")))).alias("query"))


@query("r09_verify_briefs")
def r09(spark, sf):
    v = view(spark, sf, "b_vuln")
    matches = v.select("vuln_id", F.concat(F.lit("T"), F.col("vuln_id") % 7).alias("technique_id"), F.lit(0.5).alias("score"))
    scores = v.where("vuln_id % 9 <> 0").select("vuln_id", (F.col("cvss_base_score") / 10).alias("p_final"))
    techniques = spark.createDataFrame([(f"T{i}",) for i in range(6)], "technique_id string")
    return text.verify_briefs(text.build_briefs(v, matches, scores).drop("confidence", "priority"), techniques)


# --- sources and sinks -------------------------------------------------------------

@query("s05_date_chunks", """, r as (select min(o_orderdate)::date a, max(o_orderdate)::date b from orders), c as (select unnest(generate_series(a, b - 1, interval 120 day))::date s, b from r where a < b)
select s chunk_start, least(s+119, b) chunk_end from c""".replace(", r as", "with r as", 1))
def s05(spark, sf):
    """The request windows that cover the dates of the table."""
    ends = spark.read.parquet(f"{sf}/orders.parquet").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return feeds.date_chunks_of(ends)


_CODES = "select l_orderkey*1000+l_linenumber id, concat(case when l_linenumber%3=0 then '' else concat('CVE-2024-', cast(l_partkey as varchar(12)), ';') end, 'OSVDB-1;CVE-2023-', cast(l_suppkey as varchar(12))) codes, cast(l_shipdate as date) shipped, case when l_linenumber%4=0 then 'x,Metasploit' else 'y' end tags from {lineitem}"


def _exploits(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.sql(_CODES, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return feeds.exploit_rows(raw.select("id", F.lit("d").alias("description"), F.col("shipped").cast("string").alias("date_published"), "codes", "tags"))


_EXPLODED = "with c as (" + _CODES.format(lineitem="lineitem") + "), e as (select id exploit_id, unnest(regexp_extract_all(codes, 'CVE-\\d{4}-\\d+')) cve_id, shipped published, contains(lower(tags),'metasploit') msf from c)"


@query("s19_exploit_rows", _EXPLODED + " select * from e")
def s19(spark, sf):
    return _exploits(spark, sf).drop("description")


@query("a03_exploit_summary", _EXPLODED + " select cve_id, min(published) first_date, count(*) n, bool_or(msf) msf, min(published) filter(msf) msf_date, array_to_string(list_slice(list(exploit_id order by exploit_id),1,5),',') ids from e group by 1")
def a03(spark, sf):
    return sinks.exploit_summary(_exploits(spark, sf).withColumn("pos", F.col("exploit_id")))


@query("k01_insert_if_absent", """, n as (select s_suppkey pos, case when s_suppkey%4=0 then null else concat('CVE-2024-', cast((s_suppkey-s_suppkey%2)*61 as varchar)) end cve_id, 'x' source, concat('V', cast(s_suppkey%25 as varchar)) vuldb_id from supplier),
k as (select *, case when cve_id is not null then 'c:'||cve_id else 'v:'||source||':'||vuldb_id end k from n), f as (select *, row_number() over(partition by k order by pos) rn from k)
select pos, cve_id, source, vuldb_id from f where rn=1 and not exists (select 1 from b_vuln v where 'c:'||v.cve_id=f.k)""", "b_vuln")
def k01(spark, sf):
    s = F.col("s_suppkey")
    new = spark.read.parquet(f"{sf}/supplier.parquet").select(
        s.alias("pos"), F.when(s % 4 != 0, F.concat(F.lit("CVE-2024-"), (s - s % 2) * 61)).alias("cve_id"), F.lit("x").alias("source"), F.concat(F.lit("V"), s % 25).alias("vuldb_id")
    )
    held = view(spark, sf, "b_vuln").select("cve_id", F.lit("y").alias("source"), F.lit(None).cast("string").alias("vuldb_id"))
    return sinks.insert_if_absent(held, new, "pos")


@query("k02_unpivot", """, r as (select vuln_id, case when vuln_id%3=0 then null else (vuln_id%5)/10e0 end e, vuln_id%2=0 k, case when vuln_id%4=0 then null else vuln_id%7=0 end p, false m from b_vuln)
select vuln_id, 'epss' signal_type, e value_num, null::boolean value_bool from r where e is not null union all select vuln_id, 'kev', null, k from r where k union all select vuln_id, 'poc_exploitdb', null, p from r where p union all select vuln_id, 'metasploit', null, m from r where m""", "b_vuln")
def k02(spark, sf):
    v = F.col("vuln_id")
    records = view(spark, sf, "b_vuln").select(
        v, F.when(v % 3 != 0, (v % 5) / 10).alias("epss_score"), (v % 2 == 0).alias("kev_flag"), F.when(v % 4 != 0, v % 7 == 0).alias("poc_exploitdb"), F.lit(False).alias("metasploit_module")
    )
    return sinks.unpivot_signals(records, f"{ASOF} 00:00:00").drop("observed_at")


@query("k03_ingest_signals", ", r as (select concat('CVE-2024-', cast(user_id*2 as varchar)) cve_id, value value_num from events) select vuln_id, value_num from r join b_vuln using(cve_id)", "b_vuln")
def k03(spark, sf):
    records = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("CVE-2024-"), F.col("user_id") * 2).alias("cve_id"), F.col("value").alias("value_num"))
    return sinks.ingest_signals(records, view(spark, sf, "b_vuln"))


@query("j12_missing_rows", "select vuln_id, signal_type from b_signal n where observed_at > timestamp '2024-01-02' and not exists (select 1 from b_signal h where h.observed_at <= timestamp '2024-01-02' and h.vuln_id=n.vuln_id and h.signal_type=n.signal_type)", "b_signal")
def j12(spark, sf):
    s, cut = view(spark, sf, "b_signal"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return sinks.missing_rows(s.where(F.col("observed_at") <= cut), s.where(F.col("observed_at") > cut), ["vuln_id", "signal_type"]).select("vuln_id", "signal_type")


@query("s14_cpe_title", """select vuln_id, vendor v, replace(product,'_',' ') p, case when vuln_id%2=0 then 'all' else '1.0' end "version" from b_vuln where vuln_id%3<>0""", "b_vuln")
def s14(spark, sf):
    v = view(spark, sf, "b_vuln")
    cpe = F.concat(F.lit("cpe:2.3:a:"), F.col("vendor"), F.lit(":"), F.when(F.col("vuln_id") % 3 != 0, F.concat("product", F.lit(":"), F.when(F.col("vuln_id") % 2 == 0, "*").otherwise("1.0"))).otherwise(""))
    return v.select("vuln_id", feeds.parse_cpe(cpe).alias("c")).where("c is not null").select("vuln_id", F.col("c.vendor").alias("v"), F.col("c.product").alias("p"), F.col("c.version").alias("version"))


# --- experiments ---------------------------------------------------------------------

@query("p10_counts", """select vuln_id, len(string_split(title,' '))::double product_count, case when vuln_id%3=0 then 0e0 else len(string_split(product,'_'))::double end reference_count from b_vuln""", "b_vuln")
def p10(spark, sf):
    v = view(spark, sf, "b_vuln")
    v = v.withColumns({"affected_products": F.split("title", " "), "references": F.when(F.col("vuln_id") % 3 != 0, F.split("product", "_"))})
    return signals.vulnerability_features(v, view(spark, sf, "b_signal"), ASOF).select("vuln_id", "product_count", "reference_count")


_CPE = """, s as (select asset_id, vendor v, product p, confidence from b_sbom union all select asset_id, concat('x',vendor), product, confidence from b_sbom)
select s.asset_id, k.vuln_id, coalesce(max(confidence),0.8e0) best from b_vuln k join s on s.v=k.vendor and s.p=k.product group by all"""
#: Components under a misspelled vendor, whose CPE has the right one.
_MISSPELLED = "select asset_id, concat('x', vendor) vendor, product, confidence, observed_at, concat('cpe:2.3:a:', vendor, ':', product, ':1.0') cpe from {sbom}"


def _software(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_MISSPELLED, sbom=view(spark, sf, "b_sbom"))


def _products(spark: SparkSession, sf: str) -> DataFrame:
    one = F.array(F.struct(F.upper("vendor").alias("vendor"), "product"))
    return assets.product_keys(view(spark, sf, "b_vuln"), one)


@query("j08_cpe_match", _CPE, "b_vuln", "b_sbom")
def j08(spark, sf):
    return experiments.product_matches(_products(spark, sf), assets.software_keys(_software(spark, sf)))


@query("j08_cpe_features", _EV + " select asset_id, vuln_id, case when n>0 then 1e0 else 0e0 end affected_product_confirmed, case when n is null then 0e0 else coalesce(sbest,0.8e0) end sbom_match_confidence from j", *_PAIRS)
def j08_features(spark, sf):
    """Items name their products as CPE texts, software matches by its CPE only: the features of pairs are those of matching names."""
    pair, asset, vuln, _, _, vex, reach, control = _pairs(spark, sf)
    vuln = vuln.withColumn("products", F.array(F.concat(F.lit("cpe:2.3:a:"), F.upper("vendor"), F.lit(":"), "product", F.lit(":1.0"))))
    found = assets.actionability_features(pair, asset, vuln, _software(spark, sf), vex, reach, control, ASOF)
    return found.select("asset_id", "vuln_id", "affected_product_confirmed", "sbom_match_confidence")


@query("j09_items_to_score", " , s as (" + _MISSPELLED.format(sbom="b_sbom") + " union all select asset_id, vendor, product, confidence, observed_at, 'x' from b_sbom) select vuln_id from b_vuln v where exists (select 1 from s where s.vendor=v.vendor and s.product=v.product)", "b_vuln", "b_sbom")
def j09(spark, sf):
    """All assets' software under its right name, and again under a wrong one with the right CPE, which does not count."""
    v, right = view(spark, sf, "b_vuln"), view(spark, sf, "b_sbom").withColumn("cpe", F.lit("x"))
    software = _software(spark, sf).unionByName(right.select("asset_id", "vendor", "product", "confidence", "observed_at", "cpe"))
    return experiments.items_to_score(v, _products(spark, sf), assets.software_keys(software)).select("vuln_id")


@query("w04_latest_epss", "select vuln_id, arg_max(value_num, (observed_at, id)) value_num from b_signal where signal_type='epss' group by 1", "b_signal")
def w04(spark, sf):
    return experiments.latest_by_time(view(spark, sf, "b_signal"), "epss")


@query("l04_top_cvss", "select vuln_id, cvss_base_score from b_vuln order by cvss_base_score desc nulls last, vuln_id limit 12", "b_vuln")
def l04(spark, sf):
    return experiments.top_by_cvss(view(spark, sf, "b_vuln"), 12).select("vuln_id", "cvss_base_score")


@query("l07_violators", f"select vuln_id, published_at from b_vuln where published_at > timestamp '{ASOF}' order by published_at, vuln_id limit 5", "b_vuln")
def l07(spark, sf):
    return experiments.violators(view(spark, sf, "b_vuln"), ASOF).select("vuln_id", "published_at")


@query("x02_pair_overlap", "select distinct concat(asset_id::varchar,'_',vuln_id::varchar) entity from b_reach where vuln_id is not null and (asset_id, vuln_id) in (select asset_id, vuln_id from b_vex where asset_id is not null) order by 1 limit 10", "b_reach", "b_vex")
def x02(spark, sf):
    return experiments.overlaps(view(spark, sf, "b_reach"), view(spark, sf, "b_vex").where("asset_id is not null"), ["asset_id", "vuln_id"])


@query("p17_shown_text", "select vuln_id, case when length(description)>40 then left(description,40)||'…' else description end shown from b_vuln", "b_vuln")
def p17(spark, sf):
    return view(spark, sf, "b_vuln").select("vuln_id", experiments.shown_text(F.col("description"), 40).alias("shown"))


@query("d19_label_frame", _ALL_LABELS + " select v.vuln_id, cvss_base_score, label_value from b_vuln v join labels4 l on l.vuln_id=v.vuln_id and l.policy='kev_strict'", "b_vuln", "b_signal")
def d19(spark, sf):
    return experiments.training_frame(view(spark, sf, "b_vuln").select("vuln_id", "cvss_base_score"), _all_labels(spark, sf), "kev_strict")


@query("d24_audit_report", f"""select * from (select 'temporal' "check", count(*) filter(published_at > timestamp '{ASOF}')=0 passed, (count(*) filter(published_at > timestamp '{ASOF}'))::varchar||' of '||count(*)::varchar detail from b_vuln)
union all select 'label', true, '' union all select 'overall', count(*) filter(published_at > timestamp '{ASOF}')=0, 'kev_strict' from b_vuln""", "b_vuln")
def d24(spark, sf):
    return experiments.audit_report(view(spark, sf, "b_vuln"), None, ASOF, "kev_strict")


_EXPERIMENT = _SIG + f""", f as (select v.vuln_id, published_at, cvss_base_score, coalesce(kev,false)::int::double kev_flag, coalesce(epss_max,0) epss_score from b_vuln v left join sig using(vuln_id)),
l as (select vuln_id, coalesce(kev,false)::int y from b_vuln left join sig using(vuln_id) where vuln_id%3<>0), m as (select * from f join l using(vuln_id)),
tr as (select vuln_id from f where published_at <= timestamp '{ASOF}'), te as (select vuln_id from f where published_at > timestamp '2024-01-15'),
c as (select * from (select unnest(['cvss_base_score','epss_score','kev_flag']) n, unnest([corr(cvss_base_score,y), corr(epss_score,y), corr(kev_flag,y)]) r from m) where abs(r)>0.95)
select 'temporal' "check", count(*) filter(published_at > timestamp '{ASOF}')=0 passed, (count(*) filter(published_at > timestamp '{ASOF}'))::varchar||' of '||count(*)::varchar detail,
 (select string_agg(vuln_id::varchar, ',' order by published_at, vuln_id) from (select * from f where published_at > timestamp '{ASOF}' order by published_at, vuln_id limit 5)) violators from f
union all select 'label', false, 'kev_flag', ''
union all select 'entity', count(tr.vuln_id)=0, count(tr.vuln_id)::varchar||' of '||count(*)::varchar, coalesce((select string_agg(e, ',' order by e) from (select distinct vuln_id::varchar e from te semi join tr using(vuln_id) order by e limit 10)),'') from te left join tr using(vuln_id)
union all select 'correlation', count(*)=0, coalesce(string_agg(n, ',' order by n),''), '' from c
union all select 'overall', false, 'kev_strict', ''"""


@query("d24_audit_experiment", _EXPERIMENT, "b_vuln", "b_signal")
def d24_experiment(spark, sf):
    v, s = view(spark, sf, "b_vuln"), signals.signal_pivot(signals.asof_filter(view(spark, sf, "b_signal"), ASOF))
    kev = F.coalesce("kev", F.lit(False)).cast("double")
    f = v.join(s, "vuln_id", "left").select("vuln_id", "published_at", "cvss_base_score", kev.alias("kev_flag"), F.coalesce("epss_max", F.lit(0.0)).alias("epss_score"))
    labels = f.where("vuln_id % 3 <> 0").select("vuln_id", F.col("kev_flag").cast("int").alias("label_value"))
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    return experiments.audit_experiment(f, labels, f.where(F.col("published_at") <= at(ASOF)), f.where(F.col("published_at") > at("2024-01-15")), ASOF, "kev_strict")


@query("d26_asset_slices", _EV + """, f as (select internet_facing i, case coalesce(criticality,'medium') when 'low' then 0.25e0 when 'medium' then 0.5e0 when 'high' then 0.75e0 when 'critical' then 1e0 else 0.5e0 end c, coalesce(network,false) n,
round(coalesce((coalesce(waf,false)::int+coalesce(edr,false)::int+coalesce(ips,false)::int+coalesce(seg,false)::int)::double/4*mean,0)+1e-9,4) k from j),
x as (select unnest(list_filter(['overall','no_kev', case when i then 'internet_facing' end, case when c>=0.75 then 'crown_jewel' end, case when n then 'reachable_confirmed' end, case when k>=0.5 then 'high_control_coverage' end], lambda e: e is not null)) slice from f)
select slice, count(*) n from x group by 1""", *_PAIRS)
def d26(spark, sf):
    pair, asset, vuln, _, sbom, vex, reach, control = _pairs(spark, sf)
    df = assets.actionability_features(pair, asset, vuln, sbom, vex, reach, control, ASOF).withColumn("one", F.lit(1))
    return audit.apply_slices(df, ["one"]).groupBy("slice").agg(F.count("*").alias("n"))


_REPORT = """, g as (select slice, p, count(*) n, sum(y) pos from x group by all), w as (select *, sum(n) over d cn, sum(pos) over d cp, sum(n) over(partition by slice) tn, sum(pos) over(partition by slice) tp from g window d as (partition by slice order by p desc)),
r as (select slice, round(sum(pos/nullif(tp,0)*cp/cn),6) ap, round(sum(pos*((tn-cn)-(tp-cp)+(n-pos)/2e0))/nullif(max(tp*(tn-tp)),0),6) auc from w group by 1),
t as (select slice, """ + _THRESHOLD + """ from x group by 1)
select slice, n, positives, accuracy, positive_rate, """ + ", ".join(f'case when positives>0 and positives<n then "{c}" end "{c}"' for c in ("precision", "recall", "f1", "brier")) + """,
case when positives>0 and positives<n then ap end average_precision, case when positives>0 and positives<n then auc end roc_auc from t join r using(slice)"""


@query("d28_slice_report", _SIG + _SLICED + _REPORT, "b_vuln", "b_signal")
def d28_report(spark, sf):
    return metrics.slice_report(_sliced(spark, sf), ["slice"])


@query("d37_decide_items", _SIG + """, e as (select vuln_id, coalesce(cvss_base_score,0) cvss, coalesce(epss_max,0) epss, coalesce(kev,false) k, coalesce(poc,false) or coalesce(msf,false) o from b_vuln left join sig using(vuln_id)),
r as (select *, 0.45e0*least(cvss/10,1e0)+0.45e0*epss risk from e) select vuln_id, case when k then 'mitigate_now' when o then 'patch_window' when risk>=0.7 then 'monitor' when risk>=0.3 then 'monitor' else 'accept' end "action" from r""", "b_vuln", "b_signal")
def d37(spark, sf):
    known = signals.signal_pivot(signals.asof_filter(view(spark, sf, "b_signal"), ASOF))
    return assets.decide_pairs(experiments.bare_evidence(view(spark, sf, "b_vuln"), known)).select("vuln_id", "action")


@query("j11_decide_with_model", _DECIDE.replace("0.15e0*least(cvss/10,1e0)+0.15e0*epss", "case when vuln_id%3=0 then 0.15e0*least(cvss/10,1e0)+0.15e0*epss else 0.3e0*((vuln_id%10)/10e0) end").replace("cvss>=9 or epss>=0.5 sev", "cvss>=9 or epss>=0.5 or (vuln_id%3<>0 and vuln_id%10>=7) sev")
       + " select asset_id, vuln_id, round(risk+1e-9,4) risk, action from dd", *_PAIRS)
def j11(spark, sf):
    ml = view(spark, sf, "b_vuln").where("vuln_id % 3 <> 0").select("vuln_id", ((F.col("vuln_id") % 10) / 10).alias("prob"))
    return assets.decide_pairs(_evidence(spark, sf), ml).select("asset_id", "vuln_id", "risk", "action")


@query("m14_mean_blend", "select doc_id, round((p1+p2+p3)/3,8) p from b_score", "b_score")
def m14(spark, sf):
    return experiments.blend(view(spark, sf, "b_score"), STREAMS).select("doc_id", F.round("p", 8).alias("p"))


@query("k04_exploit_signals", _EXPLODED.replace("with ", ", ", 1) + """, a as (select cve_id, min(published) d, bool_or(msf) m, min(published) filter(msf) md from e group by 1), n as (select vuln_id, 'poc_exploitdb' signal_type, d::timestamp observed_at from a join b_vuln using(cve_id)
union all select vuln_id, 'metasploit', md::timestamp from a join b_vuln using(cve_id) where m) select * from n where not (signal_type='poc_exploitdb' and vuln_id%5=0)""", "b_vuln")
def k04(spark, sf):
    v = view(spark, sf, "b_vuln")
    held = v.where("vuln_id % 5 = 0").select("vuln_id", F.lit("poc_exploitdb").alias("signal_type"), F.lit("exploitdb").alias("source"))
    rows = _exploits(spark, sf).withColumn("pos", F.col("exploit_id"))
    return sinks.exploit_signals(held, rows, v, f"{ASOF} 00:00:00").select("vuln_id", "signal_type", "observed_at")


@query("k05_label_rows", _ALL_LABELS + " select vuln_id, policy, 9::bigint label_value from labels4 where policy='kev_strict' and vuln_id%2=0 union all select vuln_id, policy, label_value from labels4 where not (policy='kev_strict' and vuln_id%2=0)", "b_vuln", "b_signal")
def k05(spark, sf):
    new = _all_labels(spark, sf).select("vuln_id", "policy", "label_value")
    held = new.where("policy = 'kev_strict' and vuln_id % 2 = 0").withColumn("label_value", F.lit(9).cast("long"))
    return sinks.label_rows(held, new)


@query("k06_snapshots", f"select vuln_id, date '{ASOF}' as \"asof\" from b_vuln where vuln_id%4<>0", "b_vuln")
def k06(spark, sf):
    v = view(spark, sf, "b_vuln").select("vuln_id", "cvss_base_score")
    held = v.where("vuln_id % 4 = 0").select("vuln_id", F.lit(ASOF).cast("date").alias("asof"), F.lit("v1").alias("version"))
    return sinks.snapshot_rows(held, v, ASOF).select("vuln_id", "asof")


@query("k08_vex_rows", "select v.vuln_id, status from (select concat('CVE-2024-', cast(vuln_id*2 as varchar)) cve_id, status from b_vex) s join b_vuln v using(cve_id)", "b_vuln", "b_vex")
def k08(spark, sf):
    rows = view(spark, sf, "b_vex").select(F.concat(F.lit("CVE-2024-"), F.col("vuln_id") * 2).alias("cve_id"), "status")
    return sinks.vex_rows(rows, view(spark, sf, "b_vuln"), f"{ASOF} 00:00:00").select("vuln_id", "status")


@query("k09_vector_payload", "select e.vec_id id, len(e.embedding)::bigint width, round(e.embedding[1],6) head, left(d.text,500) text, d.lang from embeddings e left join (select * from documents qualify row_number() over(partition by doc_id order by text desc)=1) d on d.doc_id=e.vec_id")
def k09(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    out = sinks.vector_payload(rows, "vec_id", "embedding", {"text": 500, "lang": 5})
    return out.select("id", F.size("vector").cast("long").alias("width"), F.round(F.get("vector", F.lit(0)), 6).alias("head"), "text", "lang")


@query("f09_in_list", "select vuln_id from b_vuln where cve_id in ('CVE-2024-3','CVE-2024-44','CVE-2024-0')", "b_vuln")
def f09(spark, sf):
    v = view(spark, sf, "b_vuln")
    return experiments.items_to_score(v, v, v, ["CVE-2024-3", "CVE-2024-44", "CVE-2024-0"]).select("vuln_id")


@query("s27_technique_registry", "select 'T'||(user_id%40)::varchar technique_id, arg_max(event_type, event_id) name from events group by 1")
def s27(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("T"), F.col("user_id") % 40).alias("technique_id"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"))
    return experiments.techniques(e)


# --- tables, recorded sources, caches ----------------------------------------------------

_HALF = "exploit_id%2=0"


def _written(name: str, which: str) -> str:
    """The signals that the exploits of ``which`` give, as common table expressions over e (see _EXPLODED) and b_vuln."""
    return f"""{name}_a as (select cve_id, min(published) d, count(*) n, bool_or(msf) m, min(published) filter(msf) md, list_slice(list(exploit_id order by exploit_id),1,5) five from e where {which} group by 1),
{name}_k as (select * from {name}_a join b_vuln using(cve_id)),
{name} as (select vuln_id, 'poc_exploitdb' signal_type, d::timestamp observed_at, n::double value_num, 'EDB-IDs: '||array_to_string(five,',') value_text, 'https://www.exploit-db.com/exploits/'||five[1]::varchar evidence_ref from {name}_k
union all select vuln_id, 'metasploit', md::timestamp, null, 'Metasploit module (via ExploitDB tags)', 'https://www.exploit-db.com/exploits/'||five[1]::varchar from {name}_k where m)"""


_RUNS = _EXPLODED.replace("with ", ", ", 1) + ", " + _written("h", _HALF) + ", " + _written("w", "true") + ", more as (select * from w where not exists (select 1 from h where h.vuln_id=w.vuln_id and h.signal_type=w.signal_type))"
_INSERTED = "count(*) filter(signal_type='poc_exploitdb') poc_inserted, count(*) filter(signal_type='metasploit') msf_inserted"
_OF_ALL = "(select count(*) from w_k) cves_matched, (select count(*) from w_a) cves_in_edb, (select count(*) from b_vuln) cves_in_db"


@query("k04_exploit_table", _RUNS + " select * from h union all select * from more", "b_vuln")
def k04_table(spark, sf):
    """The table after half of the exploits, all of them, and all of them again."""
    signals_of = sinks.tables(spark, new_folder(spark, "exploits"))["signal"]
    v, rows = view(spark, sf, "b_vuln"), _exploits(spark, sf).withColumn("pos", F.col("exploit_id"))
    for part in (rows.where(_HALF), rows, rows):
        sinks.write_exploit_signals(signals_of, part, v, f"{ASOF} 00:00:00")
    return signals_of.read().select("vuln_id", "signal_type", "observed_at", "value_num", "value_text", "evidence_ref")


@query("k04_counters", _RUNS + f""" select 1::bigint run, {_INSERTED}, (select count(*) from h_k) cves_matched, (select count(*) from h_a) cves_in_edb, (select count(*) from b_vuln) cves_in_db, 1::bigint grew from h
union all select 2, {_INSERTED}, {_OF_ALL}, 1 from more union all select 3, 0, 0, {_OF_ALL}, 1 union all select 4, {_INSERTED}, {_OF_ALL}, 0 from w""", "b_vuln")
def k04_counters(spark, sf):
    """Counters of four runs: half of the exploits, all, all again, and all with overwrite as a dry run; grew: whether a version followed."""
    signals_of = sinks.tables(spark, new_folder(spark, "exploits"))["signal"]
    v, rows = view(spark, sf, "b_vuln"), _exploits(spark, sf).withColumn("pos", F.col("exploit_id"))
    found = []
    for run, (part, over) in enumerate(((rows.where(_HALF), False), (rows, False), (rows, False), (rows, True)), 1):
        before = signals_of.version()
        counts = sinks.write_exploit_signals(signals_of, part, v, f"{ASOF} 00:00:00", overwrite=over, dry_run=over)
        found.append((run, *counts.values(), signals_of.version() - before))
    return spark.createDataFrame(found, "run long, " + ", ".join(f"{c} long" for c in counts) + ", grew long")


@query("k05_label_table", _ALL_LABELS + """, l as (select vuln_id, policy, label_value from labels4)
select vuln_id, policy, label_value from l where policy='kev_strict' union all select vuln_id, policy, label_value from l where policy='epss_derived' and vuln_id%2=0""", "b_vuln", "b_signal")
def k05_table(spark, sf):
    """Labels of two policies, one of them replaced by its rows of every other item; a dry run leaves no trace."""
    labels_of, rows = sinks.tables(spark, new_folder(spark, "labels"))["label"], tables.durable(_all_labels(spark, sf))
    sinks.write_labels(labels_of, rows, "kev_strict", ASOF)
    sinks.write_labels(labels_of, rows, "epss_derived", ASOF)
    sinks.write_labels(labels_of, rows, "composite_no_leak", ASOF, dry_run=True)
    sinks.write_labels(labels_of, rows.where("vuln_id % 2 = 0"), "epss_derived", ASOF, overwrite=True)
    sinks.write_labels(labels_of, rows, "kev_strict", ASOF)
    return labels_of.read().select("vuln_id", "policy", F.col("label_value").cast("long").alias("label_value"))


@query("k06_snapshot_table", f" select vuln_id, date '{ASOF}' as \"asof\", cvss_base_score, 2::bigint runs from b_vuln", "b_vuln")
def k06_table(spark, sf):
    """All rows come back from the second run too, which stores none; what is stored is read back from its JSON."""
    snapshots = sinks.tables(spark, new_folder(spark, "snapshots"))["snapshot"]
    v = view(spark, sf, "b_vuln").select("vuln_id", "cvss_base_score")
    sinks.write_snapshots(snapshots, v, ASOF)
    again, counts = sinks.write_snapshots(snapshots, v, ASOF)
    stored = snapshots.read().select("vuln_id", "asof", F.get_json_object("features", "$.cvss_base_score").cast("double").alias("cvss_base_score"))
    runs = F.lit(snapshots.version() if counts["persisted"] == 0 else -1).cast("long")
    return stored.join(again.select("vuln_id"), "vuln_id").withColumn("runs", runs)


@query("k08_component_table", ", r as (select asset_id, vendor, product from b_sbom where asset_id%3=0) select asset_id, vendor, product, 2*count(*) n from r group by all", "b_sbom")
def k08_table(spark, sf):
    """Components appended twice: they are observations, so repeats stay."""
    software = sinks.tables(spark, new_folder(spark, "software"))["software"]
    rows = view(spark, sf, "b_sbom").where("asset_id % 3 = 0").select("asset_id", "vendor", "product", *[F.lit(None).cast("string").alias(c) for c in ("version", "cpe", "purl")])
    for _ in range(2):
        sinks.append_components(software, rows, f"{ASOF} 00:00:00", "b_sbom")
    return software.read().groupBy("asset_id", "vendor", "product").agg(F.count("*").alias("n"))


_PAGED = "select vuln_id, cve_id, description, published_at, cvss_base_score, case when cvss_base_score>=9 then 'CRITICAL' when cvss_base_score>=7 then 'HIGH' when cvss_base_score>=4 then 'MEDIUM' else 'LOW' end severity from b_vuln"


@query("s30_recorded_pages", f", p as ({_PAGED}) select cve_id, coalesce(description,'') description, published_at, nullif(cvss_base_score,0) cvss_base_score from p where severity in ('HIGH','CRITICAL')", "b_vuln")
def s30(spark, sf):
    """Items recorded as a crawler's page files, of which those of two severities are opened."""
    rows = spark.sql(_PAGED.replace("b_vuln", "{b_vuln}"), b_vuln=view(spark, sf, "b_vuln"))
    record = F.struct(F.struct(
        F.col("cve_id").alias("id"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), F.array(F.struct(F.lit("en").alias("lang"), F.col("description").alias("value"))).alias("descriptions"),
        F.struct(F.array(F.struct(F.lit("Primary").alias("type"), F.struct(F.col("cvss_base_score").alias("baseScore")).alias("cvssData"))).alias("cvssMetricV31")).alias("metrics"),
    ).alias("cve"))
    folder = new_folder(spark, "pages")
    recorded.write_pages(rows.select("severity", F.col("vuln_id").alias("place"), F.to_json(record).alias("record")), folder, page_size=500)
    found = recorded.PageProvider(folder, ("HIGH", "CRITICAL")).fetch(spark)
    return found.select("cve_id", "description", "published_at", "cvss_base_score")


@query("s29_latest_report", f"""select 'temporal' "check", count(*) filter(published_at > timestamp '{ASOF}')=0 passed, (count(*) filter(published_at > timestamp '{ASOF}'))::varchar||' of '||count(*)::varchar detail from b_vuln
union all select 'label', true, '' union all select 'overall', count(*) filter(published_at > timestamp '{ASOF}')=0, 'kev_strict' from b_vuln""", "b_vuln")
def s29(spark, sf):
    """Two audits write their reports into a folder; the newer one is read."""
    folder, v = new_folder(spark, "reports"), view(spark, sf, "b_vuln")
    for asof in ("2030-01-01", ASOF):
        experiments.write_report(experiments.audit_report(v, None, asof, "kev_strict"), folder)
    return recorded.latest_report(spark, folder, "check string, passed boolean, detail string").select("check", "passed", "detail")


@query("s28_cached_vectors", """select s.step::bigint step, s.came, case when s.step=3 then (select count(*) from embeddings where vec_id%2=0) else (select count(*) from embeddings) end n from (values (1,'miss'),(2,'hit'),(3,'stale'),(4,'stale')) s(step, came)""")
def s28(spark, sf):
    """A cache of normalised vectors asked four times: new, unchanged, with half of the rows, with all again."""
    folder, e = new_folder(spark, "cache"), spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    unit = lambda df: df.select("vec_id", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))).alias("unit"))
    found = []
    for step, rows in enumerate((e, e, e.where("vec_id % 2 = 0"), e), 1):
        out, came = tables.cached(rows, folder, "unit", unit)
        found.append((step, came, out.count()))
    return spark.createDataFrame(found, "step long, came string, n long")


# --- models and streaming (no SQL form) ------------------------------------------------

@query("m02_trees")
def m02(spark, sf):
    df = signals.vulnerability_features(view(spark, sf, "b_vuln"), view(spark, sf, "b_signal"), ASOF).join(_labels(spark, sf, "composite_no_leak").select("vuln_id", "label_value"), "vuln_id")
    features = sorted(audit.ablation_columns("cve_only") & set(df.columns))
    model = models.train_trees(df, features, "label_value")
    return models.scored(model, df, features).select("vuln_id", "label_value", F.round("p", 6).alias("p"))


@query("m12_stacking")
def m12(spark, sf):
    _, out = models.stack(tables.durable(view(spark, sf, "b_score").select("doc_id", "y", *STREAMS)), STREAMS)
    return models.calibrated(out).select("doc_id", "y", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"))


def _encoded(spark: SparkSession, sf: str, width: int = 1 << 18) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return models.encoded(docs, models.text_encoder(docs.where("doc_id % 5 <> 0"), width=width))


@query("m17_text_encoding")
def m17(spark, sf):
    """Every document's encoding, fitted on four fifths of them, as indices and values."""
    found = models.sparse_parts(_encoded(spark, sf).select("doc_id", "encoding"), "encoding")
    return found.select("doc_id", "indices", F.transform("values", lambda x: F.round(x, 6)).alias("weights"))


@query("m21_text_head")
def m21(spark, sf):
    """Metrics of a text head on the fifth of the labelled documents that it has not seen."""
    labelled = _encoded(spark, sf, 1 << 14).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("y")), "doc_id").where("y is not null")
    rows = tables.durable(labelled.select("doc_id", "y", "encoding"))
    head = models.vector_head(rows.where("doc_id % 5 <> 0"), "y")
    return experiments.evaluate(models.vector_scores(rows.where("doc_id % 5 = 0"), head), [])


@query("m18_components")
def m18(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return models.reduced_vectors(e.where("label < 5"), e).drop("embedding")


@query("q_stream_signal_counts", "select time_bucket(interval 7 day, ts, timestamp '1970-01-01') window_start, event_type signal_type, count(*) n, count(*) filter(value>200) raised from events group by all")
def stream(spark, sf):
    """The windowed counts over the whole log, run as a stream up to the end of what is there."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    log = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").selectExpr(
        "user_id vuln_id", "event_type signal_type", "cast(ts as timestamp) observed_at", "value > 200 value_bool"
    )
    folder = signal_log.stream_folder(spark)
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/counts")
    run = signal_log.windowed_counts(log).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
