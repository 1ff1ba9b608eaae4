"""Lexical scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import lexical as jobs
from lurelens.operators.domains import typosquat, with_registrable_domain
from lurelens.operators.evidence import layer_groups
from lurelens.operators.feeds import risk_scores
from workload.registry import Inputs, brand_values, query

_CHARS = """
    chars as (select target_id, host, length(host) as n, c, count(*) as k
      from (select target_id, host, unnest(string_split(host, '')) as c from hosts) group by target_id, host, c)"""

_DGA = """
    labels as (select target_id, host, ord, label from (
        select target_id, host, unnest(string_split(lower(host), '.')) as label, unnest(range(len(string_split(host, '.')))) as ord, len(string_split(host, '.')) as parts from hosts)
      where (ord < parts - 1 or parts = 1) and length(label) >= 3),
    letters as (select target_id, host, ord, label, unnest(string_split(label, '')) as c from labels),
    counts as (select target_id, host, ord, label, c, count(*) as k from letters group by all),
    measured as (select target_id, host, ord, label, sum(-(k::double / length(label)) * log2(k::double / length(label))) as h,
        sum(case when c in ('a','e','i','o','u') then k else 0 end) as v,
        sum(case when c between 'a' and 'z' and c not in ('a','e','i','o','u') then k else 0 end) as co,
        sum(case when c between '0' and '9' then k else 0 end)::double / length(label) as d
      from counts group by target_id, host, ord, label),
    dga as (select hosts.target_id, hosts.host, case when count(label) = 0 then 0e0 else
        0.35e0 * least(1e0, greatest(0e0, (avg(h) - 3) / 2))
        + 0.35e0 * avg(case when v > 0 and (co / v < 0.5 or co / v > 4) then 1e0 when v = 0 and co > 0 then 1e0 else 0e0 end)
        + 0.3e0 * avg(case when d > 0.3e0 then d else 0e0 end) end as score
      from hosts left join measured on hosts.target_id = measured.target_id group by hosts.target_id, hosts.host)"""

_TYPOSQUAT = f"""
    domains as (select distinct target_id, case target_id % 9
        when 0 then brand_domain when 1 then brand_domain when 5 then host when 6 then host
        when 7 then substr(host, 5) when 8 then array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:2]), '.')
        else host end as domain from hosts),
    near as (select d.domain, b.brand, b.domain as matched_domain, damerau_levenshtein(d.domain, b.domain) as distance, b.ord
      from (select distinct domain from domains) d join {brand_values()}
        on d.domain <> b.domain and abs(length(d.domain) - length(b.domain)) <= 2 and damerau_levenshtein(d.domain, b.domain) <= 2),
    closest as (select domain, arg_min(brand, (distance, ord)) as brand, arg_min(matched_domain, (distance, ord)) as matched_domain, min(distance) as distance
      from near group by domain)"""


@query(f"with {_CHARS} select target_id, host, round(sum(-(k::double / n) * log2(k::double / n)), 3) as entropy from chars group by target_id, host")
def host_entropy(t: Inputs):
    return t.hosts.select("target_id", "host", F.round(jobs.entropy(F.col("host")), 3).alias("entropy"))


@query(f"with {_DGA} select target_id, host, round(score, 4) as score from dga")
def dga_scores(t: Inputs):
    return t.hosts.select("target_id", "host", jobs.dga_score(F.col("host")).alias("score"))


@query("""
    select target_id, host, case when host like '%.workers.dev' then 'cloudflare-workers' end as infra_category,
      host like '10.0.0.%' as ip_literal, regexp_matches(replace(host, 'x', chr(1093)), '[a-z]') and host like '%x%' as mixed_script
    from hosts""")
def host_patterns(t: Inputs):
    df = jobs.with_host_signals(t.hosts).drop("mixed_script")
    lookalike = jobs.has_mixed_script(F.translate("host", "x", "х"))
    return df.select("target_id", "host", "infra_category", "ip_literal", lookalike.alias("mixed_script"))


@query(f"with {_TYPOSQUAT} select domain, brand, matched_domain, distance from closest")
def typosquat_matches(t: Inputs):
    domains = with_registrable_domain(t.hosts, t.rules).select(F.col("registrable_domain").alias("domain"))
    return typosquat(domains, t.brands).withColumn("distance", F.col("distance").cast("long"))


_SIGNALS = f"""
    {_DGA.strip()}, {_TYPOSQUAT.strip()},
    signals as (
      select d.target_id, 'typosquat' as key, c.brand as detail, case c.distance when 1 then 0.3e0 else 0.15e0 end as weight
        from domains d join closest c on d.domain = c.domain
      union all select target_id, 'dga_score', null, 0.25e0 from dga where round(score, 4) > 0.6e0
      union all select target_id, 'dga_borderline', null, 0e0 from dga where round(score, 4) > 0.3e0 and round(score, 4) <= 0.6e0
      union all select target_id, 'abuse_prone_infra', 'cloudflare-workers', 0.2e0 from hosts where host like '%.workers.dev'
      union all select target_id, 'ip_literal', null, 0.15e0 from hosts where host like '10.0.0.%')"""


@query(f"with {_SIGNALS} select target_id, 'L1' as layer, key, detail, weight from signals")
def lexical_evidence(t: Inputs):
    rows = jobs.lexical_evidence(jobs.lexical_signals(t.host_urls, t.brands, t.rules))
    detail = F.coalesce(F.get_json_object("value", "$.brand"), F.get_json_object("value", "$.category"))
    return rows.select("target_id", "layer", "key", detail.alias("detail"), "weight")


@query(f"with {_SIGNALS} select target_id, round(least(1, sum(weight)), 4) as lexical_risk_score from signals group by target_id")
def lexical_risk_scores(t: Inputs):
    rows = jobs.lexical_evidence(jobs.lexical_signals(t.host_urls, t.brands, t.rules))
    return risk_scores(rows, "L1", "lexical_risk_score")


@query("""
    select target_id, 'aitm_email_payload' as key, concat('{"count":1,"emails":["user', cast(page_id as varchar), '@mail.example.com"]}') as value, 0.4e0 as weight
    from submissions where target_id % 9 = 8""")
def email_payload_evidence(t: Inputs):
    from lurelens.operators.intake import with_intake

    rows = jobs.lexical_evidence(jobs.lexical_signals(with_intake(t.submissions), t.brands, t.rules))
    return rows.filter("key = 'aitm_email_payload'").select("target_id", "key", "value", "weight")


@query("""
    select target_id, layer, case layer when 'L0' then 0 when 'L1' then 1 when 'L2' then 2 when 'L3' then 3 when 'L4' then 4 when 'L5' then 5 else 6 end as layer_rank,
      case when weight <= 0 then 'info' when weight < 0.2e0 then 'low' when weight < 0.4e0 then 'medium' else 'high' end as band,
      count(*) as n, round(sum(weight), 3) as weight
    from evidence group by all""")
def evidence_by_layer(t: Inputs):
    return layer_groups(t.evidence).withColumns({"weight": F.round("weight", 3), "layer_rank": F.col("layer_rank").cast("int")})
