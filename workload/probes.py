"""Probe result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import probes as jobs
from workload.registry import Inputs, query

_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+')"

_CHAINS = f"""
    kept as (select *, status_code in (301, 302) and coalesce(location, '') <> '' and error is null as moved from hops where hop <= 10),
    chains as (select target_id, count(*) as hop_count, count(*) filter (moved) as redirect_count, arg_max(url, hop) as last_url, max(hop) as last_hop,
      arg_max(moved, hop) as moved, list(error order by hop)[-1] as error from kept group by target_id),
    summary as (select target_id, hop_count, redirect_count, case when moved then concat({_ORIGIN.replace('url', 'last_url')}, '/next/', last_hop + 1) else last_url end as final_url,
      moved and last_hop = 10 as truncated, error from chains)"""


@query(f"with {_CHAINS} select target_id, hop_count, redirect_count, final_url, truncated, error from summary")
def redirect_summary(t: Inputs):
    return jobs.redirect_summary(t.hops)


@query(f"""
    with {_CHAINS}
    select target_id, 'redirect_hop_count' as key, concat(hop_count, '|', redirect_count, '|', truncated, '|', final_url) as detail,
      case when redirect_count >= 3 then 0.05e0 else 0e0 end as weight from summary where error is null
    union all select target_id, 'excessive_redirects', concat('||', redirect_count), 0.15e0 from summary where error is null and redirect_count >= 5
    union all select target_id, 'active_probe_error', error, 0e0 from summary where error is not null
    union all select h.target_id, 'unusual_server_header', concat(server, '|', url), 0.05e0 from kept h join summary s using (target_id)
      where s.error is null and server = 'Boa/0.94'""")
def redirect_evidence(t: Inputs):
    get = lambda path: F.get_json_object("value", path)
    detail = (
        F.when(F.col("key") == "redirect_hop_count", F.concat_ws("|", get("$.hop_count"), get("$.redirect_count"), get("$.truncated"), get("$.final_url")))
        .when(F.col("key") == "excessive_redirects", F.concat(F.lit("||"), get("$.redirect_count")))
        .when(F.col("key") == "active_probe_error", get("$.error"))
        .otherwise(F.concat_ws("|", get("$.server"), get("$.hop_url")))
    )
    return jobs.redirect_evidence(t.hops).select("target_id", "key", detail.alias("detail"), "weight")


@query(f"""
    select target_id, hop, url as from_url, concat({_ORIGIN}, location) as to_url, 'http_3xx' as kind
    from hops where status_code in (301, 302) and location is not null and error is null""")
def redirect_edges(t: Inputs):
    return jobs.redirect_edges(t.hops)


@query("select user_id as target_id, array_to_string(list_filter(['sid', concat('k', event_id % 5), 'flag'], x -> x <> 'k0'), '|') as cookies from events".replace("x -> x", "lambda x: x"))
def cookie_names(t: Inputs):
    headers = F.array(
        F.concat(F.lit("sid = "), F.col("props")),
        F.concat(F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" k"), F.col("event_id") % 5)), F.lit("=a=b; Path=/")),
        F.lit("flag"),
    )
    return t.events.select(F.col("user_id").alias("target_id"), F.array_join(jobs.cookie_names(headers), "|").alias("cookies"))


@query("select page_id, n_name, n_name not like '%AN%' as unusual from pages join nation on page_id % 25 = n_nationkey")
def unusual_servers(t: Inputs):
    df = t.sql("select page_id, n_name from pages join nation on page_id % 25 = n_nationkey")
    header = F.when(F.col("n_name").contains("AN"), F.concat(F.lit("My-NGINX/"), F.col("n_name"))).otherwise(F.concat(F.lit("Boa "), F.col("n_name")))
    return df.select("page_id", "n_name", jobs.is_unusual_server(header).alias("unusual"))


_COMPARED = """
    good as (select * from fetches where error is null),
    sized as (select *, count(*) over (partition by target_id) as ok from good),
    votes as (
      select target_id, 1 as stage, cast(status_code as varchar) as v, count(*) as n, min(ord) as first from sized where ok >= 2 group by all
      union all select target_id, 2, final_url, count(*), min(ord) from sized where ok >= 2 group by all
      union all select target_id, 3, body_sha256, count(*), min(ord) from sized where ok >= 2 group by all),
    majority as (select target_id, stage, arg_min(v, (-n, first)) as v from votes group by target_id, stage),
    odd as (
      select g.target_id, m.stage, g.profile, g.ord, g.content_length from good g join majority m on g.target_id = m.target_id
      where case m.stage when 1 then cast(g.status_code as varchar) when 2 then g.final_url else g.body_sha256 end <> m.v),
    stage as (select target_id, min(stage) as stage from odd group by target_id),
    divergent as (select odd.* from odd join stage using (target_id, stage)),
    named as (select target_id, array_to_string(list(profile order by ord), '|') as divergent_profiles,
      arg_min(profile, (-content_length, ord)) as probe_profile, arg_min(profile, ord) as first_divergent from divergent group by target_id),
    agreeing as (select g.target_id, arg_min(g.profile, (-g.content_length, g.ord)) as richest from good g anti join divergent d on g.target_id = d.target_id and g.profile = d.profile group by g.target_id),
    compared as (select p.page_id as target_id, (select count(*) from good g where g.target_id = p.page_id) as profiles_compared,
        n.target_id is not null as cloaking_detected, coalesce(divergent_profiles, '') as divergent_profiles,
        case when n.target_id is null then 'desktop_chrome' else coalesce(richest, first_divergent) end as recommended_profile, probe_profile
      from pages p left join named n on n.target_id = p.page_id left join agreeing a on a.target_id = p.page_id)"""


@query(f"with {_COMPARED} select target_id, profiles_compared, cloaking_detected, divergent_profiles from compared")
def cloaking(t: Inputs):
    df = jobs.compare_profiles(t.fetches)
    return df.select(
        "target_id", F.col("profiles_compared").cast("long").alias("profiles_compared"), "cloaking_detected",
        F.array_join("divergent_profiles", "|").alias("divergent_profiles"),
    )


@query(f"with {_COMPARED} select target_id, recommended_profile, probe_profile from compared")
def profile_choice(t: Inputs):
    return jobs.compare_profiles(t.fetches).select("target_id", "recommended_profile", "probe_profile")


@query(f"""
    with {_COMPARED}, per as (select target_id, count(*) as profiles, sum(content_length) as bytes from fetches group by target_id)
    select target_id, 'cloaking_detected' as key, 0.25e0 as weight, divergent_profiles as detail from compared where cloaking_detected
    union all select target_id, 'differential_fetch_summary', 0e0, concat(profiles_compared, '|', profiles, '|', bytes) from compared join per using (target_id)""")
def cloaking_evidence(t: Inputs):
    rows = jobs.cloaking_evidence(jobs.compare_profiles(t.fetches))
    value = F.from_json("value", "struct<divergent_profiles:array<string>,profiles_compared:bigint,profiles:map<string,struct<content_length:bigint>>>")
    sizes = F.transform(F.map_values(value["profiles"]), lambda p: p["content_length"])
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x)
    detail = F.when(F.col("weight") > 0, F.array_join(value["divergent_profiles"], "|")).otherwise(
        F.concat_ws("|", value["profiles_compared"], F.size(sizes), total)
    )
    return rows.select("target_id", "key", "weight", detail.alias("detail"))


@query()
def favicon_hashes(t: Inputs):
    """Favicon fingerprints; the bytes of the page stand in for the icon."""
    icons = t.pages.select(F.col("page_id").alias("target_id"), F.col("html").cast("binary").alias("content"))
    return jobs.favicon_fingerprints(icons)


@query("""
    select page_id as target_id, 'favicon_hash' as key, 0.05e0 as weight, octet_length(cast(url as blob)) as size from pages
    union all select page_id, 'jarm_fingerprint', 0.1e0, 62 from pages where page_id % 3 = 0
    union all select page_id, 'active_probe_error', 0e0, 0 from pages where page_id % 3 = 2""")
def fingerprint_evidence(t: Inputs):
    icons = t.pages.select(F.col("page_id").alias("target_id"), F.col("url").cast("binary").alias("content"))
    digest = F.substring(F.sha2("url", 256), 1, 62)
    prints = t.pages.select(F.col("page_id").alias("target_id"), F.when(F.col("page_id") % 3 == 0, digest).when(
        F.col("page_id") % 3 == 1, "0" * 62).otherwise("short").alias("tls_print"), F.lit(None).cast("string").alias("error"))
    rows = jobs.fingerprint_evidence(jobs.favicon_fingerprints(icons), prints)
    size = F.coalesce(F.get_json_object("value", "$.size_bytes").cast("long"), F.length(F.get_json_object("value", "$.hash")), F.lit(0))
    return rows.select("target_id", "key", "weight", size.cast("long").alias("size"))


@query("select user_id as target_id, 'active_probe_error' as key, concat('{\"probe\":\"', event_type, '\",\"error\":\"e', event_id, '\"}') as value, 0e0 as weight from events where event_type = 'error'")
def probe_failures(t: Inputs):
    failures = t.events.select(
        F.col("user_id").alias("target_id"), F.col("event_type").alias("probe"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id"))).alias("error"),
    )
    return jobs.probe_errors(failures).select("target_id", "key", "value", "weight")
