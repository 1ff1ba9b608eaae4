"""Feed enrichment queries. Inputs are built from orders and customers; see ``inputs``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import feeds as jobs
from lurelens.operators.snapshots import fresh_or_missing, with_freshness
from lurelens.sources import feeds as sources
from workload.inputs import AS_OF
from workload.registry import Inputs, query

_NOW_SQL = "timestamp '2000-01-01 00:00:00'"


def _now():
    return F.lit("2000-01-01T00:00:00Z").cast("timestamp")


def _split(column: str):
    return F.filter(F.split(column, r"\|"), lambda x: x != "")


def _dns(t: Inputs):
    answers = t.dns_answers.select("target_id", "host", _split("a_text").alias("a_records"), _split("aaaa_text").alias("aaaa_records"), "error")
    return jobs.clean_dns(answers)


_DNS = """
    dns as (select target_id, lower(host) as host, error as given,
        list_distinct(list_filter(string_split(a_text, '|'), lambda x: x <> '')) as a,
        list_filter(string_split(aaaa_text, '|'), lambda x: x <> '' and not starts_with(x, '::ffff:')) as aaaa from dns_answers),
    resolved as (select target_id, host, list_sort(a) as a, list_sort(aaaa) as aaaa,
        coalesce(given, case when len(a) = 0 and len(aaaa) = 0 then concat('No DNS records found for ', host) end) as error from dns)"""


@query(f"with {_DNS} select host, array_to_string(a, '|') as a_records, array_to_string(aaaa, '|') as aaaa_records, error from resolved")
def dns_records(t: Inputs):
    text = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    return _dns(t).select("host", text("a_records"), text("aaaa_records"), "error")


@query(f"""
    with {_DNS}
    select target_id, 'dns_a_records' as key, 0e0 as weight, null as reason from resolved where error is null and len(a) > 0
    union all select target_id, 'dns_aaaa_records', 0e0, null from resolved where error is null and len(aaaa) > 0
    union all select target_id, 'provider_unavailable', 0e0, error from resolved where error is not null""")
def dns_evidence(t: Inputs):
    targets = t.dns_answers.select("target_id", F.lower("host").alias("host"))
    rows = jobs.dns_evidence(targets, _dns(t))
    return rows.select("target_id", "key", "weight", F.get_json_object("value", "$.reason").alias("reason"))


def _certs(t: Inputs):
    return t.certificates.withColumn("not_before", F.concat(F.date_format("not_before", "yyyy-MM-dd"), F.lit("T00:00:00Z")).cast("timestamp"))


_HISTORY = f"""
    ages as (select host, date_diff('day', max(not_before), {_NOW_SQL}) as newest_cert_days, date_diff('day', min(not_before), {_NOW_SQL}) as oldest,
        count(*) as certs, bool_or(has_next) as paged from certificates group by host),
    history as (select host, newest_cert_days, case when not paged then oldest end as oldest_cert_days, case when not paged then certs end as total_certs from ages)"""

_SIBLINGS = """
    newest as (select host, cert_id, row_number() over (partition by host order by not_before desc, cert_id) as r from certificates),
    names as (select distinct newest.host, lower(trim(trim(san), '.')) as san from newest join cert_names using (cert_id) where r <= 25),
    siblings as (select host, count(*) as total_siblings, list_sort(list(san))[1:50] as domains from names where san <> host group by host)"""


@query(f"with {_HISTORY} select host, newest_cert_days, coalesce(oldest_cert_days, -99999) as oldest_cert_days, coalesce(total_certs, -1) as total_certs from history")
def certificate_history(t: Inputs):
    df = jobs.certificate_history(_certs(t), _now())
    known = {"newest_cert_days": 0, "oldest_cert_days": -99999, "total_certs": -1}
    return df.withColumns({c: F.coalesce(c, F.lit(unknown)).cast("long") for c, unknown in known.items()})


@query(f"with {_SIBLINGS} select host, array_to_string(domains, '|') as domains, total_siblings > 50 as truncated, total_siblings from siblings")
def sibling_domains(t: Inputs):
    df = jobs.sibling_domains(_certs(t), t.cert_names)
    return df.withColumn("domains", F.array_join("domains", "|"))


@query(f"""
    with {_HISTORY}, {_SIBLINGS}
    select c_custkey as target_id, case when s.host is not null then 'sibling_domains' else 'certificate_history' end as key,
      case when s.host is not null then 0.3e0 when newest_cert_days <= 30 then 0.15e0 else 0e0 end as weight,
      newest_cert_days as newest, coalesce(s.total_siblings, 0) as total
    from customer join history h on h.host = concat('h', c_custkey, '.com') left join siblings s on s.host = h.host""")
def certificate_evidence(t: Inputs):
    targets = t.customer.select(F.col("c_custkey").alias("target_id"), F.concat(F.lit("h"), F.col("c_custkey"), F.lit(".com")).alias("host"))
    # lines numbered 1 carry only the host's own name, so hosts without other names keep their history
    certs = _certs(t)
    rows = jobs.certificate_evidence(targets, jobs.certificate_history(certs, _now()), jobs.sibling_domains(certs, t.cert_names))
    number = lambda path, name: F.coalesce(F.get_json_object("value", path).cast("long"), F.lit(0)).alias(name)
    return rows.select("target_id", "key", "weight", number("$.newest_cert_days", "newest"), number("$.total_siblings", "total"))


_RDAP = """
    dates as (select target_id, domain, raw, regexp_extract(raw, '"registration","eventDate":"([^"]*)"', 1) as text from registrations),
    parsed as (select target_id, domain, raw, try_cast(replace(replace(text, 'T', ' '), 'Z', '') as timestamp) as registered from dates),
    records as (select target_id, domain, registered, date_part('epoch', timestamp '2024-02-01 00:00:00') - date_part('epoch', registered) as seconds,
      concat(regexp_extract(raw, '"text","([a-z]+ Inc)"', 1)) as registrar,
      concat(lower(regexp_extract(raw, '"ldhName":"([^"]*)"', 1)), '|ns2.example.net') as nameservers from parsed)"""


@query(f"with {_RDAP} select domain, strftime(registered, '%Y-%m-%d %H:%M:%S') as registered_at, registrar, nameservers from records")
def registration_records(t: Inputs):
    df = sources.parse_rdap(t.registrations.select("domain", "raw"))
    return df.select(
        "domain", F.date_format("registered_at", "yyyy-MM-dd HH:mm:ss").alias("registered_at"), "registrar",
        F.array_join("nameservers", "|").alias("nameservers"),
    )


@query(f"""
    with {_RDAP}
    select target_id, 'domain_age_days' as key, cast(floor(seconds / 86400) as bigint) as age,
      case when floor(seconds / 86400) < 30 then 'young' else 'moderate' end as category,
      case when floor(seconds / 86400) < 30 then 0.35e0 else 0.15e0 end as weight
    from records where floor(seconds / 86400) < 90""")
def registration_evidence(t: Inputs):
    targets = t.registrations.select("target_id", F.col("domain").alias("registrable_domain"))
    rows = jobs.registration_evidence(targets, sources.parse_rdap(t.registrations.select("domain", "raw")), F.lit(AS_OF).cast("timestamp"))
    return rows.select(
        "target_id", "key", F.get_json_object("value", "$.age_days").cast("long").alias("age"),
        F.get_json_object("value", "$.category").alias("category"), "weight",
    )


@query("""
    with servers as (select concat('t', n_regionkey, '.x') as tld, n_name as name, n_nationkey as ord, case n_nationkey % 3 when 0 then 'http' when 1 then 'https' else 'ftp' end as scheme from nation),
    domains as (select distinct concat('d', c_nationkey, '.t', c_nationkey % 7, '.x') as registrable_domain, concat('t', c_nationkey % 7, '.x') as tld from customer),
    ranked as (select registrable_domain, d.tld, concat(scheme, '://', lower(replace(name, ' ', '-')), '/domain/', registrable_domain) as query_url,
      row_number() over (partition by registrable_domain order by case scheme when 'https' then 0 when 'http' then 1 else 2 end, ord) as rank
      from domains d join servers s on d.tld = s.tld)
    select registrable_domain, tld, rank, query_url from ranked where rank <= 3""")
def registry_worklist(t: Inputs):
    domains = t.sql("select concat('d', c_nationkey, '.t', c_nationkey % 7, '.x') as registrable_domain from customer")
    servers = t.sql("""
        select concat('t', n_regionkey, '.x') as tld, concat(case n_nationkey % 3 when 0 then 'http' when 1 then 'https' else 'ftp' end,
          '://', lower(replace(n_name, ' ', '-')), '/') as server, n_nationkey as ord from nation""")
    return jobs.registry_worklist(domains, servers).withColumn("rank", F.col("rank").cast("long"))


@query("""
    with services as (select n_regionkey, list(concat('https://', lower(replace(n_name, ' ', '-'))) order by n_nationkey) as servers from nation group by n_regionkey)
    select concat('T', n_regionkey) as tld, unnest(servers) as server, unnest(range(len(servers))) as ord from services""")
def registry_servers(t: Inputs):
    documents = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(
        F.struct("n_nationkey", F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("s"))
    )).alias("l"))
    raw = documents.select(F.concat(
        F.lit('{"services":[[["T'), F.col("n_regionkey"), F.lit('"],'), F.to_json(F.transform("l", lambda x: x["s"])), F.lit("]]}")
    ).alias("raw"))
    servers = sources.registry_servers(raw)
    return servers.select(F.upper("tld").alias("tld"), "server", F.col("ord").cast("long").alias("ord"))


_VALUES = """
    wanted as (
      select target_id, 0 as ord, canonical_url as value from feed_values
      union all select target_id, 1, host from feed_values union all select target_id, 2, registrable_domain from feed_values)"""


@query(f"with {_VALUES} select target_id, ord, value from wanted")
def search_values(t: Inputs):
    return jobs.search_values(t.feed_values)


_ANSWERS = 3


def _repeated(answers):
    """Every answer as it comes back for several targets."""
    return answers.select(F.explode(F.array_repeat("raw", _ANSWERS)).alias("raw"))


def _misp_answers(t: Inputs):
    """Answers with a list of attributes and answers with a single one."""
    attribute = F.to_json(F.struct(
        F.col("attribute_id").alias("id"), "value", "type", "event_id", F.when(F.col("to_ids"), F.lit("1")).otherwise("0").alias("to_ids"),
        F.array(F.struct(F.col("tag_a").alias("name"))).alias("Tag"),
        F.struct(F.array(F.struct(F.col("tag_b").alias("name"))).alias("Tag")).alias("Event"),
    ))
    listed = F.when(F.length("value") % 2 == 0, F.concat(F.lit("["), attribute, F.lit("]"))).otherwise(attribute)
    return t.misp_attributes.select(F.concat(F.lit('{"response":{"Attribute":'), listed, F.lit("}}")).alias("raw"))


def _attributes(t: Inputs):
    return sources.parse_misp(_repeated(_misp_answers(t)))


_MISP = f"""{_VALUES},
    hits as (select target_id, type, event_id, to_ids, tag_a, tag_b from wanted join misp_attributes using (value) where type <> 'sha1'),
    tags as (select target_id, array_to_string(list_sort(list(distinct tag)), '|') as tags from (select target_id, tag_a as tag from hits union select target_id, tag_b from hits) group by target_id),
    misp as (select target_id, count(*) as match_count, array_to_string(list_sort(list(distinct type)), '|') as matched_types, count(distinct event_id) as event_count,
      bool_or(to_ids) as to_ids_match from hits group by target_id)"""


@query(f"with {_MISP} select target_id, match_count, matched_types, tags, event_count, to_ids_match, not to_ids_match as context_only from misp join tags using (target_id)")
def misp_summary(t: Inputs):
    df = jobs.misp_summary(jobs.search_values(t.feed_values), _attributes(t))
    return df.withColumns({c: F.array_join(c, "|") for c in ("matched_types", "tags")})


def _opencti_answers(t: Inputs):
    per = t.indicators.groupBy("observable_id").agg(F.collect_list(F.struct(F.struct(
        F.col("indicator_id").alias("id"), "revoked", "valid_until", F.col("score").alias("x_opencti_score"),
        F.array(F.struct(F.col("label").alias("value"))).alias("objectLabel"),
    ).alias("node"))).alias("edges"))
    nodes = t.observables.join(per, "observable_id", "left").select(F.struct(
        F.col("observable_id").alias("id"), F.col("type").alias("entity_type"), F.col("value").alias("observable_value"),
        F.array(F.struct(F.col("marking").alias("definition"))).alias("objectMarking"),
        F.array(F.struct(F.col("label").alias("value"))).alias("objectLabel"),
        F.struct(F.col("creator").alias("name")).alias("createdBy"), F.struct("edges").alias("indicators"),
    ).alias("node"))
    edges = F.struct(F.array(F.struct("node")).alias("edges")).alias("stixCyberObservables")
    return nodes.select(F.to_json(F.struct(F.struct(edges).alias("data"))).alias("raw"))


def _opencti(t: Inputs):
    return sources.parse_opencti(_repeated(_opencti_answers(t)))


_OPENCTI = f"""{_VALUES},
    hits as (select target_id, o.* from wanted join observables o using (value) where type <> 'Artifact'),
    found as (select target_id, count(*) as match_count, array_to_string(list_sort(list(distinct type)), '|') as matched_types,
      array_to_string(list_sort(list(distinct marking)), '|') as markings, coalesce(array_to_string(list_sort(list(distinct creator) filter (creator is not null)), '|'), '') as created_by from hits group by target_id),
    detail as (select target_id, i.*, not revoked and coalesce(try_cast(valid_until as timestamptz) >= timestamptz '2024-02-01 00:00:00+00', false) as active
      from hits join indicators i using (observable_id)),
    counted as (select target_id, count(*) as total, count(*) filter (active) as active, min(score) filter (active) as score_min, max(score) filter (active) as score_max,
      round(avg(score) filter (active), 1) as score_avg from detail group by target_id),
    notes as (select target_id, array_to_string(list_sort(list(distinct label)), '|') as labels from (select target_id, label from hits union select target_id, label from detail) group by target_id),
    opencti as (select f.target_id, match_count, matched_types, coalesce(active, 0) as active_indicator_count, coalesce(total, 0) as total_indicator_count,
      labels, markings, created_by, score_min, score_max, score_avg, coalesce(active, 0) > 0 as active_ioc_match, coalesce(active, 0) = 0 as context_only
      from found f left join counted c using (target_id) left join notes n using (target_id))"""


@query(f"with {_OPENCTI} select * from opencti")
def opencti_summary(t: Inputs):
    df = jobs.opencti_summary(jobs.search_values(t.feed_values), *_opencti(t), F.lit(AS_OF).cast("timestamp"))
    return df.withColumns({c: F.array_join(c, "|") for c in ("matched_types", "labels", "markings", "created_by")})


@query("select observable_id, indicator_id, not revoked and coalesce(try_cast(valid_until as timestamptz) >= timestamptz '2024-02-01 00:00:00+00', valid_until is null) as active from indicators")
def active_indicators(t: Inputs):
    active = jobs.is_active_indicator(F.col("revoked"), F.col("valid_until"), F.lit(AS_OF).cast("timestamp"))
    return t.indicators.select("observable_id", "indicator_id", active.alias("active"))


_LISTED = "select c_custkey as target_id from customer where c_acctbal > 0"


@query(f"{_LISTED}")
def urlhaus_matches(t: Inputs):
    answers = t.sql("""
        select concat('https://h', c_custkey, '.s', c_nationkey, '.com/login') as value,
          case when c_acctbal > 0 then '{"query_status":"ok","threat":"malware"}' else '{"query_status":"no_results"}' end as raw
        from customer""")
    return jobs.urlhaus_matches(t.feed_values, sources.parse_urlhaus(answers)).select("target_id")


_REPUTATION = f"""
    with {_MISP}, {_OPENCTI.replace(_VALUES + ',', '').replace('hits', 'cti_hits')},
    rows as (
      select target_id, case when to_ids_match then 'reputation_hit' else 'misp_context_match' end as key, case when to_ids_match then 0.55e0 else 0e0 end as weight from misp
      union all select target_id, case when active_ioc_match then 'reputation_hit' else 'opencti_context_match' end, case when active_ioc_match then 0.55e0 else 0e0 end from opencti)"""


def _reputation(t: Inputs):
    observables, indicators = _opencti(t)
    now = F.lit(AS_OF).cast("timestamp")
    return jobs.reputation_evidence(jobs.check_reputation(jobs.search_values(t.feed_values), {
        "misp": lambda values: jobs.misp_summary(values, _attributes(t)),
        "opencti": lambda values: jobs.opencti_summary(values, observables, indicators, now),
    }))


@query(f"{_REPUTATION} select target_id, key, weight from rows")
def reputation_evidence(t: Inputs):
    return _reputation(t).select("target_id", "key", "weight")


@query(f"{_REPUTATION} select target_id, round(least(1, sum(weight)), 4) as passive_risk_score from rows group by target_id")
def passive_risk_scores(t: Inputs):
    return jobs.risk_scores(_reputation(t), "L2", "passive_risk_score")


@query("""
    select a.attribute_id, a.value, a.type, a.event_id, a.to_ids, concat(a.tag_a, '|', a.tag_b) as tags from misp_attributes a""")
def misp_records(t: Inputs):
    """Repeated answers, each attribute once."""
    return _attributes(t).withColumn("tags", F.array_join("tags", "|"))


@query("""
    select observable_id, 'observable' as kind, null as indicator_id, value as detail, label, marking, creator from observables
    union all
    select observable_id, 'indicator', indicator_id, concat(revoked, '|', coalesce(valid_until, ''), '|', cast(score as bigint)), label, '', null from indicators join observables using (observable_id)""".replace(
    ", label, '', null from indicators join", ", indicators.label, '', null from indicators join"))
def opencti_records(t: Inputs):
    observables, indicators = _opencti(t)
    first = lambda c: F.array_join(c, "|")
    found = observables.select(
        "observable_id", F.lit("observable").alias("kind"), F.lit(None).cast("string").alias("indicator_id"),
        F.col("value").alias("detail"), first("labels").alias("label"), first("markings").alias("marking"), "creator",
    )
    detail = F.concat_ws("|", F.col("revoked"), F.coalesce("valid_until", F.lit("")), F.col("score").cast("long"))
    return found.unionByName(indicators.select(
        "observable_id", F.lit("indicator").alias("kind"), "indicator_id", detail.alias("detail"), first("labels").alias("label"),
        F.coalesce(first("markings"), F.lit("")).alias("marking"), "creator",
    ))


@query("""
    select host, cert_id, strftime(not_before, '%Y-%m-%d') as issued, has_next, san from certificates left join cert_names using (cert_id)""")
def certificate_records(t: Inputs):
    rows = F.struct(F.col("cert_id").alias("id"), F.date_format("not_before", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("not_before"))
    search = t.certificates.groupBy("host").agg(F.first("has_next").alias("has_next"), F.collect_list(rows).alias("rows"))
    details = t.cert_names.groupBy("cert_id").agg(F.collect_list("san").alias("san_dns"))
    certs = sources.parse_ct_search(search.select("host", F.to_json(F.struct("has_next", "rows")).alias("raw")))
    sans = sources.parse_ct_details(details.select("cert_id", F.to_json(F.struct("san_dns")).alias("raw")))
    df = certs.join(sans, "cert_id", "left")
    return df.select("host", "cert_id", F.date_format("not_before", "yyyy-MM-dd").alias("issued"), "has_next", "san")


_SNAPSHOT = """
    keys as (select distinct case event_type when 'click' then 'rdap' when 'view' then 'dns' else 'urlhaus' end as provider, concat('q', user_id) as query from events),
    collected as (select case event_type when 'click' then 'rdap' when 'view' then 'dns' else 'urlhaus' end as provider, concat('q', user_id) as query,
      case when event_id % 10 = 0 then 'broken {' else props end as payload, ts, event_id from events where event_type <> 'signup'),
    newest as (select provider, query, arg_max(payload, (ts, payload)) as payload, max(ts) as ts from collected group by provider, query),
    checked as (select provider, query, case when try_cast(payload as json) is not null
      and date_part('epoch', timestamp '2024-01-31 00:00:00') - date_part('epoch', ts) <= case provider when 'rdap' then 86400 else 3600 end then payload end as payload
      from keys left join newest using (provider, query))"""


def _snapshot(t: Inputs):
    provider = F.when(F.col("event_type") == "click", "rdap").when(F.col("event_type") == "view", "dns").otherwise("urlhaus")
    df = t.events.select("*", provider.alias("provider"), F.concat(F.lit("q"), F.col("user_id")).alias("query"))
    answers = df.filter("event_type <> 'signup'").select(
        "provider", F.sha2("query", 256).alias("cache_key"), F.when(F.col("event_id") % 10 == 0, "broken {").otherwise(F.col("props")).alias("payload"),
        F.col("ts").cast("timestamp").alias("cached_at"),
    )
    return df.select("provider", "query"), answers, F.lit("2024-01-31 00:00:00").cast("timestamp")


@query(f"with {_SNAPSHOT} select provider, query, payload from checked")
def fresh_snapshots(t: Inputs):
    return with_freshness(*_snapshot(t)).select("provider", "query", "payload")


@query(f"with {_SNAPSHOT} select provider, query from checked where payload is null")
def keys_to_collect(t: Inputs):
    return fresh_or_missing(*_snapshot(t)).missing
