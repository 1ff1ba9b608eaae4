"""Stored analyses: listing, history, overrides, replace, delete, export, logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lurelens.operators import decisions, history as jobs, overrides
from lurelens.schemas import TABLES
from lurelens.session import fresh_folder
from lurelens.sources import tables as store
from lurelens.sources.graph_store import GraphStore
from workload.registry import Inputs, query

_STAMP = "strftime(created_at, '%Y-%m-%d')"


def _stamp(column: str = "created_at"):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _case_edges(t: Inputs):
    return t.case_transitions


_COUNTED = """
    n as (select target_id, count(*) as num_states from states group by target_id),
    x as (select target_id, count(*) as num_transitions from case_transitions group by target_id),
    joined as (select t.*, v.classification, v.confidence, v.brand, v.rationale, coalesce(num_states, 0) as num_states, coalesce(num_transitions, 0) as num_transitions
      from targets t left join verdicts v using (target_id) left join n using (target_id) left join x using (target_id))"""


@query(f"""
    with {_COUNTED} select target_id, input_url, final_url, status, {_STAMP} as created_at, classification, confidence, num_states, num_transitions
    from joined order by created_at desc, target_id limit 50 offset 100""".replace("order by created_at", "order by joined.created_at"))
def listing_page(t: Inputs):
    page = jobs.list_targets(t.targets, t.verdicts, t.states, _case_edges(t), limit=50, offset=100)
    return page.withColumn("created_at", _stamp()).select(
        "target_id", "input_url", "final_url", "status", "created_at", "classification", "confidence", "num_states", "num_transitions"
    )


@query(f"""
    with {_COUNTED} select target_id, input_url, status, classification from joined
    where status = 'done' and classification = 'suspicious' and (input_url ilike '%BUILD_NG%' or final_url ilike '%BUILD_NG%')
    order by created_at desc, target_id limit 20""")
def filtered_listing(t: Inputs):
    page = jobs.list_targets(
        t.targets, t.verdicts, t.states, _case_edges(t), limit=20, status="done", classification="suspicious", search="BUILD_NG"
    )
    return page.select("target_id", "input_url", "status", "classification")


@query("""
    select (select count(*) from targets) as total, (select count(*) from targets t join verdicts v using (target_id) where v.classification = 'phishing') as phishing,
      (select count(*) from targets where input_url ilike '%auto%' or final_url ilike '%auto%') as matching""")
def target_counts(t: Inputs):
    count = lambda name, **filters: jobs.count_targets(t.targets, t.verdicts, **filters).select(
        F.lit(name).alias("name"), "total"
    )
    rows = count("total").unionByName(count("phishing", classification="phishing")).unionByName(count("matching", search="auto"))
    return rows.groupBy().pivot("name", ["total", "phishing", "matching"]).agg(F.first("total"))


@query("select status, count(*) as targets from targets group by status")
def status_counts(t: Inputs):
    return jobs.status_counts(t.targets)


@query(f"""
    with {_COUNTED} select url_hash, target_id, {_STAMP} as created_at, status, classification, num_states from joined where cast(url_hash as bigint) in (select l_suppkey from lineitem)""")
def url_history(t: Inputs):
    keys = t.lineitem.select(F.col("l_suppkey").cast("string").alias("url_hash"))
    rows = jobs.history(t.targets, t.verdicts, t.states, _case_edges(t), keys)
    return rows.select("url_hash", "target_id", _stamp(), "status", "classification", "num_states")


@query("""
    select query, case when length(query) = 64 then query else sha256(query) end as url_hash
    from (select url as query from pages union all select sha256(url) from pages)""")
def history_keys(t: Inputs):
    urls = t.pages.select(F.col("url").alias("query")).unionByName(t.pages.select(F.sha2("url", 256).alias("query")))
    return jobs.history_keys(urls)


_LATEST = "latest as (select * from (select *, row_number() over (partition by url_hash order by created_at desc, target_id) as r from targets) where r = 1)"


@query(f"with {_LATEST} select url_hash, target_id, status, {_STAMP} as created_at from latest")
def latest_runs(t: Inputs):
    return jobs.latest_per_url(t.targets).select("url_hash", "target_id", "status", _stamp())


@query(f"""
    with {_LATEST} select l.url_hash, l.target_id, v.classification from latest l join verdicts v using (target_id)
    where l.status = 'done' and timestamp '2001-08-01 12:00:00' - l.created_at < interval 9000 hours""")
def cached_verdicts(t: Inputs):
    rows = jobs.cached_verdicts(t.targets, t.verdicts, F.lit("2001-08-01 12:00:00").cast("timestamp"), hours=9000)
    return rows.select("url_hash", "target_id", "classification")


@query(f"""
    with {_COUNTED}, e as (select target_id, count(*) as num_evidence from case_evidence group by target_id)
    select target_id, classification, num_states, num_transitions, coalesce(num_evidence, 0) as num_evidence from joined left join e using (target_id)""")
def analysis_summaries(t: Inputs):
    rows = jobs.analysis_summary(t.targets, t.verdicts, t.states, _case_edges(t), t.case_evidence)
    return rows.select("target_id", "classification", "num_states", "num_transitions", "num_evidence")


def _tables(t: Inputs):
    return {"targets": t.targets, "states": t.case_states, "transitions": t.case_transitions, "evidence": t.case_evidence, "verdicts": t.verdicts}


def stored_graphs(t: Inputs) -> GraphStore:
    """A new store with the graphs of all runs: five tables, by their fixed schemas."""
    none, moment = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    given = _tables(t) | {
        "targets": t.targets.withColumns({"canonical_url": F.col("input_url"), "root_state_id": none, "created_at": F.col("created_at").cast("timestamp")}),
        "states": t.case_states.withColumns({"screenshot_ref": none, "har_ref": none}),
        "transitions": t.case_transitions.withColumns({"trigger": none, "ts": moment}),
        "evidence": t.case_evidence.withColumn("ts", moment),
        "verdicts": t.verdicts.withColumns({"produced_by": F.lit("test"), "final_url": none, "exfil_endpoint": none}),
    }
    kept = GraphStore(t.spark, fresh_folder(t.spark, "graphs"), buckets=8)
    typed = lambda name, df: df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields if f.name in df.columns])
    kept.save({name: typed(name, df) for name, df in given.items()}, {"evidence": {"evidence_id": F.sha2(F.concat_ws("|", "target_id", "key", "value"), 256)}})
    return kept


_RESAVED = "resaved as (select target_id from targets where status = 'error')"


@query(f"""
    with {_RESAVED}
    select 'targets' as part, target_id, status as detail, count(*) as n from (
      select target_id, status from targets anti join resaved using (target_id) union all select target_id, 'done' from resaved) group by all
    union all select 'states', target_id, state_id, 1 from case_states anti join resaved using (target_id)
    union all select 'states', target_id, concat(target_id, '-new'), 1 from resaved
    union all select 'verdicts', target_id, classification, 1 from verdicts anti join resaved using (target_id)""")
def replaced_graphs(t: Inputs):
    """Runs that failed are saved again with one state and no verdict; saving twice changes nothing."""
    old = _tables(t)
    again = old["targets"].filter("status = 'error'").withColumn("status", F.lit("done"))
    ids = again.select("target_id")
    states = old["states"].limit(0).unionByName(ids.select(
        "target_id", F.concat("target_id", F.lit("-new")).alias("state_id"), F.lit("u").alias("url"), F.lit("h").alias("dom_hash"),
        F.lit(0).alias("depth"), F.lit("A").alias("flag"),
    ))
    new = {"targets": again, "states": states, **{k: old[k].limit(0) for k in ("transitions", "evidence", "verdicts")}}
    saved = store.upsert_targets(store.upsert_targets(old, new), new)
    part = lambda name, detail: saved[name].select(F.lit(name).alias("part"), "target_id", F.col(detail).alias("detail"))
    rows = part("targets", "status").unionByName(part("states", "state_id")).unionByName(part("verdicts", "classification"))
    return rows.groupBy("part", "target_id", "detail").agg(F.count(F.lit(1)).alias("n"))


_WANTED = "wanted as (select distinct cast(event_id as varchar) as target_id from events)"


@query(f"""
    with {_WANTED}
    select 'kept targets' as part, count(*) as n from targets anti join wanted using (target_id)
    union all select 'kept states', count(*) from case_states anti join wanted using (target_id)
    union all select 'kept evidence', count(*) from case_evidence anti join wanted using (target_id)
    union all select 'deleted', count(*) from wanted semi join targets using (target_id)
    union all select 'not found', count(*) from wanted anti join targets using (target_id)""")
def deleted_graphs(t: Inputs):
    done = store.delete_targets(_tables(t), t.events.select(F.col("event_id").cast("string").alias("target_id")))
    sized = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    rows = sized("deleted", done.deleted).unionByName(sized("not found", done.not_found))
    for name in ("targets", "states", "evidence"):
        rows = rows.unionByName(sized(f"kept {name}", done.tables[name]))
    return rows


@query(f"""
    with {_WANTED},
    parts as (
      select target_id, 'targets' as part, target_id as name, 0 as depth from targets
      union all select target_id, 'states', state_id, depth from case_states
      union all select target_id, 'transitions', transition_id, 0 from case_transitions
      union all select target_id, 'evidence', key, 0 from case_evidence
      union all select target_id, 'verdicts', classification, 0 from verdicts)
    select target_id, part, name, row_number() over (partition by target_id, part order by depth, name) as position
    from parts semi join wanted using (target_id)""")
def exported_graphs(t: Inputs):
    """All five parts of the wanted graphs, children numbered in their order."""
    moment, tables = F.lit("2024-01-01").cast("timestamp"), _tables(t)
    tables["transitions"] = tables["transitions"].withColumn("ts", moment)
    tables["evidence"] = tables["evidence"].withColumn("ts", moment).withColumn("evidence_id", F.col("key"))
    rows = store.graph_rows(tables, t.events.select(F.col("event_id").cast("string").alias("target_id")))
    names = {"targets": "target_id", "states": "state_id", "transitions": "transition_id", "evidence": "key", "verdicts": "classification"}
    name = F.coalesce(*[F.when(F.col("part") == part, F.get_json_object("body", f"$.{field}")) for part, field in names.items()])
    named = rows.select("target_id", "part", "sort_key", name.alias("name"))
    position = F.row_number().over(W.partitionBy("target_id", "part").orderBy("sort_key", "name"))
    return named.select("target_id", "part", "name", position.cast("long").alias("position"))


@query("select target_id, input_url, url_hash, status, strftime(created_at, '%Y-%m-%d') as created from targets")
def stored_targets(t: Inputs):
    """Runs written as stored tables and read back with their fixed schemas."""
    folder = fresh_folder(t.spark, "tables")
    empty = lambda schema: t.spark.createDataFrame([], schema)
    targets = t.targets.select(
        "target_id", "input_url", F.col("input_url").alias("canonical_url"), "url_hash", "final_url", "status",
        F.lit(None).cast("string").alias("root_state_id"), F.col("created_at").cast("timestamp").alias("created_at"))
    store.write_tables({"targets": targets, **{name: empty(schema) for name, schema in TABLES.items() if name != "targets"}}, folder)
    rows = store.read_tables(t.spark, folder)["targets"]
    return rows.select("target_id", "input_url", "url_hash", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("select page_id, url, octet_length(encode(html)) as bytes, sha256(html) as digest from pages")
def page_snapshots(t: Inputs):
    pages = store.read_pages(t.spark, f"{t.folder}/pages.parquet")
    return pages.select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"))


@query("""
    select event_id as state_id, ord, case ord when 0 then 'GET' else 'POST' end as method, concat('https://h', user_id, '.example.com/', ord) as url,
      case ord when 0 then 200 else 0 end as status, case ord when 0 then value else -1e0 end as time_ms
    from events join (values (0), (1)) as o(ord) on o.ord <= event_id % 2""")
def har_requests(t: Inputs):
    first = """concat('{"startedDateTime":"x","time":', cast(value as string), ',"request":{"method":"GET","url":"https://h', cast(user_id as string),
        '.example.com/0","headers":[]},"response":{"status":200}}')"""
    second = """concat(',{"request":{"method":"POST","url":"https://h', cast(user_id as string), '.example.com/1"}}')"""
    logs = t.sql(f"""
        select event_id as state_id, concat('{{"log":{{"version":"1.2","entries":[', {first}, case when event_id % 2 = 1 then {second} else '' end, ']}}}}') as har from events""")
    rows = store.har_requests(logs)
    return rows.select("state_id", F.col("ord").cast("int").alias("ord"), "method", "url", F.col("status").cast("int").alias("status"), "time_ms")


# --- overrides: every event changes the entry of its user's page ---------------------------------------------

_CURRENT = """
    newest as (select user_id, arg_max(event_id, (added_at, change_id)) as event_id, max(added_at) as added_at from (select *, change_id as event_id from overrides) group by user_id),
    current as (select o.* from newest n join overrides o on o.change_id = n.event_id where not o.removed)"""


def _override_lists(t: Inputs):
    changes = t.sql("""
        select o.*, concat('HTTPS://Host', user_id, '.Example.com:443/p', user_id, '?q=1#f') as value from overrides o""")
    urls = overrides.url_changes(changes).accepted
    hosts = t.sql("select o.*, concat('login.dom', user_id, '.example.it') as value from overrides o")
    domains = overrides.domain_changes(hosts, t.rules).accepted
    return overrides.current_overrides(urls, "url_key"), overrides.current_overrides(domains, "domain_key")


@query(f"""
    with {_CURRENT}
    select 'urls' as list, concat('https://host', user_id, '.example.com/p', user_id) as value, list_type, note, added_by from current
    union all select 'domains', 'example.it', list_type, note, added_by from overrides
      where change_id = (select arg_max(change_id, (added_at, change_id)) from overrides) and not removed""")
def override_lists(t: Inputs):
    return overrides.list_overrides(*_override_lists(t)).drop("added_at")


@query(f"""
    with {_CURRENT}
    select concat('https://host', user_id, '.example.com/p', user_id) as url_key, bool_or(user_id in (select user_id from current)) as found
    from overrides group by user_id""")
def override_removals(t: Inputs):
    requests = t.sql("select *, concat('https://host', user_id, '.example.com/p', user_id) as url_key from overrides")
    return overrides.removal_results(requests, _override_lists(t)[0], "url_key")


def _matched(t: Inputs):
    """Even events look up the listed URL, every third one a listed domain."""
    urls = t.sql("""
        select event_id as target_id, case when event_id % 2 = 0 then concat('https://host', user_id, '.example.com/p', user_id) else 'https://other.example.com/' end as url_key,
          case when event_id % 3 = 0 then concat('dom', user_id, '.it') else 'none.it' end as registrable_domain from events""")
    by_url, _ = _override_lists(t)
    changes = t.sql("select o.*, concat('login.dom', user_id, '.it') as value from overrides o")
    by_domain = overrides.current_overrides(overrides.domain_changes(changes, t.rules).accepted, "domain_key")
    return overrides.apply_overrides(urls, by_url, by_domain)


@query(f"""
    with {_CURRENT}
    select e.event_id as target_id, coalesce(c.list_type, d.list_type) as list_type, case when c.user_id is not null then c.note else d.note end as note,
      case when c.user_id is not null then 'url' when d.user_id is not null then 'domain' end as matched
    from events e left join current c on c.user_id = e.user_id and e.event_id % 2 = 0 left join current d on d.user_id = e.user_id and e.event_id % 3 = 0""")
def override_matches(t: Inputs):
    return _matched(t).select("target_id", "list_type", "note", "matched")


@query(f"""
    with {_CURRENT}, m as (
    select e.event_id as target_id, coalesce(c.list_type, d.list_type) as list_type, case when c.user_id is not null then 'URL' when d.user_id is not null then 'Domain' end as level
    from events e left join current c on c.user_id = e.user_id and e.event_id % 2 = 0 left join current d on d.user_id = e.user_id and e.event_id % 3 = 0)
    select target_id, case list_type when 'whitelist' then 'safe' else 'malicious' end as verdict, 1e0 as confidence,
      case list_type when 'whitelist' then concat('Whitelist-Override: ', level, ' explicitly trusted') else concat('Blacklist-Override: ', level, ' explicitly blocked') end as signature,
      case list_type when 'whitelist' then 'allow' else 'block' end as recommended_action, case list_type when 'whitelist' then 'benign' else 'phishing' end as classification
    from m where list_type is not null""")
def override_decisions(t: Inputs):
    matched = _matched(t)
    answers = decisions.override_decision(matched).drop("reason")
    return answers.join(decisions.override_verdicts(matched).select("target_id", "classification"), "target_id")
