"""Answers at request time: verdicts in stream state, as-of lookups, deep pages, cycles, whole documents, checked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.functions.table_functions import register_table_functions
from lurelens.operators import asof, graph, history, overrides
from lurelens.operators.decisions import OVERRIDE_SIGNATURES
from lurelens.plans.analysis import Collected, analyse
from lurelens.session import dealt, fresh_folder, stored
from lurelens.sources import answers, documents, feeds, tables as store
from lurelens.streaming import stateful
from workload.feeds import _certs, _misp_answers, _opencti_answers  # noqa: F401
from workload.pages import _plus
from workload.registry import Inputs, query
from workload.store import stored_graphs

_DAYS = 8200
_THIRDS = 3

# --- requests are events; runs are orders ----------------------------------------------------------------------

_ASOF = f"""
    requests as (select event_id, cast(user_id as varchar) as url_hash, ts - interval {_DAYS} days as requested_at from events),
    first_runs as (select url_hash, created_at, min(target_id) as target_id from targets group by url_hash, created_at),
    runs as (select f.url_hash, f.target_id, cast(f.created_at as timestamp) as created_at, t.status, v.classification
      from first_runs f join targets t using (target_id) left join verdicts v using (target_id)),
    answered as (select q.*, r.target_id, r.status, r.classification, r.created_at,
        coalesce(r.status = 'done' and r.classification is not null and date_part('epoch', q.requested_at) - date_part('epoch', r.created_at) < 86400, false) as usable
      from requests q asof left join runs r on q.url_hash = r.url_hash and q.requested_at >= r.created_at)"""


def _requests(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("url_hash"), (F.col("ts").cast("timestamp") - F.expr(f"interval {_DAYS} days")).alias("requested_at"))


@query(f"""
    with {_ASOF}
    select event_id, url_hash, target_id as run_target, status as run_status, case when usable then target_id end as cached_target,
      case when usable then classification end as classification from answered""")
def runs_at_request_time(t: Inputs):
    """Every request with the run that was the newest when it came, not with the newest of all."""
    return asof.runs_at_request(_requests(t.events), t.targets, t.verdicts).drop("requested_at")


def _batches(t: Inputs, name: str, rows: dict[str, DataFrame], time: dict[str, str], start, run) -> str:
    """Write rows in three spans of time, and let the stream run after each; where the results are."""
    path = fresh_folder(t.spark, name)
    streams = start({key: t.spark.readStream.schema(df.schema).parquet(f"{path}/{key}/*") for key, df in rows.items()})
    ends = [F.lit(low).cast("timestamp") for low in _ends(t)]
    for i in range(_THIRDS):
        for key, df in rows.items():
            at = F.col(time[key]).cast("timestamp")
            span = at <= ends[0] if i == 0 else at > ends[i - 1]
            df.where(span if i == _THIRDS - 1 else span & (at <= ends[i])).write.parquet(f"{path}/{key}/batch={i}")
        run(streams, f"{path}/data", f"{path}/progress")
    return f"{path}/data"


def _ends(t: Inputs) -> list[str]:
    """The ends of the first two thirds of the time that requests span."""
    at = F.unix_micros((F.col("ts").cast("timestamp") - F.expr(f"interval {_DAYS} days")))
    low, high = t.events.agg(F.min(at), F.max(at)).first()
    shown = t.spark.range(1).select(*[F.timestamp_micros(F.lit(low + (high - low) * i // _THIRDS)).cast("string") for i in (1, 2)]).first()
    return list(shown)


@query(f"""
    with {_ASOF}
    select cast(event_id as varchar) as request_id, url_hash, case when usable then target_id end as cached_target,
      case when usable then classification end as classification from answered""")
def streamed_verdict_state(t: Inputs):
    """Runs and requests as two streams in three batches; runs are kept in state until they are too old to answer."""
    # one row per order on both sides: too many to broadcast, and joined once for all batches
    runs = stored(t.targets.join(t.verdicts.select("target_id", "classification").hint("merge"), "target_id", "left").select(
        "url_hash", "target_id", "status", "classification", F.col("created_at").cast("timestamp").alias("created_at")), "runs")
    requests = _requests(t.events).withColumnRenamed("event_id", "request_id")
    path = _batches(
        t, "verdict-state", {"runs": runs, "requests": requests}, {"runs": "created_at", "requests": "requested_at"},
        lambda streams: stateful.answer_from_state(streams["requests"], streams["runs"]), stateful.run_stateful)
    return t.spark.read.parquet(path).select("request_id", "url_hash", "cached_target", "classification")


_STATUS = "case event_type when 'purchase' then 'done' when 'error' then 'error' else 'running' end"


@query(f"""
    with updates as (select cast(user_id as varchar) as target_id, {_STATUS} as status, epoch_us(ts - interval {_DAYS} days) as us from events),
    span as (select min(us) as low, max(us) as high from updates),
    ends as (select i, case when i = 2 then high else low + (high - low) * (i + 1) // 3 end as until_us,
        case when i = 0 then low - 1 else low + (high - low) * i // 3 end as since_us from span, range(3) as r(i)),
    waters as (select i, until_us, since_us, (select max(us) from updates where us <= until_us) - 3600000000 as water from ends),
    changes as (select target_id, arg_max(status, (us, status)) as status, max(us) as us from updates join waters on us > since_us and us <= until_us group by target_id, i),
    known as (select target_id, i, any_value(water) as water, arg_max(status, (us, status)) as status, max(us) as us from updates join waters on us <= until_us group by target_id, i)
    select target_id, status, us as changed_micros from changes
    union all
    select distinct target_id, 'stale', us + 86400000000 from known where status = 'running' and (us + 86400000000) // 1000 + 1 < water // 1000""")
def streamed_lifecycle(t: Inputs):
    """Changes of status of runs in three batches; runs that fall silent turn stale when the watermark passes them."""
    status = F.expr(_STATUS)
    updates = t.events.select(
        F.col("user_id").cast("string").alias("target_id"), status.alias("status"),
        (F.col("ts").cast("timestamp") - F.expr(f"interval {_DAYS} days")).alias("ts"))
    path = _batches(t, "lifecycle", {"updates": updates}, {"updates": "ts"}, lambda s: stateful.run_lifecycle(s["updates"]), stateful.run_stateful)
    return t.spark.read.parquet(path)


# --- listings, cycles, documents -------------------------------------------------------------------------------

@query("""
    with placed as (select target_id, input_url, status, row_number() over (order by created_at desc, target_id) as place, count(*) over () as n from targets)
    select p.target_id, input_url, status, classification from placed p left join verdicts v using (target_id)
    where place > n // 2 and place <= n // 2 + 50""")
def deep_listing_page(t: Inputs):
    """The page in the middle of the listing, found by counting."""
    page = history.list_targets(t.targets, t.verdicts, t.states, t.case_transitions, limit=50, offset=t.targets.count() // 2, deep_offset=0)
    return page.select("target_id", "input_url", "status", "classification")


_RINGS = """
    edges as (
      select c.user_id as target_id, p.event_id as from_state, c.event_id as to_state, concat('t', c.event_id) as transition_id, c.ts
      from steps c join steps p on c.user_id = p.user_id and p.rn = case when c.rn > 1 then cast(floor(c.rn / 2) as bigint) else c.user_id % 3 * 2 + 1 end and p.rn <> c.rn)"""


@query(f"""
    with recursive {_RINGS},
    back as (
      select user_id as target_id, event_id as state_id, event_id as at, [event_id] as seen from steps
      union all
      select b.target_id, b.state_id, e.from_state, list_append(seen, e.from_state) from back b join edges e
        on e.target_id = b.target_id and e.to_state = b.at where not list_contains(seen, e.from_state)),
    heads as (select distinct b.target_id, b.state_id from back b join edges e on e.target_id = b.target_id and e.to_state = b.at and e.from_state = b.state_id
      where b.state_id = list_min(seen)),
    walk as (
      select user_id as target_id, event_id as state_id, '' as path, h.state_id is not null as cyclic from steps s
        left join heads h on h.target_id = s.user_id and h.state_id = s.event_id
        where h.state_id is not null or not exists (from edges e where e.target_id = s.user_id and e.to_state = s.event_id)
      union all
      select w.target_id, e.to_state, concat(w.path, '/', e.transition_id), w.cyclic from walk w join edges e on e.target_id = w.target_id and e.from_state = w.state_id
        where not exists (from heads h where h.target_id = e.target_id and h.state_id = e.to_state))
    select target_id, state_id, path, cyclic from walk""")
def paths_with_cycles(t: Inputs):
    """Activity trees whose first event follows a later one, for two thirds of the users: paths begin at the smallest state
    of the cycle."""
    edges = t.sql(f"with {_RINGS.replace('with ', '')} select * from edges")
    df = graph.every_path(t.nodes, edges)
    path = F.array_join(F.transform("path", lambda x: F.concat(F.lit("/"), x)), "")
    return df.select("target_id", "state_id", path.alias("path"), "cyclic")


_OBJECTS = {
    "targets": ("target_id", "input_url", "url_hash", "final_url", "status"),
    "states": ("state_id", "target_id", "url", "dom_hash", "depth"),
    "transitions": ("transition_id", "target_id", "from_state", "to_state", "kind"),
    "evidence": ("target_id", "layer", "key", "value", "weight"),
    "verdicts": ("target_id", "classification", "confidence", "brand"),
}


def _json(table: str) -> str:
    return "cast(to_json({" + ", ".join(f"'{c}': {c}" for c in _OBJECTS[table]) + "}) as varchar)"


@query(f"""
    with wanted as (select distinct cast(event_id as varchar) as target_id from events),
    s as (select target_id, string_agg({_json("states")}, ',' order by depth, state_id) as body from case_states group by target_id),
    x as (select target_id, string_agg({_json("transitions")}, ',' order by transition_id) as body from case_transitions group by target_id),
    e as (select target_id, string_agg(body, ',' order by key, body) as body from (select target_id, key, {_json("evidence")} as body from case_evidence) group by target_id),
    v as (select target_id, {_json("verdicts")} as body from verdicts)
    select target_id, 0 as part, concat('{{"target":', {_json("targets")}, ',"states":[', s.body, '],"transitions":[', x.body, '],"evidence":[', e.body, '],"verdict":',
      coalesce(v.body, 'null'), '}}') as text
    from targets t semi join wanted using (target_id) left join s using (target_id) left join x using (target_id) left join e using (target_id) left join v using (target_id)""")
def exported_documents(t: Inputs):
    """Every wanted graph as one nested document."""
    given = {
        "targets": t.targets, "states": t.case_states, "transitions": t.case_transitions.withColumn("ts", F.lit(0)),
        "evidence": t.case_evidence.withColumns({"ts": F.lit(0), "evidence_id": F.col("key")}), "verdicts": t.verdicts}
    rows = store.graph_rows(given, t.events.select(F.col("event_id").cast("string").alias("target_id")), _OBJECTS)
    return documents.graph_documents(rows)


_PARTS = """
    select 'targets' as part, target_id, target_id as name, status as detail from {t}
    union all select 'states', target_id, state_id, dom_hash from {s}
    union all select 'transitions', target_id, transition_id, kind from {x}
    union all select 'evidence', target_id, key, value from {e}
    union all select 'verdicts', target_id, produced_by, classification from {v}"""
_GIVEN = {
    "t": "targets", "s": "case_states", "x": "case_transitions", "e": "case_evidence",
    "v": "(select target_id, classification, 'test' as produced_by from verdicts)"}


def _shown(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows are counted table by table, where the joins of the store have left the targets."""
    def part(name: str, label: str, detail: str) -> DataFrame:
        rows = tables[name].select("target_id", F.col(label).alias("name"), F.col(detail).alias("detail"))
        counted = rows.groupBy("target_id", "name", "detail").agg(F.count(F.lit(1)).alias("n"))
        return counted.select(F.lit(name).alias("part"), "target_id", "name", "detail", "n")

    return part("targets", "target_id", "status").unionByName(part("states", "state_id", "dom_hash")).unionByName(
        part("transitions", "transition_id", "kind")).unionByName(part("evidence", "key", "value")).unionByName(part("verdicts", "produced_by", "classification"))


@query(f"""
    with failed as (select target_id from targets where status = 'error'),
    rows as (
      select * from ({_PARTS.format(**_GIVEN)}) where target_id not in (select target_id from failed)
      union all select 'targets', target_id, target_id, 'done' from failed
      union all select 'states', target_id, concat(target_id, '-new'), 'h' from failed
      union all select 'evidence', target_id, 'gate_solved', 'again' from failed)
    select part, target_id, name, detail, count(*) as n from rows group by all""")
def committed_saves(t: Inputs):
    """All graphs are saved, then those that failed are saved again, twice: all five tables, read back from the store."""
    kept = stored_graphs(t)
    tables = kept.tables()
    again = tables["targets"].where("status = 'error'").withColumn("status", F.lit("done"))
    ids = again.select("target_id")
    states = ids.select(
        F.concat("target_id", F.lit("-new")).alias("state_id"), "target_id", F.lit("u").alias("url"), F.lit("h").alias("dom_hash"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("screenshot_ref"), F.lit(None).cast("string").alias("har_ref"))
    text = lambda value, name: F.lit(value).alias(name)
    found = ids.select(
        F.concat("target_id", F.lit("-e")).alias("evidence_id"), "target_id", text("target", "scope"), F.col("target_id").alias("scope_id"), text("L4", "layer"),
        text("gate_solved", "key"), text("again", "value"), F.lit(1.0).alias("weight"), text("test", "produced_by"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    for _ in range(2):
        kept.save({"targets": again, "states": states, "evidence": found})
    return _shown(kept.tables())


@query(f"""
    with wanted as (select distinct cast(event_id as varchar) as target_id from events),
    rows as (select * from ({_PARTS.format(**_GIVEN)}) anti join wanted using (target_id))
    select part, target_id, name, detail, count(*) as n from rows group by all
    union all select 'deleted', target_id, null, null, 1 from wanted semi join targets using (target_id)
    union all select 'not found', target_id, null, null, 1 from wanted anti join targets using (target_id)""")
def committed_deletes(t: Inputs):
    """All graphs are saved, some are deleted: what is left of all five tables, what went, and what never was."""
    kept = stored_graphs(t)
    gone = kept.delete(t.events.select(F.col("event_id").cast("string").alias("target_id")))
    rows = _shown(kept.tables())
    for part, ids in (("deleted", gone.deleted), ("not found", gone.not_found)):
        rows = rows.unionByName(ids.select(F.lit(part).alias("part"), "target_id", F.lit(1).cast("long").alias("n")), allowMissingColumns=True)
    return rows


# --- answers that cannot be read -------------------------------------------------------------------------------

def _spoilt(df: DataFrame, key: str) -> DataFrame:
    """Every tenth answer is broken, every eleventh is empty."""
    number = F.col(key).cast("long")
    return df.withColumn("raw", F.when(number % 10 == 0, F.substring("raw", F.lit(1), F.length("raw") - 1)).when(number % 11 == 0, "").otherwise(F.col("raw")))


_FAULT = "case when k % 10 = 0 then 'unreadable answer' when k % 11 = 0 then 'empty answer' when {} then {} end"


def _sources(t: Inputs) -> dict[str, DataFrame]:
    """Answers of all seven providers, one per customer, order or nation: ``key, raw``."""
    return {
        "rdap": t.registrations.select(F.col("target_id").alias("key"), F.when(F.col("target_id") % 13 == 0, '{"errorCode":404}').otherwise(F.col("raw")).alias("raw")),
        "certificate_search": t.sql("""
            select o_orderkey as key, concat('{"has_next":false', case when o_orderkey % 13 = 0 then '' else concat(',"rows":[{"id":"', o_orderkey,
              '","not_before":"', case when o_orderkey % 7 = 0 then 'soon' else '2024-01-01T00:00:00' end, '"},{"id":"","not_before":"2024-01-01T00:00:00"}]') end, '}') as raw from orders"""),
        "certificate_details": t.sql("""
            select o_orderkey as key, case when o_orderkey % 13 = 0 then '{"other":1}' else concat('{"san_dns":["n', o_orderkey, '.com"]}') end as raw from orders"""),
        "misp": t.sql("""
            select c_custkey as key, case when c_custkey % 13 = 0 then '{"response":{}}' else concat('{"response":{"Attribute":[{"id":"', c_custkey, '","type":"url","value":"',
              case when c_custkey % 7 = 0 then '' else concat('v', c_custkey) end, '"},{"id":"x","type":"url","value":"w"}]}}') end as raw from customer"""),
        "opencti": t.sql("""
            select c_custkey as key, case when c_custkey % 13 = 0 then '{"errors":[{"message":"x"}]}' else concat('{"data":{"stixCyberObservables":{"edges":[{"node":{"id":"o', c_custkey,
              '","entity_type":"Url"', case when c_custkey % 7 = 0 then '' else concat(',"observable_value":"v', c_custkey, '"') end, '}}]}}}') end as raw from customer"""),
        "urlhaus": t.sql("select c_custkey as key, case when c_custkey % 13 = 0 then '{}' else concat('{\"query_status\":\"ok\",\"id\":\"', c_custkey, '\"}') end as raw from customer"),
        "registry": t.sql("select n_nationkey as key, case when n_nationkey % 13 = 0 then '{\"version\":1}' else concat('{\"services\":[[[\"t', n_nationkey, '\"],[\"https://x/\"]]]}') end as raw from nation"),
    }


_KEYS = {"rdap": "c_custkey as k from customer", "certificate_search": "o_orderkey as k from orders", "certificate_details": "o_orderkey as k from orders",
         "misp": "c_custkey as k from customer", "opencti": "c_custkey as k from customer", "urlhaus": "c_custkey as k from customer", "registry": "n_nationkey as k from nation"}
_LACKS = {"rdap": "'error 404'", "certificate_search": "'no rows'", "certificate_details": "'no names'", "misp": "'no attributes'", "opencti": "'no observables'",
          "urlhaus": "'no status'", "registry": "'no services'"}
_RECORDS = {
    "rdap": "select k, case k % 5 when 1 then 'unreadable date: ' || date when 4 then 'unreadable date: ' || date || ' bad' end as reason from (select k, '2024-01-' || lpad(cast(k % 31 + 1 as varchar), 2, '0') as date from good) where k % 5 = 4",
    "certificate_search": "select k, 'certificate without date: ' || k as reason from good where k % 7 = 0 union all select k, 'certificate without id' from good",
    "misp": "select k, 'attribute without value: ' || k as reason from good where k % 7 = 0",
    "opencti": "select k, 'observable without value: o' || k as reason from good where k % 7 = 0",
}


def _rejects_sql(provider: str) -> str:
    records = _RECORDS.get(provider)
    whole = f"select '{provider}' as provider, k as key, fault as reason from faults where fault is not null"
    return f"""(with faults as (select k, {_FAULT.format("k % 13 = 0", _LACKS[provider])} as fault from (select {_KEYS[provider]})), good as (select k from faults where fault is null)
        {whole}{f" union all select '{provider}', k, reason from ({records})" if records else ""})"""


@query(" union all ".join(f"select * from {_rejects_sql(provider)}" for provider in _KEYS))
def rejected_answers(t: Inputs):
    """Why answers, or records in them, of all seven providers cannot be used; each source is read once."""
    rows = None
    for provider, df in _sources(t).items():
        found = answers.check_answers(_spoilt(df, "key"), provider).rejects.select("provider", F.col("key").cast("long").alias("key"), "reason")
        rows = found if rows is None else rows.unionByName(found)
    return rows


@query("""
    select c_custkey as attribute_id, concat('v', c_custkey) as value from customer where c_custkey % 10 <> 0 and c_custkey % 11 <> 0 and c_custkey % 13 <> 0 and c_custkey % 7 <> 0""")
def readable_attributes(t: Inputs):
    """What the parser makes of the answers that can be read, faulty records aside."""
    good = answers.check_answers(_spoilt(_sources(t)["misp"], "key"), "misp").answers
    rows = feeds.parse_misp(good.select("raw")).where("attribute_id <> 'x' and value <> ''")
    return rows.select(F.col("attribute_id").cast("int").alias("attribute_id"), "value")


# --- table functions -------------------------------------------------------------------------------------------

@query("""
    select page_id, unnest([0, 1, 2]) as ord, unnest(['email', 'password', 'select']) as type, unnest(['user', 'p', 's']) as name_or_id from pages""")
def lateral_form_fields(t: Inputs):
    """Form fields in SQL."""
    register_table_functions(t.spark)
    _plus(t).createOrReplaceTempView("pages_with_forms")
    return t.spark.sql("select page_id, f.ord, f.type, f.name_or_id from pages_with_forms, lateral form_fields(html) f")


@query("""
    select concat('p', page_id % 5) as part, cast(count(*) as int) as form_pages, cast(3 * count(*) as int) as n_fields, cast(count(*) as int) as passwords from pages group by page_id % 5""")
def partitioned_field_counts(t: Inputs):
    """Forms of each part of the pages, by a function of a partitioned table."""
    register_table_functions(t.spark)
    _plus(t).withColumn("part", F.concat(F.lit("p"), F.col("page_id") % 5)).select("part", "html").createOrReplaceTempView("parted_pages")
    return t.spark.sql("select * from field_counts(table(parted_pages) partition by part)")


# --- whole analyses --------------------------------------------------------------------------------------------

_KIND = "c_custkey % 5"


@query(f"""
    with cases as (select cast(c_custkey as varchar) as target_id, c_custkey as k, {_KIND} as kind, c_custkey % 3 as answer, c_custkey % 7 = 0 as broken from customer),
    judged as (select *, case when kind = 0 then 'failed' when kind = 2 then 'trusted' when kind = 3 then 'blocked' when kind = 1 and not broken then 'listed'
        when kind = 4 and answer = 0 then 'benign' when kind = 4 and answer = 1 then 'phishing' else 'unclear' end as case_ from cases)
    select target_id,
      case when case_ in ('blocked', 'listed', 'phishing') then 'malicious' else 'safe' end as verdict,
      case case_ when 'failed' then 0.1e0 when 'trusted' then 1e0 when 'blocked' then 1e0 when 'listed' then 0.95e0 when 'benign' then 0.97e0 when 'phishing' then 0.8e0 else 0.15e0 end as confidence,
      case case_ when 'failed' then 'Analysis-Failed' when 'trusted' then '{OVERRIDE_SIGNATURES["whitelist"] % "Domain"}' when 'blocked' then '{OVERRIDE_SIGNATURES["blacklist"] % "URL"}'
        when 'listed' then 'Phishing: Acme Impersonation' when 'benign' then 'No Threats Detected' when 'phishing' then 'Phishing Page Detected' else 'Suspicious Site (Low Confidence)' end as signature,
      case when case_ in ('blocked', 'listed', 'phishing') then 'block' else 'allow' end as recommended_action,
      case when kind in (2, 3) then 0 else cast(kind = 0 as int) + cast(broken as int) end as n_errors
    from judged""")
def whole_decisions(t: Inputs):
    """The whole analysis of one URL per customer: some cannot be read, some are listed by a feed, some are overridden (with hops
    collected for them all the same), the others have a model's answer or none; some feed answers are broken."""
    cases = stored(dealt(t.sql(f"""
        select cast(c_custkey as string) as target_id, c_custkey as k, {_KIND} as kind,
          case {_KIND} when 0 then 'http://bad:port/' when 1 then concat('https://h', c_custkey, '.example.com/login') when 2 then concat('https://login.dom', c_custkey, '.it/x')
            when 3 then concat('https://host', c_custkey, '.example.net/p?q=1') else concat('https://w', c_custkey, '.example.org/') end as input_url from customer"""), "target_id"), "cases")
    changes = cases.where("kind in (2, 3)").select(
        F.when(F.col("kind") == 2, "whitelist").otherwise("blacklist").alias("list_type"), F.lit(None).cast("string").alias("note"), F.lit("me").alias("added_by"),
        F.lit("2024-01-01").cast("timestamp").alias("added_at"), F.col("k").alias("change_id"), F.lit(False).alias("removed"), "kind", F.col("input_url").alias("value"))
    urls = overrides.current_overrides(overrides.url_changes(changes.where("kind = 3")).accepted, "url_key")
    domains = overrides.current_overrides(overrides.domain_changes(changes.where("kind = 2"), t.rules).accepted, "domain_key")
    raw = cases.select("target_id", F.when(F.col("k") % 7 == 0, '{"response":').otherwise(F.concat(
        F.lit('{"response":{"Attribute":[{"id":"'), "target_id", F.lit('","event_id":"1","type":"hostname","to_ids":"1","value":"h'), "target_id",
        F.lit('.example.com","Tag":[{"name":"phishing-name:Acme"}]}]}}'))).alias("raw"))
    checked = answers.check_answers(raw, "misp")
    rejects = checked.rejects.select("target_id", "reason")
    states = cases.select("target_id", F.explode(F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(s).alias("s")) for i, s in enumerate("ab")])).alias("x")).select(
        "target_id", F.concat("target_id", "x.s").alias("state_id"), F.lit("u").alias("url"), F.col("x.s").alias("dom_hash"), "x.depth")
    edges = cases.select(
        "target_id", F.concat("target_id", F.lit("t")).alias("transition_id"), F.concat("target_id", F.lit("a")).alias("from_state"),
        F.concat("target_id", F.lit("b")).alias("to_state"), F.lit("click").alias("kind"))
    pages = states.select("target_id", "state_id", F.lit("<p>Hello</p>").alias("html"))
    hops = cases.select(
        "target_id", F.lit(1).alias("hop"), F.col("input_url").alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("server"), F.lit(None).cast("string").alias("error"))
    told = cases.where("kind = 4 and k % 3 < 2").select("target_id", F.when(
        F.col("k") % 3 == 0, '{"classification":"benign","confidence":0.97}').otherwise('{"classification":"phishing","confidence":0.7}').alias("raw_json"))
    done = analyse(
        cases.select("target_id", "input_url"), states, edges, pages, None, t.brands, t.rules,
        Collected(misp=feeds.parse_misp(checked.answers.select("raw")), hops=hops, rejects=rejects), F.lit("2024-02-01").cast("timestamp"),
        answers=told, override_urls=urls, override_domains=domains)
    errors = done.evidence.where("key = 'pipeline_error'").groupBy("target_id").agg(F.count("*").cast("int").alias("n_errors"))
    return done.decisions.drop("reason").join(errors, "target_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
