"""Streaming queries: each processes the given files as a stream and returns what reached the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import overrides
from lurelens.session import fresh_folder
from lurelens.streaming import jobs
from workload.registry import Inputs, query

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t: Inputs):
    return jobs.read_submissions(t.spark, t.folder, _EVENTS, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(t: Inputs, df, name: str):
    path = fresh_folder(t.spark, name)
    jobs.run_available(df, f"{path}/data", f"{path}/progress")
    return t.spark.read.parquet(f"{path}/data")


@query("""
    select event_id, concat('https://u', user_id, '.example.com/', event_type) as canonical_url, sha256(concat('https://u', user_id, '.example.com/', event_type)) as url_hash from events""")
def streamed_intake(t: Inputs):
    url = F.concat(F.lit("hxxps://U"), F.col("user_id"), F.lit("[.]example[.]com:443/"), F.col("event_type"))
    stream = jobs.stream_intake(_events(t).select("event_id", url.alias("input_url")))
    return _finished(t, stream.select("event_id", "canonical_url", "url_hash"), "intake")


@query("select distinct sha256(concat('https://u', user_id, '.example.com/')) as url_hash from events")
def streamed_repeat_suppression(t: Inputs):
    """One batch: every URL hash passes once, whatever its number of submissions."""
    url = F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.com/"))
    stream = jobs.suppress_repeats(_events(t).select(F.sha2(url, 256).alias("url_hash"), F.col("ts").alias("submitted_at")))
    return _finished(t, stream.select("url_hash"), "repeats")


@query("select user_id as target_id, arg_max(event_type, (ts, event_type)) as status, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as changed_at from events group by user_id")
def streamed_latest_status(t: Inputs):
    stream = jobs.latest_status(_events(t).select(F.col("user_id").alias("target_id"), F.col("event_type").alias("status"), "ts"))
    path = fresh_folder(t.spark, "status")
    jobs.run_available_updates(stream, f"{path}/data", f"{path}/progress")
    newest = jobs.newest_version(t.spark.read.parquet(f"{path}/data"), ["target_id"])
    return newest.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""
    with newest as (select user_id, arg_max(change_id, (added_at, change_id)) as change_id from overrides group by user_id),
    current as (select o.* from newest join overrides o using (user_id, change_id) where not removed)
    select e.event_id as target_id, c.list_type, case when c.user_id is not null then 'domain' end as matched from events e left join current c using (user_id)""")
def streamed_override_matches(t: Inputs):
    changes = t.sql("select o.*, concat('login.dom', user_id, '.it') as value from overrides o")
    domains = overrides.current_overrides(overrides.domain_changes(changes, t.rules).accepted, "domain_key")
    urls = domains.limit(0).withColumnRenamed("domain_key", "url_key")
    stream = _events(t).select(
        F.col("event_id").alias("target_id"), F.lit("https://none.example.com/").alias("url_key"),
        F.concat(F.lit("dom"), F.col("user_id"), F.lit(".it")).alias("registrable_domain"),
    )
    return _finished(t, jobs.match_overrides(stream, urls, domains).select("target_id", "list_type", "matched"), "overrides")


@query("""
    with latest as (select * from (select *, row_number() over (partition by url_hash order by created_at desc, target_id) as r from targets) where r = 1),
    runs as (select l.url_hash, l.target_id, l.created_at, v.classification from latest l join verdicts v using (target_id) where l.status = 'done'),
    requests as (select event_id, cast(user_id as varchar) as url_hash, ts - interval 8200 days as requested_at from events)
    select q.event_id, q.url_hash, case when date_part('epoch', q.requested_at) - date_part('epoch', r.created_at) < 86400 then r.target_id end as cached_target,
      case when date_part('epoch', q.requested_at) - date_part('epoch', r.created_at) < 86400 then r.classification end as classification
    from requests q left join runs r using (url_hash)""")
def streamed_verdict_cache(t: Inputs):
    requests = _events(t).select(
        "event_id", F.col("user_id").cast("string").alias("url_hash"), (F.col("ts") - F.expr("interval 8200 days")).alias("requested_at")
    )
    answers = jobs.answer_from_history(requests, t.targets, t.verdicts)
    return _finished(t, answers.drop("requested_at"), "cache")
