"""Reuse of collected provider answers that are still fresh."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds an answer of each provider stays valid.
TTL_SECONDS = {"rdap": 86_400, "ctlogs": 21_600, "urlhaus": 3_600, "dns": 3_600, "iana_bootstrap": 2_592_000}


class Freshness(NamedTuple):
    hits: DataFrame
    missing: DataFrame


def snapshot_key(query: Column) -> Column:
    return F.sha2(query, 256)


def with_freshness(keys: DataFrame, snapshot: DataFrame, as_of: Column, ttl: dict[str, int] | None = None) -> DataFrame:
    """Keys with their newest readable payload, or NULL where it is missing, unreadable or too old.

    ``keys``: ``(provider, query)``; ``snapshot``: ``(provider, cache_key, payload, cached_at)``. The newest
    answer per key is a map-side aggregate, so repeated answers of one key do not pile up in a task.
    """
    newest = snapshot.groupBy("provider", "cache_key").agg(
        F.max("cached_at").alias("cached_at"), F.max_by("payload", F.struct("cached_at", "payload")).alias("payload")
    )
    seconds = F.create_map(*(F.lit(x) for pair in (ttl or TTL_SECONDS).items() for x in pair))
    wanted = keys.select("provider", "query").distinct().withColumn("cache_key", snapshot_key(F.col("query")))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp"))) / F.lit(1e6)
    valid = (age <= F.try_element_at(seconds, F.col("provider"))) & F.try_parse_json("payload").isNotNull()
    return wanted.join(newest, ["provider", "cache_key"], "left").select(
        "provider", "query", F.when(valid, F.col("payload")).alias("payload"), F.when(valid, F.col("cached_at")).alias("cached_at")
    )


def fresh_or_missing(keys: DataFrame, snapshot: DataFrame, as_of: Column, ttl: dict[str, int] | None = None) -> Freshness:
    """Split keys into answers to reuse and keys to collect again."""
    checked = with_freshness(keys, snapshot, as_of, ttl)
    return Freshness(
        checked.filter(F.col("payload").isNotNull()),
        checked.filter(F.col("payload").isNull()).select("provider", "query"),
    )
