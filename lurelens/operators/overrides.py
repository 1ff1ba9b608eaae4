"""Trusted and blocked lists by URL and by registrable domain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.functions.url import URL_PARTS, with_url_parts
from lurelens.operators.domains import with_registrable_domain
from lurelens.operators.intake import with_canonical

# The two kinds of list.
LIST_TYPES = ("whitelist", "blacklist")


def with_url_key(df: DataFrame, column: str, out: str = "url_key") -> DataFrame:
    """Add the canonical URL without query and fragment, and ``{out}_error`` for anything but http(s)."""
    df = with_canonical(df, column, "_k_")
    url = F.col("_k_canonical_url")
    web = url.rlike(r"\Ahttps?:")
    key = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    error = F.coalesce("_k_url_error", F.when(~web, "not an http or https URL"))
    df = df.withColumns({out: F.when(web, key), f"{out}_error": error})
    return df.drop("_k_canonical_url", "_k_url_hash", "_k_url_error")


def with_domain_key(df: DataFrame, column: str, rules: DataFrame, out: str = "domain_key") -> DataFrame:
    """Add the registrable domain of a URL or bare host name."""
    df = with_url_parts(df.withColumn("_raw", F.trim(column)), "_raw", "_d_")
    bare = F.lower(F.regexp_replace("_raw", r"\.+\z", ""))
    df = df.withColumn("_host", F.when(F.col("_d_host") != "", F.col("_d_host")).otherwise(bare))
    df = with_registrable_domain(df.withColumnRenamed("_host", "_dhost"), rules, "_dhost", out)
    return df.drop("_raw", "_dhost", *(f"_d_{part}" for part in URL_PARTS))


def current_overrides(changes: DataFrame, key: str) -> DataFrame:
    """The list in force from an append-only change log: the newest change per key, removals dropped.

    ``changes``: ``key, list_type, note, added_by, added_at, change_id, removed``.
    """
    fields = ["list_type", "note", "added_by", "added_at", "removed"]
    newest = F.max_by(F.struct(*fields), F.struct("added_at", "change_id")).alias("c")
    latest = changes.groupBy(key).agg(newest).select(key, "c.*")
    return latest.filter(~F.col("removed")).drop("removed")


class Change(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def url_changes(requests: DataFrame) -> Change:
    """Normalise requested URL entries; bad list types and addresses are rejected with a reason."""
    df = with_url_key(requests, "value")
    reason = F.when(~F.col("removed") & ~F.col("list_type").isin(*LIST_TYPES), "unknown list type")
    df = df.withColumn("reason", F.coalesce(reason, F.col("url_key_error"))).drop("url_key_error")
    return Change(df.filter("reason is null").drop("reason"), df.filter("reason is not null"))


def domain_changes(requests: DataFrame, rules: DataFrame) -> Change:
    """Normalise requested domain entries; bad list types are rejected."""
    df = with_domain_key(requests, "value", rules)
    reason = F.when(~F.col("removed") & ~F.col("list_type").isin(*LIST_TYPES), "unknown list type")
    df = df.withColumn("reason", reason)
    return Change(df.filter("reason is null").drop("reason"), df.filter("reason is not null"))


def removal_results(requests: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """For each key asked to be removed, whether it was on the list."""
    known = current.select(key, F.lit(True).alias("_known"))
    return requests.select(key).distinct().join(known, key, "left").select(key, F.col("_known").isNotNull().alias("found"))


def apply_overrides(urls: DataFrame, override_urls: DataFrame, override_domains: DataFrame) -> DataFrame:
    """Add ``list_type, note, matched, match_key``: the URL list wins over the domain list.

    ``urls`` holds ``url_key`` and ``registrable_domain``. The lists have one row per key, so both joins keep
    the row count; Spark broadcasts a list only while it is small.
    """
    by_url = override_urls.select("url_key", F.struct("list_type", "note").alias("_u"))
    by_domain = override_domains.select(F.col("domain_key").alias("registrable_domain"), F.struct("list_type", "note").alias("_d"))
    df = urls.join(by_url, "url_key", "left").join(by_domain, "registrable_domain", "left")
    entry = F.coalesce("_u", "_d")
    matched = F.when(F.col("_u").isNotNull(), "url").when(F.col("_d").isNotNull(), "domain")
    key: Column = F.when(matched == "url", F.col("url_key")).when(matched == "domain", F.col("registrable_domain"))
    return df.withColumns({
        "list_type": entry["list_type"], "note": entry["note"], "matched": matched, "match_key": key,
    }).drop("_u", "_d")


def without_overridden(urls: DataFrame, matched: DataFrame) -> DataFrame:
    """URLs that still need analysis."""
    return urls.join(matched.filter(F.col("list_type").isNotNull()).select("target_id"), "target_id", "left_anti")


def list_overrides(override_urls: DataFrame, override_domains: DataFrame) -> DataFrame:
    """Both lists with one ``value`` column, ordered by value within each list."""
    fields = ["list_type", "note", "added_by", "added_at"]
    domains = override_domains.select(F.lit("domains").alias("list"), F.col("domain_key").alias("value"), *fields)
    return domains.unionByName(
        override_urls.select(F.lit("urls").alias("list"), F.col("url_key").alias("value"), *fields)
    ).orderBy("list", "value")
