"""Analysis of recorded probe results: redirect chains, profile comparison, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lurelens.functions.fingerprint import favicon_hash
from lurelens.functions.url import resolve
from lurelens.schemas import as_json, emit, emit_all, finding

# Redirect limits, server names that are common, weights of the probe signals.
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MAX_HOPS = 10
COMMON_SERVERS = (
    "Apache-Coyote", "nginx", "Apache", "cloudflare", "CloudFront", "Microsoft-IIS", "LiteSpeed", "Caddy",
    "lighttpd", "Varnish", "BigIP", "ATS", "Squid", "HAProxy", "Traefik", "envoy",
)
WEIGHT_MANY_REDIRECTS = 0.05
WEIGHT_EXCESSIVE_REDIRECTS = 0.15
WEIGHT_UNUSUAL_SERVER = 0.05
WEIGHT_FAVICON = 0.05
WEIGHT_TLS_PRINT = 0.10
WEIGHT_CLOAKING = 0.25
DEFAULT_PROFILE = "desktop_chrome"
TLS_PRINT_CHARS = 62


def _evidence(df: DataFrame, key: str, value: Column, weight: float | Column) -> DataFrame:
    return emit(df, "L3", key, value, weight, "active")


def cookie_names(headers: Column) -> Column:
    """Names of Set-Cookie headers; values are never kept."""
    return F.filter(F.transform(headers, lambda h: F.trim(F.substring_index(h, "=", 1))), lambda n: n != "")


def is_unusual_server(server: Column) -> Column:
    known = "|".join(name.lower() for name in COMMON_SERVERS)
    return (server != "") & ~F.lower(server).rlike(known)


def redirect_summary(hops: DataFrame, max_hops: int = MAX_HOPS, *more: Column) -> DataFrame:
    """Per target: hops, redirects, final URL, whether the chain was cut, the error of the last hop.

    ``hops``: ``target_id, hop (from 1), url, status_code, location, error``. Only map-side combinable
    aggregates; a chain longer than ``max_hops`` is read up to the limit and flagged. ``more`` are further aggregates
    over the hops that are read.
    """
    redirected = F.col("status_code").isin(*REDIRECT_STATUSES) & (F.coalesce("location", F.lit("")) != "")
    redirected = redirected & F.col("error").isNull()
    last = F.struct(F.col("url"), F.col("location"), redirected.alias("redirected"), F.col("error"), F.col("hop"))
    df = hops.filter(F.col("hop") <= max_hops).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("hop_count"),
        F.count_if(redirected).alias("redirect_count"),
        F.max_by(last, F.col("hop")).alias("_last"), *more,
    )
    extra = df.columns[4:]
    df = df.select("*", F.col("_last.url").alias("_url"), F.col("_last.location").alias("_location"))
    return df.select(
        "target_id", "hop_count", "redirect_count",
        F.when(F.col("_last.redirected"), F.expr(resolve("_url", "_location"))).otherwise(F.col("_url")).alias("final_url"),
        (F.col("_last.redirected") & (F.col("_last.hop") >= max_hops)).alias("truncated"),
        F.col("_last.error").alias("error"), *extra,
    )


def redirect_evidence(hops: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Redirect counts, excessive chains, unusual servers; a failed last hop gives an error row only."""
    odd = F.when(is_unusual_server(F.col("server")), F.struct("server", "url"))
    summary = redirect_summary(hops, max_hops, F.collect_list(odd).alias("odd"))
    good, count = F.col("error").isNull(), F.col("redirect_count")
    value = as_json(F.col("hop_count"), count, F.col("truncated"), F.col("final_url"))
    servers = F.transform("odd", lambda hop: finding(
        good, "unusual_server_header", as_json(hop["server"].alias("server"), hop["url"].alias("hop_url")), WEIGHT_UNUSUAL_SERVER))
    return emit_all(summary, F.concat(F.array(
        finding(good, "redirect_hop_count", value, F.when(count >= 3, WEIGHT_MANY_REDIRECTS).otherwise(0.0)),
        finding(good & (count >= 5), "excessive_redirects", as_json(count), WEIGHT_EXCESSIVE_REDIRECTS),
        finding(~good, "active_probe_error", as_json(F.lit("redirect_chain").alias("probe"), F.col("error")), 0.0),
    ), servers), "L3", "active")


def redirect_edges(hops: DataFrame) -> DataFrame:
    """``http_3xx`` edges of the recorded chains: ``(target_id, hop, from_url, to_url, kind)``."""
    moved = hops.filter(
        F.col("status_code").isin(*REDIRECT_STATUSES) & (F.coalesce("location", F.lit("")) != "") & F.col("error").isNull()
    )
    return moved.select(
        "target_id", "hop", F.col("url").alias("from_url"), F.expr(resolve("url", "location")).alias("to_url"),
        F.lit("http_3xx").alias("kind"),
    )


def _profiles(fetches: DataFrame) -> DataFrame:
    """One row per target with its profiles in order. Repeats collapse first, so the list has one entry per profile."""
    fields = ["ord", "profile", "status_code", "final_url", "content_length", "body_sha256", "error"]
    order = W.partitionBy("target_id", "profile").orderBy(*fields)
    first = fetches.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    single = first.select("target_id", F.struct(*fields).alias("r"))
    return single.groupBy("target_id").agg(F.array_sort(F.collect_list("r")).alias("profiles"))


def _divergent(field: str) -> str:
    """Entries of ``ok`` whose field differs from the majority; ties go to the earliest profile."""
    same = f"size(filter(ok, y -> y.{field} <=> x.{field}))"
    majority = f"array_min(transform(ok, x -> named_struct('n', -{same}, 'ord', x.ord, 'v', x.{field}))).v"
    return f"filter(ok, p -> not (p.{field} <=> {majority}))"


def compare_profiles(fetches: DataFrame) -> DataFrame:
    """Per target: cloaking decision, divergent profiles, the profile to explore with and the one to probe with.

    ``fetches``: ``target_id, profile, ord, status_code, final_url, content_length, body_sha256, error``.
    Status, then final URL, then body are compared; a later one is used only if the earlier agree.
    """
    df = _profiles(fetches).withColumn("ok", F.expr("filter(profiles, p -> p.error is null)"))
    by = {field: F.expr(_divergent(field)) for field in ("status_code", "final_url", "body_sha256")}
    df = df.withColumns({f"_{field}": e for field, e in by.items()})
    stages = [F.col(f"_{field}") for field in by]
    none = F.slice("ok", 1, 0)
    found = F.when(F.size("ok") < 2, none)
    for stage in stages:
        found = found.when(F.size(stage) > 0, stage)
    df = df.withColumn("_divergent", found.otherwise(none))
    richest = lambda rows: F.expr(
        f"array_min(transform({rows}, p -> named_struct('n', -coalesce(p.content_length, 0), 'ord', p.ord, 'v', p.profile))).v"
    )
    cloaked = F.size("_divergent") > 0
    distinct = lambda field: F.size(F.array_distinct(F.transform("ok", lambda p: p[field])))
    agreeing = "filter(ok, p -> not exists(_divergent, d -> d.profile = p.profile))"
    return df.select(
        "target_id",
        F.size("ok").alias("profiles_compared"),
        cloaked.alias("cloaking_detected"),
        F.transform("_divergent", lambda p: p["profile"]).alias("divergent_profiles"),
        distinct("status_code").alias("distinct_statuses"),
        distinct("final_url").alias("distinct_final_urls"),
        distinct("body_sha256").alias("distinct_bodies"),
        F.when(cloaked, F.coalesce(richest(agreeing), F.get("_divergent", 0)["profile"]))
        .otherwise(DEFAULT_PROFILE).alias("recommended_profile"),
        F.when(cloaked, richest("_divergent")).alias("probe_profile"),
        F.map_from_entries(F.transform(
            "profiles", lambda p: F.struct(p["profile"], F.struct(p["status_code"].alias("status_code"), p["content_length"].alias("content_length")))
        )).alias("profiles"),
    )


def cloaking_evidence(compared: DataFrame) -> DataFrame:
    details = F.format_string(
        "%d status codes, %d final URLs, %d bodies", "distinct_statuses", "distinct_final_urls", "distinct_bodies"
    )
    return emit_all(compared, F.array(
        finding(F.col("cloaking_detected"), "cloaking_detected", as_json(F.col("divergent_profiles"), details.alias("details")), WEIGHT_CLOAKING),
        finding(F.lit(True), "differential_fetch_summary", as_json(F.col("profiles_compared"), F.col("profiles")), 0.0),
    ), "L3", "active")


def favicon_fingerprints(icons: DataFrame, content: str = "content") -> DataFrame:
    """``(target_id, favicon_hash, favicon_size_bytes)`` of non-empty icons."""
    df = icons.filter(F.length(content) > 0)
    return df.select(
        "target_id", favicon_hash(F.col(content)).alias("favicon_hash"), F.length(content).alias("favicon_size_bytes")
    )


def fingerprint_evidence(favicons: DataFrame, tls_prints: DataFrame) -> DataFrame:
    """Favicon hashes and TLS fingerprints ``(target_id, tls_print, error)``; an all-zero print is no print."""
    icons = _evidence(
        favicons, "favicon_hash",
        as_json(F.col("favicon_hash").alias("hash"), F.col("favicon_size_bytes").alias("size_bytes")), WEIGHT_FAVICON,
    )
    known = F.col("tls_print") != "0" * TLS_PRINT_CHARS
    full = F.length("tls_print") == TLS_PRINT_CHARS
    prints = _evidence(
        tls_prints.filter(known & full), "jarm_fingerprint",
        as_json(F.col("tls_print").alias("hash"), F.lit(443).alias("port")), WEIGHT_TLS_PRINT,
    )
    broken = tls_prints.filter((known & ~full) | F.col("error").isNotNull())
    failed = _evidence(
        broken, "active_probe_error",
        as_json(F.lit("jarm").alias("probe"), F.coalesce("error", F.lit("unknown")).alias("error")), 0.0,
    )
    return icons.unionByName(prints).unionByName(failed)


def probe_errors(failures: DataFrame) -> DataFrame:
    """Evidence for probes that failed outright: ``(target_id, probe, error)`` rows."""
    return _evidence(failures.filter(F.col("error").isNotNull()), "active_probe_error", as_json(F.col("probe"), F.col("error")), 0.0)
