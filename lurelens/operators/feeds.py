"""Feed enrichment: registration, certificates, DNS and threat-intelligence answers as evidence.

Feed sides are summarised per value before they meet the targets, so neither a popular host nor a value with
many feed records multiplies rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lurelens.functions.times import days_between, utc_timestamp
from lurelens.schemas import as_json, emit_all, finding

# Weights and thresholds of the passive signals.
WEIGHT_AGE_YOUNG = 0.35
WEIGHT_AGE_MODERATE = 0.15
WEIGHT_SIBLINGS = 0.30
WEIGHT_FRESH_CERT = 0.15
WEIGHT_REPUTATION = 0.50
WEIGHT_MISP = 0.55
WEIGHT_OPENCTI = 0.55
AGE_YOUNG_DAYS = 30
AGE_MODERATE_DAYS = 90
FRESH_CERT_DAYS = 30
MAX_CERT_DETAILS = 25
MAX_SIBLINGS = 50
REGISTRY_SERVERS = 3

# Record types each feed is searched for.
MISP_TYPES = ("domain", "hostname", "url", "ip-dst")
OPENCTI_TYPES = ("Url", "Hostname", "Domain-Name", "IPv4-Addr", "IPv6-Addr")

CT_SOURCE = "ctlogs.dev"


def _findings(df: DataFrame, *findings: Column) -> DataFrame:
    return emit_all(df, F.array(*findings), "L2", "osint")


def _no_answer(provider: str | Column, reason: str = "error") -> Column:
    """The finding (weight 0) for an answer that failed."""
    name = F.lit(provider) if isinstance(provider, str) else provider
    value = as_json(name.alias("provider"), F.col(reason).alias("reason"))
    return finding(F.col(reason).isNotNull(), "provider_unavailable", value, 0.0)


def unavailable(df: DataFrame, provider: str | Column, reason: str = "error") -> DataFrame:
    """Evidence (weight 0) for answers that failed."""
    return _findings(df, _no_answer(provider, reason))


# --- DNS ---------------------------------------------------------------------------------------------------

def clean_dns(answers: DataFrame) -> DataFrame:
    """``(host, a_records, aaaa_records, error)``: distinct in order, mapped IPv4 dropped, nothing found = error."""
    empty = F.array().cast("array<string>")
    v4 = F.array_distinct(F.coalesce("a_records", empty))
    v6 = F.array_distinct(F.filter(F.coalesce("aaaa_records", empty), lambda a: ~a.startswith("::ffff:")))
    nothing = (F.size("a_records") == 0) & (F.size("aaaa_records") == 0)
    df = answers.select(F.lower("host").alias("host"), v4.alias("a_records"), v6.alias("aaaa_records"), "error")
    return df.withColumn(
        "error", F.coalesce("error", F.when(nothing, F.concat(F.lit("No DNS records found for "), F.col("host"))))
    )


def dns_evidence(targets: DataFrame, dns: DataFrame) -> DataFrame:
    """Targets ``(target_id, host)`` with cleaned answers: address lists or a failure, all weight 0."""
    df = targets.select("target_id", "host").join(dns, "host")
    good = F.col("error").isNull()
    lists = [
        finding(good & (F.size(column) > 0), f"dns_{column}", as_json(F.col(column).alias("addresses")), 0.0)
        for column in ("a_records", "aaaa_records")
    ]
    return _findings(df, *lists, _no_answer("dns"))


# --- certificates ------------------------------------------------------------------------------------------

def certificate_history(certs: DataFrame, as_of: Column) -> DataFrame:
    """Per host: newest and oldest age in days and the count; oldest and count are unknown when paged."""
    newest, oldest = days_between(F.max("not_before"), as_of), days_between(F.min("not_before"), as_of)
    df = certs.groupBy("host").agg(
        newest.alias("newest_cert_days"), oldest.alias("_oldest"), F.count(F.lit(1)).alias("_certs"),
        F.bool_or("has_next").alias("_paged"),
    )
    return df.select(
        "host", "newest_cert_days",
        F.when(~F.col("_paged"), F.col("_oldest")).alias("oldest_cert_days"),
        F.when(~F.col("_paged"), F.col("_certs")).alias("total_certs"),
    )


def newest_certificates(certs: DataFrame, n: int = MAX_CERT_DETAILS) -> DataFrame:
    """The ``n`` newest certificates of each host; the rank limit is applied before the shuffle."""
    order = W.partitionBy("host").orderBy(F.col("not_before").desc_nulls_last(), "cert_id")
    return certs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def sibling_domains(certs: DataFrame, sans: DataFrame, limit: int = MAX_SIBLINGS) -> DataFrame:
    """Names that share a host's newest certificates: ``(host, domains, truncated, total_siblings)``."""
    name = F.regexp_replace(F.lower(F.trim("san")), r"\A\.+|\.+\z", "")
    own = F.regexp_replace(F.lower("host"), r"\A\.+|\.+\z", "")
    names = newest_certificates(certs).select("host", "cert_id").join(sans, "cert_id").select(
        "host", own.alias("_own"), name.alias("san")
    )
    names = names.filter((F.col("san") != "") & (F.col("san") != F.col("_own"))).select("host", "san").distinct()
    totals = names.groupBy("host").agg(F.count(F.lit(1)).alias("total_siblings"))
    first = names.withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy("san"))).filter(F.col("rank") <= limit)
    first = first.groupBy("host").agg(F.array_sort(F.collect_list("san")).alias("domains"))
    return totals.join(first, "host").select(
        "host", "domains", (F.col("total_siblings") > limit).alias("truncated"), "total_siblings"
    )


def certificate_evidence(targets: DataFrame, history: DataFrame, siblings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``sibling_domains`` where names are shared, else ``certificate_history``; failures stay visible."""
    df = targets.select("target_id", "host").join(history, "host", "left").join(siblings, "host", "left")
    ages = [F.col(c) for c in ("newest_cert_days", "oldest_cert_days", "total_certs")]
    shared = F.size("domains") > 0
    source = F.lit(CT_SOURCE).alias("source")
    rows = _findings(
        df,
        finding(shared, "sibling_domains", as_json(F.col("domains"), F.col("truncated"), F.col("total_siblings"), *ages, source), WEIGHT_SIBLINGS),
        finding(
            F.coalesce(~shared, F.lit(True)) & F.col("newest_cert_days").isNotNull(), "certificate_history", as_json(*ages, source),
            F.when(F.col("newest_cert_days") <= FRESH_CERT_DAYS, WEIGHT_FRESH_CERT).otherwise(0.0)),
    )
    if errors is not None:
        rows = rows.unionByName(unavailable(targets.join(errors, "host"), CT_SOURCE))
    return rows


# --- registration ------------------------------------------------------------------------------------------

def registration_evidence(targets: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """Targets ``(target_id, registrable_domain)`` with young or moderately young domains."""
    records = records.withColumnRenamed("domain", "registrable_domain")
    df = targets.select("target_id", "registrable_domain").join(records, "registrable_domain")
    df = df.withColumn("age_days", days_between(F.col("registered_at"), as_of))
    age = F.col("age_days")
    category = F.when(age < AGE_YOUNG_DAYS, "young").when(age < AGE_MODERATE_DAYS, "moderate")
    df = df.withColumn("category", F.when(F.col("error").isNull(), category))
    value = as_json(age, F.col("category"), F.col("registrar"), F.col("nameservers"))
    weight = F.when(F.col("category") == "young", WEIGHT_AGE_YOUNG).otherwise(WEIGHT_AGE_MODERATE)
    return _findings(df, finding(F.col("category").isNotNull(), "domain_age_days", value, weight), _no_answer("rdap"))


def registry_worklist(domains: DataFrame, servers: DataFrame, n: int = REGISTRY_SERVERS, fallback: bool = False) -> DataFrame:
    """Which registry servers to ask per domain: https before http before others, at most ``n``.

    The registry label is everything after the first label of the domain; ``fallback`` also tries the last one.
    """
    unique = domains.select("registrable_domain").distinct()
    labels = F.split("registrable_domain", r"\.")
    rest = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(1))), ".")).otherwise(
        F.col("registrable_domain")
    )
    tlds = F.array_distinct(F.array(rest, F.element_at(labels, -1))) if fallback else F.array(rest)
    keyed = unique.select("registrable_domain", F.posexplode(tlds).alias("choice", "tld"))
    scheme = F.when(F.col("server").startswith("https://"), 0).when(F.col("server").startswith("http://"), 1).otherwise(2)
    order = W.partitionBy("registrable_domain").orderBy("choice", scheme, "ord", "server")
    df = keyed.join(servers, "tld").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    url = F.concat(F.regexp_replace("server", r"/+\z", ""), F.lit("/domain/"), F.col("registrable_domain"))
    return df.select("registrable_domain", "tld", "rank", url.alias("query_url"))


# --- reputation --------------------------------------------------------------------------------------------

def search_values(urls: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """``(target_id, ord, value)``: URL, host, registrable domain, then addresses; trimmed, distinct, in order.

    ``urls`` holds ``target_id, canonical_url, host, registrable_domain``.
    """
    df = urls.select("target_id", "canonical_url", "host", "registrable_domain")
    ips = F.array().cast("array<string>")
    if dns is not None:
        addresses = dns.filter(F.col("error").isNull()).select("host", F.concat("a_records", "aaaa_records").alias("ips"))
        df = df.join(addresses, "host", "left")
        ips = F.coalesce("ips", ips)
    host = F.when(F.col("host") != "", F.col("host"))
    domain = F.when(host.isNotNull() & (F.col("registrable_domain") != ""), F.col("registrable_domain"))
    values = F.concat(F.array("canonical_url", host, domain), ips)
    clean = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))
    return df.select("target_id", F.posexplode(clean).alias("ord", "value"))


def _united(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def _vocabulary(rows: DataFrame, column: Column, out: str) -> DataFrame:
    """``(value, out)``: the distinct words a feed uses for each value. Words are distinct before they meet."""
    words = rows.select("value", column.alias("word")).filter("word is not null and word <> ''").distinct()
    return words.groupBy("value").agg(F.array_sort(F.collect_set("word")).alias(out))


def _distinct_events(matched: DataFrame, events: DataFrame) -> DataFrame:
    """``(target_id, event_count)``: distinct events over all matched values of a target, exactly.

    A target's values are ordered by size, largest first, and counted as growing prefixes: each prefix adds the
    events of its last value that no earlier value has. A prefix is worked out once, however many targets share
    it, and its work is the size of its smallest value, so a value with very many records costs its size once.
    """
    sizes = events.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    sized = matched.hint("merge").join(sizes, "value")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "value"))), lambda x: x["value"])
    lists = sized.groupBy("target_id").agg(ordered.alias("_values"))
    prefixes = lists.select(
        "target_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("_values")), lambda k: F.slice("_values", F.lit(1), k))).alias("_prefix")
    ).withColumn("prefix_key", F.sha2(F.concat_ws("\x1f", "_prefix"), 256))
    unique = prefixes.groupBy("prefix_key").agg(F.first("_prefix").alias("_prefix"))
    last = unique.select(
        "prefix_key", F.element_at("_prefix", -1).alias("value"), F.slice("_prefix", F.lit(1), F.size("_prefix") - 1).alias("_earlier")
    ).hint("merge").join(events, "value")
    pairs = last.select("prefix_key", "event_id", F.explode("_earlier").alias("value"))
    known = pairs.join(events.hint("merge"), ["value", "event_id"], "left_semi").select("prefix_key", "event_id").distinct()
    fresh = last.select("prefix_key", "event_id").join(known.hint("merge"), ["prefix_key", "event_id"], "left_anti")
    added = fresh.groupBy("prefix_key").agg(F.count(F.lit(1)).alias("_added"))
    counted = prefixes.select("target_id", "prefix_key").hint("merge").join(added, "prefix_key")
    return counted.groupBy("target_id").agg(F.sum("_added").alias("event_count"))


def misp_summary(values: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per target with a match: counts, types, tags, events and whether any record is marked for detection.

    The feed is summarised per value first; a target then meets one row for each of its few values. Both sides of
    the joins grow with targets and records, whatever the size of the files they come from, so none is broadcast.
    """
    wanted = attributes.filter(F.col("type").isin(*MISP_TYPES))
    per_value = wanted.groupBy("value").agg(
        F.count(F.lit(1)).alias("match_count"), F.array_sort(F.collect_set("type")).alias("matched_types"),
        F.bool_or("to_ids").alias("to_ids_match"),
    ).hint("merge").join(_vocabulary(wanted.select("value", F.explode("tags").alias("tag")), F.col("tag"), "tags"), "value", "left")
    none = F.array().cast("array<string>")
    matched = values.select("target_id", "value").distinct().hint("merge").join(per_value, "value")
    summary = matched.withColumn("tags", F.coalesce("tags", none)).groupBy("target_id").agg(
        F.sum("match_count").alias("match_count"), _united("matched_types").alias("matched_types"), _united("tags").alias("tags"),
        F.bool_or("to_ids_match").alias("to_ids_match"),
    )
    events = wanted.select("value", "event_id").filter(F.col("event_id").isNotNull()).distinct()
    counts = _distinct_events(matched.select("target_id", "value"), events)
    return summary.join(counts.hint("merge"), "target_id", "left").select(
        "target_id", "match_count", "matched_types", "tags", F.coalesce("event_count", F.lit(0)).alias("event_count"),
        "to_ids_match", (~F.col("to_ids_match")).alias("context_only"),
    )


def is_active_indicator(revoked: Column, valid_until: Column, as_of: Column) -> Column:
    """Not revoked and not expired; no expiry counts as active, an unreadable one does not."""
    has_expiry = F.coalesce(valid_until != "", F.lit(False))
    return ~F.coalesce(revoked, F.lit(False)) & F.when(
        has_expiry, F.coalesce(utc_timestamp(valid_until) >= as_of.cast("timestamp"), F.lit(False))
    ).otherwise(True)


def opencti_summary(values: DataFrame, observables: DataFrame, indicators: DataFrame, as_of: Column) -> DataFrame:
    """Per target with a match: observables, active and total indicators, context sets and active scores.

    Every observable has one value and every indicator one observable, so counts per value simply add up. They
    are made per value, each at its own grain, and a target meets one row for each of its few values. Both sides of
    the joins grow with targets and records, so none is broadcast.
    """
    wanted = observables.filter(F.col("type").isin(*OPENCTI_TYPES))
    active = is_active_indicator(F.col("revoked"), F.col("valid_until"), as_of)
    # records of both kinds are one table, counted and spread into words in the same pass
    detail = wanted.select("observable_id", "value").hint("merge").join(indicators, "observable_id").withColumn("_active", active)
    score = F.when(F.col("_active"), F.col("score"))
    context = ["value", "labels", "markings", "creator"]
    none = F.array().cast("array<string>")
    notes = wanted.select(*context, F.lit(1).alias("_seen"), "type").unionByName(detail.select(
        *context, F.lit(0).alias("_seen"), F.lit(None).cast("string").alias("type"), "_active", score.alias("_score"),
    ), allowMissingColumns=True)
    kinds = {"matched_types": F.array("type"), "labels": F.col("labels"), "markings": F.col("markings"), "created_by": F.array("creator")}

    def spread(kind: str, column: Column) -> Column:
        known = F.filter(F.coalesce(column, none), lambda w: w.isNotNull() & (w != ""))
        return F.transform(known, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))

    record = F.array(F.struct(F.lit("record").alias("kind"), F.lit(None).cast("string").alias("word")))
    words = F.concat(record, *(spread(kind, column) for kind, column in kinds.items()))
    each = notes.select("value", F.explode(words).alias("w"), "_seen", "_active", "_score").select("value", "w.*", "_seen", "_active", "_score")
    counted = each.groupBy("value", "kind", "word").agg(
        F.sum("_seen").alias("match_count"), F.count_if("_active").alias("_active_n"), F.count("_active").alias("_n"),
        F.min("_score").alias("_min"), F.max("_score").alias("_max"), F.sum("_score").alias("_sum"), F.count("_score").alias("_scored"),
    )
    once = lambda name: F.max(F.when(F.col("kind") == "record", F.col(name))).alias(name)
    per_value = counted.groupBy("value").agg(
        *(once(name) for name in ("match_count", "_active_n", "_n", "_min", "_max", "_sum", "_scored")),
        *(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("word")))).alias(kind) for kind in kinds),
    )
    matched = values.select("target_id", "value").distinct().hint("merge").join(per_value, "value")
    summary = matched.groupBy("target_id").agg(
        F.sum("match_count").alias("match_count"), _united("matched_types").alias("matched_types"),
        F.sum("_active_n").alias("active_indicator_count"), F.sum("_n").alias("total_indicator_count"),
        *(_united(name).alias(name) for name in ("labels", "markings", "created_by")),
        F.min("_min").alias("score_min"), F.max("_max").alias("score_max"), F.round(F.try_divide(F.sum("_sum"), F.sum("_scored")), 1).alias("score_avg"),
    )
    ioc = F.col("active_indicator_count") > 0
    summary = summary.withColumn("score_avg", F.when(ioc, F.col("score_avg")))
    return summary.withColumns({"active_ioc_match": ioc, "context_only": ~ioc})


def urlhaus_matches(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """Targets whose full URL is listed; ``no_results`` means not listed."""
    listed = answers.filter(F.col("query_status") != "no_results")
    listed = listed.groupBy("value").agg(F.min("details").alias("details")).withColumnRenamed("value", "canonical_url")
    return urls.select("target_id", "canonical_url").join(listed, "canonical_url").select("target_id", "details")


def provider_results(summary: DataFrame, provider: str) -> DataFrame:
    """A provider's summary in the common result shape used by ``reputation_evidence``."""
    flag = lambda name: F.col(name) if name in summary.columns else F.lit(False)
    if "details" in summary.columns:
        details, listed = F.col("details"), F.lit(True)
    else:
        details = as_json(*(F.col(c) for c in summary.columns if c != "target_id"))
        listed = flag("to_ids_match") | flag("active_ioc_match")
    return summary.select(
        "target_id", F.lit(provider).alias("provider"), listed.alias("listed"), details.alias("details"),
        flag("to_ids_match").alias("to_ids_match"), flag("active_ioc_match").alias("active_ioc_match"),
        flag("context_only").alias("context_only"), F.lit(None).cast("string").alias("error"),
    )


def reputation_evidence(results: DataFrame) -> DataFrame:
    """A hit, a context-only match or a failure per target and provider; nothing for silence."""
    weight = F.when(F.col("to_ids_match"), WEIGHT_MISP).when(F.col("active_ioc_match"), WEIGHT_OPENCTI).otherwise(WEIGHT_REPUTATION)
    answered, listed = F.col("error").isNull(), F.col("listed")
    return _findings(
        results, finding(answered & listed, "reputation_hit", F.col("details"), weight),
        finding(answered & ~listed & F.col("context_only"), F.concat(F.col("provider"), F.lit("_context_match")), F.col("details"), 0.0),
        _no_answer(F.col("provider")),
    )


Provider = Callable[[DataFrame], DataFrame]


def check_reputation(values: DataFrame, providers: dict[str, Provider]) -> DataFrame:
    """Run every registered provider over the search values and union their results.

    A provider maps ``(target_id, ord, value)`` rows to a per-target summary.
    """
    parts = [provider_results(check(values), name) for name, check in providers.items()]
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    return results


def risk_scores(evidence: DataFrame, layer: str, out: str) -> DataFrame:
    """Per target: sum of one layer's weights, at most 1, four decimals."""
    total = F.round(F.least(F.lit(1.0), F.sum("weight")), 4)
    return evidence.filter(F.col("layer") == layer).groupBy("target_id").agg(total.alias(out))
