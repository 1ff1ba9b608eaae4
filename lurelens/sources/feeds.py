"""Readers of collected provider answers: raw JSON text in, typed rows out. Unreadable rows keep an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.functions.times import utc_timestamp

_RDAP = """struct<errorCode: string,
    events: array<struct<eventAction: string, eventDate: string>>,
    entities: array<struct<roles: array<string>, vcardArray: array<string>>>,
    nameservers: array<struct<ldhName: string, unicodeName: string>>>"""
_CT = """struct<has_next: boolean, rows: array<struct<id: string, match: string, not_before: string,
    not_after: string, serial_hex: string, issuer: string, key_algo: string, san_count: int>>>"""
_MISP_ATTRIBUTE = """array<struct<id: string, event_id: string, type: string, value: string, to_ids: string,
    Tag: array<struct<name: string>>, Event: struct<Tag: array<struct<name: string>>>>>"""
_LABELS = "objectLabel: array<struct<value: string>>, createdBy: struct<name: string>"
_OPENCTI = f"""struct<data: struct<stixCyberObservables: struct<edges: array<struct<node: struct<
    id: string, entity_type: string, observable_value: string,
    objectMarking: array<struct<definition: string>>, {_LABELS},
    indicators: struct<edges: array<struct<node: struct<id: string, revoked: boolean, valid_until: string,
        x_opencti_score: string, objectMarking: array<struct<definition: string>>, {_LABELS}>>>>>>>>>>"""


def _one_each(rows: DataFrame, *ids: str) -> DataFrame:
    """One row per record, however many answers repeat it; records without an id are told apart by their content."""
    known = F.lit(True)
    for name in ids:
        known = known & F.col(name).isNotNull()
    record = F.when(known, F.concat_ws("\x1f", *ids)).otherwise(F.concat(F.lit("\x1e"), F.to_json(F.struct("*"))))
    return rows.withColumn("_record", record).dropDuplicates(["_record"]).drop("_record")


def parse_rdap(df: DataFrame, raw: str = "raw", key: str = "domain") -> DataFrame:
    """``(domain, registered_at, registrar, nameservers, error)`` from registration records.

    The registrar is the formatted name of the first entity with that role; contact cards mix arrays and
    objects, so they are read as text first and only the wanted line is parsed.
    """
    parsed = df.select(key, F.from_json(raw, _RDAP).alias("r"))
    event = F.get(F.filter("r.events", lambda e: e["eventAction"] == "registration"), 0)
    registrar = F.get(
        F.filter("r.entities", lambda e: F.exists(e["roles"], lambda role: F.lower(role) == "registrar")), 0
    )
    card = F.from_json(F.get(registrar["vcardArray"], 1), "array<array<string>>")
    line = F.get(F.filter(card, lambda item: (F.size(item) >= 4) & (F.get(item, 0) == "fn")), 0)
    names = F.transform("r.nameservers", lambda n: F.lower(F.coalesce(F.nullif(n["ldhName"], F.lit("")), n["unicodeName"])))
    return parsed.select(
        key,
        utc_timestamp(event["eventDate"], offsets=False).alias("registered_at"),
        F.get(line, 3).alias("registrar"),
        F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")).alias("nameservers"),
        F.when(F.col("r").isNull(), "unreadable answer").otherwise(F.col("r.errorCode")).alias("error"),
    )


def parse_ct_search(df: DataFrame, raw: str = "raw", key: str = "host") -> DataFrame:
    """``(host, cert_id, not_before, has_next)`` rows of certificate searches."""
    parsed = df.select(key, F.from_json(raw, _CT).alias("r"))
    return parsed.select(key, F.coalesce("r.has_next", F.lit(False)).alias("has_next"), F.explode("r.rows").alias("c")).select(
        key, F.col("c.id").alias("cert_id"), utc_timestamp(F.trim("c.not_before")).alias("not_before"), "has_next"
    )


def parse_ct_details(df: DataFrame, raw: str = "raw", key: str = "cert_id") -> DataFrame:
    """``(cert_id, san)`` rows of certificate details."""
    parsed = df.select(key, F.from_json(raw, "struct<san_dns: array<string>>").alias("r"))
    return parsed.select(key, F.explode("r.san_dns").alias("san"))


def parse_misp(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``(attribute_id, value, type, event_id, to_ids, tags)`` rows; the attribute list may also be a single object.

    ``tags`` joins the names on the attribute and on its event. An attribute that several answers hold is one row.
    """
    text = F.from_json(raw, "struct<response: struct<Attribute: string>>")["response"]["Attribute"]
    rows = df.select(F.explode(F.from_json(text, _MISP_ATTRIBUTE)).alias("a"))
    names = lambda tags: F.transform(F.coalesce(tags, F.array().cast("array<struct<name:string>>")), lambda t: t["name"])
    tags = F.array_union(names(F.col("a.Tag")), names(F.col("a.Event.Tag")))
    return _one_each(rows.select(
        F.col("a.id").alias("attribute_id"), "a.value", "a.type", "a.event_id",
        F.coalesce(F.col("a.to_ids").isin("true", "1"), F.lit(False)).alias("to_ids"),
        F.filter(tags, lambda t: t.isNotNull() & (t != "")).alias("tags"),
    ), "attribute_id")


def parse_opencti(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Observables and their indicators as two tables, so that neither multiplies the other's counts. Records that
    several answers hold are one row.

    Observables: ``(observable_id, value, type, labels, markings, creator)``; indicators: ``(observable_id,
    indicator_id, revoked, valid_until, score, labels, markings, creator)``.
    """
    parsed = F.from_json(raw, _OPENCTI)["data"]["stixCyberObservables"]["edges"]
    nodes = df.select(F.explode(parsed).alias("e")).select(F.col("e.node").alias("n"))

    def context(node: str) -> list:
        labels = F.transform(f"{node}.objectLabel", lambda x: x["value"])
        markings = F.transform(f"{node}.objectMarking", lambda x: x["definition"])
        return [
            F.filter(labels, lambda x: x != "").alias("labels"),
            F.filter(markings, lambda x: x != "").alias("markings"),
            F.nullif(F.col(f"{node}.createdBy.name"), F.lit("")).alias("creator"),
        ]

    observables = nodes.select(
        F.col("n.id").alias("observable_id"), F.col("n.observable_value").alias("value"),
        F.col("n.entity_type").alias("type"), *context("n"),
    )
    rows = nodes.select(F.col("n.id").alias("observable_id"), F.explode("n.indicators.edges").alias("e"))
    rows = rows.select("observable_id", F.col("e.node").alias("i"))
    indicators = rows.select(
        "observable_id", F.col("i.id").alias("indicator_id"), F.coalesce("i.revoked", F.lit(False)).alias("revoked"),
        F.col("i.valid_until").alias("valid_until"), F.col("i.x_opencti_score").try_cast("double").alias("score"),
        *context("i"),
    )
    return _one_each(observables, "observable_id"), _one_each(indicators, "observable_id", "indicator_id")


def parse_urlhaus(df: DataFrame, raw: str = "raw", key: str = "value") -> DataFrame:
    """``(value, query_status, details)`` of feed answers."""
    parsed = df.select(key, F.col(raw).alias("details"), F.from_json(raw, "struct<query_status: string>").alias("r"))
    return parsed.select(key, F.coalesce("r.query_status", F.lit("")).alias("query_status"), "details")


def registry_servers(bootstrap: DataFrame, raw: str = "raw") -> DataFrame:
    """``(tld, server, ord)`` rows of a registry bootstrap document (``services``: [[tlds], [servers]] pairs)."""
    services = F.from_json(raw, "struct<services: array<array<array<string>>>>")["services"]
    rows = bootstrap.select(F.posexplode(services).alias("service", "s"))
    servers = rows.select("service", F.get("s", 0).alias("tlds"), F.posexplode(F.get("s", 1)).alias("ord", "server"))
    return servers.select(F.explode("tlds").alias("tld"), "server", "ord").select(F.lower("tld").alias("tld"), "server", "ord")
