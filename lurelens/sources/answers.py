"""Collected provider answers, checked before they are parsed: what can be read, and why the rest cannot."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lurelens.functions.times import utc_timestamp
from lurelens.schemas import emit
from lurelens.session import ensure_checkpoint_dir
from lurelens.sources import feeds

_BROKEN = "_broken"
_REGISTRY = "struct<services: array<array<array<string>>>>"


class Check(NamedTuple):
    """How a provider's answers look: their schema, what must be there, and what is wrong with single records."""

    schema: str
    missing: Callable[[Column], Column]
    records: Callable[[Column], Column]


def _nothing(_: Column) -> Column:
    return F.array().cast("array<string>")


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _wrong(records: Column, reason: Callable[[Column], Column]) -> Column:
    """Reasons of the records that have one."""
    return F.coalesce(F.filter(F.transform(records, reason), lambda text: text.isNotNull()), F.array().cast("array<string>"))


def _rdap(answer: Column) -> Column:
    bad = lambda e: (e["eventAction"] == "registration") & utc_timestamp(e["eventDate"], offsets=False).isNull()
    return _wrong(answer["events"], lambda e: F.when(bad(e), F.concat(F.lit("unreadable date: "), F.coalesce(e["eventDate"], F.lit("")))))


def _certificates(answer: Column) -> Column:
    return _wrong(answer["rows"], lambda c: F.when(_empty(c["id"]), "certificate without id").when(
        utc_timestamp(F.trim(c["not_before"])).isNull(), F.concat(F.lit("certificate without date: "), c["id"])))


def _attributes(answer: Column) -> Column:
    rows = F.from_json(answer["response"]["Attribute"], feeds._MISP_ATTRIBUTE)
    return _wrong(rows, lambda a: F.when(_empty(a["value"]), F.concat(F.lit("attribute without value: "), F.coalesce(a["id"], F.lit("")))))


def _observables(answer: Column) -> Column:
    edges = answer["data"]["stixCyberObservables"]["edges"]
    return _wrong(edges, lambda e: F.when(_empty(e["node"]["observable_value"]), F.concat(
        F.lit("observable without value: "), F.coalesce(e["node"]["id"], F.lit("")))))


#: What is checked of each provider's answers.
CHECKS = {
    "rdap": Check(feeds._RDAP, lambda a: F.when(a["errorCode"].isNotNull(), F.concat(F.lit("error "), a["errorCode"])), _rdap),
    "certificate_search": Check(feeds._CT, lambda a: F.when(a["rows"].isNull(), "no rows"), _certificates),
    "certificate_details": Check("struct<san_dns: array<string>>", lambda a: F.when(a["san_dns"].isNull(), "no names"), _nothing),
    "misp": Check("struct<response: struct<Attribute: string>>", lambda a: F.when(a["response"]["Attribute"].isNull(), "no attributes"), _attributes),
    "opencti": Check(feeds._OPENCTI, lambda a: F.when(a["data"]["stixCyberObservables"]["edges"].isNull(), "no observables"), _observables),
    "urlhaus": Check("struct<query_status: string>", lambda a: F.when(_empty(a["query_status"]), "no status"), _nothing),
    "registry": Check(_REGISTRY, lambda a: F.when(a["services"].isNull(), "no services"), _nothing),
}


class Checked(NamedTuple):
    """``answers``: rows that the provider's parser can read, as they came; ``rejects``: the other columns with ``provider``
    and ``reason``, one row per fault; ``counts``: ``answers, unreadable, faults``, known once the check has run."""

    answers: DataFrame
    rejects: DataFrame
    counts: Observation


def check_answers(df: DataFrame, provider: str, raw: str = "raw") -> Checked:
    """Check the answers of a provider in one pass over them.

    Every row is marked as readable or not, with the reasons: empty or broken text, an answer that says it failed or
    lacks its records, and single records that lack what makes them one (these do not take the rest of the answer
    with them). The marked rows are written once; both results read them from there, so the source is read once.
    """
    check = CHECKS[provider]
    struct = check.schema.removeprefix("struct<")
    answer = F.from_json(raw, f"struct<{_BROKEN}: string, {struct}", {"columnNameOfCorruptRecord": _BROKEN, "mode": "PERMISSIVE"})
    marked = df.withColumn("_answer", answer)
    parsed = F.col("_answer")
    fault = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty answer").when(
        parsed.isNull() | parsed[_BROKEN].isNotNull(), "unreadable answer").otherwise(check.missing(parsed))
    marked = marked.withColumn("_fault", fault).withColumn(
        "_reasons", F.when(F.col("_fault").isNotNull(), F.array("_fault")).otherwise(check.records(parsed))).drop("_answer")
    counts = Observation(provider)
    ensure_checkpoint_dir(df.sparkSession)
    seen = marked.observe(
        counts, F.count(F.lit(1)).alias("answers"), F.count_if(F.col("_fault").isNotNull()).alias("unreadable"),
        F.sum(F.size("_reasons")).alias("faults")).checkpoint()
    others = [name for name in df.columns if name != raw]
    rejects = seen.where(F.size("_reasons") > 0).select(*others, F.lit(provider).alias("provider"), F.explode("_reasons").alias("reason"))
    return Checked(seen.where(F.col("_fault").isNull()).select(df.columns), rejects, counts)


def reject_evidence(rejects: DataFrame) -> DataFrame:
    """Rejects with their ``target_id`` as ``pipeline_error`` evidence, so that partial results say what they lack."""
    value = F.concat_ws(": ", "provider", "reason")
    return emit(rejects.where("target_id is not null"), "API", "pipeline_error", value, None, "collection")
