"""Verdict rules over evidence bundles, all as column logic: one pass, no target leaves its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.schemas import CLASSIFICATIONS

# Thresholds, confidences and tag prefixes of the rules.
RISK_THRESHOLD = 0.5
IOC_EXACT_CONFIDENCE = 0.95
IOC_INFRA_CONFIDENCE = 0.85
SPARSE_CONFIDENCE = 0.05
TLS_CONFIDENCE = 0.6
BRAND_TAG = "phishing-name:"
TAG_PREFIXES = (
    "CERT-", "campaign-type:", "phishing-name:", "country-target:", "attack-method:", "theme:", "via:",
)
MAX_TAGS = 8
FALLBACK_BOTH, FALLBACK_ONE, FALLBACK_SPARSE, FALLBACK_FIELDS, FALLBACK_NONE = 0.6, 0.4, 0.1, 0.2, 0.15
DEFAULT_ANSWER_CONFIDENCE = 0.3

_VERDICT = (
    "struct<classification:string,confidence:double,produced_by:string,brand:string,kit_family:string,"
    "rationale:string,final_url:string,exfil_endpoint:string>"
)
_MISP = "struct<match_count:bigint,matched_types:array<string>,tags:array<string>,event_count:bigint>"
_OPENCTI = """struct<match_count:bigint,matched_types:array<string>,active_indicator_count:bigint,
    total_indicator_count:bigint,labels:array<string>,markings:array<string>,score_avg:double>"""


def _verdict(
    classification: str | Column, confidence: Column | float, produced_by: str, rationale: Column,
    brand: Column | None = None, final_url: Column | None = None, kit_family: Column | None = None,
    exfil_endpoint: Column | None = None,
) -> Column:
    literal = lambda v: F.lit(v) if isinstance(v, (str, float)) else v
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(
        literal(classification).alias("classification"), literal(confidence).cast("double").alias("confidence"),
        F.lit(produced_by).alias("produced_by"), text(brand).alias("brand"), text(kit_family).alias("kit_family"),
        rationale.alias("rationale"), text(final_url).alias("final_url"), text(exfil_endpoint).alias("exfil_endpoint"),
    ).cast(_VERDICT)


def has_strong_signal() -> Column:
    """Enough signal outside the page graph: a risk score, cloaking, a feed hit or a close look-alike."""
    seen = lambda key: F.coalesce(F.try_element_at("evidence_counts", F.lit(key)), F.lit(0)) > 0
    return (
        (F.col("lexical_risk_score") >= RISK_THRESHOLD) | (F.col("passive_risk_score") >= RISK_THRESHOLD)
        | seen("cloaking_detected") | seen("reputation_hit") | F.col("close_lookalike")
    )


def _join_words(words: Column) -> Column:
    return F.array_join(F.array_sort(words), ", ")


def _noted(label: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f" {label}: "), text, F.lit("."))).otherwise("")


def _ioc_verdicts(landing: Column) -> tuple[Column, Column]:
    misp, cti = F.col("_misp"), F.col("_opencti")
    exact = F.array(F.lit("url"), F.lit("hostname"))

    def confidence(types: Column) -> Column:
        overlap = F.arrays_overlap(F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower), exact)
        return F.when(overlap, IOC_EXACT_CONFIDENCE).otherwise(IOC_INFRA_CONFIDENCE)

    tags = F.coalesce(misp["tags"], F.array().cast("array<string>"))
    names = F.transform(
        F.filter(tags, lambda t: t.startswith(BRAND_TAG)), lambda t: F.trim(F.substr(t, F.lit(len(BRAND_TAG) + 1)))
    )
    brand = F.nullif(_join_words(F.array_distinct(names)), F.lit(""))

    def informative(tag: Column) -> Column:
        keep = F.lit(False)
        for prefix in TAG_PREFIXES:
            keep = keep | tag.startswith(prefix)
        return keep

    shown = F.array_join(F.slice(F.filter(tags, informative), 1, MAX_TAGS), ", ")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    corroborated = F.when(
        cti.isNotNull(),
        F.concat(
            F.lit(" Also confirmed by OpenCTI: "), number(cti["match_count"]), F.lit(" observables ("),
            _join_words(cti["matched_types"]), F.lit("), "), number(cti["active_indicator_count"]),
            F.lit(" active indicators of "), number(cti["total_indicator_count"]), F.lit("."),
        ),
    ).otherwise("")
    misp_text = F.concat(
        F.lit("MISP hit marked for detection: "), number(misp["match_count"]), F.lit(" attributes ("),
        _join_words(misp["matched_types"]), F.lit(") in "), number(misp["event_count"]), F.lit(" events."),
        _noted("Tags", shown), corroborated,
    )
    cti_text = F.concat(
        F.lit("OpenCTI hit with an active indicator: "), number(cti["match_count"]), F.lit(" observables ("),
        _join_words(cti["matched_types"]), F.lit("), "), number(cti["active_indicator_count"]),
        F.lit(" active indicators of "), number(cti["total_indicator_count"]), F.lit("."),
        _noted("Labels", F.array_join(cti["labels"], ", ")), _noted("Markings", F.array_join(cti["markings"], ", ")),
        _noted("Mean score", cti["score_avg"].cast("string")),
    )
    return (
        _verdict("phishing", confidence(misp["matched_types"]), "prefilter", misp_text, brand, landing),
        _verdict("phishing", confidence(cti["matched_types"]), "prefilter", cti_text, None, landing),
    )


def prefilter(bundles: DataFrame) -> DataFrame:
    """Add ``strong_signal`` and ``prefilter`` (verdict struct or NULL).

    In order: verified threat-feed record; any strong signal leaves the case open; nothing explored; an
    exploration that only failed. The last two rise when the host's certificate was wrong.
    """
    df = bundles.withColumns({"_misp": F.from_json("misp_hit", _MISP), "_opencti": F.from_json("opencti_hit", _OPENCTI)})
    landing = F.coalesce("canonical_url", "input_url")
    misp, opencti = _ioc_verdicts(landing)

    def sparse(reason: str) -> Column:
        return F.when(
            F.col("had_tls_error"),
            _verdict("suspicious", TLS_CONFIDENCE, "prefilter", F.lit("The certificate is not valid for the host and nothing useful was explored.")),
        ).otherwise(_verdict("suspicious", SPARSE_CONFIDENCE, "prefilter", F.lit(reason)))

    nothing_seen = (F.col("num_states") <= 1) & ~F.col("has_text")
    only_failed = (
        F.col("had_unhandled_error") & ~F.col("had_gate") & (F.col("total_fields") == 0)
        & ~F.col("had_navigation_error") & (F.size(F.map_keys("transition_kinds")) <= 1)
    )
    verdict = (
        F.when(F.col("misp_hit").isNotNull(), misp)
        .when(F.col("opencti_hit").isNotNull(), opencti)
        .when(F.col("strong_signal"), F.lit(None).cast(_VERDICT))
        .when(nothing_seen, sparse("Only the first state was reached and no text was found; not enough data."))
        .when(only_failed, sparse("The exploration failed without any other signal; not enough data."))
    )
    return df.withColumn("strong_signal", has_strong_signal()).withColumn("prefilter", verdict).drop("_misp", "_opencti")


def heuristic_verdict(reason: str = "no model answer") -> Column:
    """Conservative verdict over bundle columns for cases the model did not answer; always suspicious."""
    seen = lambda key: F.coalesce(F.try_element_at("evidence_counts", F.lit(key)), F.lit(0)) > 0
    cloaked, abused = seen("cloaking_detected"), seen("abuse_prone_infra")
    fields = F.col("total_fields")
    confidence = (
        F.when(cloaked & abused, FALLBACK_BOTH)
        .when(cloaked | abused, FALLBACK_ONE)
        .when((F.col("num_states") <= 1) & (fields == 0), FALLBACK_SPARSE)
        .when(fields >= 2, FALLBACK_FIELDS)
        .otherwise(FALLBACK_NONE)
    )
    signals = F.concat_ws(", ", F.when(cloaked, "cloaking"), F.when(abused, "abuse-prone hosting"))
    why = (
        F.when(cloaked | abused, F.concat(F.lit("measured signals: "), signals))
        .when((F.col("num_states") <= 1) & (fields == 0), "a single state without form fields")
        .when(fields >= 2, F.concat(fields.cast("string"), F.lit(" form fields")))
        .otherwise("not enough signals")
    )
    return _verdict("suspicious", confidence, "heuristic_fallback", F.concat(F.lit(f"Heuristic fallback ({reason}): "), why))


def answer_verdict(raw: Column) -> Column:
    """A model's JSON answer as a verdict, NULL when it is not a JSON object."""
    readable = F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{")
    fields = ("classification", "confidence", "brand", "kit_family", "rationale", "final_url", "exfil_endpoint")
    a = F.from_json(raw, "struct<" + ",".join(f"{f}:string" for f in fields) + ">")
    classification = F.when(a["classification"].isin(*CLASSIFICATIONS), a["classification"]).otherwise("suspicious")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["confidence"].try_cast("double"), F.lit(DEFAULT_ANSWER_CONFIDENCE))))
    text = lambda name: F.nullif(a[name], F.lit(""))
    return F.when(
        readable,
        _verdict(
            classification, confidence, "model", text("rationale"), text("brand"), text("final_url"),
            text("kit_family"), text("exfil_endpoint"),
        ),
    )


def verdicts(prefiltered: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One verdict per bundle: prefilter, else a readable model answer, else the heuristic.

    ``answers``: ``(target_id, raw_json)``, at most one row per target.
    """
    df, answered = prefiltered, F.lit(None).cast(_VERDICT)
    if answers is not None:
        df = df.join(answers.select("target_id", "raw_json"), "target_id", "left")
        answered = answer_verdict(F.col("raw_json"))
    broken = F.col("raw_json").isNotNull() if answers is not None else F.lit(False)
    fallback = F.when(broken, heuristic_verdict("unreadable answer")).otherwise(heuristic_verdict())
    return df.select("target_id", F.coalesce("prefilter", answered, fallback).alias("v")).select("target_id", "v.*")


def undecided(prefiltered: DataFrame) -> DataFrame:
    """Bundles to send to the model."""
    return prefiltered.filter(F.col("prefilter").isNull())
