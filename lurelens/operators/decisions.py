"""The binary answer given to callers: safe or malicious, with confidence, signature, action and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and texts of the answer contract.
BLOCK_THRESHOLD = 0.6
MALICIOUS_FLOOR = 0.8
SUSPICIOUS_CEILING = 0.5
SUSPICIOUS_DEFAULT = 0.4
BENIGN_FLOOR = 0.9
NO_DATA_CONFIDENCE = 0.1
KIT_WORDS = ("aitm", "harvest", "evilginx")
SIGNATURE_BRAND = "Phishing: %s Impersonation"
SIGNATURE_GATE = "Suspicious Gate Bypass Detected"
SIGNATURE_CREDENTIAL = "Credential Harvesting Detected"
SIGNATURE_INCOMPLETE = "Analysis-Incomplete — Benign By Default"
SIGNATURE_FAILED = "Analysis-Failed"
SIGNATURE_BLOCKED = "Suspicious Site Blocked"
SIGNATURES = {
    "phishing": "Phishing Page Detected",
    "benign": "No Threats Detected",
    "suspicious": "Suspicious Site (Low Confidence)",
}
SIGNATURE_UNKNOWN = "Unclassified"
OVERRIDE_SIGNATURES = {
    "whitelist": "Whitelist-Override: %s explicitly trusted",
    "blacklist": "Blacklist-Override: %s explicitly blocked",
}


def signature_facts(evidence: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """Per target what a signature may name: look-alike brand, solved gate, e-mail payload, pipeline error.

    A solved gate counts as evidence key or as edge kind. Map-side combinable, one row per target.
    """
    key, value = F.col("key"), F.col("value")
    facts = evidence.groupBy("target_id").agg(
        F.min(F.when(key == "typosquat", F.get_json_object(value, "$.brand"))).alias("lookalike_brand"),
        F.bool_or(key == "gate_solved").alias("gate_evidence"),
        F.bool_or(key == "aitm_email_payload").alias("email_payload"),
        F.min(F.when(key == "pipeline_error", value)).alias("pipeline_error"),
    )
    if transitions is None:
        return facts.withColumnRenamed("gate_evidence", "gate_solved")
    solved = transitions.filter("kind = 'gate_solved'").select("target_id", F.lit(True).alias("gate_edge")).distinct()
    both = facts.join(solved, "target_id", "full")
    gate = F.coalesce("gate_evidence", F.lit(False)) | F.coalesce("gate_edge", F.lit(False))
    return both.select("target_id", "lookalike_brand", gate.alias("gate_solved"), "email_payload", "pipeline_error")


def _signature(malicious: Column) -> Column:
    label = F.col("classification")
    kit = F.lower("kit_family").rlike("|".join(KIT_WORDS))
    attack = (
        F.when(F.col("lookalike_brand").isNotNull(), F.format_string(SIGNATURE_BRAND, "lookalike_brand"))
        .when(F.coalesce("brand", F.lit("")) != "", F.format_string(SIGNATURE_BRAND, "brand"))
        .when(F.col("gate_solved"), SIGNATURE_GATE)
        .when(F.col("email_payload") | kit, SIGNATURE_CREDENTIAL)
        .when(label == "suspicious", SIGNATURE_BLOCKED)
    )
    generic = F.lit(SIGNATURE_UNKNOWN)
    for name, text in SIGNATURES.items():
        generic = F.when(label == name, text).otherwise(generic)
    return F.coalesce(F.when(malicious, attack), generic)


def decide(targets: DataFrame, verdicts: DataFrame, facts: DataFrame) -> DataFrame:
    """``(target_id, verdict, confidence, signature, recommended_action, reason)`` for every target.

    Phishing and strong suspicion are malicious; failed, unfinished or unclassified runs say so and pass.
    """
    chosen = ("classification", "confidence", "brand", "kit_family", "rationale")
    df = targets.select("target_id", "status").join(
        verdicts.select("target_id", F.col("confidence").alias("_confidence"), *(c for c in chosen if c != "confidence")),
        "target_id", "left",
    ).join(facts, "target_id", "left")
    label, given = F.col("classification"), F.coalesce("_confidence", F.lit(0.0))
    status = F.col("status")
    known = F.coalesce(~status.isin("error", "running", "queued"), F.lit(True)) & label.isNotNull()
    malicious = known & ((label == "phishing") | ((label == "suspicious") & (given >= BLOCK_THRESHOLD)))
    doubtful = F.least(F.lit(SUSPICIOUS_CEILING), F.when(given == 0.0, SUSPICIOUS_DEFAULT).otherwise(given))
    confidence = (
        F.when(~known, NO_DATA_CONFIDENCE)
        .when(malicious, F.round(F.greatest(F.lit(MALICIOUS_FLOOR), given), 2))
        .when(label == "suspicious", F.round(doubtful, 2))
        .otherwise(F.round(F.greatest(F.lit(BENIGN_FLOOR), given), 2))
    )
    signature = (
        F.when(status == "error", SIGNATURE_FAILED).when(~known, SIGNATURE_INCOMPLETE).otherwise(_signature(malicious))
    )
    reason = (
        F.when(status == "error", F.concat(F.lit("Analysis failed: "), F.coalesce("pipeline_error", F.lit("unknown error"))))
        .when(status.isin("running", "queued"), F.concat(F.lit("Analysis still "), status))
        .when(label.isNull(), "Analysis finished without a verdict.")
        .otherwise(F.coalesce(
            F.nullif("rationale", F.lit("")),
            F.when(malicious, "Phishing indicators confirmed.").otherwise("No phishing indicator found."),
        ))
    )
    return df.select(
        "target_id", F.when(malicious, "malicious").otherwise("safe").alias("verdict"), confidence.alias("confidence"),
        signature.alias("signature"), F.when(malicious, "block").otherwise("allow").alias("recommended_action"),
        reason.alias("reason"),
    )


def not_started(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Answers for requested targets nothing is known about yet."""
    missing = requests.select("target_id").distinct().join(answered, "target_id", "left_anti")
    return missing.select(
        "target_id", F.lit("safe").alias("verdict"), F.lit(NO_DATA_CONFIDENCE).alias("confidence"),
        F.lit(SIGNATURE_INCOMPLETE).alias("signature"), F.lit("allow").alias("recommended_action"),
        F.lit("Analysis not started.").alias("reason"),
    )


def override_decision(matched: DataFrame) -> DataFrame:
    """Answers for URLs an override list decides (rows of ``apply_overrides`` with a match)."""
    hit = matched.filter(F.col("list_type").isNotNull())
    level = F.when(F.col("matched") == "url", "URL").otherwise("Domain")
    trusted = F.col("list_type") == "whitelist"
    signature = F.when(trusted, F.format_string(OVERRIDE_SIGNATURES["whitelist"], level)).otherwise(
        F.format_string(OVERRIDE_SIGNATURES["blacklist"], level)
    )
    default = F.concat(level, F.lit(" on the "), F.col("list_type"), F.lit("; analysis skipped."))
    return hit.select(
        "target_id", F.when(trusted, "safe").otherwise("malicious").alias("verdict"), F.lit(1.0).alias("confidence"),
        signature.alias("signature"), F.when(trusted, "allow").otherwise("block").alias("recommended_action"),
        F.coalesce(F.nullif("note", F.lit("")), default).alias("reason"),
    )


def override_verdicts(matched: DataFrame) -> DataFrame:
    """Stored verdicts for overridden URLs."""
    hit = matched.filter(F.col("list_type").isNotNull())
    return hit.select(
        "target_id", F.when(F.col("list_type") == "whitelist", "benign").otherwise("phishing").alias("classification"),
        F.lit(1.0).alias("confidence"), F.lit("prefilter").alias("produced_by"),
        F.concat(F.col("list_type"), F.lit(" match on "), F.col("matched"), F.lit(" "), F.col("match_key")).alias("rationale"),
    )
