"""Schemas of the five stored tables and the evidence row every job produces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Closed vocabularies of the stored columns.
TRANSITION_KINDS = (
    "http_3xx", "meta_refresh", "js_location", "history_push", "click",
    "form_submit", "new_tab", "gate_solved", "ws_message", "cloaking_probe",
)
TARGET_STATUSES = ("queued", "running", "done", "error")
EVIDENCE_SCOPES = ("target", "state", "transition")
CLASSIFICATIONS = ("benign", "suspicious", "phishing")
LAYERS = ("L0", "L1", "L2", "L3", "L4", "L5")


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

TARGETS = _table(
    ("target_id", _S, False), ("input_url", _S, False), ("canonical_url", _S, True),
    ("url_hash", _S, True), ("final_url", _S, True), ("status", _S, False),
    ("root_state_id", _S, True), ("created_at", _TS, False),
)
STATES = _table(
    ("state_id", _S, False), ("target_id", _S, False), ("url", _S, False), ("dom_hash", _S, False),
    ("depth", _I, False), ("screenshot_ref", _S, True), ("har_ref", _S, True),
)
TRANSITIONS = _table(
    ("transition_id", _S, False), ("target_id", _S, False), ("from_state", _S, False),
    ("to_state", _S, False), ("kind", _S, False), ("trigger", _S, True), ("ts", _TS, False),
)
EVIDENCE = _table(
    ("evidence_id", _S, False), ("target_id", _S, False), ("scope", _S, False), ("scope_id", _S, False),
    ("layer", _S, False), ("key", _S, False), ("value", _S, False), ("weight", _D, False),
    ("produced_by", _S, False), ("ts", _TS, False),
)
VERDICTS = _table(
    ("target_id", _S, False), ("classification", _S, False), ("confidence", _D, False),
    ("produced_by", _S, False), ("brand", _S, True), ("kit_family", _S, True),
    ("rationale", _S, True), ("final_url", _S, True), ("exfil_endpoint", _S, True),
)

TABLES = {
    "targets": TARGETS, "states": STATES, "transitions": TRANSITIONS,
    "evidence": EVIDENCE, "verdicts": VERDICTS,
}

EVIDENCE_COLUMNS = ["target_id", "scope", "scope_id", "layer", "key", "value", "weight", "produced_by"]


def as_json(*fields: Column) -> Column:
    """One JSON object, keeping null fields."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def emit(
    df: DataFrame,
    layer: str,
    key: str | Column,
    value: Column,
    weight: float | Column | None = None,
    produced_by: str = "",
    scope: str | Column = "target",
    scope_id: Column | None = None,
) -> DataFrame:
    """Project rows of ``df`` (with ``target_id``) into the evidence schema; the default weight is 1.0."""
    literal = lambda v: F.lit(v) if isinstance(v, (str, float, int)) else v
    return df.select(
        "target_id",
        literal(scope).alias("scope"),
        (F.col("target_id").cast("string") if scope_id is None else scope_id.cast("string")).alias("scope_id"),
        F.lit(layer).alias("layer"),
        literal(key).alias("key"),
        value.cast("string").alias("value"),
        (F.lit(1.0) if weight is None else F.coalesce(literal(weight).cast("double"), F.lit(1.0))).alias("weight"),
        F.lit(produced_by).alias("produced_by"),
    )


def finding(condition: Column, key: str | Column, value: Column, weight: float | Column) -> Column:
    """One possible evidence row of an input row, null where the condition doesn't hold."""
    literal = lambda v: F.lit(v) if isinstance(v, (str, float, int)) else v
    return F.when(condition, F.struct(
        literal(key).alias("key"), value.cast("string").alias("value"), literal(weight).cast("double").alias("weight")))


def emit_all(df: DataFrame, findings: Column, layer: str, produced_by: str) -> DataFrame:
    """All findings of every row, from one pass over the rows."""
    rows = df.select("target_id", F.explode(F.filter(findings, lambda e: e.isNotNull())).alias("e"))
    return emit(rows, layer, F.col("e.key"), F.col("e.value"), F.col("e.weight"), produced_by)


def identified(evidence: DataFrame, as_of: Column) -> DataFrame:
    """Give evidence rows a repeatable id and the time of the run, ready to store."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EVIDENCE_COLUMNS]
    return evidence.select(
        F.sha2(F.concat_ws("\x1f", *content), 256).alias("evidence_id"),
        *EVIDENCE_COLUMNS,
        as_of.cast("timestamp").alias("ts"),
    )


def outside_domain(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not in a closed vocabulary (used before a table is written)."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))
