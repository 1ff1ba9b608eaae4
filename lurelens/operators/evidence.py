"""One evidence table: union, counts, flags, and the per-target bundle the verdict rules read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lurelens.functions.joins import is_short
from lurelens.functions.ranking import with_position
from lurelens.operators.graph import kind_maps, with_leaf_flag
from lurelens.operators.pages import VISIBLE_TEXT_CHARS, title, visible_text
from lurelens.schemas import EVIDENCE_COLUMNS, LAYERS, emit
from lurelens.session import stored

# Keys that are strong on their own, and how TLS failures read.
STRONG_KEYS = ("typosquat", "reputation_hit", "cloaking_detected")
TLS_KEYS = ("navigation_error", "active_probe_error")
TLS_MARKERS = ("ERR_CERT", "CERTIFICATE_VERIFY_FAILED", "HOSTNAME MISMATCH")
FLAG_KEYS = {
    "had_gate": "blocked_by_gate",
    "had_navigation_error": "navigation_error",
    "had_replay_fallback": "replay_fallback_used",
    "had_unhandled_error": "unhandled_node_error",
}
FLAGS = (*FLAG_KEYS, "had_tls_error")
WEIGHT_BANDS = ((0.0, "info"), (0.2, "low"), (0.4, "medium"))

# Limits of the case digest.
DIGEST_URL_CHARS = 300
DIGEST_TEXT_CHARS = 1000
DIGEST_OCR_CHARS = 600
DIGEST_FIELDS = 25
DIGEST_LABEL_CHARS = 60
DIGEST_LINE_CHARS = 200
DETAILED_INTERMEDIATE_STATES = 12
#: A case with more states is not put into one task; as many rows as a window holds in memory.
LARGE_CASE = 4096


def union_evidence(*producers: DataFrame) -> DataFrame:
    """All producers in the common schema."""
    rows = producers[0].select(*EVIDENCE_COLUMNS)
    for part in producers[1:]:
        rows = rows.unionByName(part.select(*EVIDENCE_COLUMNS))
    return rows


def rejected_rows(rejects: DataFrame, produced_by: str) -> DataFrame:
    """Rows a job could not handle as ``pipeline_error`` evidence, so that partial results stay useful."""
    return emit(rejects.filter(F.col("reason").isNotNull()), "API", "pipeline_error", F.col("reason"), None, produced_by)


def is_tls_failure(value: Column) -> Column:
    return F.upper(value).rlike("|".join(TLS_MARKERS))


def _by_key(evidence: DataFrame) -> DataFrame:
    """First aggregation level: one row per target, layer and key, whatever the number of evidence rows."""
    value, key = F.col("value"), F.col("key")
    marked = lambda flag: F.when((key == "reputation_hit") & (F.get_json_object(value, f"$.{flag}") == "true"), value)
    return evidence.groupBy("target_id", "layer", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("weight").alias("weight"),
        F.bool_or(key.isin(*TLS_KEYS) & is_tls_failure(value)).alias("tls"),
        F.bool_or((key == "typosquat") & (F.get_json_object(value, "$.distance") == "1")).alias("close_lookalike"),
        F.min(marked("to_ids_match")).alias("misp_hit"),
        F.min(marked("active_ioc_match")).alias("opencti_hit"),
    )


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("target_id", "key").agg(F.count(F.lit(1)).alias("n"))


def evidence_flags(evidence: DataFrame) -> DataFrame:
    """Per target: gate, navigation, replay, unhandled and TLS failure flags."""
    key = F.col("key")
    flags = [F.bool_or(key == wanted).alias(flag) for flag, wanted in FLAG_KEYS.items()]
    tls = F.bool_or(key.isin(*TLS_KEYS) & is_tls_failure(F.col("value"))).alias("had_tls_error")
    return evidence.groupBy("target_id").agg(*flags, tls)


def strong_details(evidence: DataFrame) -> DataFrame:
    """Values of the strong keys in long form: ``(target_id, key, is_json, value, decoded)``. ``decoded`` maps the fields of a
    JSON object to their texts; other values have none."""
    return evidence.filter(F.col("key").isin(*STRONG_KEYS)).select(
        "target_id", "key", F.try_parse_json("value").isNotNull().alias("is_json"), "value",
        F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>")).alias("decoded"),
    )


def layer_order(layer: Column) -> Column:
    order = F.lit(len(LAYERS))
    for i, name in enumerate(LAYERS):
        order = F.when(layer == name, i).otherwise(order)
    return order


def weight_band(weight: Column) -> Column:
    band = F.lit("high")
    for limit, name in reversed(WEIGHT_BANDS):
        band = F.when(weight <= limit if limit == 0.0 else weight < limit, name).otherwise(band)
    return band


def layer_groups(evidence: DataFrame) -> DataFrame:
    """Evidence per target, layer and weight band, in layer order with unknown layers last."""
    df = evidence.withColumns({"layer_rank": layer_order(F.col("layer")), "band": weight_band(F.col("weight"))})
    return df.groupBy("target_id", "layer", "layer_rank", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def bundle_states(
    states: DataFrame, transitions: DataFrame, pages: DataFrame, max_chars: int | None = VISIBLE_TEXT_CHARS
) -> DataFrame:
    """Every state with ``is_leaf``, title, visible text and OCR text; states without a snapshot have empty texts.

    ``pages``: ``target_id, state_id, html`` and optionally ``ocr_text, brands``.
    """
    extra = [c for c in ("ocr_text", "brands") if c in pages.columns]
    text = pages.select(
        "target_id", "state_id", title(F.col("html")).alias("title"),
        visible_text(F.col("html"), max_chars).alias("visible_text"), *extra,
    )
    df = with_leaf_flag(states, transitions).join(text, ["target_id", "state_id"], "left")
    if "ocr_text" not in extra:
        df = df.withColumn("ocr_text", F.lit(""))
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "visible_text", "ocr_text")})


def bundles(
    targets: DataFrame, states: DataFrame, transitions: DataFrame, evidence: DataFrame, fields: DataFrame | None = None
) -> DataFrame:
    """One record per target: sizes, scores, kind and key counts, flags, strong signals, content totals.

    ``states`` come from ``bundle_states``. Every side is reduced to one row per target by combinable
    aggregates on ``target_id``, so the final joins need no further shuffle. State texts stay in their table.
    """
    shown = F.trim(F.concat_ws(" ", "visible_text", "ocr_text")) != ""
    s = states.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("num_states"), F.max("depth").alias("max_depth_reached"), F.bool_or(shown).alias("has_text")
    )
    layer = F.col("layer")
    score = lambda name: F.round(F.least(F.lit(1.0), F.sum(F.when(layer == name, F.col("weight")).otherwise(0.0))), 4)
    per_key = _by_key(evidence)
    flags = [F.bool_or(F.col("key") == wanted).alias(flag) for flag, wanted in FLAG_KEYS.items()]
    e = per_key.groupBy("target_id").agg(
        *flags, F.bool_or("tls").alias("had_tls_error"), F.bool_or("close_lookalike").alias("close_lookalike"),
        score("L1").alias("lexical_risk_score"), score("L2").alias("passive_risk_score"),
        F.min("misp_hit").alias("misp_hit"), F.min("opencti_hit").alias("opencti_hit"),
        F.collect_list(F.struct("key", "n")).alias("_counts"),
    )
    # a key is in one layer as a rule; only the counts of others are added up
    plain = F.size(F.array_distinct("_counts.key")) == F.size("_counts")
    total = lambda k: F.aggregate(F.filter("_counts", lambda c: c["key"] == k), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    keys = F.array_sort(F.array_distinct(F.transform("_counts", lambda c: c["key"])))
    counted = F.when(plain, F.sort_array("_counts")).otherwise(F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("n"))))
    e = e.withColumn("evidence_counts", F.map_from_entries(counted)).drop("_counts")
    df = targets.select("target_id", "input_url", F.col("final_url").alias("canonical_url"))
    for side in (s, kind_maps(transitions), e):
        df = df.join(side, "target_id", "left")
    if fields is not None:
        df = df.join(fields.groupBy("target_id").agg(F.count(F.lit(1)).alias("total_fields")), "target_id", "left")
    else:
        df = df.withColumn("total_fields", F.lit(0).cast("long"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    filled = {c: F.coalesce(c, zero) for c in ("num_states", "num_transitions", "max_depth_reached", "total_fields")}
    filled |= {c: F.coalesce(c, no) for c in (*FLAGS, "close_lookalike", "has_text")}
    filled |= {c: F.coalesce(c, F.lit(0.0)) for c in ("lexical_risk_score", "passive_risk_score")}
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:bigint>>"))
    filled |= {c: F.coalesce(c, empty) for c in ("transition_kinds", "evidence_counts")}
    return df.withColumns(filled)


def shortened(text: Column, limit: int) -> Column:
    cut = F.concat(F.rtrim(F.substring(text, 1, limit)), F.format_string(" …[cut: %d characters]", F.length(text) - limit))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def with_detail_level(states: DataFrame, limit: int = DETAILED_INTERMEDIATE_STATES) -> DataFrame:
    """Add ``position`` and ``detail``: ``full``, ``same`` (content shown at ``same_as``) or ``summary``.

    Leaves are shown in full once per content; of the other states the first ``limit`` distinct ones are.
    The state that shows a content in full is found per content, not by scanning the states in order. States of a target
    meet in one task, where all is found by windows; targets with more than ``LARGE_CASE`` states are spread over many.
    """
    sizes = states.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    many = stored(sizes.filter(F.col("n") > min(limit, LARGE_CASE)), "long-cases")
    if is_short(many, 0):
        return _detail_of_small(states, None)
    large = F.col("n") > LARGE_CASE
    of = lambda ids, how: states.join(ids.select("target_id"), "target_id", how).select(states.columns)
    rows = _detail_of_small(of(many, "left_anti"), None).unionByName(_detail_of_small(of(many.filter(~large), "left_semi"), limit))
    return rows.unionByName(_detail_of_large(of(many.filter(large), "left_semi"), limit))


def _content() -> Column:
    return F.coalesce(F.nullif("dom_hash", F.lit("")), F.concat(F.lit("state:"), F.col("state_id")))


def _detailed(df: DataFrame) -> DataFrame:
    position, full = F.col("position"), F.col("_full_at")
    detail = F.when(position == full, "full").when(position > full, "same").otherwise("summary")
    return df.withColumns({"detail": detail, "same_as": F.when(detail == "same", full)}).drop("_content", "_full_at")


def _detail_of_small(states: DataFrame, limit: int | None) -> DataFrame:
    """``limit`` is None where no target has so many states."""
    target, content = W.partitionBy("target_id"), W.partitionBy("target_id", "_content")
    df = states.withColumn("position", F.row_number().over(target.orderBy("depth", "state_id")).cast("long"))
    # states without an id or a depth are counted and not shown
    df = df.filter("target_id is not null and depth is not null and state_id is not null").withColumn("_content", _content())
    df = df.withColumns({
        "_first": F.min(F.struct("position", "is_leaf")).over(content), "_leaf": F.min(F.when(F.col("is_leaf"), F.col("position"))).over(content)})
    inner = (F.col("position") == F.col("_first.position")) & ~F.col("_first.is_leaf")
    if limit is None:
        chosen = ~F.col("_first.is_leaf")
    else:
        before = target.orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
        df = df.withColumn("_r", F.when(inner, F.count(F.when(inner, 1)).over(before)))
        chosen = F.min("_r").over(content) <= limit
    df = df.withColumn("_full_at", F.when(F.col("_first.is_leaf") | chosen, F.col("_first.position")).otherwise(F.col("_leaf")))
    return _detailed(df.select(*states.columns, "position", "_content", "_full_at"))


def _detail_of_large(states: DataFrame, limit: int) -> DataFrame:
    prefix = [F.col("depth"), F.substring("state_id", 1, 3)]
    df = with_position(states, "target_id", ["depth", "state_id"], prefix).withColumn("_content", _content())
    content = df.groupBy("target_id", "_content").agg(
        F.min(F.struct("position", "is_leaf")).alias("first"), F.min(F.when(F.col("is_leaf"), F.col("position"))).alias("leaf")
    )
    inner = content.filter(~F.col("first.is_leaf")).select("target_id", "_content", F.col("first.position").alias("position"))
    order = W.partitionBy("target_id").orderBy("position")
    chosen = inner.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).select(
        "target_id", "_content", F.lit(True).alias("_chosen")
    )
    content = content.join(chosen, ["target_id", "_content"], "left")
    full_at = F.when(F.col("first.is_leaf") | F.col("_chosen"), F.col("first.position")).otherwise(F.col("leaf"))
    return _detailed(df.join(content.select("target_id", "_content", full_at.alias("_full_at")), ["target_id", "_content"]))


def _text_lines(text: Column, limit: int) -> Column:
    """Non-empty lines, each at most 200 characters, until ``limit`` characters are used."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    size = lambda x: F.least(F.length(x), F.lit(DIGEST_LINE_CHARS))
    start = F.struct(F.lit(0).alias("u"), F.array().cast("array<struct<x:string,u:int>>").alias("rows"))
    # lines before the limit only, so the list that grows stays short however long the text is
    shown = F.aggregate(lines, start, lambda acc, x: F.struct(
        (acc["u"] + size(x)).alias("u"),
        F.when(acc["u"] < limit, F.concat(acc["rows"], F.array(F.struct(x.alias("x"), acc["u"].alias("u"))))).otherwise(acc["rows"]).alias("rows"),
    ))["rows"]
    cut = F.transform(shown, lambda r: F.concat(F.lit("    "), F.substring(r["x"], F.lit(1), F.least(F.lit(DIGEST_LINE_CHARS), F.lit(limit) - r["u"]))))
    # a text of one line, which visible text always is, needs no loop over its lines
    line = F.trim(text)
    single = F.when(line != "", F.array(F.concat(F.lit("    "), F.substring(line, 1, min(DIGEST_LINE_CHARS, limit))))).otherwise(F.array().cast("array<string>"))
    cut = F.when(F.instr(text, "\n") == 0, single).otherwise(cut)
    more = F.array(F.format_string("    …[%d more characters]", F.length(text) - limit))
    return F.when(F.length(text) > limit, F.concat(cut, more)).otherwise(cut)


def ranked_fields(fields: DataFrame) -> DataFrame:
    """Report lines of the first fields of each state, one row each, with their ``_rank`` in the order of their numbers."""
    keys, text = ["target_id", "state_id"], lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    label = shortened(F.col("nearby_label_text"), DIGEST_LABEL_CHARS)
    line = text("    ", F.col("tag"), "[type=", F.col("type"), "]  name_or_id=", F.col("name_or_id"))
    line = F.concat(line, F.when(label != "", text('  → "', label, '"')).otherwise(""))
    lines = fields.select(*keys, "ord", line.alias("l"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("ord", "l"))
    return lines.withColumn("_rank", rank).filter(F.col("_rank") <= DIGEST_FIELDS).drop("ord")


def first_fields(fields: DataFrame) -> DataFrame:
    """``_fields``: report lines of the first fields of each state, in the order of their numbers."""
    first = ranked_fields(fields).groupBy("target_id", "state_id")
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "l"))), lambda x: x["l"]).alias("_fields"))


def case_digest(bundle: DataFrame, states: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """A text report per target as numbered lines: ``(target_id, section, position, line_no, line)``.

    Lines stay rows, so a case with many states is never built in one task; sort by the number columns to read. A state
    meets its fields row by row: the first brings all lines of the state, the others bring their own.
    """
    none = F.array().cast("array<string>")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    entries = lambda column: F.transform(
        F.sort_array(F.map_entries(column)), lambda kv: text("  ", kv["key"], ": ", kv["value"])
    )
    present = lambda value, *parts: F.when(value.isNotNull(), F.array(text(*parts))).otherwise(none)
    url = F.col("canonical_url")
    head = F.concat(
        F.array(F.lit("=== EXPLORATION SUMMARY ==="), text("Input URL: ", shortened(F.col("input_url"), DIGEST_URL_CHARS))),
        present(url, "Canonical URL: ", shortened(F.coalesce(url, F.lit("")), DIGEST_URL_CHARS)),
        F.array(
            text("States visited: ", F.col("num_states")), text("Transitions recorded: ", F.col("num_transitions")),
            text("Max depth reached: ", F.col("max_depth_reached")),
            text("Lexical risk score (L1): ", F.col("lexical_risk_score")),
            text("Passive risk score (L2): ", F.col("passive_risk_score")),
            F.lit("=== TRANSITION TYPES ==="),
        ),
        entries("transition_kinds"),
        F.array(F.lit("=== FLAGS (from Evidence) ==="), *(text(f"  {flag}: ", F.col(flag)) for flag in sorted(FLAGS))),
        F.array(F.lit("=== EVIDENCE COUNTS ===")), entries("evidence_counts"),
        F.array(F.lit("=== STATE DETAILS (every explored state) ===")),
    )
    summary = bundle.select("target_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("position"), head.alias("lines"))

    df = with_detail_level(states)
    if fields is None:
        df = df.withColumns({"_rank": F.lit(None).cast("int"), "l": F.lit(None).cast("string"), "_n_fields": F.lit(0).cast("long")})
    else:
        keys = ["target_id", "state_id"]
        counts = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_fields"))
        df = df.join(counts.join(ranked_fields(fields), keys, "left"), keys, "left").withColumn("_n_fields", F.coalesce("_n_fields", F.lit(0)))
    end = F.when(F.col("is_leaf"), "leaf, no further action").otherwise("continued")
    number, n_fields = F.col("position"), F.col("_n_fields")
    where = [
        text("  Depth: ", F.col("depth"), " (", end, ")"), text("  URL: ", shortened(F.col("url"), DIGEST_URL_CHARS)),
    ]
    named = F.when(F.col("title") != "", F.array(text("  Title: ", F.col("title")))).otherwise(none)
    more = F.when(n_fields > DIGEST_FIELDS, F.array(text("    …and ", n_fields - DIGEST_FIELDS, " more fields"))).otherwise(none)
    form = F.when(n_fields == 0, F.array(F.lit("  Form fields: none"))).otherwise(F.array(text("  Form fields detected (", n_fields, "):")))
    rank = F.col("_rank")
    first = F.when(rank.isNotNull(), F.array(F.col("l"))).otherwise(none)
    seen = lambda column, name, limit: F.when(
        F.col(column) != "", F.concat(F.array(F.lit(name)), _text_lines(F.col(column), limit))
    ).otherwise(none)
    full = F.concat(
        F.array(text("--- State #", number, " ---"), *where), named, form, first, more,
        seen("visible_text", "  Visible text (truncated):", DIGEST_TEXT_CHARS),
        seen("ocr_text", "  Text read from the screenshot:", DIGEST_OCR_CHARS),
    )
    same = F.array(text("--- State #", number, " (same content as State #", F.col("same_as"), ") ---"), *where)
    brief = F.array(
        text("--- State #", number, " (summary) ---"), *where, text("  Form fields: ", n_fields),
        text("  Visible text: ", F.length("visible_text"), " characters"),
    )
    lines = F.when(F.col("detail") == "full", full).when(F.col("detail") == "same", same).otherwise(brief)
    lines = F.when(rank.isNull() | (rank == 1), lines).when(F.col("detail") == "full", F.array(F.col("l"))).otherwise(none)
    # the lines of a state before its first field, and the number of fields shown: lines after them move by the others
    before = (F.lit(4) + F.when(F.col("title") != "", 1).otherwise(0)).alias("_before")
    shown = F.least(n_fields, F.lit(DIGEST_FIELDS)).cast("int").alias("_shown")
    body = df.select("target_id", F.lit(1).alias("section"), "position", rank, before, shown, lines.alias("lines")).select(
        "target_id", "section", "position", "_rank", "_before", "_shown", F.posexplode_outer("lines").alias("line_no", "line")).filter("line_no is not null")
    line_no = F.when(F.col("_rank") > 1, F.col("_before") + F.col("_rank") - 1).when(
        F.col("_rank").isNotNull() & (F.col("line_no") > F.col("_before")), F.col("line_no") + F.col("_shown") - 1).otherwise(F.col("line_no"))
    # the outer form: the other one has Spark ask first whether there are lines, which makes them all twice
    head = summary.select("target_id", "section", "position", F.posexplode_outer("lines").alias("line_no", "line"))
    return head.unionByName(body.select("target_id", "section", "position", line_no.alias("line_no"), "line"))
