"""Queries over stored analyses: listing, counting, history, latest run, cached verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lurelens.operators.intake import with_intake
from lurelens.operators.paging import page_at

# How long a verdict is reused, and the size of a listing page.
CACHE_HOURS = 24
PAGE_SIZE = 50
#: Pages that begin behind so many rows are found by counting instead of sorting.
DEEP_OFFSET = 10_000

SUMMARY = [
    "target_id", "input_url", "final_url", "status", "created_at", "classification", "confidence", "brand",
    "kit_family", "rationale", "num_states", "num_transitions",
]


def target_filter(status: str | None = None, classification: str | None = None, search: str | None = None) -> Column:
    """Optional filters combined; ``search`` is a case-insensitive substring where ``%`` and ``_`` are wildcards."""
    condition = F.lit(True)
    if status is not None:
        condition = condition & (F.col("status") == status)
    if classification is not None:
        condition = condition & (F.col("classification") == classification)
    if search is not None:
        pattern = "%" + search.replace("\\", "\\\\") + "%"
        found = F.col("input_url").ilike(pattern) | F.coalesce(F.col("final_url").ilike(pattern), F.lit(False))
        condition = condition & found
    return condition


def with_verdict(targets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Targets with their verdict columns, NULL where there is none."""
    wanted = [c for c in ("classification", "confidence", "brand", "kit_family", "rationale") if c in verdicts.columns]
    return targets.join(verdicts.select("target_id", *wanted), "target_id", "left")


def with_counts(targets: DataFrame, **children: DataFrame) -> DataFrame:
    """Add ``num_<name>`` for each child table, 0 where a target has no row there.

    Children are reduced to the targets at hand before they are counted.
    """
    ids = targets.select("target_id")
    for name, child in children.items():
        count = f"num_{name}"
        counted = child.join(ids, "target_id", "left_semi").groupBy("target_id").agg(F.count(F.lit(1)).alias(count))
        targets = targets.join(counted, "target_id", "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return targets


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("target_id").asc()]


def list_targets(
    targets: DataFrame, verdicts: DataFrame, states: DataFrame, transitions: DataFrame,
    limit: int = PAGE_SIZE, offset: int = 0, deep_offset: int = DEEP_OFFSET, **filters: str | None,
) -> DataFrame:
    """One page of analyses, newest first. The page is cut (top-k) before verdicts are joined and children counted; one
    that begins behind ``deep_offset`` rows is found by ``page_at``."""
    rows = _selected(targets, verdicts, filters)
    page = rows.orderBy(*newest_first()).offset(offset).limit(limit) if offset < deep_offset else page_at(rows, offset, limit)
    ids = page.select("target_id")
    counted = with_counts(with_verdict(page, verdicts.join(ids, "target_id", "left_semi")), states=states, transitions=transitions)
    return counted.select(*(c for c in SUMMARY if c in counted.columns)).orderBy(*newest_first())


def count_targets(targets: DataFrame, verdicts: DataFrame, **filters: str | None) -> DataFrame:
    """The number of analyses the same filters select."""
    return _selected(targets, verdicts, filters).agg(F.count(F.lit(1)).alias("total"))


def _selected(targets: DataFrame, verdicts: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Targets that the filters select; verdicts are read only for a filter on the classification."""
    filters = dict(filters)
    classification = filters.pop("classification", None)
    rows = targets.filter(target_filter(**filters))
    if classification is None:
        return rows
    wanted = verdicts.filter(F.col("classification") == classification).select("target_id")
    return rows.join(wanted, "target_id", "left_semi")


def status_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("status").agg(F.count(F.lit(1)).alias("targets"))


def history(targets: DataFrame, verdicts: DataFrame, states: DataFrame, transitions: DataFrame, keys: DataFrame) -> DataFrame:
    """Every analysis of the given URL hashes, newest first within a hash."""
    wanted = keys.select("url_hash").distinct()
    rows = with_verdict(targets.join(wanted, "url_hash", "left_semi"), verdicts)
    counted = with_counts(rows, states=states, transitions=transitions)
    return counted.orderBy("url_hash", *newest_first())


def history_keys(requests: DataFrame, column: str = "query") -> DataFrame:
    """``url_hash`` for each request: a 64-digit hash as it is, anything else through the intake."""
    is_hash = F.lower(F.trim(column)).rlike(r"\A[0-9a-f]{64}\z")
    annotated = with_intake(requests, column)
    return annotated.select(column, F.when(is_hash, F.lower(F.trim(column))).otherwise(F.col("url_hash")).alias("url_hash"))


def latest_per_url(targets: DataFrame) -> DataFrame:
    """The newest run of each ``url_hash``. Only the first of each task's runs of a URL are shuffled, so a URL with very
    many runs is no burden.

    Runs of the same moment are told apart by the smaller id.
    """
    order = W.partitionBy("url_hash").orderBy((-F.unix_micros(F.col("created_at").cast("timestamp"))).asc(), "target_id")
    known = targets.filter(F.col("url_hash").isNotNull())
    return known.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def cached_verdicts(targets: DataFrame, verdicts: DataFrame, as_of: Column, hours: int = CACHE_HOURS) -> DataFrame:
    """URL hashes whose newest run is done, has a verdict and is younger than ``hours``.

    The newest run is chosen before its status is looked at, so a newer failed run hides an older good one. Runs that are
    too old leave first: a URL whose newest run is among them has no younger one, and the scan skips their files.
    """
    recent = targets.filter(_since(targets, as_of.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))))
    return latest_per_url(recent).filter(F.col("status") == "done").join(verdicts, "target_id")


def _since(targets: DataFrame, moment: Column) -> Column:
    """``created_at`` after a moment, as a comparison of the stored column that a scan can use."""
    kind = dict(targets.dtypes)["created_at"]
    if kind.startswith("timestamp"):
        return F.col("created_at") > moment.cast(kind)
    return F.col("created_at").cast("timestamp") > moment.cast("timestamp")


def analysis_summary(targets: DataFrame, verdicts: DataFrame, states: DataFrame, transitions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Targets with verdict and the sizes of their states, edges and evidence."""
    return with_counts(with_verdict(targets, verdicts), states=states, transitions=transitions, evidence=evidence)
