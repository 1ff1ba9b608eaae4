"""As-of joins: for every row the version of another table that was the newest at the row's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.operators.history import CACHE_HOURS

BUCKET_SECONDS = 3600


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def as_of_join(
    rows: DataFrame, versions: DataFrame, key: str, at: str, version_at: str, tie: str,
    bucket_seconds: int = BUCKET_SECONDS, out: str = "version",
) -> DataFrame:
    """Add ``out`` to ``rows``: a struct of the columns of the newest version of the key that is not younger than the row.

    Of versions of one moment the one with the smaller ``tie`` is the newest; a version of the row's own moment counts.
    Rows without key or time, and rows before the first version, get null; versions without key or time are none.

    Both sides are one union that is cut into buckets of time. A running minimum gives the newest version within a
    bucket; what earlier buckets hand on is one row per key and bucket. A key with very many rows is thus spread over its
    buckets instead of being one window.
    """
    width = bucket_seconds * 1_000_000
    version = F.struct((-F.col("_at")).alias("before"), F.col(tie).alias("tie"), F.struct(*versions.columns).alias("row"))
    told = versions.where(F.col(key).isNotNull() & F.col(version_at).isNotNull()).withColumn("_at", _micros(version_at)).select(
        F.col(key).alias("_key"), "_at", F.lit(0).alias("_asks"), version.alias("_version"))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    asked = rows.where(known).select(F.col(key).alias("_key"), _micros(at).alias("_at"), F.lit(1).alias("_asks"), F.struct(*rows.columns).alias("_row"))
    both = told.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", F.col("_at") - F.pmod("_at", F.lit(width)))
    newest = both.groupBy("_key", "_bucket").agg(F.min("_version").alias("_version"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select("_key", "_bucket", F.min("_version").over(earlier).alias("_carried"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_inside", F.min("_version").over(inside)).where("_asks = 1").join(carried, ["_key", "_bucket"], "left")
    joined = found.select("_row.*", F.coalesce("_inside.row", "_carried.row").alias(out))
    return joined.unionByName(rows.where(~known), allowMissingColumns=True)


def runs_at_request(
    requests: DataFrame, targets: DataFrame, verdicts: DataFrame, hours: int = CACHE_HOURS, time_column: str = "requested_at",
) -> DataFrame:
    """Requests (``url_hash`` and a time) with the run that was the newest when they came: ``run_target, run_status`` and, if
    it was done, had a verdict and was younger than ``hours``, ``cached_target, classification``.

    Verdicts are joined to runs first, one row each, so requests meet them once.
    """
    runs = targets.select("url_hash", "target_id", "status", "created_at").join(verdicts.select("target_id", "classification"), "target_id", "left")
    found = as_of_join(requests, runs, "url_hash", time_column, "created_at", "target_id")
    seconds = (_micros(time_column) - F.unix_micros(F.col("version.created_at").cast("timestamp"))) / F.lit(1e6)
    usable = (F.col("version.status") == "done") & F.col("version.classification").isNotNull() & (seconds < hours * 3600)
    return found.select(
        *requests.columns, F.col("version.target_id").alias("run_target"), F.col("version.status").alias("run_status"),
        F.when(usable, F.col("version.target_id")).alias("cached_target"), F.when(usable, F.col("version.classification")).alias("classification"))
