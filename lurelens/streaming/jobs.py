"""Structured Streaming jobs. Each takes a streaming DataFrame and returns one, ready for a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lurelens.operators.history import CACHE_HOURS, latest_per_url
from lurelens.operators.intake import with_intake
from lurelens.operators.overrides import apply_overrides

def read_submissions(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """Submissions arriving as Parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def stream_intake(submissions: DataFrame, url_column: str = "input_url") -> DataFrame:
    """The batch intake, unchanged: it is stateless, so batch and stream give the same rows."""
    return with_intake(submissions, url_column)


def suppress_repeats(urls: DataFrame, time_column: str = "submitted_at", hours: int = CACHE_HOURS) -> DataFrame:
    """Drop a URL seen within the last ``hours``. State expires with the watermark; late rows are dropped."""
    return urls.withWatermark(time_column, f"{hours} hours").dropDuplicatesWithinWatermark(["url_hash"])


def latest_status(updates: DataFrame, id_column: str = "target_id", time_column: str = "ts") -> DataFrame:
    """The current status of every target; use update mode."""
    return updates.groupBy(id_column).agg(
        F.max_by("status", F.struct(time_column, "status")).alias("status"), F.max(time_column).alias("changed_at")
    )


def match_overrides(urls: DataFrame, override_urls: DataFrame, override_domains: DataFrame) -> DataFrame:
    """Look up a stream of URLs in the static override lists."""
    return apply_overrides(urls, override_urls, override_domains)


def answer_from_history(requests: DataFrame, targets: DataFrame, verdicts: DataFrame, hours: int = CACHE_HOURS) -> DataFrame:
    """Add ``cached_target`` and ``classification`` to a stream of requests from the stored runs.

    ``requests``: ``url_hash, requested_at``. The newest run of the URL answers if it is done, has a verdict and
    was younger than ``hours`` when the request came. The stored side is read again for every batch, so a
    verdict is used as soon as it is stored and nothing is kept in stream state.
    """
    newest = latest_per_url(targets).filter("status = 'done'").select("url_hash", "target_id", "created_at")
    runs = newest.join(verdicts.select("target_id", "classification"), "target_id")
    seconds = (F.unix_micros("requested_at") - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(1e6)
    fresh = F.col("created_at").isNotNull() & (seconds < hours * 3600)
    return requests.join(runs, "url_hash", "left").select(
        *requests.columns, F.when(fresh, F.col("target_id")).alias("cached_target"),
        F.when(fresh, F.col("classification")).alias("classification"),
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived and stop; the sink is a Parquet folder."""
    query: StreamingQuery = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def run_available_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Update-mode results into a Parquet folder of versions; read with ``newest_version``."""
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def newest_version(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key written by ``run_available_updates``."""
    rest = [c for c in written.columns if c not in (*keys, "batch", "batch_id")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v")).select(*keys, "v.*")
