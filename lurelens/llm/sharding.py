"""Proportional stratified interleaving: shards that all have the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import kept_columns, named

_OWN = ("shard", "slot")


def interleaved_shards(
    docs: DataFrame, shards: int = 16, seed: int = 0, key: str = "doc_id", stratum: str = "source",
) -> DataFrame:
    """Deal rows to ``shards`` so that row counts differ by one at most and every stratum is spread evenly.

    Rows are shuffled by a seeded hash of ``key`` within their stratum and ranked; row ``r`` of ``n`` gets the fraction
    ``(2 r - 1) / 2 n``. All rows in the order of their fractions are cut into ``shards`` equal runs; ``slot`` counts
    from 0 within a run.

    Ranks are counted per bucket of the hash (then of the fraction), plus the counts of the buckets before, so no task
    sees a whole stratum: there are about as many buckets as the square root of the rows, each with about as many rows.

    Defined results: a null stratum is a stratum of its own; rows with a null key or equal keys are ordered by a hash
    of the whole row, so only rows alike in every column can change places. Texts are never looked at beyond that hash.
    An empty table gives an empty result. Columns of the input named like ``shard`` or ``slot`` are replaced.
    """
    rows = docs.count()
    buckets = max(1, round(rows ** 0.5))
    columns = kept_columns(docs, _OWN)
    hashed = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    shuffled = docs.select(
        F.struct(*[named(c).alias(c) for c in columns]).alias("row"),
        F.when(named(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), named(stratum).cast("string"))).alias("stratum"),
        F.xxhash64(F.lit(seed), named(key)).alias("h"),
        F.xxhash64(*[named(c) for c in hashed]).alias("tie"),
    ).withColumn("bucket", F.pmod("h", F.lit(buckets)))

    sizes = shuffled.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("total"),
    )

    def ranked(frame: DataFrame, order: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order)) + F.col("before")
        twice = F.lit(2) * rank - 1
        return frame.join(sizes, ["stratum", "bucket"]).select(
            *[c for c in frame.columns if c != "bucket"], twice.alias("odd"), "total",
        ).withColumn("part", _div(F.col("odd") * buckets, 2 * F.col("total")))

    # how many rows each part of the fractions has does not depend on ties, so texts stay out of this count
    parts = ranked(shuffled.select("stratum", "bucket", "h"), ["h"]).groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    order = Window.partitionBy("part").orderBy(F.col("odd") / F.col("total"), "stratum", "h", "tie")
    placed = ranked(shuffled, ["h", "tie"]).join(parts, "part").withColumn(
        "position", F.row_number().over(order) - 1 + F.col("before"))
    shard = _div(F.col("position") * shards, F.lit(max(1, rows)))
    first = _div(F.col("shard") * F.lit(rows) + (shards - 1), F.lit(shards))
    return placed.withColumn("shard", shard).select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"),
    )


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs that stays exact."""
    return F.call_function("div", a.cast("long"), b.cast("long"))
