"""Row numbers for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_position(df: DataFrame, key: str, order: list[str], buckets: list[Column], out: str = "position") -> DataFrame:
    """Number rows within ``key`` by ``order``, splitting a hot key over many tasks.

    ``buckets`` must grow with ``order`` (for example a leading column and a prefix of the next one). Rows are
    numbered inside each bucket and shifted by the rows in earlier buckets; only bucket counts meet in one task.
    """
    names = [f"_bucket{i}" for i in range(len(buckets))]
    df = df.withColumns(dict(zip(names, buckets)))
    counts = df.groupBy(key, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(key, *names).orderBy(*order))
    numbered = df.withColumn("_inside", inside).join(offsets, [key, *names])
    return numbered.withColumn(out, (F.col("_inside") + F.col("_before")).cast("long")).drop(*names, "_inside", "_before")
