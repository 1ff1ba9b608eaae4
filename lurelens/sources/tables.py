"""Scans of the stored tables, page snapshots, logs and artefact listings; replace, delete and export."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.schemas import TABLES

CHILDREN = ("states", "transitions", "evidence", "verdicts")

# The fields read from a HAR 1.2 log.
HAR_SCHEMA = """struct<log: struct<entries: array<struct<
    startedDateTime: string, time: double,
    request: struct<method: string, url: string, headers: array<struct<name: string, value: string>>>,
    response: struct<status: int, statusText: string, headers: array<struct<name: string, value: string>>>>>>>"""


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five analysis tables as Parquet scans with their fixed schemas (no inference pass)."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Write tables clustered by target so that lookups by id skip row groups."""
    for name, df in tables.items():
        df.sortWithinPartitions("target_id").write.mode(mode).parquet(f"{folder}/{name}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots ``(page_id, url, html)`` from Parquet."""
    return spark.read.schema("page_id bigint, url string, html string").parquet(path)


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots saved one file per state: ``<target_id>/<state_id>/dom.html``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "dom.html").load(folder)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -3).alias("target_id"),
        F.element_at(parts, -2).alias("state_id"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
    )


def list_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``(target_id, path, name, size)`` of every stored file; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.substring_index("path", folder.split("://")[-1].rstrip("/") + "/", -1)
    return files.select(
        F.substring_index(path, "/", 1).alias("target_id"),
        path.alias("path"),
        F.substring_index(path, "/", -1).alias("name"),
        F.col("length").alias("size"),
    ).orderBy("path")


def har_requests(df: DataFrame, har: str = "har", id_column: str = "state_id") -> DataFrame:
    """One row per request of a HAR document column; an unreadable document gives no rows."""
    parsed = df.select(id_column, F.from_json(har, HAR_SCHEMA).alias("h"))
    rows = parsed.select(id_column, F.posexplode("h.log.entries").alias("ord", "e"))
    return rows.select(
        id_column, "ord", F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"),
        F.coalesce("e.response.status", F.lit(0)).alias("status"),
        F.coalesce("e.time", F.lit(-1.0)).alias("time_ms"), F.col("e.startedDateTime").alias("started"),
        F.size(F.coalesce("e.request.headers", F.array())).alias("request_headers"),
        F.size(F.coalesce("e.response.headers", F.array())).alias("response_headers"),
    )


def upsert_targets(existing: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace the whole graph of every incoming target: old parent and children go, new ones come.

    Within ``incoming`` the tables hold one version per id. Saving the same run twice changes nothing.
    """
    replaced = incoming["targets"].select("target_id").distinct()
    return {
        name: existing[name].join(replaced, "target_id", "left_anti").unionByName(incoming[name])
        for name in existing
    }


class Deletion(NamedTuple):
    tables: dict[str, DataFrame]
    deleted: DataFrame
    not_found: DataFrame


def delete_targets(tables: dict[str, DataFrame], ids: DataFrame) -> Deletion:
    """Delete targets with their children; ids that do not exist come back in ``not_found``."""
    wanted = ids.select("target_id").distinct()
    deleted = wanted.join(tables["targets"], "target_id", "left_semi")
    not_found = wanted.join(tables["targets"], "target_id", "left_anti")
    kept = {name: df.join(wanted, "target_id", "left_anti") for name, df in tables.items()}
    return Deletion(kept, deleted, not_found)


# Order of the children of an exported graph.
_CHILD_ORDER = {
    "targets": ("target_id",), "states": ("depth", "state_id"), "transitions": ("ts", "transition_id"),
    "evidence": ("ts", "evidence_id"), "verdicts": ("target_id",),
}


def graph_rows(
    tables: dict[str, DataFrame], ids: DataFrame | None = None, columns: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Full graphs in long form: ``(target_id, section, sort_key, body)``, one JSON body per stored row, with the ``columns``
    named for its table or all of them.

    Every table is reduced to the wanted ids by a semi join. A graph stays a run of rows instead of one
    nested value, so a target that owns a third of all rows is split over many tasks.
    """
    wanted = None if ids is None else ids.select("target_id").distinct()
    parts = []
    for section, (name, order) in enumerate(_CHILD_ORDER.items()):
        if name not in tables:
            continue
        df = tables[name] if wanted is None else tables[name].join(wanted, "target_id", "left_semi")
        parts.append(df.select(
            "target_id", F.lit(section).alias("section"), F.lit(name).alias("part"),
            F.concat_ws("|", *(_sortable(df, c) for c in order)).alias("sort_key"),
            F.to_json(F.struct(*(columns or {}).get(name, df.columns)), {"ignoreNullFields": "false"}).alias("body"),
        ))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _sortable(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind in ("int", "bigint", "smallint"):
        return F.lpad(F.col(column).cast("string"), 19, "0")
    return F.col(column).cast("string")


def export_graphs(rows: DataFrame, path: str) -> None:
    """Write graphs as JSON lines, range-partitioned so that each file holds a sorted run of whole rows."""
    order = ["target_id", "section", "sort_key"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)
