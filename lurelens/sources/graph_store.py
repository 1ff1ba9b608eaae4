"""Stored graphs that change as a whole: a version names the files of all tables, and is published after they are written."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lurelens.functions.joins import is_short
from lurelens.schemas import TABLES

BUCKETS = 64
#: So many layers of a bucket are read together; one more, and they are written as one.
LAYERS = 8
#: As many replaced targets travel to every task; more of them are joined by shuffles.
FEW = 50_000
#: Beside the tables: targets that a layer deletes without having new rows for them.
REMOVED = "removed"


class Conflict(RuntimeError):
    """Somebody else has published a version meanwhile; the change has to be made again on the new one."""


class Removed(NamedTuple):
    version: int
    deleted: DataFrame
    not_found: DataFrame


class GraphStore:
    """The tables of ``schemas`` under ``folder``, each in Parquet folders by a hash of ``target_id``.

    A save or delete writes a layer, into folders that no version names yet: its own rows and the targets it deletes. A
    small file then publishes it. Layers lie on each other, bucket by bucket: a row counts unless a later layer has saved
    or deleted its target. So a change costs its own size and not that of the store. A bucket with more than ``layers``
    of them is written anew as one. Readers keep the version they began with. A job that ends before that file has its
    name leaves the old version as it is, and one that somebody has overtaken fails with ``Conflict``.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schemas: dict[str, StructType] = TABLES, buckets: int = BUCKETS, layers: int = LAYERS,
    ) -> None:
        self.spark, self.folder, self.schemas, self.buckets, self.layers = spark, folder.rstrip("/"), schemas, buckets, layers
        self._bucket = F.pmod(F.xxhash64("target_id"), F.lit(buckets)).cast("int").alias("bucket")

    # --- versions: names and small files, through Spark's own file system ------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [entry.getPath().getName() for entry in files.listStatus(path)] if files.exists(path) else []

    def version(self) -> int:
        """The last published version, 0 for an empty store."""
        return max((int(name.removesuffix(".json")) for name in self._names("versions") if name.endswith(".json")), default=0)

    def _written(self, version: int) -> dict[str, dict[str, list[str]]]:
        """For each table and bucket, the writes that hold it, oldest first."""
        found = json.loads(self.spark.read.text(f"{self.folder}/versions/{version:08d}.json", wholetext=True).first()[0]) if version else {}
        # versions from before there were layers name one write
        return {name: {bucket: [w] if isinstance(w, str) else w for bucket, w in found.get(name, {}).items()} for name in (*self.schemas, REMOVED)}

    def _publish(self, version: int, written: dict[str, dict[str, list[str]]]) -> int:
        source, target = self._path(f"versions/{uuid.uuid4().hex}.tmp"), self._path(f"versions/{version:08d}.json")
        conf, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        files = source.getFileSystem(conf)
        stream = files.create(source, False)
        stream.write(bytearray(json.dumps(written).encode()))
        stream.close()
        # a rename that fails if the name is taken
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(source, target, plain)
        except Py4JJavaError as error:
            files.delete(source, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {version} is taken") from error
            raise
        return version

    # --- tables ----------------------------------------------------------------------------------------------

    def _paths(self, name: str, written: dict[str, list[str]]) -> list[str]:
        return [f"{self.folder}/data/{write}/{name}/bucket={bucket}" for bucket, writes in sorted(written.items()) for write in writes]

    def _read(self, name: str, written: dict[str, dict[str, list[str]]]) -> DataFrame:
        """The rows of a table that count."""
        schema, rows, gone = self.schemas[name], written[name], self._gone(written)
        later = {bucket: [(table, w) for table, w in gone.get(bucket, []) if _age(w) > _age(writes[0])] for bucket, writes in rows.items()}
        plain, layered = ({bucket: writes for bucket, writes in rows.items() if bool(later[bucket]) is wanted} for wanted in (False, True))
        parts = []
        if layered:
            # the layer of a row is in the name of its file
            layer = F.substring_index("_metadata.file_path", "/", -4)
            layer = F.when(F.substring(layer, 9, 1) == "-", F.substring(layer, 1, 8)).otherwise("").alias("_layer")
            found = self.spark.read.schema(schema).parquet(*self._paths(name, layered)).select(*schema.names, layer)
            since = [f"{self.folder}/data/{w}/{table}/bucket={bucket}" for bucket in sorted(layered) for table, w in later[bucket]]
            ids = self.spark.read.schema("target_id string").parquet(*since).select(F.col("target_id").alias("_gone"), layer.alias("_since"))
            ids = ids.hint("broadcast" if is_short(ids, FEW) else "merge")
            replaced = (F.col("target_id") == F.col("_gone")) & (F.col("_layer") < F.col("_since"))
            parts.append(found.join(ids, replaced, "left_anti").select(schema.names))
        if plain or not parts:
            paths = self._paths(name, plain)
            parts.append(self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _gone(self, written: dict[str, dict[str, list[str]]]) -> dict[str, list[tuple[str, str]]]:
        """For each bucket, the tables and writes that name the targets its layers have saved or deleted."""
        found: dict[str, list[tuple[str, str]]] = {}
        for table in ("targets", REMOVED):
            for bucket, writes in written[table].items():
                found.setdefault(bucket, []).extend((table, w) for w in writes)
        return found

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as one version has them, the last one by default."""
        written = self._written(self.version() if version is None else version)
        return {name: self._read(name, written) for name in self.schemas}

    def _write(self, name: str, write: str, rows: DataFrame) -> set[str]:
        """Write rows with their ``bucket`` into its folder; the buckets that have some. A task writes a file for each bucket that
        it has rows of; rows that come from joins by target are not shuffled again for larger ones."""
        rows.sortWithinPartitions("bucket", "target_id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/data/{write}/{name}")
        return {entry.removeprefix("bucket=") for entry in self._names(f"data/{write}/{name}") if entry.startswith("bucket=")}

    def _add(self, version: int, write: str, found: dict[str, set[str]]) -> int:
        """Publish a layer that has been written."""
        written = self._written(version)
        for name, buckets in found.items():
            for bucket in buckets:
                written[name].setdefault(bucket, []).append(write)
        deep = {bucket for bucket, writes in self._gone(written).items() if len({w for _, w in writes}) > self.layers}
        if deep:
            merged, old = f"{version + 1:08d}-{uuid.uuid4().hex}", {name: {b: w for b, w in writes.items() if b in deep} for name, writes in written.items()}
            for name, schema in self.schemas.items():
                filled = self._write(name, merged, self._read(name, old).select(*schema.names, self._bucket)) if old[name] else set()
                written[name] = {b: w for b, w in written[name].items() if b not in deep} | {b: [merged] for b in filled}
            written[REMOVED] = {b: w for b, w in written[REMOVED].items() if b not in deep}
        return self._publish(version + 1, written)

    def save(self, incoming: dict[str, DataFrame], derived: dict[str, dict[str, Column]] | None = None) -> int:
        """Replace the whole graph of every incoming target, in all tables at once; the new version.

        ``incoming["targets"]`` holds each target once; rows of other tables whose target is not among them are left out.
        Missing tables count as empty. Saving the same graphs again changes nothing but the version. Columns of a table that
        ``derived`` names are worked out from its others once the rows lie where they are written: a hash as an id
        would be most of what is moved to get there.
        """
        version = self.version()
        write = f"{version + 1:08d}-{uuid.uuid4().hex}"
        late = derived or {}

        def chosen(name: str) -> DataFrame:
            return incoming[name].select(*[c for c in self.schemas[name].names if c not in late.get(name, {})], self._bucket)

        def put(name: str, rows: DataFrame) -> set[str]:
            return self._write(name, write, rows.withColumns(late.get(name, {})).select(*self.schemas[name].names, "bucket"))

        found = {"targets": put("targets", chosen("targets").where("target_id is not null").hint("rebalance", "bucket"))}
        if not found["targets"]:
            return version
        # the targets as they have been written: not worked out again for each table. The join leaves rows in the order of the files
        ids = self.spark.read.schema("target_id string, bucket int").parquet(f"{self.folder}/data/{write}/targets").hint("merge")
        for name in self.schemas:
            if name != "targets" and name in incoming:
                found[name] = put(name, chosen(name).join(ids, ["bucket", "target_id"], "left_semi"))
        return self._add(version, write, found)

    def delete(self, ids: DataFrame) -> Removed:
        """Delete targets with all their rows in all tables at once; ids that the store does not have come back."""
        version = self.version()
        known = self.tables(version)["targets"].select("target_id")
        wanted = ids.select("target_id").where("target_id is not null").distinct()
        deleted, write = wanted.join(known, "target_id", "left_semi"), f"{version + 1:08d}-{uuid.uuid4().hex}"
        found = self._write(REMOVED, write, deleted.select("target_id", self._bucket))
        after = self._add(version, write, {REMOVED: found}) if found else version
        return Removed(after, deleted, wanted.join(known, "target_id", "left_anti"))


def _age(write: str) -> str:
    """The version of a write; writes from before there were layers lie below all others."""
    return write[:8] if write[8:9] == "-" else ""
