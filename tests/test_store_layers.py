"""A change of the graph store costs its own size; layers are read as one."""

import json
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lurelens.schemas import TABLES
from lurelens.sources import graph_store
from lurelens.sources.graph_store import GraphStore


def graphs(spark, found):
    """Graphs of ``(target_id, status)``: the target and two states, named after the status."""
    none, moment = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame(found, "target_id string, status string")
    made = {
        "targets": df.withColumns({"input_url": F.lit("u"), "canonical_url": F.lit("u"), "url_hash": F.lit("h"), "final_url": none, "root_state_id": none, "created_at": moment}),
        "states": df.withColumns({"state_id": F.explode(F.array(F.concat("target_id", "status"), F.concat("target_id", F.lit("2")))), "url": F.lit("u"), "dom_hash": F.col("status"),
                                  "depth": F.lit(0), "screenshot_ref": none, "har_ref": none}),
    }
    return {name: rows.select(TABLES[name].names) for name, rows in made.items()}


def content(store, version=None):
    tables = store.tables(version)
    states = tables["states"].groupBy("target_id").agg(F.count("*").alias("n"), F.min("dom_hash").alias("low"), F.max("dom_hash").alias("high")).collect()
    found = {r.target_id: r.status for r in tables["targets"].collect()}
    assert tables["targets"].count() == len(found)
    assert {r.target_id: (r.n, r.low, r.high) for r in states} == {target: (2, status, status) for target, status in found.items()}
    return found


def test_a_save_writes_what_comes_in(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), buckets=2)
    store.save(graphs(spark, [(f"t{i}", "done") for i in range(300)]))
    store.save(graphs(spark, [("t7", "error")]))
    store.delete(spark.createDataFrame([("t8",)], "target_id string"))
    written = [row["n"] for row in spark.read.option("recursiveFileLookup", "true").schema("target_id string").parquet(f"{tmp_path}/store/data").groupBy(
        F.regexp_extract("_metadata.file_path", "/data/(0000000.)", 1).alias("version")).agg(F.count("*").alias("n")).orderBy("version").collect()]
    assert written == [900, 3, 1]
    assert content(store) == {f"t{i}": "error" if i == 7 else "done" for i in range(300) if i != 8}


@pytest.mark.parametrize("few", [graph_store.FEW, 0])
def test_layers_are_read_as_one(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(graph_store, "FEW", few)
    store, known, rnd, versions = GraphStore(spark, str(tmp_path / "store"), buckets=2, layers=3), {}, random.Random(3), {}
    for step in range(9):
        ids = rnd.sample([f"t{i}" for i in range(12)], rnd.choice((1, 4, 12)))
        if step % 3 == 2:
            gone = store.delete(spark.createDataFrame([(i,) for i in (*ids, "none")], "target_id string"))
            assert {r[0] for r in gone.deleted.collect()} == known.keys() & ids and "none" in {r[0] for r in gone.not_found.collect()}
            known = {k: v for k, v in known.items() if k not in ids}
        else:
            store.save(graphs(spark, [(i, f"s{step}") for i in ids]))
            known |= dict.fromkeys(ids, f"s{step}")
        assert content(store) == known
        versions[store.version()] = dict(known)
    last = store._written(store.version())
    assert max(len(set(last["targets"].get(b, []) + last[graph_store.REMOVED].get(b, []))) for b in ("0", "1")) <= 3
    # older versions stay as they were
    middle = max(versions) // 2
    assert content(store, middle) == versions[middle]


def test_versions_from_before_there_were_layers(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), buckets=2)
    store.save(graphs(spark, [(f"t{i}", "done") for i in range(20)]))
    [write], name = Path(f"{tmp_path}/store/data").iterdir(), "f" * 32
    shutil.copytree(write, write.parent / name)
    file = Path(f"{tmp_path}/store/versions/00000001.json")
    written = {table: {bucket: name for bucket in found} for table, found in json.loads(file.read_text()).items() if table in TABLES}
    file.write_text(json.dumps(written))
    for crc in file.parent.glob(".*.crc"):
        crc.write_bytes(b"")
    spark.catalog.clearCache()
    store = GraphStore(spark, str(tmp_path / "store"), buckets=2)
    assert content(store) == {f"t{i}": "done" for i in range(20)}
    store.save(graphs(spark, [("t3", "error")]))
    store.delete(spark.createDataFrame([("t4",)], "target_id string"))
    assert content(store) == {f"t{i}": "error" if i == 3 else "done" for i in range(20) if i != 4}


def test_derived_columns_are_worked_out_by_the_store(spark, tmp_path):
    store, given = GraphStore(spark, str(tmp_path / "store"), buckets=2), graphs(spark, [("a", "done"), ("b", "done")])
    store.save({"targets": given["targets"], "states": given["states"].drop("url")}, {"states": {"url": F.concat(F.lit("u-"), "state_id")}})
    assert {(r.state_id, r.url) for r in store.tables()["states"].collect()} == {(s, f"u-{s}") for s in ("adone", "a2", "bdone", "b2")}
