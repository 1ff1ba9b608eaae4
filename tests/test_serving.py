"""As-of lookups, deep pages, cycles, committed stores, documents, checked answers and keyed stream state."""

import json

import pytest
from pyspark.sql import functions as F

from lurelens.operators.asof import as_of_join, runs_at_request
from lurelens.operators.feeds import search_values
from lurelens.operators.graph import bounded_bfs, every_path
from lurelens.operators.history import list_targets
from lurelens.operators.paging import page_at
from lurelens.schemas import TABLES
from lurelens.sources import documents, tables
from lurelens.sources.answers import check_answers, reject_evidence
from lurelens.sources.graph_store import Conflict, GraphStore
from lurelens.streaming import stateful


def times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def test_as_of_join(spark):
    rows = times(spark.createDataFrame([
        ("a", 1, "2024-01-01 10:00:00"), ("a", 2, "2024-01-03 10:00:00"), ("b", 3, "2024-01-01 00:00:00"), (None, 4, "2024-01-01 00:00:00"),
        ("a", 5, None), ("a", 6, "2023-12-01 00:00:00"), ("a", 2, "2024-01-03 10:00:00")], "url_hash string, id int, at string"), "at")
    versions = times(spark.createDataFrame([
        ("a", "t1", "2024-01-01 10:00:00"), ("a", "t0", "2024-01-01 10:00:00"), ("a", "t2", "2024-01-02 00:00:00"), ("b", "t9", "2024-01-02 00:00:00"),
        (None, "t8", "2020-01-01 00:00:00"), ("b", "t7", None)], "url_hash string, target_id string, created_at string"), "created_at")
    for seconds in (60, 3600, 10_000_000):
        found = as_of_join(rows, versions, "url_hash", "at", "created_at", "target_id", seconds).collect()
        assert sorted((r.id, r.version and r.version.target_id) for r in found) == sorted(
            [(1, "t0"), (2, "t2"), (2, "t2"), (3, None), (4, None), (5, None), (6, None)], key=lambda x: x[0])
    assert as_of_join(rows.limit(0), versions, "url_hash", "at", "created_at", "target_id").count() == 0
    assert as_of_join(rows, versions.limit(0), "url_hash", "at", "created_at", "target_id").where("version is null").count() == 7


def test_newer_failed_run_hides_an_older_one(spark):
    targets = times(spark.createDataFrame([("a", "1", "done", "2024-01-01 00:00:00"), ("a", "2", "error", "2024-01-01 02:00:00")],
                                          "url_hash string, target_id string, status string, created_at string"), "created_at")
    verdicts = spark.createDataFrame([("1", "benign")], "target_id string, classification string")
    asked = times(spark.createDataFrame([("a", 1, "2024-01-01 01:00:00"), ("a", 2, "2024-01-01 03:00:00")], "url_hash string, id int, requested_at string"), "requested_at")
    found = {r.id: (r.run_target, r.cached_target, r.classification) for r in runs_at_request(asked, targets, verdicts).collect()}
    assert found == {1: ("1", "1", "benign"), 2: ("2", None, None)}


@pytest.mark.parametrize("offset", [0, 10, 2500, 4990, 6000])
def test_deep_pages(spark, offset):
    df = spark.range(5000).select(F.col("id").cast("string").alias("target_id"), F.timestamp_seconds(F.floor(F.col("id") / 7) * 1000).alias("created_at"))
    want = [r.target_id for r in df.orderBy(F.desc("created_at"), "target_id").collect()]
    page = page_at(df, offset, 30, sorted_rows=100, pivots=15)
    assert [r.target_id for r in page.orderBy(F.desc("created_at"), "target_id").collect()] == want[offset:offset + 30]


def test_deep_pages_of_ties_and_no_times(spark):
    same = spark.range(300).select(F.lit("x").alias("target_id"), F.lit(None).cast("timestamp").alias("created_at"))
    assert page_at(same, 100, 30, sorted_rows=10).count() == 30
    assert page_at(same.limit(0), 0, 30).count() == 0
    hot = spark.range(3000).select(F.format_string("%05d", "id").alias("target_id"), F.when(F.col("id") < 1000, F.lit("2024-01-01").cast("timestamp")).otherwise(
        F.timestamp_seconds("id")).alias("created_at"))
    assert [r.target_id for r in page_at(hot, 500, 3, sorted_rows=20).orderBy("target_id").collect()] == ["00500", "00501", "00502"]


def test_deep_listing_equals_sorted_listing(spark):
    targets = spark.range(900).select(
        F.col("id").cast("string").alias("target_id"), F.lit("u").alias("input_url"), F.lit("f").alias("final_url"), F.lit("done").alias("status"),
        F.timestamp_seconds(F.col("id") % 50).alias("created_at"))
    verdicts = spark.createDataFrame([("5", "benign")], "target_id string, classification string")
    none = spark.createDataFrame([], "target_id string")
    deep, plain = (list_targets(targets, verdicts, none, none, 20, 450, deep_offset=d).collect() for d in (0, 10_000))
    assert deep == plain and len(deep) == 20


def test_every_path(spark):
    states = spark.createDataFrame([(1, i) for i in range(1, 9)] + [(2, 1), (3, 1), (3, 2)], "target_id int, state_id int")
    edges = [(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 2), (1, 4, 5), (1, 6, 7), (1, 7, 6), (1, 7, 8), (2, 1, 1), (3, 1, 2)]
    # the first edge into state 2 comes from state 4
    rows = [(t, a, b, f"{a}-{b}", 0 if (a, b) == (4, 2) else i + 1) for i, (t, a, b) in enumerate(edges)]
    df = spark.createDataFrame(rows, "target_id int, from_state int, to_state int, transition_id string, ts int")
    assert {(r.target_id, r.state_id): (r.path, r.cyclic) for r in every_path(states, df).collect()} == {
        (1, 1): ([], False), (1, 2): ([], True), (1, 3): (["2-3"], True), (1, 4): (["2-3", "3-4"], True), (1, 5): (["2-3", "3-4", "4-5"], True),
        (1, 6): ([], True), (1, 7): (["6-7"], True), (1, 8): (["6-7", "7-8"], True), (2, 1): ([], True), (3, 1): ([], False), (3, 2): (["1-2"], False)}


def test_long_cycle(spark):
    ring = spark.range(37).select(
        F.lit(1).alias("target_id"), "id", ((F.col("id") * 11 + 3) % 37).alias("from_state"), ((F.col("id") * 11 + 14) % 37).alias("to_state"),
        F.col("id").cast("string").alias("transition_id"), F.col("id").alias("ts"))
    found = every_path(ring.select("target_id", F.col("from_state").alias("state_id")), ring).collect()
    assert sorted(len(r.path) for r in found) == list(range(37)) and all(r.cyclic for r in found)
    assert [r.state_id for r in found if not r.path] == [0]


def graphs(spark, ids, status="done"):
    none, moment = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame([(i,) for i in ids], "target_id string")
    made = {
        "targets": df.withColumns({"input_url": F.lit("u"), "canonical_url": F.lit("u"), "url_hash": F.lit("h"), "final_url": none, "status": F.lit(status),
                                   "root_state_id": none, "created_at": moment}),
        "states": df.withColumns({"state_id": F.concat("target_id", F.lit(status)), "url": F.lit("u"), "dom_hash": F.lit("d"), "depth": F.lit(0),
                                  "screenshot_ref": none, "har_ref": none}),
    }
    return {name: rows.select(TABLES[name].names) for name, rows in made.items()}


def counts(store, version=None):
    return {name: df.count() for name, df in store.tables(version).items()}


def test_committed_store(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.version() == 0 and set(counts(store).values()) == {0}
    assert store.save(graphs(spark, "abcdef")) == 1
    assert counts(store) == {"targets": 6, "states": 6, "transitions": 0, "evidence": 0, "verdicts": 0}
    reader = store.tables()
    assert store.save(graphs(spark, "abx", "error")) == 2 and counts(store)["targets"] == 7
    assert {r.state_id for r in store.tables()["states"].where("target_id in ('a', 'x')").collect()} == {"aerror", "xerror"}
    # who has begun to read the old version goes on with it
    assert reader["targets"].where("status = 'error'").count() == 0 and counts(store, 1)["targets"] == 6
    gone = store.delete(spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "target_id string"))
    assert (gone.version, [r[0] for r in gone.deleted.collect()], [r[0] for r in gone.not_found.collect()]) == (3, ["a"], ["zz"])
    assert counts(store)["targets"] == 6 and counts(store)["states"] == 6
    assert store.delete(spark.createDataFrame([("zz",)], "target_id string")).version == 3

    # files that were written and never published are invisible, and the next save goes on from the last version
    with monkeypatch.context() as patch:
        def lost(*_):
            raise RuntimeError("lost")
        patch.setattr(GraphStore, "_publish", lost)
        with pytest.raises(RuntimeError):
            store.save(graphs(spark, "bcd", "queued"))
    assert store.version() == 3 and store.tables()["targets"].where("status = 'queued'").count() == 0
    # of two changes of one version the second fails
    with pytest.raises(Conflict):
        store._publish(3, {})
    assert store.save(graphs(spark, "b", "queued")) == 4


def test_documents(spark, monkeypatch):
    rows = spark.createDataFrame([
        ("a", 0, "a", '{"t":1}'), ("a", 1, "2", '{"s":2}'), ("a", 1, "1", '{"s":1}'), ("a", 3, "x", '{"e":"é"}'), ("a", 4, "a", '{"v":1}'), ("b", 1, "1", '{"s":3}'),
        ("c", 0, "c", '{"t":2}'), (None, 0, "d", '{"t":3}')], "target_id string, section int, sort_key string, body string")
    got = {r.target_id: json.loads(r.text) for r in documents.graph_documents(rows).collect()}
    assert got == {
        "a": {"target": {"t": 1}, "states": [{"s": 1}, {"s": 2}], "transitions": [], "evidence": [{"e": "é"}], "verdict": {"v": 1}},
        "b": {"target": None, "states": [{"s": 3}], "transitions": [], "evidence": [], "verdict": None},
        "c": {"target": {"t": 2}, "states": [], "transitions": [], "evidence": [], "verdict": None}}
    assert documents.graph_documents(rows.limit(0)).count() == 0


def test_long_documents_come_in_parts(spark, tmp_path):
    body = F.concat(F.lit('{"s":"'), F.repeat(F.lit("x"), 1000), F.lit('"}'))
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("target_id"), F.lit(1).alias("section"), F.format_string("%05d", "id").alias("sort_key"), body.alias("body"))
    found = documents.graph_documents(rows)
    parts = found.where("target_id = 'large'").orderBy("part").collect()
    assert [r.part for r in parts] == list(range(len(parts))) and len(parts) > 1
    assert len(json.loads("".join(r.text for r in parts))["states"]) == 2000
    documents.write_documents(found, str(tmp_path / "out"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    first, end = json.JSONDecoder().raw_decode(text)
    second, _ = json.JSONDecoder().raw_decode(text[end:].lstrip())
    assert sorted(len(d["states"]) for d in (first, second)) == [1000, 2000]


def test_checked_answers(spark):
    raw = [("1", '{"response":{"Attribute":[{"id":"1","value":"v"},{"id":"2","value":""}]}}'), ("2", "{broken"), ("3", None), ("4", "  "), ("5", '{"x":1}'), ("6", '{"response":{"Attribute":{"id":"9","value":"w"}}}')]
    checked = check_answers(spark.createDataFrame(raw, "target_id string, raw string"), "misp")
    assert {r.target_id for r in checked.answers.collect()} == {"1", "6"}
    assert {(r.target_id, r.reason) for r in checked.rejects.collect()} == {
        ("1", "attribute without value: 2"), ("2", "unreadable answer"), ("3", "empty answer"), ("4", "empty answer"), ("5", "no attributes")}
    assert checked.counts.get == {"answers": 6, "unreadable": 4, "faults": 5}
    assert {(r.key, r.value) for r in reject_evidence(checked.rejects.where("target_id = '2'")).collect()} == {("pipeline_error", "misp: unreadable answer")}


def test_long_names_in_sections(spark):
    given = {"targets": spark.createDataFrame([("a", "u", "x")], "target_id string, input_url string, other string")}
    [row] = tables.graph_rows(given, columns={"targets": ("target_id", "input_url")}).collect()
    assert json.loads(row.body) == {"target_id": "a", "input_url": "u"}


def _run(spark, folder, name, batches, schema, build):
    """Run a stream after each batch of files; the rows it has written and the state rows that are left."""
    stream = build(spark.readStream.schema(schema).parquet(f"{folder}/{name}/*"))
    left = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{name}/b{i}")
        with stateful.state_on_disk(spark):
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/out")
            query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()], left


def test_verdicts_in_state_expire(spark, tmp_path):
    run, ask = "run", "ask"
    batches = [
        [(run, "a", "t1", "done", "benign", "2024-01-01 00:00:00"), (ask, "a", "q1", None, None, "2024-01-01 01:00:00"), (ask, "a", "q0", None, None, "2023-12-31 23:00:00")],
        [(ask, "a", "q2", None, None, "2024-01-01 20:00:00"), (run, "b", "t2", "done", "phishing", "2024-01-01 20:00:00"), (run, "b", "t3", "error", None, "2024-01-01 21:00:00"),
         (ask, "b", "q3", None, None, "2024-01-01 20:30:00"), (ask, "b", "q4", None, None, "2024-01-01 22:00:00")],
        [(ask, "a", "q5", None, None, "2024-01-02 01:00:00"), (ask, "a", "q6", None, None, "2024-01-09 00:00:00")],
    ]
    schema = "kind string, url_hash string, id string, status string, classification string, ts timestamp"

    def build(stream):
        requests = stream.where("kind = 'ask'").select("url_hash", F.col("id").alias("request_id"), F.col("ts").alias("requested_at"))
        runs = stream.where("kind = 'run'").select("url_hash", F.col("id").alias("target_id"), "status", "classification", F.col("ts").alias("created_at"))
        return stateful.answer_from_state(requests, runs, shares=2)

    rows, left = _run(spark, str(tmp_path), "events", batches, schema, build)
    assert {r[1]: r[2:] for r in rows} == {
        "q0": (None, None), "q1": ("t1", "benign"), "q2": ("t1", "benign"), "q3": ("t2", "phishing"), "q4": (None, None), "q5": (None, None), "q6": (None, None)}
    assert left[0] > 0 and left[-1] == 0


def test_lifecycle_state_is_dropped(spark, tmp_path):
    batches = [
        [("a", "queued", "2024-01-01 00:00:00"), ("a", "running", "2024-01-01 00:10:00"), ("b", "running", "2024-01-01 00:00:00")],
        [("a", "done", "2024-01-01 02:00:00"), ("a", "running", "2024-01-01 01:59:00"), ("c", "error", "2024-01-01 03:00:00")],
        [("d", "done", "2024-01-09 00:00:00")],
        [("d", "done", "2024-01-19 00:00:00")],
    ]
    rows, left = _run(spark, str(tmp_path), "updates", batches, "target_id string, status string, ts timestamp", stateful.run_lifecycle)
    shown = sorted((r[0], r[1]) for r in rows)
    assert shown == [("a", "done"), ("a", "running"), ("b", "running"), ("b", "stale"), ("c", "error"), ("d", "done"), ("d", "done")]
    assert left[1] > left[2] > 0


def test_search_values_keep_their_last_characters(spark):
    urls = spark.createDataFrame([("a", " https://h1.example.com/x0 ", "h1.example.com", "2.example.com2")], "target_id string, canonical_url string, host string, registrable_domain string")
    assert [r.value for r in search_values(urls).orderBy("ord").collect()] == ["https://h1.example.com/x0", "h1.example.com", "2.example.com2"]


def test_second_trees(spark):
    roots = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "target_id int, state_id string, dom_hash string")
    seconds = spark.createDataFrame([(1, "p", "x"), (2, "q", "y"), (3, None, None)], "target_id int, state_id string, dom_hash string")
    edges = spark.createDataFrame([(2, "q", "r", "z", 1, "t")], "target_id int, from_state string, to_state string, dom_hash string, ts int, transition_id string")
    done = bounded_bfs(roots, edges, probe_roots=seconds)
    assert {(r.target_id, r.status, r.reason) for r in done.probe_status.collect()} == {
        (1, "deduped", "duplicate_dom"), (2, "explored", "divergent_profile_detected"), (3, "error", "navigation")}
    assert [tuple(r) for r in done.probe_edges.collect()] == [(2, "b", "q", "cloaking_probe")]
    assert {(r.target_id, r.state_id) for r in done.nodes.collect()} == {(1, "a"), (2, "b"), (2, "q"), (2, "r"), (3, "c")}
    few = bounded_bfs(roots, edges, max_nodes=3, probe_roots=seconds)
    assert {r.status for r in few.probe_status.collect()} == {"skipped"}
