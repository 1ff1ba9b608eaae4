"""Pages, probes, graphs, verdict rules and stored history on small tables."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lurelens.functions.fingerprint import murmur3_signed
from lurelens.functions.html import canonical_markup, form_fields
from lurelens.functions.ranking import with_position
from lurelens.functions.times import utc_timestamp
from lurelens.operators import decisions, evidence, feeds, graph, history, probes, verdicts
from lurelens.session import shared_folder
from lurelens.sources import feeds as sources


def test_state_hash_classes():
    same = lambda a, b: canonical_markup(a) == canonical_markup(b)
    page = '<html><head><script nonce="{0}">var t={0};</script></head><body><div id="main" data-timestamp="17400000{0}">Hi</div></body></html>'
    assert same(page.format("11"), page.format("22"))
    assert same('<input name="csrf-token" value="abc">', '<input name="csrf-token" value="def">')
    assert same('<div class="a" id="b" data-x="1">t</div>', '<div data-x="1" id="b" class="a">t</div>')
    assert not same("<h1>Login to A</h1>", "<h1>Login to B</h1>")
    assert not same('<div id="1234567890">c</div>', '<div id="0987654321">c</div>')
    assert canonical_markup("") == ""


def test_form_field_labels():
    page = """<label for="u">User  name</label><input id="u" type="email"><label>Code <input name="c" type="text"></label>
        <span id="l">Card</span><input aria-labelledby="l" name="card"><input aria-label=" Pin " type="tel"><input placeholder="Search">
        <p>Before it</p><textarea name="t"></textarea><input type="hidden" name="h"><input type="submit">"""
    got = [(f["type"], f["name_or_id"], f["nearby_label_text"]) for f in form_fields(page)]
    assert got == [
        ("email", "u", "User name"), ("text", "c", "Code"), ("", "card", "Card"), ("tel", "", "Pin"), ("", "", "Search"),
        ("textarea", "t", "Before it"),
    ]


def test_murmur3_reference_values():
    assert [murmur3_signed(s) for s in (b"", b"hello", b"hello, world")] == [0, 613153351, 345750399]


def test_position_of_a_hot_key(spark):
    data = [("hot", i % 7, f"{(i * 37) % 1000:04d}") for i in range(900)] + [("cold", 0, "1")]
    df = spark.createDataFrame(data, "k string, depth int, id string")
    got = with_position(df, "k", ["depth", "id"], [F.col("depth"), F.substring("id", 1, 2)]).filter("k = 'hot'").collect()
    order = sorted((r.depth, r.id) for r in got)
    assert {(r.depth, r.id): r.position for r in got} == {key: i + 1 for i, key in enumerate(order)}


def _explore(root, edges, hashes, max_depth, max_nodes):
    """Queue exploration of one target, one edge at a time."""
    nodes, seen, queue = [(root, 0)], set(), [(root, 0)]
    while queue and len(nodes) < max_nodes:
        state, depth = queue.pop(0)
        if hashes[state] in seen:
            continue
        seen.add(hashes[state])
        if depth >= max_depth:
            continue
        for target in edges.get(state, []):
            if len(nodes) >= max_nodes:
                break
            nodes.append((target, depth + 1))
            if hashes[target] not in seen:
                queue.append((target, depth + 1))
    return [(s, d, i + 1) for i, (s, d) in enumerate(nodes)]


@pytest.mark.parametrize("max_depth,max_nodes", [(6, 40), (3, 12)])
def test_bounded_exploration_equals_queue(spark, max_depth, max_nodes):
    rnd = random.Random(3)
    expected, edge_rows, roots = {}, [], []
    for target in range(4):
        names = [f"t{target}s{i:02d}" for i in range(30)]
        hashes = {n: f"h{rnd.randint(0, 20)}" for n in names}
        edges = {}
        for i in range(60):
            a, b = rnd.choice(names), rnd.choice(names)
            edges.setdefault(a, []).append(b)
            edge_rows.append((target, f"e{i:03d}", a, b, hashes[b], i))
        roots.append((target, names[0], hashes[names[0]]))
        expected[target] = _explore(names[0], edges, hashes, max_depth, max_nodes)
    edges = spark.createDataFrame(edge_rows, "target_id int, transition_id string, from_state string, to_state string, dom_hash string, ts int")
    start = spark.createDataFrame(roots, "target_id int, state_id string, dom_hash string")
    got = graph.bounded_bfs(start, edges, max_depth, max_nodes).nodes.collect()
    for target in expected:
        assert sorted(((r.state_id, r.depth, r.rank) for r in got if r.target_id == target), key=lambda x: x[2]) == expected[target]


def test_detail_levels_equal_sequential_reading(spark):
    rnd = random.Random(5)
    states = [("t", f"s{i:03d}", i // 20, f"h{rnd.randint(0, 40)}", rnd.random() < 0.3) for i in range(90)]
    seen, shown, expected = {}, 0, {}
    for i, (_, sid, _, content, leaf) in enumerate(states, start=1):
        if content in seen:
            expected[sid] = ("same", seen[content])
        elif not leaf and shown >= 12:
            expected[sid] = ("summary", None)
        else:
            seen[content] = i
            shown += not leaf
            expected[sid] = ("full", None)
    df = spark.createDataFrame(states, "target_id string, state_id string, depth int, dom_hash string, is_leaf boolean")
    got = evidence.with_detail_level(df).collect()
    assert {r.state_id: (r.detail, r.same_as) for r in got} == expected


def _bundle(spark, **over):
    base = dict(
        target_id="t", input_url="http://i/", canonical_url=None, num_states=3, num_transitions=2, max_depth_reached=1, has_text=True,
        total_fields=0, transition_kinds={}, evidence_counts={}, lexical_risk_score=0.0, passive_risk_score=0.0, close_lookalike=False,
        misp_hit=None, opencti_hit=None, **{f: False for f in evidence.FLAGS},
    ) | over
    schema = """target_id string, input_url string, canonical_url string, num_states long, num_transitions long, max_depth_reached int, has_text boolean,
        total_fields long, transition_kinds map<string,long>, evidence_counts map<string,long>, lexical_risk_score double, passive_risk_score double,
        close_lookalike boolean, misp_hit string, opencti_hit string, """ + ", ".join(f"{f} boolean" for f in evidence.FLAGS)
    return spark.createDataFrame([base], schema)


_MISP = json.dumps({"match_count": 1, "matched_types": ["domain"], "tags": ["phishing-name: Poste", "tlp:red"], "event_count": 1, "to_ids_match": True})


@pytest.mark.parametrize("over,expected", [
    (dict(misp_hit=_MISP, num_states=0, has_text=False), ("phishing", 0.85, "Poste")),
    (dict(opencti_hit='{"matched_types":["Hostname"]}'), ("phishing", 0.95, None)),
    (dict(num_states=1, has_text=False), ("suspicious", 0.05, None)),
    (dict(num_states=1, has_text=False, had_tls_error=True), ("suspicious", 0.6, None)),
    (dict(num_states=1, has_text=False, passive_risk_score=0.5), None),
    (dict(num_states=1, has_text=False, close_lookalike=True), None),
    (dict(num_states=1, has_text=False, evidence_counts={"cloaking_detected": 1}), None),
    (dict(had_unhandled_error=True), ("suspicious", 0.05, None)),
    (dict(had_unhandled_error=True, had_gate=True), None),
    (dict(had_unhandled_error=True, transition_kinds={"click": 1, "new_tab": 1}), None),
    (dict(), None),
])
def test_prefilter_branches(spark, over, expected):
    v = verdicts.prefilter(_bundle(spark, **over)).first().prefilter
    assert (v and (v.classification, v.confidence, v.brand)) == expected


@pytest.mark.parametrize("over,confidence", [
    (dict(evidence_counts={"cloaking_detected": 1, "abuse_prone_infra": 2}), 0.6), (dict(evidence_counts={"abuse_prone_infra": 2}), 0.4),
    (dict(num_states=1), 0.1), (dict(total_fields=2), 0.2), (dict(), 0.15),
])
def test_heuristic_branches(spark, over, confidence):
    assert _bundle(spark, **over).select(verdicts.heuristic_verdict().alias("v")).first().v.confidence == confidence


@pytest.mark.parametrize("status,label,confidence,expected", [
    ("done", "phishing", 0.3, ("malicious", 0.8)), ("done", "suspicious", 0.6, ("malicious", 0.8)), ("done", "suspicious", 0.59, ("safe", 0.5)),
    ("done", "suspicious", 0.0, ("safe", 0.4)), ("done", "benign", 0.2, ("safe", 0.9)), ("error", "phishing", 0.9, ("safe", 0.1)),
    ("running", None, None, ("safe", 0.1)), ("done", None, None, ("safe", 0.1)),
])
def test_decision_branches(spark, status, label, confidence, expected):
    targets = spark.createDataFrame([("t", status)], "target_id string, status string")
    given = spark.createDataFrame(
        [("t", label, confidence, None, None, None)] if label else [],
        "target_id string, classification string, confidence double, brand string, kit_family string, rationale string",
    )
    facts = decisions.signature_facts(spark.createDataFrame([], "target_id string, key string, value string"))
    row = decisions.decide(targets, given, facts).first()
    assert (row.verdict, row.confidence) == expected


def test_cloaking_ties_and_redirect_limits(spark):
    schema = "target_id int, profile string, ord int, status_code int, final_url string, content_length int, body_sha256 string, error string"
    fetches = spark.createDataFrame([
        (1, "a", 0, 200, "u", 5, "x", None), (1, "b", 1, 403, "u", 9, "x", None),
        (2, "a", 0, 200, "u", 5, "x", None), (2, "b", 1, None, None, None, None, "timeout"),
        (3, "a", 0, 200, "u", 5, "x", None), (3, "b", 1, 200, "u", 5, "y", None), (3, "c", 2, 200, "u", 5, "y", None),
    ], schema)
    got = {r.target_id: (r.cloaking_detected, r.divergent_profiles, r.probe_profile) for r in probes.compare_profiles(fetches).collect()}
    assert got == {1: (True, ["b"], "b"), 2: (False, [], None), 3: (True, ["a"], "a")}
    hops = spark.createDataFrame(
        [(1, i, f"http://h/{i}", 302, f"/{i + 1}", None, None) for i in range(1, 13)], "target_id int, hop int, url string, status_code int, location string, server string, error string"
    )
    r = probes.redirect_summary(hops).first()
    assert (r.hop_count, r.redirect_count, r.truncated, r.final_url) == (10, 10, True, "http://h/11")


def test_newer_failed_run_hides_older_verdict(spark):
    runs = spark.createDataFrame([
        ("a", "h1", "done", "2024-01-01 00:00:00"), ("b", "h1", "error", "2024-01-01 10:00:00"), ("c", "h2", "done", "2024-01-01 10:00:00"),
    ], "target_id string, url_hash string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    given = spark.createDataFrame([("a", "benign"), ("b", "benign"), ("c", "phishing")], "target_id string, classification string")
    at = lambda text: F.lit(text).cast("timestamp")
    assert [r.target_id for r in history.cached_verdicts(runs, given, at("2024-01-01 12:00:00")).collect()] == ["c"]
    assert history.cached_verdicts(runs, given, at("2024-01-02 10:00:00")).count() == 0


def test_active_indicators(spark):
    data = [(False, None, True), (True, None, False), (False, "2099-01-01T00:00:00Z", True), (False, "2020-01-01", False), (False, "soon", False), (None, "", True)]
    df = spark.createDataFrame(data, "revoked boolean, until string, expected boolean")
    active = feeds.is_active_indicator(F.col("revoked"), F.col("until"), F.lit("2024-01-01T00:00:00Z"))
    assert all(r.expected == r.active for r in df.withColumn("active", active).collect())


def test_distinct_events_with_a_hot_value_and_overlaps(spark):
    rnd = random.Random(11)
    attributes = [("hot", f"e{i}") for i in range(300)] + [(f"v{rnd.randint(0, 15)}", f"e{rnd.randint(0, 400)}") for _ in range(200)]
    targets = [(t, v) for t in range(40) for v in {"hot"} | {f"v{rnd.randint(0, 20)}" for _ in range(3)}]
    feed = spark.createDataFrame([(v, "url", e, False, ["a"]) for v, e in attributes], "value string, type string, event_id string, to_ids boolean, tags array<string>")
    values = spark.createDataFrame(targets, "target_id int, value string")
    got = {r.target_id: (r.event_count, r.match_count) for r in feeds.misp_summary(values, feed).collect()}
    for t in range(40):
        mine = [(v, e) for v, e in attributes if (t, v) in set(targets)]
        assert got[t] == (len({e for _, e in mine}), len(mine))


def test_paths_of_any_length(spark):
    edges = [(1, i, i + 1, i, i) for i in range(200)] + [(2, 5, 6, 1, 1), (2, 6, 5, 2, 2), (2, 6, 7, 3, 3)]
    transitions = spark.createDataFrame(edges, "target_id int, from_state int, to_state int, ts int, transition_id int")
    states = spark.createDataFrame([(1, i) for i in range(201)] + [(2, 5), (2, 6), (2, 7), (3, 1)], "target_id int, state_id int")
    got = {(r.target_id, r.state_id): r.path for r in graph.root_paths(states, transitions).collect()}
    assert got == {(1, i): [str(k) for k in range(i)] for i in range(201)} | {(3, 1): []}


def test_paths_shuffle_little(spark):
    """Chains of 100 states: every round moves each path twice at most, and no round is run for nothing."""
    ids = spark.range(50 * 100).select(F.expr("id div 100").alias("target_id"), F.col("id").alias("state_id"))
    edges = ids.where("state_id % 100 > 0").select(
        "target_id", (F.col("state_id") * 7919).alias("transition_id"), (F.col("state_id") - 1).alias("from_state"),
        F.col("state_id").alias("to_state"), F.lit(0).alias("ts"))
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    size = lambda: sum(f.length() for f in (all_.apply(i) for all_ in [files.getAllFiles()] for i in range(all_.size())) if f.getName().startswith("shuffle_"))
    before = size()
    paths = graph.root_paths(ids, edges)
    moved = size() - before
    assert paths.agg(F.sum(F.size("path"))).first()[0] == 50 * 100 * 99 // 2
    assert paths.where("target_id = 3 and state_id = 302").first()["path"] == [str(301 * 7919), str(302 * 7919)]
    assert moved < 5_000_000


def test_odd_edges_have_the_paths_they_had(spark):
    """Texts as ids, states without a number, edges from nowhere and from unlisted states, a cycle with a tail."""
    columns = "target_id bigint, transition_id string, from_state bigint, to_state bigint, ts int"
    edges = spark.createDataFrame([
        (1, "a", 1, 2, 0), (1, "b", 2, None, 0), (1, None, 2, 3, 0), (1, "c", None, 4, 0), (1, "d", 4, 5, 0), (1, "e", 9, 6, 0),
        (2, "f", 1, 2, 0), (2, "g", 2, 1, 0), (2, "h", 2, 3, 0), (None, "i", 1, 2, 0)], columns)
    states = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (1, None), (None, 1)], "target_id bigint, state_id bigint")
    got = sorted(((r.target_id, r.state_id, r.path) for r in graph.root_paths(states, edges).collect()), key=repr)
    assert got == sorted([
        (1, 1, []), (1, 2, ["a"]), (1, None, ["a", "b"]), (1, 3, ["a", None]), (1, None, []), (None, 1, [])], key=repr)


def test_digest_shows_the_first_fields_whatever_their_numbers(spark):
    fields = spark.createDataFrame(
        [("t", "s", i, "input", "email", f"f{i}", "") for i in range(30, 60)],
        "target_id string, state_id string, ord int, tag string, type string, name_or_id string, nearby_label_text string")
    ranked = evidence.first_fields(fields).first()
    assert [line.split("name_or_id=")[1] for line in ranked["_fields"]] == [f"f{i}" for i in range(30, 55)]


def test_records_that_answers_repeat_count_once(spark):
    record = '{"response":{"Attribute":[{"id":"7","event_id":"1","type":"url","value":"v","to_ids":true}]}}'
    attributes = sources.parse_misp(spark.createDataFrame([(record,)] * 3 + [(record.replace('"id":"7",', ""),)], "raw string"))
    values = spark.createDataFrame([("t", "v")], "target_id string, value string")
    assert feeds.misp_summary(values, attributes).first()["match_count"] == 2
    node = '{"id":"o","entity_type":"Url","observable_value":"v","indicators":{"edges":[{"node":{"id":"i"}},{"node":{"id":"j"}}]}}'
    answer = '{"data":{"stixCyberObservables":{"edges":[{"node":%s}]}}}' % node
    summary = feeds.opencti_summary(values, *sources.parse_opencti(spark.createDataFrame([(answer,)] * 3, "raw string")), F.lit("2024-01-01"))
    row = summary.first()
    assert (row["match_count"], row["active_indicator_count"], row["total_indicator_count"]) == (1, 2, 2)


def test_heads_without_an_end(spark):
    pages = ["<html><head><title>A</title><h1>x</h1>", "<html><head><title>B</title></head><body><h1>x</h1>", "<html><head><title>A</title><form>",
             "<p>&lt;b&gt;</p>", "<p><b></p>", "<html><head><title>A</title>text"]
    got = [canonical_markup(page) for page in pages]
    assert got[0] == got[1] == "<h1>x</h1>" and len(set(got)) == 5


def test_times_of_feeds_and_of_registrations(spark):
    texts = ["2099-01-01T00:00", "2099-01-01T00:00Z", "2099-01-01T02:00+02:00", "2099-01-01 00:00:00", "2099-01-01T00:00:00"]
    row = spark.createDataFrame([texts], [f"t{i}" for i in range(5)]).select(
        *[utc_timestamp(F.col(f"t{i}")).alias(f"a{i}") for i in range(5)], *[utc_timestamp(F.col(f"t{i}"), offsets=False).alias(f"b{i}") for i in range(5)]).first()
    assert len({row[f"a{i}"] for i in range(5)}) == 1 and row["a0"] is not None
    assert [row[f"b{i}"] is not None for i in range(5)] == [False, False, False, False, True]
