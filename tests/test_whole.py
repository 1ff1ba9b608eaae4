"""Whole analyses and stored tables end to end."""

import json

from pyspark.sql import functions as F

from lurelens import schemas
from lurelens.operators import graph, intake
from lurelens.plans.analysis import Collected, analyse, annotate
from lurelens.sources import tables
from lurelens.sources.brands import brands
from lurelens.sources.suffixes import suffix_rules


def _at(text):
    return F.lit(text).cast("timestamp")


def test_whole_analysis(spark):
    submissions = spark.createDataFrame([
        ("a", "hxxps://paypla[.]com/login"), ("b", "https://example.com/"), ("c", "http://bad:port/"), ("d", "https://trusted.example.org/x"),
        ("e", "https://listed.example.net/p"),
    ], "target_id string, input_url string")
    states = spark.createDataFrame([("a", "a1", "u", "h", 0), ("b", "b1", "u", "h", 0), ("e", "e1", "u", "h", 0)],
                                   "target_id string, state_id string, url string, dom_hash string, depth int")
    transitions = spark.createDataFrame([], "target_id string, transition_id string, from_state string, to_state string, kind string")
    pages = spark.createDataFrame([("a", "a1", "<title>T</title><p>Hello</p>")], "target_id string, state_id string, html string")
    attributes = spark.createDataFrame([("listed.example.net", "hostname", "7", True, ["phishing-name:Acme"])],
                                       "value string, type string, event_id string, to_ids boolean, tags array<string>")
    dns = spark.createDataFrame([("paypla.com", ["1.2.3.4"], [], None)], "host string, a_records array<string>, aaaa_records array<string>, error string")
    registrations = spark.createDataFrame([("paypla.com", "2024-01-20", "R", ["ns"], None)],
                                          "domain string, registered_at string, registrar string, nameservers array<string>, error string")
    registrations = registrations.withColumn("registered_at", F.col("registered_at").cast("timestamp"))
    urls = spark.createDataFrame([("https://trusted.example.org/x", "whitelist", "ours")], "url_key string, list_type string, note string")
    listed = spark.createDataFrame([], "domain_key string, list_type string, note string")
    hops = spark.createDataFrame([("d", 1, "https://trusted.example.org/x", 302, "/y", None, None), ("b", 1, "https://example.com/", 200, None, None, None)],
                                 "target_id string, hop int, url string, status_code int, location string, server string, error string")
    observables = spark.createDataFrame([("o", "example.com", "Hostname", ["x"], [], None)],
                                        "observable_id string, value string, type string, labels array<string>, markings array<string>, creator string")
    indicators = spark.createDataFrame([("o", "i", False, None, 80.0, [], [], None)],
                                       "observable_id string, indicator_id string, revoked boolean, valid_until string, score double, labels array<string>, markings array<string>, creator string")
    failures = spark.createDataFrame([("b", "jarm", "timeout"), ("d", "jarm", "timeout")], "target_id string, probe string, error string")
    rejects = spark.createDataFrame([("b", "rdap: unreadable answer"), ("d", "x")], "target_id string, reason string")
    done = analyse(
        submissions, states, transitions, pages, None, brands(spark), suffix_rules(spark),
        Collected(dns=dns, misp=attributes, registrations=registrations, hops=hops, observables=observables, indicators=indicators,
                  probe_failures=failures, rejects=rejects), _at("2024-02-01 00:00:00"), override_urls=urls, override_domains=listed,
    )
    keys = {(r.target_id, r.key) for r in done.evidence.collect()}
    assert {("a", "typosquat"), ("a", "dns_a_records"), ("a", "domain_age_days"), ("e", "reputation_hit"), ("c", "pipeline_error")} <= keys
    assert not any(target == "d" for target, _ in keys)
    assert {("b", "reputation_hit"), ("b", "active_probe_error"), ("b", "pipeline_error")} <= keys
    given = {r.target_id: (r.classification, r.confidence, r.brand) for r in done.verdicts.collect()}
    assert given["e"] == ("phishing", 0.95, "Acme") and given["b"][:2] == ("phishing", 0.95) and given["a"][0] == "suspicious"
    assert given["d"][:2] == ("benign", 1.0)
    answers = {r.target_id: (r.verdict, r.signature) for r in done.decisions.collect()}
    assert answers["e"] == ("malicious", "Phishing: Acme Impersonation")
    assert answers["c"] == ("safe", "Analysis-Failed")
    assert answers["d"] == ("safe", "Whitelist-Override: URL explicitly trusted")


def _stored(spark):
    row = {"target_id": "t1", "input_url": "u", "canonical_url": "u", "url_hash": "h", "final_url": None, "status": "done", "root_state_id": None}
    targets = spark.createDataFrame([row], "target_id string, input_url string, canonical_url string, url_hash string, final_url string, status string, root_state_id string")
    states = spark.createDataFrame([("s1", "t1", "u", "d", 0, None, None), ("s2", "t1", "u2", "d2", 1, None, None)],
                                   "state_id string, target_id string, url string, dom_hash string, depth int, screenshot_ref string, har_ref string")
    edges = spark.createDataFrame([("x", "t1", "s1", "s2", "click", None)], "transition_id string, target_id string, from_state string, to_state string, kind string, trigger string")
    verdict = spark.createDataFrame([("t1", "benign", 0.5, "model", None, None, None, None, None)], schemas.VERDICTS)
    crawl = spark.createDataFrame([("t1", "target", "t1", "navigation_error", "boom")], "target_id string, scope string, scope_id string, key string, message string")
    return {
        "targets": targets.withColumn("created_at", _at("2024-01-01")), "states": states, "transitions": edges.withColumn("ts", _at("2024-01-01")),
        "evidence": schemas.identified(graph.crawl_evidence(crawl), _at("2024-01-01")), "verdicts": verdict,
    }


def test_stored_tables_round_trip_and_export(spark, tmp_path):
    folder = str(tmp_path / "store")
    tables.write_tables(_stored(spark), folder)
    back = tables.read_tables(spark, folder)
    assert {name: df.count() for name, df in back.items()} == {"targets": 1, "states": 2, "transitions": 1, "evidence": 1, "verdicts": 1}
    assert schemas.outside_domain(back["transitions"], "kind", schemas.TRANSITION_KINDS).count() == 0
    tables.export_graphs(tables.graph_rows(back), str(tmp_path / "out"))
    lines = spark.read.json(str(tmp_path / "out")).orderBy("section", "sort_key").collect()
    assert [r.part for r in lines] == ["targets", "states", "states", "transitions", "evidence", "verdicts"]
    assert json.loads(lines[1].body)["state_id"] == "s1" and json.loads(lines[4].body)["value"] == "boom"


def test_saved_page_files(spark, tmp_path):
    saved = tmp_path / "t1" / "s1"
    saved.mkdir(parents=True)
    (saved / "dom.html").write_text("<title>é</title>", encoding="utf-8")
    (saved / "shot.png").write_bytes(b"123")
    page = tables.read_page_files(spark, str(tmp_path)).first()
    assert (page.target_id, page.state_id, page.html) == ("t1", "s1", "<title>é</title>")
    files = {(r.target_id, r.path, r.size) for r in tables.list_artifacts(spark, str(tmp_path)).collect()}
    assert files == {("t1", "t1/s1/dom.html", 17), ("t1", "t1/s1/shot.png", 3)}


def test_intake_is_stable(spark):
    df = spark.createDataFrame([(1, "hxxp://A.example[.]com:80/x?b=1&a=2")], "target_id long, input_url string")
    once = intake.with_intake(df).select("target_id", F.col("canonical_url").alias("input_url"), F.col("url_hash").alias("first_hash"))
    again = intake.with_intake(once).first()
    assert again.canonical_url == again.input_url and again.url_hash == again.first_hash


def test_submissions_of_one_file_are_many_tasks(spark):
    rows = [(str(i), f"https://h{i}.example.com/") for i in range(200)] + [("7", "https://again.example.com/"), (None, "https://x.example.com/")]
    urls = annotate(spark.createDataFrame(rows, "target_id string, input_url string").coalesce(1))
    sizes = urls.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 80
    assert sorted((r.target_id, r.input_url) for r in urls.where("target_id is not null").collect()) == sorted(rows[:-1])
    assert urls.where("target_id is null").count() == 1
