"""Joins of feeds with targets keep both sides off the driver."""

from pyspark.sql import functions as F

from lurelens.operators import feeds

_OBSERVABLE = "observable_id string, value string, type string, labels array<string>, markings array<string>, creator string"
_INDICATOR = """observable_id string, indicator_id string, revoked boolean, valid_until string, score double, labels array<string>,
    markings array<string>, creator string"""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feed_summaries_broadcast_nothing(spark):
    values = spark.createDataFrame([(1, 0, "a.com"), (1, 1, "b.com"), (2, 0, "a.com"), (3, 0, "c.com")], "target_id int, ord int, value string")
    attributes = spark.createDataFrame(
        [("1", "a.com", "url", "e1", True, ["t"]), ("2", "b.com", "url", "e1", False, []), ("3", "b.com", "url", None, False, None)],
        "attribute_id string, value string, type string, event_id string, to_ids boolean, tags array<string>")
    observables = spark.createDataFrame([
        ("o1", "a.com", "Url", ["x", ""], ["m"], "org"), ("o2", "a.com", "Hostname", None, [None, "m"], None),
        ("o3", "b.com", "Url", [], [], ""), ("o4", "c.com", "Artifact", ["y"], [], "org"), ("o5", None, "Url", ["z"], [], "org")], _OBSERVABLE)
    indicators = spark.createDataFrame([
        ("o1", "i1", False, None, 10.0, ["w", "x"], None, "org2"), ("o1", "i2", True, None, 90.0, None, ["n"], None),
        ("o2", "i3", None, "2099-01-01T00:00:00Z", 25.0, [], [], "org"), ("o3", "i4", False, "soon", 5.0, [], [], None)], _INDICATOR)
    misp = feeds.misp_summary(values, attributes)
    cti = feeds.opencti_summary(values, observables, indicators, F.lit("2024-02-01").cast("timestamp"))
    assert "Broadcast" not in plan(misp) and "Broadcast" not in plan(cti)
    assert {r.target_id: (r.match_count, r.event_count, r.tags) for r in misp.collect()} == {1: (3, 1, ["t"]), 2: (1, 1, ["t"])}
    got = {r.target_id: r for r in cti.collect()}
    assert sorted(got) == [1, 2]
    assert tuple(got[1])[1:10] == (3, ["Hostname", "Url"], 2, 4, ["w", "x"], ["m", "n"], ["org", "org2"], 10.0, 25.0)
    assert tuple(got[2])[1:10] == (2, ["Hostname", "Url"], 2, 3, ["w", "x"], ["m", "n"], ["org", "org2"], 10.0, 25.0)
    assert got[1].score_avg == 17.5 and got[1].active_ioc_match
