"""State of URLs in buckets: the answers of one URL at a time, for far fewer calls."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lurelens.streaming import stateful

LIFE = 100_000
COLUMNS = ["url_hash", "at", "request_id", "target_id", "usable", "classification"]


class _State:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.state, self.timers = _State(), set()

    def getValueState(self, name, schema):
        return self.state

    def registerTimer(self, at):
        self.timers.add(at)


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _job(kind):
    job = kind(LIFE)
    job.init(_Handle())
    return job


def _answers(frames):
    return sorted((tuple(None if pd.isna(v) else v for v in row) for frame in frames for row in frame.itertuples(index=False)), key=repr)


def _expire(job, key, water):
    """Timers fire as Spark lets them: those before the watermark, each once."""
    for at in sorted(at for at in job.handle.timers if at < water):
        job.handle.timers.discard(at)
        list(job.handleExpiredTimer(key, _Watermark(water), _Watermark(at)))


def test_buckets_answer_as_single_urls_do():
    rnd = random.Random(7)
    whole, single, low = _job(stateful._NewestRuns), {}, 0
    for batch in range(6):
        rows = []
        for i in range(400):
            url, at = rnd.choice(["a", "b", "ü", "", "hot", "hot"]), low + rnd.randrange(80_000) // 500 * 500
            if rnd.random() < 0.5:
                rows.append((url, at, f"q{batch}-{i}", None, False, None))
            else:
                rows.append((url, at, None, rnd.choice([None, f"t{i % 7}"]), rnd.random() < 0.7, rnd.choice([None, "benign"])))
        # the same run has one status and verdict
        known = {}
        rows = [(u, at, q, *known.setdefault((u, at, t), (t, s, c))) if q is None else (u, at, q, t, s, c) for u, at, q, t, s, c in rows]
        frame = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
        got = _answers(whole.handleInputRows((1, 0), iter([frame.iloc[:150], frame.iloc[150:]]), None))
        expected = []
        for url, part in frame.groupby("url_hash"):
            job = single.setdefault(url, _job(stateful._NewestRun))
            expected += _answers(job.handleInputRows((url, 0), iter([part]), None))
        assert got == sorted(expected, key=repr) and len(got) > 100
        low += 70_000
        water = (low - 20_000) // 1000
        _expire(whole, (1, 0), water)
        for url, job in single.items():
            _expire(job, (url, 0), water)
        held = {r["url_hash"]: (r["at"], r["target_id"], r["usable"], r["classification"]) for r in whole._known().to_pylist()}
        assert held == {url: tuple(job.newest.value) for url, job in single.items() if job.newest.value is not None}
    _expire(whole, (1, 0), 10**9)
    assert whole.newest.value is None and not whole.handle.timers


def test_a_bucket_is_read_and_written_once():
    job = _job(stateful._NewestRuns)
    frame = pd.DataFrame([(f"u{i}", i, None, f"t{i}", True, "benign") for i in range(1000)], columns=COLUMNS, dtype=object)
    assert not list(job.handleInputRows((1, 0), iter([frame]), None))
    assert job.newest.calls == 2 and job.handle.timers == {LIFE // 1000 + 1}
    asked = pd.DataFrame([("u5", 7, "q", None, False, None), ("none", 7, "r", None, False, None), ("u6", None, "s", None, False, None)], columns=COLUMNS, dtype=object)
    assert _answers(job.handleInputRows((1, 0), iter([asked]), None)) == [("none", "r", None, None), ("u5", "q", "t5", "benign"), ("u6", "s", None, None)]
    assert job.newest.calls == 3


def test_stream_with_and_without_buckets(spark, tmp_path):
    runs = [(f"u{i % 9}", f"t{i}", "done" if i % 4 else "error", "benign" if i % 3 else None, f"2024-01-0{1 + i % 3} 0{i % 7}:00:00") for i in range(60)]
    asks = [(f"u{i % 11}", f"q{i}", f"2024-01-0{1 + i % 4} 0{i % 9}:30:00") for i in range(90)]
    spark.createDataFrame(runs, "url_hash string, target_id string, status string, classification string, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp")).write.parquet(f"{tmp_path}/runs/b")
    spark.createDataFrame(asks, "url_hash string, request_id string, requested_at string").withColumn(
        "requested_at", F.col("requested_at").cast("timestamp")).write.parquet(f"{tmp_path}/asks/b")
    found = []
    for buckets in (None, 2):
        read = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}/b").schema).parquet(f"{tmp_path}/{name}/*") for name in ("asks", "runs")]
        stateful.run_stateful(stateful.answer_from_state(*read, shares=2, buckets=buckets), f"{tmp_path}/out{buckets}", f"{tmp_path}/progress{buckets}")
        found.append(sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{buckets}").collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 90 and any(r[2] for r in found[0])
