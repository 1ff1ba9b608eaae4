"""Jobs that keep state per key: verdicts that answer requests, and the life cycle of runs.

Both order the rows of a key within a batch by their own time, so results follow the times of the events and not the
order of arrival, as long as no row is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lurelens.operators.history import CACHE_HOURS
from lurelens.streaming.jobs import run_available

DELAY = "1 hour"
#: Shares into which the requests of one URL are split.
SHARES = 4
#: Buckets of URLs that have their state in common.
BUCKETS = 1024
SILENT_HOURS = 24
FINAL = ("done", "error")
_HOUR = 3_600_000_000
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB, which these jobs need."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_stateful(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived and stop, as ``run_available``, with state on disk."""
    with state_on_disk(df.sparkSession):
        run_available(df, path, checkpoint)


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _present(text: str | None) -> str | None:
    """A text as pandas holds it, where a missing one may also be NaN."""
    return text if isinstance(text, str) else None


class _NewestRun(StatefulProcessor):
    """State of a URL: its newest run. It goes once the watermark says that nobody can ask for it any more."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, target_id string, usable boolean, classification string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # most keys hold a row or two, so plain values: a frame is only made for answers
        known = self.newest.get()
        events = [] if known is None else [(known[0], False, known[1], known[2], known[3], None)]
        for frame in rows:
            columns = [frame[name].tolist() for name in ("at", "request_id", "target_id", "usable", "classification")]
            for at, request, target, usable, label in zip(*columns):
                request = _present(request)
                events.append((int(at), request is not None, _present(target), usable is True, _present(label), request))
        # runs before requests of the same moment; of runs of one moment the smaller id is the newest
        events.sort(key=lambda e: (e[2] is not None, e[2] or ""), reverse=True)
        events.sort(key=lambda e: e[:2])
        run, answers = None, []
        for event in events:
            if not event[1]:
                run = event
                continue
            fresh = run is not None and run[3] and event[0] - run[0] < self.life
            answers.append((key[0], event[5], run[2] if fresh else None, run[4] if fresh else None))
        if run is not None and (known is None or (run[0], run[2]) != (known[0], known[1])):
            self.newest.update((run[0], run[2], run[3], run[4]))
            self.handle.registerTimer((run[0] + self.life) // 1000 + 1)
        if answers:
            yield pd.DataFrame(answers, columns=["url_hash", "request_id", "cached_target", "classification"], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a newer run has a timer of its own
        known = self.newest.get()
        if known is not None and (known[0] + self.life) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


_RUNS = pa.schema([
    ("url_hash", pa.string()), ("at", pa.int64()), ("target_id", pa.string()), ("usable", pa.bool_()), ("classification", pa.string())])
_ANSWERED = 10_000


class _NewestRuns(StatefulProcessor):
    """State of a bucket of URLs: the newest run of each, as one Arrow table. Answers are those of ``_NewestRun``, worked out for all
    URLs of the bucket at once: a call for each URL, and each read, write and timer of its own state, costs far more than its rows."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("runs", "runs binary")

    def _known(self) -> pa.Table:
        held = self.newest.get()
        return _RUNS.empty_table() if held is None else pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_all()

    def _ends(self, at: np.ndarray) -> np.ndarray:
        """When runs are too old, in the milliseconds of timers."""
        return (at + self.life) // 1000 + 1

    def _keep(self, runs: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _RUNS) as stream:
            stream.write_table(runs)
        self.newest.update((sink.getvalue().to_pybytes(),))
        # one timer for the bucket: the end of its oldest run
        self.handle.registerTimer(int(self._ends(runs["at"].to_numpy()).min()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        told, asked = [known], []
        for frame in rows:
            table = pa.table({field.name: pa.array(frame[field.name], field.type, from_pandas=True) for field in (*_RUNS, pa.field("request_id", pa.string()))})
            is_request = pc.is_valid(table["request_id"])
            told.append(table.filter(pc.and_(pc.invert(is_request), pc.is_valid(table["at"]))).select(_RUNS.names))
            asked.append(table.filter(is_request).select(["url_hash", "at", "request_id"]))
        runs, asked = pa.concat_tables(told).combine_chunks(), pa.concat_tables(asked).combine_chunks()
        n, none = runs.num_rows, np.iinfo(np.int64).min
        urls = pa.chunked_array([*runs["url_hash"].chunks, *asked["url_hash"].chunks], pa.string()).combine_chunks()
        code = urls.dictionary_encode().indices.to_numpy()
        at = np.concatenate([runs["at"].to_numpy(), pc.fill_null(asked["at"], none).to_numpy()])
        is_run, rank = np.arange(len(code)) < n, np.zeros(len(code), np.int64)
        rank[:n] = _tie_ranks(runs["target_id"], code[:n], at[:n])
        # runs before requests of the same moment
        order = np.lexsort((rank, ~is_run, at, code))
        self._newest_of(known.num_rows, runs, code, at, order[is_run[order]])
        if not asked.num_rows:
            return
        before = np.maximum.accumulate(np.where(is_run[order], np.arange(len(order)), -1))
        last = np.where((before >= 0) & (code[order[before]] == code[order]), order[before], -1)
        found = np.empty(len(order), np.int64)
        found[order] = last
        found, fresh = found[n:], np.zeros(len(order) - n, bool)
        if n:
            usable = pc.fill_null(runs["usable"], False).to_numpy()
            fresh = (found >= 0) & usable[found] & (at[n:] - at[found] < self.life)
        chosen = pa.array(found, mask=~fresh)
        answers = pa.table({
            "url_hash": asked["url_hash"], "request_id": asked["request_id"], "cached_target": runs["target_id"].take(chosen),
            "classification": runs["classification"].take(chosen)})
        for batch in answers.combine_chunks().to_batches(max_chunksize=_ANSWERED):
            yield batch.to_pandas().astype(object)

    def _newest_of(self, held: int, runs: pa.Table, code: np.ndarray, at: np.ndarray, order: np.ndarray) -> None:
        """Keep the last run of each URL, if one of them is new. The first ``held`` runs are those that the state has."""
        if len(order) == held:
            return
        newest = order[np.append(code[order][1:] != code[order][:-1], True)]
        old_of = np.full(code.max() + 1, -1)
        old_of[code[:held]] = np.arange(held)
        old = old_of[code[newest]]
        # a run that comes again changes nothing
        targets = runs["target_id"]
        for i in np.flatnonzero((old >= 0) & (newest != old) & (at[newest] == at[old])):
            if targets[int(newest[i])].as_py() == targets[int(old[i])].as_py():
                newest[i] = old[i]
        if (newest >= held).any():
            self._keep(runs.take(newest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known.num_rows:
            left = known.filter(pa.array(self._ends(known["at"].to_numpy()) >= timerValues.getCurrentWatermarkInMs()))
            self._keep(left) if left.num_rows else self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def _tie_ranks(targets: pa.ChunkedArray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of runs of one URL and one moment: the smaller id is the newest, none at all comes after it."""
    order, ranks = np.lexsort((at, code)), np.zeros(len(code), np.int64)
    same = (code[order][1:] == code[order][:-1]) & (at[order][1:] == at[order][:-1])
    if same.any():
        tied = order[np.append(same, False) | np.append(False, same)]
        texts = targets.take(pa.array(tied)).to_pylist()
        place = {text: i for i, text in enumerate(sorted({t for t in texts if t is not None}, reverse=True))}
        ranks[tied] = [place.get(t, len(place)) for t in texts]
    return ranks


def answer_from_state(
    requests: DataFrame, runs: DataFrame, hours: int = CACHE_HOURS, delay: str = DELAY, shares: int = SHARES, buckets: int | None = BUCKETS,
) -> DataFrame:
    """Answer a stream of requests from a stream of runs: ``url_hash, request_id, cached_target, classification``.

    ``requests``: ``url_hash, request_id, requested_at``; ``runs``: ``url_hash, target_id, status, classification,
    created_at``. A request gets the run of its URL that was the newest when it came, if that is done, has a verdict and
    is younger than ``hours``; all other requests get nulls. The newest run of each URL is the state, kept until the
    watermark has passed its end. A request that comes so late that its run has been replaced gets nulls. The requests of
    a URL are dealt into ``shares``, each with a copy of the run, so one URL does not wait for one task.

    URLs of a bucket have their state in common, which is read and written as a whole once a batch. Without ``buckets`` each URL
    has a state of its own: for small batches that meet few of very many URLs, and for streams that were begun so.
    """
    none = F.lit(None).cast("string")
    asked = requests.select(
        "url_hash", F.pmod(F.xxhash64("request_id"), F.lit(shares)).cast("int").alias("share"), F.col("request_id").cast("string").alias("request_id"),
        none.alias("target_id"), F.lit(False).alias("usable"), none.alias("classification"), F.col("requested_at").cast("timestamp").alias("ts"))
    usable = (F.col("status") == "done") & F.col("classification").isNotNull()
    told = runs.select(
        "url_hash", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), none.alias("request_id"),
        F.col("target_id").cast("string").alias("target_id"), F.coalesce(usable, F.lit(False)).alias("usable"), "classification",
        F.col("created_at").cast("timestamp").alias("ts"))
    both = asked.unionByName(told).where(F.col("url_hash").isNotNull()).withColumn("at", _micros("ts")).withWatermark("ts", delay)
    answers = "url_hash string, request_id string, cached_target string, classification string"
    if buckets is None:
        return both.groupBy("url_hash", "share").transformWithStateInPandas(_NewestRun(hours * _HOUR), answers, "Append", "EventTime")
    dealt = both.withColumn("bucket", F.pmod(F.xxhash64("url_hash"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket", "share").transformWithStateInPandas(_NewestRuns(hours * _HOUR), answers, "Append", "EventTime")


class _Lifecycle(StatefulProcessor):
    """State of a run: its last status. Final ones go when the watermark has passed them, silent ones become stale."""

    def __init__(self, silent: int) -> None:
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, status string")

    def _ends(self, at: int, status: str) -> int:
        return (at if status in FINAL else at + self.silent) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        at, status = max(max(zip(frame["at"], frame["status"])) for frame in rows)
        if known is None or (at, status) > tuple(known):
            self.last.update((int(at), status))
            self.handle.registerTimer(self._ends(int(at), status))
            yield pd.DataFrame({"target_id": [key[0]], "status": [status], "changed_micros": [int(at)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        at, status = self.last.get()
        if self._ends(at, status) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            if status not in FINAL:
                yield pd.DataFrame({"target_id": [key[0]], "status": ["stale"], "changed_micros": [at + self.silent]})

    def close(self) -> None:
        pass


def run_lifecycle(updates: DataFrame, silent_hours: int = SILENT_HOURS, delay: str = DELAY) -> DataFrame:
    """Changes of status of a stream of updates ``target_id, status, ts``: ``target_id, status, changed_micros``.

    An older update than the last one changes nothing. A run that is not done and says nothing for ``silent_hours`` turns
    ``stale`` at that time, which one further update undoes. State is dropped when a run is stale, or when it is done or
    failed and the watermark has passed that; until then late updates must still find it.
    """
    rows = updates.select(F.col("target_id").cast("string").alias("target_id"), "status", F.col("ts").cast("timestamp").alias("ts")).where(
        "target_id is not null and status is not null and ts is not null")
    return rows.withColumn("at", _micros("ts")).withWatermark("ts", delay).groupBy("target_id").transformWithStateInPandas(
        _Lifecycle(silent_hours * _HOUR), "target_id string, status string, changed_micros long", "Append", "EventTime")
