"""Repeated byte strings against a plain search of all strings."""

import hashlib
import random

import numpy as np
import pytest

from lurelens.llm import repeated_bytes
from lurelens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FIRST = -(1 << 63)


def plain(rows, width=100):
    """``(doc_id, text)`` rows cut as the operator says, by a dictionary of all strings."""
    first = {}
    places = [(FIRST if doc is None else doc, (text or "").encode()) for doc, text in rows]
    for doc, data in places:
        for i in range(len(data) - width + 1):
            string = data[i:i + width]
            first[string] = min(first.get(string, (doc, i)), (doc, i))
    out = []
    for (doc_id, _), (doc, data) in zip(rows, places, strict=True):
        gone = bytearray(len(data) + 1)
        for i in range(len(data) - width + 1):
            if first[data[i:i + width]] < (doc, i):
                gone[i:i + width] = b"\1" * width
        spans = sum(gone[i] and not gone[i - 1] for i in range(len(data)))
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(frame):
    return sorted(
        ((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
         for r in frame.collect()), key=repr)


@pytest.mark.parametrize("width", [20, 100, 101, 108])
def test_merged_transforms_find_equal_strings(width):
    random.seed(width)
    pool = [bytes(random.choice(b"ab\0") for _ in range(width + 30)) for _ in range(5)]
    texts, shards = [], []
    for _ in range(4):
        own = []
        for _ in range(random.randrange(1, 9)):
            a, b = random.choice(pool), random.choice(pool)
            cut = random.randrange(len(a))
            own.append((a[:cut] + b[cut:])[random.randrange(20):])
        texts += own
        shards.append((np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])))
    got = repeated_bytes.repeated_intervals([*shards, (np.zeros(0, np.uint8), np.zeros(1, np.int64))], width)
    by_string, by_interval, at = {}, {}, 0
    for text in texts:
        for i in range(len(text) - width + 1):
            by_string.setdefault(text[i:i + width], set()).add(at + i)
            by_interval.setdefault(got[at + i], set()).add(at + i)
        at += len(text)
    assert sorted(map(sorted, by_string.values())) == sorted(map(sorted, by_interval.values()))


def made_rows(seed, n=60):
    random.seed(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "zeta", "eta", "theta", "iota", "kappa", "lambda"]
    prose = lambda k: " ".join(random.choice(words) + random.choice(["", "s", "x"]) for _ in range(k))
    passages = [prose(random.randrange(10, 60)) for _ in range(4)]
    line = prose(9)
    rows = []
    for doc in random.sample(range(1000), n):
        parts = [random.choice([prose(20), random.choice(passages), line, "x" * random.randrange(300), "ab" * 90]) for _ in range(random.randrange(5))]
        rows.append((doc, " ".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, None), (2001, ""), (2002, line[:99]), (None, passages[0]), (None, passages[0] + "!"), rows[0]]
    near = list(prose(80))
    for i in range(6):
        near[random.randrange(len(near))] = "Q"
        rows.append((3000 + i, "".join(near)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_documents(spark, seed):
    rows = made_rows(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, version string").repartition(3)
    assert digest(repeated_bytes.without_repeated_bytes(docs)) == plain(rows)


def test_hot_anchors_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "MAX_BUCKETED", 2)
    monkeypatch.setattr(repeated_bytes, "MAX_REPORTED", 2)
    monkeypatch.setattr(repeated_bytes, "GROUP_BYTES", 3000)
    monkeypatch.setattr(repeated_bytes, "BUCKET_BYTES", 2000)
    rows = made_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(repeated_bytes.without_repeated_bytes(docs)) == plain(rows)


def test_long_rows_are_cut_into_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(repeated_bytes, "PIECE_BYTES", 500)
    random.seed(9)
    data = bytes(random.choice(b"abcdefgh ") for _ in range(5000)).decode()
    row, starts, sizes, _, _ = repeated_bytes._stretches(pa.array(["", data, None, "short", data[:100]]), 100)
    covered = [(r, s + k) for r, s, n in zip(row.tolist(), starts.tolist(), sizes.tolist(), strict=True) for k in range(n)]
    assert covered == [(1, i) for i in range(4901)] + [(4, 0)]


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op8_repeated_bytes"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_bytes.without_repeated_bytes(none).count() == 0
