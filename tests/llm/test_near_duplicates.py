"""Near-duplicate classes against all pairs."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lurelens.llm import near_duplicates
from lurelens.llm.queries import QUERIES


def bag(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_classes(rows, similarity=0.8):
    """Smallest key of each component of all linked pairs; keys are unique and not null."""
    bags = {doc: bag(text) for doc, text in rows}
    holders = {}
    for doc, own in bags.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(doc)
    of = {doc: doc for doc in bags}

    def root(doc):
        while of[doc] != doc:
            doc = of[doc]
        return doc

    for doc, own in bags.items():
        for other in {x for shingle in own for x in holders[shingle] if x < doc}:
            shared = (own & bags[other]).total()
            if shared >= similarity * (own.total() + bags[other].total() - shared) - 1e-9:
                a, b = sorted((root(doc), root(other)))
                of[b] = a
    return {doc: root(doc) for doc in bags}


def made(seed):
    random.seed(seed)
    word = lambda: random.choice("abcdefghij") + random.choice("klmnopqrst") + str(random.randrange(30))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(random.choice([8, 40, 120, 300]))]
        for _ in range(random.randrange(1, 9)):
            own = list(base)
            for _ in range(random.randrange(max(2, len(base) // 30))):
                own[random.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += ["The Same, words here!", "the same words HERE", "alone", "alone", " ".join("tick tock".split() * 200), " ".join("tick tock".split() * 150), " ".join("tick tock".split() * 120)]
    random.shuffle(rows)
    return list(enumerate(rows, 5))


def test_classes_of_made_documents(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == plain_classes(rows)


def test_classes_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = QUERIES["op2_near_duplicates"](spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == plain_classes(rows)
    assert len(got) == len(rows)


def test_odd_rows(spark):
    same = "one two three four five six seven"
    rows = [(None, same), (None, same), (1, None), (2, ""), (3, " .,"), (4, " .,"), (5, same), (6, same.upper()), (6, same.upper()), (7, "a b"), (8, "A, b"), (9, "x" * 100_000), (9, "y y")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, class long")
    got = Counter((r["doc_id"], r["class_id"]) for r in near_duplicates.near_duplicate_classes(docs).collect())
    assert got == Counter({(None, None): 2, (1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 5): 1, (6, 5): 2, (7, 7): 1, (8, 7): 1, (9, 9): 2})
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 9: 1})
    assert near_duplicates.near_duplicate_classes(docs.limit(0)).count() == 0
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_documents_left_by_one_hub_find_others(spark):
    """Copies of two bases that share most shingles: one band holds several classes."""
    random.seed(12)
    base = [f"w{random.randrange(10 ** 6)}" for _ in range(200)]
    rows = []
    for family in range(6):
        head = list(base)
        for i in range(0, 200, 18):
            head[(i + 3 * family) % 200] = f"f{family}"
        for k in range(6):
            own = list(head)
            own[random.randrange(200)] = f"x{k}"
            rows.append(" ".join(own))
    rows = list(enumerate(rows))
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == plain_classes(rows)


def test_pairs_in_large_bands_that_are_far_from_all_hubs(spark):
    """Choices of three quarters of the same passages: large bands of many classes, where only pairs are similar."""
    random.seed(21)
    passages = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(20)]
    rows = []
    for _ in range(200):
        own = set(random.sample(range(20), 15))
        out, new = random.choice(sorted(own)), random.choice([i for i in range(20) if i not in own])
        for chosen in (own, own - {out} | {new}):
            rows.append(" ".join(passages[i] for i in sorted(chosen)))
    random.shuffle(rows)
    rows = list(enumerate(rows))
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == plain_classes(rows)


def test_pair_in_one_large_band_that_is_far_from_all_hubs(spark):
    bags = [(i, list(range(100 * i, 100 * i + 100))) for i in range(40)]
    bags[3] = (3, bags[5][1][:90] + list(range(9000, 9010)))
    members = spark.createDataFrame([(1, i, i) for i in range(40)], "band long, doc long, rank long")
    links, classes = near_duplicates.linked(members, spark.createDataFrame(bags, "doc long, bag array<int>"), 0.8)
    assert [set(r) for r in links.collect()] == [{3, 5}]
    assert {r["doc"]: r["class"] for r in classes.collect()} == {i: 3 if i == 5 else i for i in range(40)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    rows, hashes, weights, truth = [], [], [], []
    for t in range(1500):
        own = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
        a = rng.integers(0, 40, 40)
        b = np.maximum(0, a + rng.integers(-15, 6, 40))
        for k, w in enumerate((a, b)):
            rows.append(np.full((w > 0).sum(), 2 * t + k))
            hashes.append(own[w > 0])
            weights.append(w[w > 0])
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    signed = near_duplicates.bag_min_hash(np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights), 3000, 130)
    error = (signed[0::2] == signed[1::2]).mean(axis=1) - truth
    assert abs(error.mean()) < 0.004 and error.std() < 0.05


def test_components(spark):
    nodes = spark.range(100).select(F.col("id").alias("doc"), F.col("id").alias("class"))
    edges = spark.createDataFrame([(i + 1, i) for i in range(0, 39)] + [(60, 50), (50, 70)], "a long, b long")
    got = {r["doc"]: r["class"] for r in near_duplicates.connected(nodes, edges).collect()}
    assert got == {i: 0 if i < 40 else 50 if i in (50, 60, 70) else i for i in range(100)}


def test_hashing_takes_little_memory_whatever_the_batch():
    random.seed(4)
    words = [f"word{i}" for i in range(5000)]
    texts = [" ".join(random.choices(words, k=500)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    for step in (near_duplicates._signed, near_duplicates._elements):
        list(step(iter([batch.slice(0, 10)])))  # tables that are kept
        tracemalloc.start()
        try:
            assert sum(out.num_rows for out in step(iter([batch]))) == len(texts)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 60e6, step


def test_python_gets_few_texts_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    texts = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)) for i in range(8)]).alias("text"))
    docs = texts.unionByName(texts.withColumn("doc_id", F.col("doc_id") + 5000)).coalesce(1)

    def limited(step, most):
        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.num_rows <= most, batch.num_rows
                    yield batch

            return step(seen())

        return run

    for name in ("_signed", "_elements"):
        monkeypatch.setattr(near_duplicates, name, limited(getattr(near_duplicates, name), 1000))
    classes = near_duplicates.near_duplicate_classes(docs)
    assert classes.count() == 10000 and classes.select("class_id").distinct().count() == 5000
    assert spark.conf.get(key) == own  # the session has its own limit again
    try:
        corpus_pipeline.quality_rules(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "10")
        corpus_pipeline.quality_rules(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
        assert spark.conf.get(key) == "10"  # a smaller limit stays
    finally:
        spark.conf.set(key, own)
