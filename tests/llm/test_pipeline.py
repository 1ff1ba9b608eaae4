"""The stages of the pipeline against their plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_near_duplicates import plain_classes
from tests.llm.test_rules_hits_shards_archive import plain_base, plain_hits, plain_positions

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    given = {name: stage for name, stage in corpus_pipeline.STAGES}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = given["quality rules"](spark, docs, FOLDER)
    assert good.columns == columns
    kept = {r["doc_id"] for r in good.collect()}
    failed = {i for i, t in texts.items() if (b := plain_base(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
    assert not kept & failed and len(kept) >= 0.8 * (len(texts) - len(failed))

    single = given["MinHash near-dedup"](spark, good, FOLDER)
    assert single.columns == columns
    classes = plain_classes([(i, texts[i]) for i in sorted(kept)])
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(i for i, c in classes.items() if i == c)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = given["benchmark decontamination"](spark, single, FOLDER)
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, c in classes.items() if i == c and not plain_hits(texts[i], items)[1]}

    mixed = given["mixing to target weights"](spark, clean, FOLDER)
    assert mixed.columns == columns and 0 < mixed.count() <= clean.count()
    dealt = given["sharding"](spark, mixed, FOLDER).collect()
    assert Counter(r["doc_id"] for r in dealt) == Counter(r["doc_id"] for r in mixed.collect())
    plain_positions(dealt)


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == Counter(map(tuple, docs.collect()))
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "sharding" and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_no_documents(spark):
    none = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
