"""Quality rules, decontamination, sharding and the archive against plain Python."""

import base64
import binascii
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lurelens.llm import archive, decontamination, quality, sharding
from lurelens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "a a a a", "one two three one two three one two three", "Ünï çödé ## $", "x" * 200_000, "wörd " * 3000, "a\n\na\n \nb\na"]


def texts(spark, values, **extra):
    rows = [(i, v, *extra.values()) for i, v in enumerate(values)]
    types = "".join(f", {name} string" for name in extra)
    return spark.createDataFrame(rows, f"doc_id long, text string{types}")


def plain_base(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts_of_given_documents_and_odd_texts(spark):
    given = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for text in [*given, *ODD]:
        assert quality.base_counts(text) == plain_base(text)


def test_quality_rows_and_verdicts(spark):
    got = QUERIES["op5_quality_rules"](spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for row in got:
        base = plain_base(docs[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == base
        assert row["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (row["base_failed"] and row["kept"])
        for distance in (row["class_distance"], row["word_distance"]):
            assert distance is None or 0 <= distance <= 1


def test_divergence_finds_strange_text_and_keeps_plain_text(spark):
    import random
    random.seed(5)
    stems = ["river", "stone", "market", "window", "garden", "letter", "morning", "summer"]
    prose = lambda: " ".join(random.choice(["the", "of", "and", "to", "in", *(s + random.choice("abcdefgh") for s in stems)]) for _ in range(150))
    strange = " ".join(f"{random.randrange(10 ** 6)}|{random.choice('#$%&')}{random.randrange(99)}" for _ in range(200))
    shown = [prose() for _ in range(40)] + [strange]
    got = {r["doc_id"]: r for r in quality.with_quality(texts(spark, shown, lang="en")).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not got[40]["kept"] and not got[40]["base_failed"]


def test_documents_of_small_languages_are_kept(spark):
    """A Greek language of two documents in 500 that is a reference, and a Cyrillic text whose script none has."""
    import random
    random.seed(8)
    stock = {"en": "the of and river stone market window garden".split(), "el": "και το της νερό κήπος πέτρα αγορά".split(), "ru": "и в на вода камень рынок окно".split()}
    say = lambda lang: " ".join(random.choice(stock[lang]) + (random.choice("abcdefgh") if lang == "en" else random.choice("αβγδεζη") if lang == "el" else random.choice("абвгдеж")) * (random.random() < 0.6) for _ in range(600))
    rows = [(i, lang, say(lang)) for i, lang in enumerate(["en"] * 498 + ["el"] * 2)] + [(500, None, say("ru")), (501, "ru", " ".join(say("ru").split()[:150]))]
    got = {r["doc_id"]: r for r in quality.with_quality(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert not got[498]["base_failed"] and got[498]["kept"] and got[499]["kept"] and got[499]["nearest"] == "el"
    assert all(got[i]["base_failed"] or got[i]["kept"] and got[i]["class_distance"] is None for i in (500, 501))


def test_quality_without_languages_with_clashing_columns_and_empty(spark):
    docs = texts(spark, [*ODD, " ".join(f"w{i}" for i in range(60))]).withColumn("lang", F.lit(None).cast("string")).withColumn("KEPT", F.lit("x"))
    got = quality.with_quality(docs).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 1 and got[-1]["kept"] and got[0]["n_words"] == 0 and not got[0]["kept"]
    assert quality.good_documents(docs).columns == docs.columns
    assert quality.good_documents(docs).count() == 1
    assert quality.with_quality(docs.limit(0)).count() == 0


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, other in items:
        own = words_of(other)
        for i in range(max(1, len(own) - 9) if own else 0):
            window = own[i:i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j:j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found - {None}))


def check_hits(spark, docs, items):
    got = decontamination.contamination(docs, items).collect()
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    expected = Counter()
    for row in docs.collect():
        n, hit, found = plain_hits(row["text"], known)
        expected[row["doc_id"], n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    assert Counter(tuple(r) for r in got) == expected
    return got


def test_hits_of_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = check_hits(spark, docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert any(r["contaminated"] for r in got)


def test_hits_of_odd_rows(spark):
    passage = " ".join(f"Term{i}" for i in range(15))
    items = spark.createDataFrame(
        [(10, passage), (9, "short ITEM"), (None, "nobody owns this"), (7, "!!!"), (6, None), (9, passage), (5, "été")], "item_id long, text string")
    values = [*ODD, passage, f"x-{passage.lower()}, {passage}", "a short, item; SHORT item short item", "nobody owns this", "Été été"]
    docs = texts(spark, values).unionByName(texts(spark, values[-2:])).withColumn("hits", F.lit(1)).withColumn("items", F.lit("x"))
    got = check_hits(spark, docs, items)
    assert sum(r["contaminated"] for r in got) == 7
    assert Counter(map(tuple, got)) == Counter(map(tuple, decontamination.contamination(docs, items, max_bytes=40).collect()))
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, items.limit(0)).collect())
    assert decontamination.clean_documents(docs, items).columns == docs.columns
    spans = decontamination.benchmark_hits(texts(spark, ["é, a SHORT... item!"]), items).first()["spans"]
    assert "é, a SHORT... item!".encode()[spans[0]["start"]:spans[0]["end"]] == b"SHORT... item"


def plain_positions(got):
    """Counts, slots and mixture of shards."""
    by_shard = {}
    for row in got:
        by_shard.setdefault(row["shard"], []).append(row)
    sizes = [len(rows) for rows in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by_shard.values())
    return by_shard


def test_shards_have_the_mixture(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' else concat('s', id % 7) end").alias("source"))
    got = sharding.interleaved_shards(docs, shards=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4000))
    by_shard = plain_positions(got)
    whole = Counter(r["source"] for r in got)
    for rows in by_shard.values():
        own = Counter(r["source"] for r in rows)
        # a cut between equal counts can lie off its fraction by half a row of every stratum
        assert all(abs(own[s] - n / 16) <= 1 + len(whole) * n / 4000 for s, n in whole.items())
    # the exact positions, from ranks over whole strata
    keys = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("h")).collect()}
    buckets, place = round(4000 ** 0.5), {}
    for source, n in whole.items():
        own = sorted((r["doc_id"] for r in got if r["source"] == source), key=lambda i: (keys[i] % buckets, keys[i]))
        place |= {i: ((2 * k + 1) / n, "=" + source, keys[i]) for k, i in enumerate(own)}
    order = sorted(place, key=place.get)
    assert [i for _, i in sorted(((r["shard"], r["slot"]), r["doc_id"]) for r in got)] == order


def test_shards_of_odd_rows(spark):
    rows = [(None, None, "a"), (None, None, "a"), (1, None, "b"), (1, "s", "b"), (1, "s", "b"), (2, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string").withColumn("h", F.lit(1)).withColumn("part", F.lit(2))
    got = sharding.interleaved_shards(docs, shards=4).collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"doc_id", "source", "h", "part", "shard", "slot"}
    plain_positions(got)
    assert sharding.interleaved_shards(docs.limit(0)).count() == 0


def test_sharding_query(spark):
    got = QUERIES["op9_sharding"](spark, FOLDER).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 1, binascii.crc32(t)) for i, t in docs.items()}
    plain_positions(got)


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (5, "http://b/\r\nWARC-Type: bad", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "u", None),
            (9, "u", ""), (4, "ü", "é" * 70_000), (None, "n", "alone"), (None, "n", "<p>x</p>"), (7, "same", "same"), (7, "same", "same")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit("clash"))


def plain_records(rows):
    newest = {}
    for row in rows:
        payload = row["html"] or ""
        newest[payload] = max(newest.get(payload, -1), -1 if row["page_id"] is None else row["page_id"])
    out = Counter()
    for row in rows:
        payload, page = row["html"] or "", row["page_id"]
        response = (-1 if page is None else page) == newest[payload]
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        out[page, len(payload.encode()), digest, "response" if response else "revisit", None if response else newest[payload]] += 1
    return out


def test_archive_round_trip(spark, pages, tmp_path):
    written = archive.write_archive(pages, str(tmp_path / "warc"))
    rows = pages.collect()
    assert Counter(map(tuple, archive.read_records(spark, written).collect())) == plain_records(rows)
    assert spark.read.parquet(written.payloads).count() == len({r["html"] or "" for r in rows})
    records = archive.reconstruct_records(spark, written).collect()
    assert Counter((r["page_id"], bytes(r["payload"]).decode()) for r in records) == Counter((r["page_id"], r["html"] or "") for r in rows)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        declared = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert block[declared:] == b"\r\n\r\n"
        body = block[:declared].partition(b"\r\n\r\n")[2]
        assert body == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
        assert len(re.findall(rb"WARC-Type: ", head)) == 1 or b"%0D%0AWARC-Type" in head


def test_archive_of_given_pages_and_of_none(spark, tmp_path):
    got = QUERIES["op10_warc_archive"](spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == plain_records(spark.read.parquet(f"{FOLDER}/pages.parquet").collect())
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.read_records(spark, archive.write_archive(none, str(tmp_path / "none"))).count() == 0


def test_archive_notices_changed_payloads(spark, pages, tmp_path):
    written = archive.write_archive(pages, str(tmp_path / "warc"))
    bad = archive.Archive(written.headers, str(tmp_path / "bad"))
    spark.read.parquet(written.payloads).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(bad.payloads)
    with pytest.raises(Exception, match="does not match"):
        archive.read_records(spark, bad).collect()
