"""Token counts, languages, mixing and repeated lines against plain Python and SQL."""

import cProfile
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.llm import language, mixing, repeated_lines, token_counts
from lurelens.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, QUERIES, TARGET_WEIGHTS

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "x" * 50_000, "123 !!", "Ünï çödé ## $", "wörd " * 3000, "梦 мир"]


def texts(spark, values, start=0):
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(values)], "doc_id long, text string")


def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_takes_the_longest_pieces():
    random.seed(3)
    for _ in range(200):
        pieces = {bytes(random.choice(b"abc") for _ in range(random.randrange(1, 6))) for _ in range(random.randrange(1, 12))}
        automaton = token_counts.Automaton(pieces)
        for _ in range(40):
            word = bytes(random.choice(b"abcd") for _ in range(random.randrange(1, 15)))
            assert automaton.count(word) == greedy(word, pieces, 5), (pieces, word)


def test_token_counts(spark):
    pieces = token_counts.read_vocabulary(BYTE_VOCABULARY)
    known, longest = set(pieces), max(map(len, pieces))
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("N_tokens", F.lit("clash"))
    for got, (doc, text) in zip(token_counts.with_token_counts(docs, pieces).orderBy("doc_id").collect(), sorted(given), strict=True):
        words = (text or "").encode().split()
        assert (got["doc_id"], got["n_words"], got["n_tokens"], got["n_unknown"]) == (doc, len(words), sum(greedy(b" " + w, known, longest) for w in words), 0)
    few = token_counts.with_token_counts(texts(spark, ["ab abc x", None]), [b"ab", b"c"], b"").orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in few] == [(3, 4, 1), (0, 0, 0)]
    assert token_counts.with_token_counts(texts(spark, []), pieces).count() == 0
    assert QUERIES["op4_token_counts"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def all_cuts(word, probabilities, unknown):
    if not word:
        return 1.0
    found = sum(p * all_cuts(word[len(piece):], probabilities, unknown) for piece, p in probabilities.items() if word.startswith(piece))
    return found + (unknown * all_cuts(word[1:], probabilities, unknown) if word[0] not in probabilities else 0)


def test_forward_sums_all_cuts():
    random.seed(4)
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aab", "▁ba"]
    probabilities = np.array([[random.random(), random.random()] for _ in pieces] + [[1e-3, 1e-3]])
    words = ["▁" + "".join(random.choice("abz") for _ in range(random.randrange(1, 9))) for _ in range(50)]
    sums = language.forward(language.Lattices(pieces).edges(words), len(words), probabilities)
    for w, word in enumerate(words):
        for k in range(2):
            assert sums[w, len(word), k] == pytest.approx(all_cuts(word, dict(zip(pieces, probabilities[:, k], strict=False)), 1e-3))
    # expected pieces of a word, from the share of each cut
    expected = language.expected_counts(["▁ab"], np.array([2]), language.Lattices(pieces), probabilities[:, [0]])
    p = dict(zip(pieces, probabilities[:, 0], strict=False))
    cuts = {("▁", "a", "b"): p["▁"] * p["a"] * p["b"], ("▁a", "b"): p["▁a"] * p["b"], ("▁", "ab"): p["▁"] * p["ab"]}
    share = sum(v for cut, v in cuts.items() if "▁" in cut) / sum(cuts.values())
    assert expected[pieces.index("▁")] == pytest.approx(2 * share)


def plain_edges(words, pieces):
    rows = []
    for w, word in enumerate(words):
        rows += [(i + 1, w, i, len(pieces)) for i, c in enumerate(word) if c not in pieces]
        rows += [(j, w, i, pieces.index(word[i:j])) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in pieces]
    return sorted(rows)


def test_edges_are_found_for_all_words_at_once():
    """The same edges as one by one, and no call of Python for each character: this was most of the time of a prediction."""
    random.seed(5)
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aab", "▁bab", "é", "😀b", "zz"]
    words = ["▁" + "".join(random.choice("abzé😀") for _ in range(random.randrange(12))) for _ in range(500)]
    lattices = language.Lattices(pieces)
    profile = cProfile.Profile()
    edges = profile.runcall(lattices.edges, [*words, ""])
    assert [tuple(row) for row in edges.tolist()] == plain_edges(words, pieces)
    assert sum(entry.callcount for entry in profile.getstats()) < 2 * len(words)
    assert lattices.edges([]).shape == (0, 4)
    assert language.Lattices([]).edges(["ab"]).tolist() == [[1, 0, 0, 0], [2, 0, 1, 0]]


def test_language_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [r for r in docs if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert len(got) == len(docs) and len(held) > 100
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    pieces = language.read_pieces(PIECE_MODEL)
    rows = [(1, "the house and the garden of the man", "en"), (2, "das haus und der garten von dem mann", "de"), (3, None, "de"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, pieces)
    found = language.with_language(texts(spark, [*ODD, "das und der", "the and of"]).withColumn("SCORE", F.lit(1)), model, pieces).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found[:3]] == ["und"] * 3 and found[5]["lang_pred"] == "und" and found[5]["score"] == 0
    assert [r["lang_pred"] for r in found[-2:]] == ["de", "en"] and all(r["lang_pred"] in ("de", "en") for r in found[6:9])
    nothing = language.fit(docs.limit(0), pieces)
    assert {r["lang_pred"] for r in language.with_language(docs, nothing, pieces).collect()} == {"und"}
    assert language.with_language(docs.limit(0), model, pieces).count() == 0


def test_small_languages_are_learned(spark, monkeypatch):
    """Two languages with 2 in 1,000 documents each, in blocks of one language and of all."""
    random.seed(9)
    stock = {"en": "the house and of garden man with water".split(), "fi": "talo ja puutarha on mies vesi kanssa".split(), "hu": "a ház és kert az ember víz vele".split()}
    say = lambda lang: " ".join(random.choice(stock[lang]) for _ in range(40))
    rows = [(i, say(lang), lang) for i, lang in enumerate(["en"] * 996 + ["fi"] * 2 + ["hu"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    pieces = language.read_pieces(PIECE_MODEL)
    models = [language.fit(docs, pieces)]
    monkeypatch.setattr(language, "BLOCK", 1)
    models.append(language.fit(docs, pieces))
    assert [m.langs for m in models] == [("en", "fi", "hu")] * 2 and np.allclose(models[0].dense(0, 3), models[1].dense(0, 3))
    shown = [say(lang) for lang in stock]
    monkeypatch.setattr(language, "MAX_REMEMBERED", 9)
    small = language.Scorer(models[1], pieces).predict([*shown, None])
    monkeypatch.undo()
    whole = language.Scorer(models[0], pieces).predict([*shown, None])
    assert small[0] == whole[0] == ["en", "fi", "hu", "und"] and small[1] == pytest.approx(whole[1])


def labelled(spark, n=400):
    random.seed(6)
    stock = {(1, 0): "calm lake quiet field".split(), (0, 0): "buy cheap offer now".split(), (1, 1): "vile rage awful hate".split()}
    rows, labels = [], []
    for doc in range(n):
        kind = random.choices(list(stock), (6, 3, 1))[0]
        rows.append((doc, " ".join(random.choice(stock[kind] + ["the", "a"]) for _ in range(random.randrange(5, 60)))))
        if doc % 2:
            labels.append((doc, *kind))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def plain_posteriors(classifier, features):
    scores = np.array([0.0] + [p + sum(odds[f] for f in features) for p, odds in zip(classifier.prior[1:], classifier.odds, strict=True)])
    scores = scores * classifier.scale + (classifier.shift or np.zeros(len(scores)))
    e = np.exp(scores - scores.max())
    return e / e.sum()


def test_rates_meet_targets(spark):
    docs, labels = labelled(spark)
    got = mixing.mixture_rates(docs, labels, TARGET_WEIGHTS).collect()
    classifier = mixing.fit_classifier(docs, labels)
    hashed = docs.select("doc_id", F.size(F.split("text", " ")).alias("n"), F.transform(
        F.array_distinct(F.split("text", " ")), lambda w: F.pmod(F.hash(w), F.lit(mixing.FEATURES))).alias("f")).collect()
    posterior = {r["doc_id"]: plain_posteriors(classifier, r["f"]) for r in hashed}
    tokens = {r["doc_id"]: r["n"] for r in hashed}
    totals = np.zeros(len(classifier.domains))
    for row in got:
        p = posterior[row["doc_id"]]
        assert row["n_tokens"] == tokens[row["doc_id"]] and row["domain"] == classifier.domains[int(p.argmax())]
        assert row["posterior"] == pytest.approx(p.max()) and row["rate"] >= 0
        totals += row["rate"] * row["n_tokens"] * p
    whole = sum(TARGET_WEIGHTS.values())
    assert totals == pytest.approx([TARGET_WEIGHTS[d] / whole * sum(tokens.values()) for d in classifier.domains], rel=1e-6)


def test_bounded_rates_minimise_the_distance(spark):
    """Against the same steps over arrays, and against a plain projected gradient in small steps."""
    random.seed(8)
    rows = [(i, random.randrange(1, 50), [x := random.random(), 1 - x]) for i in range(300)]
    known = spark.createDataFrame(rows, "doc_id long, n_tokens long, posteriors array<double>")
    rates = mixing.fit_rates(known, ("a", "b"), {"a": 0.9, "b": 0.1}, upper=1.0)
    got = {r["doc_id"]: r["rate"] for r in known.select("doc_id", rates.of(F.col("posteriors")).alias("rate")).collect()}
    n, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    target = np.array([0.9, 0.1]) * n.sum()
    metric = np.linalg.inv((p * n[:, None]).T @ p)
    distance = lambda r: float((d := p.T @ (n * r) - target) @ metric @ d)
    r = np.ones(len(rows))
    for _ in range(4000):
        r = np.clip(r - 0.5 * p @ (metric @ (p.T @ (n * r) - target)), 0, 1)
    mine = np.array([got[i] for i in range(len(rows))])
    assert (mine >= 0).all() and (mine <= 1).all() and distance(mine) <= distance(r) * 1.001 + 1e-9


def test_rounds_share_their_code(spark):
    """Other rates are other numbers in the same generated code, which the driver compiles and keeps once."""
    rows = [(i, 1 + i % 50, [x := (i * 37 % 101) / 101, 1 - x]) for i in range(300)]
    known = spark.createDataFrame(rows, "doc_id long, n_tokens long, posteriors array<double>")
    known = mixing.stored(known, "rounds")
    compiled = lambda: spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()
    mixing.fit_rates(known, ("a", "b"), {"a": 0.7, "b": 0.3}, upper=1.0)
    before = compiled()
    for share in (0.35, 0.45, 0.8):
        mixing.fit_rates(known, ("a", "b"), {"a": share, "b": 1 - share}, upper=1.0)
    assert compiled() == before


@pytest.mark.parametrize(("spread", "upper"), [(1, None), (3, None), (8, None), (1, 1.0), (3, 1.0), (8, 1.0)])
def test_solver_reaches_the_optimum(spread, upper):
    """Against very many small steps of a plain projected gradient, for targets in and out of reach."""
    rng = np.random.default_rng(spread)
    p = np.exp(rng.normal(size=(3000, 4)) * spread)
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(1, 3000, 3000).astype(float)
    targets = np.array([0.94, 0.05, 0.01, 0]) * n.sum()

    def sums(dual):
        free = 1 - p @ dual
        rate = np.clip(free, 0, upper)
        inside = np.where(free == rate, n, 0)
        return mixing.Sums(float((n * rate * (free - rate / 2)).sum()), float((n * (rate - 1) ** 2).sum()), p.T @ (n * rate), (p * inside[:, None]).T @ p)

    second = (p * n[:, None]).T @ p
    _, reached = mixing.solved(sums, second, targets, n.sum())
    metric, rate = np.linalg.inv(second), np.ones(3000)
    for _ in range(3000):
        rate = np.clip(rate - p @ (metric @ (p.T @ (n * rate) - targets)), 0, upper)
    distance = lambda totals: float((totals - targets) @ metric @ (totals - targets))
    assert distance(reached) <= distance(p.T @ (n * rate)) * 1.001 + 1e-3


def test_posteriors_are_calibrated_and_misses_reported(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    classifier = mixing.fit_classifier(docs, labels)
    known = labels.groupBy("quality", "toxic").count().collect()
    shares = {f"quality{r['quality']}_toxic{r['toxic']}": r["count"] for r in known}
    means = mixing.memberships(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), classifier).select(
        *[F.avg(F.col("posteriors")[d]).alias(name) for d, name in enumerate(classifier.domains)]).first()
    for name in classifier.domains:
        assert means[name] == pytest.approx(shares[name] / sum(shares.values()), abs=0.05)
    # shares near those that there are can be had; a few hundred labels tell domains apart too little for others
    whole = mixing.memberships(docs, classifier).agg(*[
        (F.sum(F.col("n_tokens") * F.col("posteriors")[d]) / F.sum("n_tokens")).alias(name) for d, name in enumerate(classifier.domains)]).first().asDict()
    easy = whole | {"quality1_toxic0": whole["quality1_toxic0"] * 1.05}
    got = mixing.mixture_rates(docs, labels, easy).collect()
    assert {r["targets_met"] for r in got} == {True}
    assert all(r["domain_reached"] == pytest.approx(r["domain_target"], abs=1e-3 * sum(x["n_tokens"] for x in got)) for r in got)
    # more of a domain than dropping can leave
    none = mixing.mixture_rates(docs, labels, {"quality1_toxic1": 1.0}, upper=1.0).collect()
    assert {r["targets_met"] for r in none} == {False}


def test_mixing_odd_rows(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.unionByName(texts(spark, ODD, 1000)).unionByName(docs.limit(2)).withColumn("rate", F.lit("clash")).withColumn("draw", F.lit(1))
    got = mixing.mixture_rates(odd, labels, TARGET_WEIGHTS).collect()
    assert len(got) == 62 + len(ODD) and all(math.isfinite(r["rate"]) for r in got)
    none = mixing.mixture_rates(odd, labels.limit(0), TARGET_WEIGHTS).collect()
    assert {(r["domain"], r["rate"]) for r in none} == {(None, 1.0)}
    assert mixing.mixture_rates(odd.limit(0), labels, TARGET_WEIGHTS).count() == 0
    mixed = mixing.mixed_documents(odd, labels, {"quality1_toxic0": 1.0})
    assert mixed.columns == odd.columns and 0 < mixed.count() <= 62 + len(ODD)
    with pytest.raises(ValueError, match="no weight"):
        mixing.mixture_rates(docs, labels, {"unheard": 1.0})


def test_relative_weights_drop_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = mixing.mixed_documents(docs, labels, {"quality0_toxic1": 0.3, "quality1_toxic1": 0.3}, relative=True)
    assert kept.columns == docs.columns
    left = {(r["toxic"]): r["n"] for r in kept.join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    there = {(r["toxic"]): r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert left.get(1, 0) <= 0.3 * there[1] and left[0] >= 0.85 * there[0]


def test_classifier_on_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    taught, other = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = {r["doc_id"]: r["domain"] for r in mixing.mixture_rates(docs, taught, TARGET_WEIGHTS).collect()}
    truth = {r["doc_id"]: f"quality{r['quality']}_toxic{r['toxic']}" for r in other.collect()}
    # clearly better than naming the commonest domain
    assert sum(got[i] == d for i, d in truth.items()) >= max(Counter(truth.values()).values()) + 0.05 * len(truth)


WRITTEN = re.compile("[^\\x20\\x09-\\x0D]")


def plain_lines(rows, run=3):
    first, cut = {}, []
    each = [(-1 if doc is None else doc, [] if text is None else text.split("\n")) for doc, text in rows]

    def windows(lines):
        written = [i for i, x in enumerate(lines) if WRITTEN.search(x)]
        for k in range(len(written)):
            for size in range(1, run + 1):
                own = written[k:k + size]
                if len(own) == size and (size == run or sum(len(re.findall("[^\\x20\\x09-\\x0D]+", lines[i])) for i in own) >= 50):
                    yield k, tuple(lines[i] for i in own), own
                    break

    for doc, lines in each:
        for _, own, _ in windows(lines):
            first[own] = min(first.get(own, doc), doc)
    for (doc_id, text), (doc, lines) in zip(rows, each, strict=True):
        gone, seen = set(), set()
        for _, own, at in windows(lines):
            if first[own] < doc or own in seen:
                gone.update(at)
            seen.add(own)
        kept = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        cut.append((doc_id, sum(bool(WRITTEN.search(x)) for x in lines), len(gone), kept))
    return Counter(cut)


def test_repeated_lines(spark):
    random.seed(11)
    pool = [f"line {i}" for i in range(6)] + ["", "  "]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randrange(12)))) for i in range(200)]
    rows += [(None, "a\nb\nc\nd"), (None, "a\nb\nc"), (500, "z\na\nb\nc\nd\nz"), (501, None), (502, ""), (503, "a\nb"), rows[3], (504, "q\nq\nq\nq\nq")]
    # long lines are runs alone or in pairs
    long, half = " ".join(f"w{i}" for i in range(60)), " ".join(f"h{i}" for i in range(30))
    rows += [(600, f"a\n{long}\nb"), (601, f"c\n{long}"), (602, long), (603, f"{half}\n{half}x\ne"), (604, f"{half}\n\n{half}x"), (605, half), (606, half),
             (607, f"{long}\n{long}\n{half}"), (608, f"{half}\nk\n{long}")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lines int").repartition(4)
    assert Counter(map(tuple, repeated_lines.without_repeated_lines(docs).collect())) == plain_lines(rows)
    assert repeated_lines.without_repeated_lines(docs.limit(0)).count() == 0
