"""Near duplicates of documents: BagMinHash signatures of their word shingles, bands, and verified overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import Rolling, mixed, named, small_batches, stored, text_blocks, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 26, over 0.9999.
BANDS = 26
BAND_ROWS = 5
#: Rounds of hubs: 1, 2 and 4 of each band.
ROUNDS = 3
#: Text that is hashed at a time; its arrays take some thirty times as much memory.
HASHED_BYTES = 1 << 19

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _constants(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of five words, A-Z lower-cased; one run of all words where there are fewer."""
    lower = _LOWER[data]
    starts, ends, bounds = word_spans(lower, offsets, _IN_WORD)
    words = Rolling(lower).of(starts, ends)
    counts = np.diff(bounds)
    of_row = np.repeat(np.arange(len(counts)), counts)
    last = bounds[1:][of_row]
    runs = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.arange(len(words)) - bounds[:-1][of_row] < runs[of_row]
    heads = np.flatnonzero(at)
    sums = np.zeros(len(heads), np.uint64)
    for k, factor in enumerate(_constants(SHINGLE, 1)):
        inside = heads + k < last[heads]
        sums[inside] += words[heads[inside] + k] * factor
    return of_row[heads], mixed(sums)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all rows: row, hash, how often."""
    rows, hashes = shingles(data, offsets)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])))) if len(rows) else np.zeros(0, np.int64)
    return rows[fresh], hashes[fresh], np.diff(np.append(fresh, len(rows)))


def bag_min_hash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, n_hashes: int) -> np.ndarray:
    """Signatures whose entries agree with the probability of the weighted Jaccard similarity.

    Weights are counts, discretised in doubling intervals (0, 1], (1, 2], (2, 4], ... Each shingle has a Poisson process
    for each interval, with a rate of the interval's width, seeded by shingle and interval alone. A point has a time, an
    entry of the signature and a level in the interval, and counts for a bag if its level is not above the weight. An
    entry is the time of its first point. Processes run in the order of time and end when no entry can change any more.
    Returns one row of 32-bit values per bag; an empty bag has none and keeps the value of infinity.
    """
    tops = np.ceil(np.log2(weights)).astype(np.int64)  # the last interval that a weight reaches into
    process = np.repeat(np.arange(len(rows)), tops + 1)
    level = np.arange(len(process)) - np.repeat(np.cumsum(tops + 1) - (tops + 1), tops + 1)
    row, weight = rows[process], weights[process]
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    floor = np.where(level > 0, width, 0.0)
    seed = mixed(hashes[process] + level.astype(np.uint64) * _STEP)
    time = np.zeros(len(process))
    first = np.full((n_rows, n_hashes), np.inf)
    flat = first.reshape(-1)
    limit = np.full(n_rows, np.inf)
    points = 0
    while len(row):
        # several points of each process at a time once few processes are left
        more = max(1, min(64, 8192 // len(row)))
        steps = np.arange(points + 1, points + more + 1, dtype=np.uint64) * _STEP
        points += more
        draw = mixed(seed[:, None] + steps)
        place = mixed(draw ^ _STEP)
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        time = times[:, -1]
        level = floor[:, None] + (place >> np.uint64(32)).astype(np.float64) * 2.0 ** -32 * width[:, None]
        which, at = np.nonzero((times < limit[row][:, None]) & (level < weight[:, None]))
        entry = (place[which, at] & np.uint64(0xFFFFFFFF)) % np.uint64(n_hashes)
        np.minimum.at(flat, row[which] * n_hashes + entry.astype(np.int64), times[which, at])
        present = np.unique(row) if len(row) < n_rows else slice(None)
        limit[present] = first[present].max(axis=1)
        soon = time < limit[row]
        row, weight, width, floor, seed, time = (x[soon] for x in (row, weight, width, floor, seed, time))
    return first.astype(np.float32).view(np.int32)


def _band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = signatures.astype(np.uint32).astype(np.uint64).reshape(len(signatures), bands, -1)
    sums = (mixed(parts) * _constants(parts.shape[2], 2)).sum(axis=2, dtype=np.uint64)
    return mixed(sums + _constants(bands, 3)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: 128 bits that stand for its words in order, and its band keys; documents without words drop out."""
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column(1), HASHED_BYTES):
            n = end - first
            rows, hashes = shingles(data, offsets)
            ids = pa.array(np.flatnonzero(np.bincount(rows, minlength=n)))
            words = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            for k, total in enumerate(words):
                np.add.at(total, rows, mixed(hashes * _constants(1, 5 + k) + mixed(place.astype(np.uint64) + np.uint64(k))))
            keys = _band_keys(bag_min_hash(*bags(data, offsets), n, BANDS * BAND_ROWS), BANDS)
            chosen = ids.to_numpy()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, n).take(ids), *[pa.array(w.view(np.int64)[chosen]) for w in words],
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(chosen) * BANDS + 1, BANDS), pa.int32()), pa.array(keys[chosen].reshape(-1))),
            ], names=["doc", "words1", "words2", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its bag as a set of 32-bit hashes: the second of equal shingles is another element than the first."""
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column(1), HASHED_BYTES):
            rows, hashes, counts = bags(data, offsets)
            each = np.repeat(np.arange(len(rows)), counts)
            place = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            values = mixed(hashes[each] + place.astype(np.uint64) * _STEP)
            bounds = np.searchsorted(rows[each], np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32))),
            ], names=["doc", "bag"])


def _verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(hub, doc)`` whose bags overlap enough, by exact weighted Jaccard similarity."""
    other = bag.select(F.col("doc").alias("hub"), F.col("bag").alias("hub_bag"))
    both = pairs.join(bag, "doc").join(other, "hub")
    shared = F.size(F.array_intersect("bag", "hub_bag"))
    return both.where(shared >= similarity * (F.size("bag") + F.size("hub_bag") - shared) - 1e-9).select("hub", "doc")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of ``edges (a, b)``: ``doc, class`` for all of ``nodes (doc, class)``, merged with the classes they
    have; a class is its smallest member. Every round hooks each class to its smallest neighbour, or to what that is
    hooked to itself, until no edge joins two classes."""
    while True:
        of = lambda end: nodes.select(F.col("doc").alias(end), F.col("class").alias(f"class_{end}"))
        links = edges.join(of("a"), "a").join(of("b"), "b").where("class_a <> class_b").select(
            F.greatest("class_a", "class_b").alias("class"), F.least("class_a", "class_b").alias("to"))
        hooks = stored(links.groupBy("class").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return nodes
        ahead = hooks.select(F.col("class").alias("to"), F.col("to").alias("further"))
        hooks = hooks.join(ahead, "to", "left").select("class", F.coalesce("further", "to").alias("to"))
        nodes = stored(nodes.join(hooks, "class", "left").select("doc", F.coalesce("to", "class").alias("class")), "classes")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents that chains of links connect: ``doc_id, class_id, n_links`` for every row.

    Two documents are linked if the weighted Jaccard similarity of their bags of five-word shingles is ``similarity`` or
    more. Documents with the same words in the same order are one from the start. The others meet where a band of their
    signatures is equal. The documents of a band are not paired with each other but with its hubs, those that share
    most bands with others: first with the foremost one, and if that leaves them in another class, with the next two,
    the next four, and so on. Pairs within a class are not looked at. ``ROUNDS`` such rounds compare all documents of
    bands with up to ``2 ** ROUNDS`` documents. Whatever larger bands still hold in several classes is then compared
    exactly, by rare shingles (``_rare_places``): no pair of theirs that is similar enough stays apart.

    ``class_id`` is the smallest key in the class, ``n_links`` how many links of the document were verified (links to
    copies of the same words count as one).

    Defined results: texts that are null or have no words are alone in their class; rows that share a key are one
    document; a row with a null key is alone, its class is null. Extra columns are not handed on. An empty table gives an
    empty result.
    """
    source = docs.select(named(key).cast("long").alias("doc"), named(text).cast("string").alias("text"))
    keyed = source.where("doc is not null and text is not null")
    with small_batches(docs.sparkSession):
        signed = stored(keyed.mapInArrow(_signed, "doc long, words1 long, words2 long, bands array<long>"), "signatures")
    firsts = stored(signed.groupBy("words1", "words2").agg(F.min("doc").alias("same"), F.first("bands").alias("bands")), "texts")
    in_band = firsts.select(F.col("same").alias("doc"), F.explode("bands").alias("band"))
    sizes = in_band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(in_band.join(sizes, "band"), "bands")
    weight = members.groupBy("doc").agg(F.sum("n").alias("weight"))
    members = stored(members.join(weight, "doc").select("band", "doc", _ranked("weight", "doc").alias("rank")), "ranked-bands")
    # bags are smaller than texts, so they are made before they are dealt out; the plan is the same at every size
    bag = keyed.mapInArrow(_elements, "doc long, bag array<int>").join(weight.select("doc").hint("merge"), "doc", "left_semi")
    with small_batches(docs.sparkSession):
        bag = stored(bag, "bags")

    links, classes = linked(members, bag, similarity)
    same = signed.select("doc", "words1", "words2").join(firsts.select("words1", "words2", "same"), ["words1", "words2"])
    ends = links.select(F.col("hub").alias("same")).unionByName(links.select(F.col("doc").alias("same")))
    found = same.join(classes.withColumnRenamed("doc", "same"), "same", "left").join(
        ends.groupBy("same").agg(F.count("*").alias("links")), "same", "left")
    # rows that share a key share a class
    by_doc = found.groupBy("doc").agg(F.min(F.coalesce("class", "same")).alias("class"), F.max("links").alias("links"))
    return docs.select(named(key).alias("doc_id")).join(by_doc.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("class", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def linked(members: DataFrame, bag: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(hub, doc)`` and classes ``(doc, class)`` of the documents that ``members (band, doc, rank)`` brings
    together."""
    classes = stored(members.select("doc").distinct().withColumn("class", F.col("doc")), "classes")
    hubs = members.groupBy("band").agg(F.max_by("doc", "rank").alias("hub"))
    stars = stored(members.join(hubs, "band").where("doc <> hub").groupBy("hub", "doc").agg(F.count("*").alias("shared")), "stars")
    # of several hubs the one with most common bands is tried first, and the others only if need be
    best = stars.groupBy("doc").agg(F.max_by("hub", _ranked("shared", "hub")).alias("hub")).select("hub", "doc")
    links = stored(_verified(best, bag, similarity), "links")
    classes = connected(classes, links.toDF("a", "b"))
    more = stored(_verified(_apart(stars.select("hub", "doc"), classes), bag, similarity), "links")
    links, classes = links.unionByName(more), connected(classes, more.toDF("a", "b"))
    tried, left, round_ = _unordered(stars), members, 1
    while round_ < ROUNDS:
        # documents that a hub of theirs has left in another class
        stars = stored(_apart(stars.select("hub", "doc"), classes), "stars")
        if stars.isEmpty():
            break
        left = stored(left.join(stars.select("doc").distinct(), "doc", "left_semi"), "left")
        pairs = stored(_next_pairs(members, left, classes, round_).join(tried, ["hub", "doc"], "left_anti"), "pairs")
        more = stored(_verified(pairs, bag, similarity), "links")
        links, classes = links.unionByName(more), connected(classes, more.toDF("a", "b"))
        tried, round_ = tried.unionByName(pairs), round_ + 1
    open_docs = stored(_open_documents(members, classes, 1 << round_), "open")
    if not open_docs.isEmpty():
        places = stored(_rare_places(bag.join(open_docs, "doc", "left_semi"), similarity), "rare-places")
        # one document for each rare shingle first, so that families are one class before all that is left is paired
        for pairs in (_rare_stars, _rare_pairs):
            pairs = stored(pairs(places, classes, similarity).join(tried, ["hub", "doc"], "left_anti"), "pairs")
            more = stored(_verified(pairs, bag, similarity), "links")
            links, classes = links.unionByName(more), connected(classes, more.toDF("a", "b"))
            tried = tried.unionByName(pairs)
    return links, classes


def _ranked(size: str, doc: str) -> Column:
    """The size, and where sizes are equal a hash of the document."""
    return F.col(size) * (1 << 20) + F.pmod(F.xxhash64(doc), F.lit(1 << 20))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes."""
    of_hub = classes.select(F.col("doc").alias("hub"), F.col("class").alias("hub_class"))
    return pairs.join(classes, "doc").join(of_hub, "hub").where("class <> hub_class").select("hub", "doc")


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("hub", "doc").alias("hub"), F.least("hub", "doc").alias("doc"))


def _next_pairs(members: DataFrame, left: DataFrame, classes: DataFrame, round_: int) -> DataFrame:
    """The documents that are left with the further hubs of this round in their bands, and those of these hubs that are
    left with all documents of the band."""
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("rank"), "doc"))
    further = members.withColumn("place", place).where(F.col("place") < 1 << (round_ + 1)).where(
        F.col("place") >= 1 << round_).select("band", F.col("doc").alias("hub"))
    open_hubs = further.join(left.select("band", F.col("doc").alias("hub")), ["band", "hub"], "left_semi")
    pairs = left.select("band", "doc").join(further, "band").unionByName(members.select("band", "doc").join(open_hubs, "band"))
    return _apart(_unordered(pairs.where("doc <> hub")).distinct(), classes)


def _open_documents(members: DataFrame, classes: DataFrame, done: int) -> DataFrame:
    """Documents of the bands that hold several classes, and more documents than are ``done``."""
    placed = members.join(classes, "doc")
    several = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most")).where(
        (F.col("n") > done) & F.expr("least <> most"))
    return placed.join(several, "band", "left_semi").select("doc").distinct()


def _rare_places(bag: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each bag that others have too: ``element, doc, size, at``.

    All bags are ordered alike, rare shingles first; ``at`` is a shingle's place in its bag. Of two bags that are similar
    enough, the first common shingle stands among the first ``size - ceil(similarity * size) + 1`` of both.
    """
    # rows that share a key have bags of their own
    sets = bag.select("doc", F.xxhash64("bag").alias("version"), F.array_distinct("bag").alias("bag")).dropDuplicates(["doc", "version"])
    each = sets.select("doc", "version", F.size("bag").alias("size"), F.explode("bag").alias("element"))
    shared = each.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    ordered = each.join(shared, "element").groupBy("doc", "version", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "element"))).alias("own"))
    single = F.col("size") - F.size("own")
    length = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1 - single
    first = ordered.where(length > 0).select("doc", "size", single.alias("single"), F.posexplode(F.slice("own", F.lit(1), length.cast("int"))))
    return first.select("col.element", "doc", "size", (F.col("single") + F.col("pos")).alias("at"))


def _may_be_similar(similarity: float) -> Column:
    """Whether two bags can overlap enough if a shingle at these places is the first that they share."""
    most = F.least(F.col("size") - F.col("at"), F.col("hub_size") - F.col("hub_at"))
    return most >= similarity / (1 + similarity) * (F.col("size") + F.col("hub_size")) - 1e-6


def _rare_stars(places: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Each document with one of another class: of the foremost ones of its rare shingles, that of most shingles."""
    placed = places.join(classes, "doc")
    hubs = placed.groupBy("element").agg(F.max_by(F.struct("doc", "size", "at", "class"), F.xxhash64("doc")).alias("hub")).select(
        "element", F.col("hub.doc").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.at").alias("hub_at"), F.col("hub.class").alias("hub_class"))
    both = placed.join(hubs, "element").where((F.col("class") != F.col("hub_class")) & _may_be_similar(similarity))
    shared = both.groupBy("hub", "doc").agg(F.count("*").alias("shared"))
    return _unordered(shared.groupBy("doc").agg(F.max_by("hub", _ranked("shared", "hub")).alias("hub"))).distinct()


def _rare_pairs(places: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different classes that share a rare shingle and can be similar enough."""
    placed = places.join(classes, "doc")
    others = placed.select("element", *[F.col(c).alias(f"hub_{c}" if c != "doc" else "hub") for c in ("doc", "size", "at", "class")])
    both = placed.join(others, "element").where((F.col("doc") < F.col("hub")) & (F.col("class") != F.col("hub_class")) & _may_be_similar(similarity))
    return both.select("hub", "doc").distinct()


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of smallest key of every class, with all its columns; of rows that share that key, one stays. Rows
    with a null key all stay."""
    classes = near_duplicate_classes(docs, similarity, key, text)
    rows = classes.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    packed = docs.select(named(key).alias("_key"), F.struct(*[named(c).alias(c) for c in docs.columns]).alias("_row"))
    kept = packed.join(rows.withColumnRenamed("doc_id", "_key"), "_key", "left").where("_key is null or _rows is not null")
    single = kept.where("_key is null or _rows = 1")
    several = kept.where("_rows > 1").dropDuplicates(["_key"])
    return single.unionByName(several).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
