"""Collocations of every language: frequent phrases by a sample and its negative border, counted exactly, then scored.

Until the last pass phrases are 64-bit values of their language and words, and sets of phrases are filters of a fixed
number of bits. Both can only take phrases for frequent that are not: the last pass counts the texts of all that are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import Rolling, mixed, named, small_batches, stored, text_blocks

LONGEST = 4
LEAST_COUNT = 30
#: One of so many documents is in the sample; the least count there is this share of what the sample should hold.
SAMPLE_PART = 4
SAMPLE_SHARE = 0.5
#: A phrase is dropped if a longer one around it has so many percent of its occurrences.
COVERED_PERCENT = 80
SCORE_FACTOR = 2_000_000
TOP = 2000
NO_LANGUAGE = "und"
SHARES = 64

#: Bits of the filter that tells tasks which phrases are known; its size is fixed. With more phrases than an eighth of
#: this, ever more phrases are counted that need not be; results stay the same.
FILTER_BITS = 1 << 25
BLOCK_BYTES = 1 << 20
#: Values that a task counts at a time; text and distinct phrases in it of which it holds phrases; rows that it hands on at a time.
COUNTED = 1 << 20
COUNTED_BYTES = 4 << 20
COUNTED_PHRASES = 1 << 19
HANDED_ROWS = 1 << 16

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_PIECE_END = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_GAP = _PIECE_END | np.isin(np.arange(256), [ord(" "), ord("\t")])
_ONE = np.uint64(1)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts ``data[start:end]``."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[places]))


class Filter:
    """A set of values as two bits each among a fixed number: it may hold values that were not put in."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def of(cls, values: DataFrame, bits: int) -> Filter:
        """The filter of a column ``value``; its words are all that reaches the driver, however many values there are."""
        mask = F.lit(bits - 1)
        places = F.array(F.col("value").bitwiseAND(mask), F.shiftrightunsigned("value", 32).bitwiseAND(mask))
        rows = values.select(F.explode(places).alias("place")).groupBy(F.expr("place div 64").alias("slot")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("word")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows.column("slot").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
        return cls(words)

    @classmethod
    def empty(cls, bits: int) -> Filter:
        return cls(np.zeros(bits // 64, np.uint64))

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.words | other.words)

    def holds(self, values: np.ndarray) -> np.ndarray:
        found, mask = np.ones(len(values), bool), np.uint64(len(self.words) * 64 - 1)
        for place in (values & mask, (values >> np.uint64(32)) & mask):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & _ONE == _ONE
        return found


class _Block:
    """Words of some texts, packed with a blank after each, and the phrases that they form."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, of_lang: np.ndarray) -> None:
        # a line feed after each text ends its last piece
        lengths = np.diff(offsets)
        joined = np.full(len(data) + len(lengths), 10, np.uint8)
        row_ends = offsets[1:] + np.arange(len(lengths))
        inside = np.ones(len(joined), bool)
        inside[row_ends] = False
        joined[inside] = _LOWER[data]
        gap = _GAP[joined]
        before = np.concatenate(([True], gap[:-1]))
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        self.piece = np.cumsum(_PIECE_END[joined], dtype=np.int32)[starts]
        self.lang = langs[np.searchsorted(row_ends, starts)]
        keep = ~gap
        keep[ends] = True
        at = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        joined[gap] = 32
        self.packed, self.starts, self.ends = joined[keep], at[starts].astype(np.int64), at[ends].astype(np.int64)
        del joined, gap, before, keep, at, inside
        self.of_lang, self.rolling = of_lang[self.lang], Rolling(self.packed)

    def _longer(self, member: np.ndarray, n: int) -> np.ndarray:
        """Places of phrases of ``n`` words within a piece, both parts of which are members."""
        at = np.flatnonzero(member[:-1] & member[1:])
        at = at[at + n <= len(self.starts)]
        return at[self.piece[at] == self.piece[at + n - 1]]

    def _values(self, at: np.ndarray, n: int) -> np.ndarray:
        return mixed(self.rolling.of(self.starts[at], self.ends[at + n - 1]) ^ self.of_lang[at])

    def phrases(self, lengths: range, proposed: Filter) -> Iterator[np.ndarray]:
        """Values of the phrases of some lengths that the proposal reaches: all words, and longer phrases whose parts
        (without the last word, without the first word) it reaches and holds."""
        at = np.arange(len(self.starts))
        member = np.zeros(len(at) + 1, bool)
        for n in range(1, lengths.stop):
            if n > 1:
                at = self._longer(member, n)
            if not len(at):
                return
            values = self._values(at, n)
            if n in lengths:
                yield values
            if n + 1 < lengths.stop:
                member[:] = False
                member[at] = proposed.holds(values)

    def settled(self, longest: int, proposed: Filter, frequent: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, places and values of all phrases that can be frequent: of those that the proposal reaches the ones that
        ``frequent`` holds, and all others that it does not reach, both only if their parts can be frequent."""
        at = np.arange(len(self.starts))
        member, old = np.zeros(len(at) + 1, bool), np.zeros(len(at) + 1, bool)
        for n in range(1, longest + 1):
            if n > 1:
                at = self._longer(member, n)
            if not len(at):
                return
            values = self._values(at, n)
            reached = old[at] & old[at + 1] if n > 1 else np.ones(len(at), bool)
            chosen = frequent.holds(values) | ~reached
            yield n, at[chosen], values[chosen]
            member[:] = False
            member[at] = chosen
            old[:] = False
            old[at] = reached & proposed.holds(values)


def _language_hashes(langs: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(langs).encode(), np.uint8)
    ends = np.cumsum([0] + [len(lang.encode()) for lang in langs])
    # mixed once more, or a language would be as good as a word of the same letters
    return mixed(Rolling(data).of(ends[:-1], ends[1:]) + _ONE)


def _parts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A very long text in parts that end where pieces end; everything else as it is."""
    if len(offsets) > 2 or len(data) <= 2 * BLOCK_BYTES:
        yield data, offsets
        return
    cuts = np.flatnonzero(_PIECE_END[data])
    first = 0
    while first < len(data):
        found = int(np.searchsorted(cuts, first + BLOCK_BYTES))
        end = int(cuts[found]) + 1 if found < len(cuts) else len(data)
        yield data[first:end], np.array([0, end - first], np.int64)
        first = end


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    """The texts of rows ``lang, text`` in blocks; ``lang`` of a block counts from 0 as the batch's languages come."""
    langs = batch.column(0).dictionary_encode()
    of_lang, of_row = _language_hashes(langs.dictionary.to_pylist()), langs.indices.to_numpy()
    for first, end, data, offsets in text_blocks(batch.column(1), BLOCK_BYTES):
        for part, bounds in _parts_of(data, offsets):
            yield _Block(part, bounds, of_row[first:end], of_lang)


def _handed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """In small runs, as Spark holds each of them outside its heap."""
    for first in range(0, len(batch), HANDED_ROWS):
        yield batch.slice(first, HANDED_ROWS)


def value_counts(docs: DataFrame, lengths: range, least: int, proposed: Filter) -> DataFrame:
    """Values of the phrases of ``_Block.phrases`` in all texts ``lang, text`` that occur ``least`` times or more, counted by
    value: ``value``. A value that several phrases share counts all of theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(proposed.words)

    def counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(waiting)
        waiting.clear()
        values.sort()
        heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        counts = np.diff(heads, append=len(values))
        return pa.RecordBatch.from_arrays([pa.array(values[heads].view(np.int64)), pa.array(counts)], names=["value", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed, waiting = Filter(shared.value), []
        for batch in batches:
            for block in _blocks(batch):
                waiting.extend(values for values in block.phrases(lengths, proposed) if len(values))
                if sum(map(len, waiting)) >= COUNTED:
                    yield from _handed(counted(waiting))
        if waiting:
            yield from _handed(counted(waiting))

    counts = docs.select("lang", "text").mapInArrow(run, "value long, count long").groupBy("value").agg(F.sum("count").alias("count"))
    return counts.where(F.col("count") >= least).select("value")


class _Counted:
    """Phrases of some blocks with their counts; equal values of so few phrases are taken for equal phrases."""

    def __init__(self) -> None:
        self.values, self.slots, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.rows: list[tuple[pa.Array, pa.Array, pa.Array]] = []
        self.n_bytes = 0

    def full(self) -> bool:
        return self.n_bytes >= COUNTED_BYTES or len(self.counts) >= COUNTED_PHRASES

    def add(self, block: _Block, names: pa.Array, longest: int, proposed: Filter, frequent: Filter) -> None:
        self.n_bytes += len(block.packed)
        for n, at, values in block.settled(longest, proposed, frequent):
            values, first, counts = np.unique(values, return_index=True, return_counts=True)
            place = np.searchsorted(self.values, values)
            known = place < len(self.values)
            known[known] = self.values[place[known]] == values[known]
            self.counts[self.slots[place[known]]] += counts[known]
            place, at = place[~known], at[first[~known]]
            slots = np.arange(len(self.counts), len(self.counts) + len(at), dtype=np.int32)
            self.values, self.slots = np.insert(self.values, place, values[~known]), np.insert(self.slots, place, slots)
            self.counts = np.concatenate((self.counts, counts[~known]))
            self.rows.append((
                names.take(pa.array(block.lang[at].astype(np.int32))), pa.array(np.full(len(at), n, np.int32)),
                _slices(block.packed, block.starts[at], block.ends[at + n - 1]).cast(pa.string())))

    def batch(self) -> pa.RecordBatch:
        columns = [pa.concat_arrays(column) for column in zip(*self.rows, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.counts)], names=["lang", "n", "phrase", "count"])


def phrase_counts(docs: DataFrame, proposed: Filter, frequent: Filter, longest: int = LONGEST) -> DataFrame:
    """Exact counts ``lang, n, phrase, count`` over all texts ``lang, text`` of the phrases of ``_Block.settled``. The phrase of
    no words counts all words of a language."""
    shared = [docs.sparkSession.sparkContext.broadcast(f.words) for f in (proposed, frequent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, found, totals = [Filter(words.value) for words in shared], _Counted(), Counter()
        for batch in batches:
            names = batch.column(0).dictionary_encode().dictionary
            for block in _blocks(batch):
                totals.update(dict(zip(names.to_pylist(), np.bincount(block.lang, minlength=len(names)).tolist(), strict=True)))
                found.add(block, names, longest, *filters)
                if found.full():
                    yield from _handed(found.batch())
                    found = _Counted()
        if found.rows:
            yield from _handed(found.batch())
        yield pa.RecordBatch.from_arrays([
            pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array([""] * len(totals), pa.string()),
            pa.array(list(totals.values()), pa.int64())], names=["lang", "n", "phrase", "count"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, n int, phrase string, count long")
    return rows.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"))


def proposed_phrases(sample: DataFrame, least: int, longest: int = LONGEST, bits: int = FILTER_BITS) -> Filter:
    """Phrases shorter than ``longest`` that occur ``least`` times in the sample, length by length: a phrase is counted only
    if its parts are frequent there. Longer ones need no proposal, as they are no part of any other."""
    proposed = Filter.empty(bits)
    for n in range(1, longest):
        proposed = proposed | Filter.of(value_counts(sample, range(n, n + 1), least, proposed), bits)
    return proposed


def frequent_phrases(
    docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, sample_part: int = SAMPLE_PART, share: float = SAMPLE_SHARE,
    bits: int = FILTER_BITS, key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words that occur ``least`` times in their language, ``lang, n, phrase, count``, and
    the words of each language, ``lang, n_words``.

    The sample is one of ``sample_part`` documents, by a hash of the key; it proposes phrases by a lower least count. One
    pass over all texts then counts these and their negative border: phrases that were not proposed, but all of whose
    parts were. It counts by value, which can only be too much. A last pass counts the texts of the phrases that were
    found frequent, and with them of all phrases beyond the border that can be frequent: those that the first pass did not
    reach and all of whose parts are frequent or beyond it themselves. Every part of a frequent phrase is frequent, so none
    can be missed, whatever the sample was; the fewer frequent phrases the sample missed, the fewer are beyond the border.
    """
    source = docs.select(
        F.coalesce(named(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(named(key)), F.lit(sample_part)).alias("part"))
    lower = max(1, int(share * least / sample_part))
    # tasks hold their texts on both sides, and outside the heap
    with small_batches(docs.sparkSession):
        proposed = proposed_phrases(source.where("part = 0"), lower, longest, bits)
        frequent = Filter.of(stored(value_counts(source, range(1, longest + 1), least, proposed), "frequent-values"), bits)
        counts = stored(phrase_counts(source, proposed, frequent, longest).where((F.col("count") >= least) | (F.col("n") == 0)), "phrase-counts")
    return counts.where("n > 0"), counts.where("n = 0").select("lang", F.col("count").alias("n_words"))


def _words(phrase: Column, first: int, last: int) -> Column:
    """Words ``first`` to ``last`` of a phrase, counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, last - first + 1), " ")


def scored_phrases(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Phrases of two words and more with their weakest cut: ``lang, n_words, phrase, a, l, r, score``.

    A cut after the first words gives the counts of both sides; all of them are frequent, as the phrase is. The score is the
    Dice coefficient of the sides in millionths, rounded down. The cut of least score
    counts, of equal ones the earliest.
    """
    phrases = frequent.where("n > 1").select("lang", F.col("n").alias("n_words"), "phrase", F.col("count").alias("a"))
    cuts = [F.struct(F.lit(k).alias("cut"), _words(F.col("phrase"), 1, k).alias("left_part"), F.expr(
        f"array_join(slice(split(phrase, ' ', -1), {k + 1}, greatest(n_words - {k}, 0)), ' ')").alias("right_part")) for k in range(1, longest)]
    each = phrases.withColumn("one", F.explode(F.filter(F.array(*cuts), lambda c: c["cut"] < F.col("n_words")))).select(
        "lang", "n_words", "phrase", "a", "one.*")
    sides = lambda side, count: frequent.select(
        "lang", F.col("phrase").alias(side), F.col("count").alias(count))
    both = each.join(sides("left_part", "l"), ["lang", "left_part"]).join(sides("right_part", "r"), ["lang", "right_part"])
    score = F.expr(f"cast({SCORE_FACTOR} as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    return both.groupBy("lang", "n_words", "phrase", "a").agg(F.min(F.struct(
        score.cast("long").alias("score"), "cut", "l", "r")).alias("best")).select("lang", "n_words", "phrase", "a", "best.l", "best.r", "best.score")


def without_covered(phrases: DataFrame, longest: int = LONGEST, percent: int = COVERED_PERCENT) -> DataFrame:
    """Phrases of which no longer one, whether dropped itself or not, holds ``percent`` of all occurrences or more."""
    spans = [(i, j) for size in range(2, longest) for i in range(1, longest + 1) for j in [i + size - 1] if j <= longest]
    inner = F.array(*[F.struct(F.lit(j).alias("until"), F.lit(j - i + 1).alias("size"), _words(F.col("phrase"), i, j).alias("inner")) for i, j in spans])
    around = phrases.where("n_words > 2").select("lang", "a", "n_words", F.explode(inner).alias("one")).where(
        "one.until <= n_words and one.size < n_words").groupBy("lang", F.col("one.inner").alias("phrase")).agg(F.max("a").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return phrases.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (wide("around") * 100 < wide("a") * percent)).drop("around")


def collocations(docs: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", lang: str = "lang", **mining) -> DataFrame:
    """The foremost phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A to Z) and cut into pieces at punctuation and line ends, pieces into words at blanks and tabs;
    phrases stay within a piece. ``a`` counts all occurrences, overlapping ones too, ``l`` and ``r`` those of the two sides
    of the weakest cut, ``n`` all words of the language. Phrases that a longer one covers are left out. The order is by
    score, then count, then the bytes of the phrase.

    Defined results: null texts are empty, a null language is ``und``; a language without frequent phrases has no rows;
    repeated rows count as often as they stand; extra columns are ignored. An empty table gives an empty result.
    """
    frequent, words = frequent_phrases(docs, key=key, text=text, lang=lang, **mining)
    longest = mining.get("longest", LONGEST)
    left = without_covered(scored_phrases(frequent, longest), longest)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the foremost of each of many shares first: a language can hold most of all rows
    place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SHARES))).orderBy(*order))
    foremost = left.withColumn("rank", place).where(F.col("rank") <= top)
    ranked = foremost.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.drop("n_words").join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
