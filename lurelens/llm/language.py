"""Language of a text: unigram piece models per language, summed over all ways to cut its words into pieces."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import kept_columns, named, stored

#: Bound of the training sample: documents of each language, each with its whole text.
SAMPLE_DOCS = 500
#: Languages that are learned and scored at a time, so that dense tables never hold more.
BLOCK = 64
ROUNDS = 3
SMOOTHING = 0.05
#: Probability of a character that no piece has, alike in all languages.
UNKNOWN = 1e-8
#: Longer words are scored in parts, which keeps products of probabilities above the smallest double.
MAX_PART = 30
#: Words times languages that a task remembers, or works out at a time.
MAX_REMEMBERED = 2_000_000
UNDETERMINED = "und"
_START = "▁"
_WORD = re.compile(r"[^\W\d_]+")
_OWN = ("lang_pred", "score")
_CODE_BITS = 21


def read_pieces(path: str) -> list[str]:
    """Pieces of a public sentencepiece model, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case, the start of each marked; parts of ``MAX_PART`` characters of longer ones."""
    words = [_START + word for word in _WORD.findall((text or "").lower())]
    if max(map(len, words), default=0) > MAX_PART:
        return [word[i: i + MAX_PART] for word in words for i in range(0, len(word), MAX_PART)]
    return words


@dataclass(frozen=True)
class Model:
    """Languages, their shares of the training documents, and the probability of each piece in each of them: that of the
    pieces that a language has, and the one that all others of it share."""

    langs: tuple[str, ...]
    priors: np.ndarray
    n_pieces: int
    own: tuple[tuple[np.ndarray, np.ndarray], ...]  # numbers and probabilities of the pieces, by language
    rest: tuple[float, ...]

    def dense(self, first: int, end: int) -> np.ndarray:
        """Probabilities of all pieces, and one row for unknown characters, in a run of languages."""
        table = np.tile(np.array(self.rest[first:end]), (self.n_pieces + 1, 1))
        for k, (numbers, probabilities) in enumerate(self.own[first:end]):
            table[numbers, k] = probabilities
        table[-1] = UNKNOWN
        return table


class Lattices:
    """All cuts of words into pieces of one vocabulary: a trie as sorted arrays, in which all characters of many words are
    looked up at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=0)
        nodes, steps, ends = {"": 0}, [], {}
        for number, piece in enumerate(pieces):
            node = 0
            for k in range(1, len(piece) + 1):
                child = nodes.setdefault(piece[:k], len(nodes))
                if child > len(steps):
                    steps.append(node << _CODE_BITS | ord(piece[k - 1]))
                node = child
            ends[node] = number
        self.unknown = len(ends)
        order = np.argsort(np.array(steps, np.int64))
        # a last key that no character has, so that every place is one of the table
        self.steps = np.append(np.array(steps, np.int64)[order], np.iinfo(np.int64).max)
        self.children = np.append(order + 1, 0)
        self.piece = np.full(len(nodes), -1)
        self.piece[list(ends)] = list(ends.values())

    def edges(self, words: list[str]) -> np.ndarray:
        """Rows ``(end, word, start, piece)`` in this order; a character without a piece is the last number."""
        lengths = np.array([len(word) for word in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - start
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        places, sizes, numbers = [], [], []
        alone = np.ones(len(codes), bool)
        for size in range(1, self.longest + 1):
            more = left[at] >= size
            at, node = at[more], node[more]
            key = node << _CODE_BITS | codes[at + (size - 1)]
            step = np.searchsorted(self.steps, key)
            hit = self.steps[step] == key
            at, node = at[hit], self.children[step[hit]]
            number = self.piece[node]
            whole = number >= 0
            if size == 1:
                alone[at[whole]] = False
            places.append(at[whole])
            sizes.append(np.full(len(places[-1]), size))
            numbers.append(number[whole])
        single = np.flatnonzero(alone)
        places, sizes, numbers = (np.concatenate(x) for x in (
            [*places, single], [*sizes, np.ones(len(single), np.int64)], [*numbers, np.full(len(single), self.unknown)]))
        found = np.stack((start[places] + sizes, word[places], start[places], numbers), axis=1)
        return found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]


def forward(edges: np.ndarray, n_words: int, probabilities: np.ndarray) -> np.ndarray:
    """Sums over all cuts of each word's first characters: ``[word, length, language]``."""
    longest = int(edges[-1, 0]) if len(edges) else 0
    sums = np.zeros((n_words, longest + 1, probabilities.shape[1]))
    sums[:, 0] = 1
    bounds = np.searchsorted(edges[:, 0], np.arange(1, longest + 2))
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        end, word, start, piece = edges[first:last].T
        if len(word):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            sums[word[heads], end[0]] = np.add.reduceat(sums[word, start] * probabilities[piece], heads)
    return sums


def expected_counts(words: list[str], counts: np.ndarray, lattices: Lattices, probabilities: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language, given its present probabilities."""
    edges = lattices.edges(words)
    ahead = forward(edges, len(words), probabilities)[:, :, 0]
    lengths = np.array([len(word) for word in words])
    behind = np.zeros_like(ahead)
    behind[np.arange(len(words)), lengths] = 1
    for end in range(ahead.shape[1] - 1, 0, -1):
        first, last = np.searchsorted(edges[:, 0], (end, end + 1))
        _, word, start, piece = edges[first:last].T
        np.add.at(behind, (word, start), probabilities[piece, 0] * behind[word, end])
    end, word, start, piece = edges.T
    share = ahead[word, start] * probabilities[piece, 0] * behind[word, end] / ahead[word, lengths[word]]
    return np.bincount(piece, weights=share * counts[word], minlength=len(probabilities))


def fit(docs: DataFrame, pieces: list[str], lang: str = "lang", text: str = "text", order: str = "doc_id") -> Model:
    """Piece probabilities of every language in ``docs``, by expectation maximisation over all cuts.

    Languages are counted over all rows, and every language is learned, however small its share. The probabilities come
    from ``SAMPLE_DOCS`` documents of each language at most, chosen by a hash of ``order``; ``BLOCK`` languages are worked
    out at a time. Rows without language or text teach nothing.
    """
    known = docs.select(
        named(lang).cast("string").alias("lang"), named(text).cast("string").alias("text"), F.xxhash64(named(order)).alias("order"),
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros(0), len(pieces), (), ())
    # first about twice the sample by the size of the hash, so that few rows are ranked however many there are
    some = known.withColumn("order", F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)))
    large = {name: 2 * SAMPLE_DOCS / n for name, n in sizes.items() if n > 2 * SAMPLE_DOCS}
    if large:
        share = F.create_map(*[F.lit(x) for item in large.items() for x in item])
        some = some.where(F.col("order") < F.coalesce(F.element_at(share, F.col("lang")), F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    sample = some.withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS)
    words = stored(
        sample.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(F.xxhash64("word")), "language-words")
    own, rest = [], []
    for first in range(0, len(langs), BLOCK):
        block = langs[first: first + BLOCK]
        part = words if len(langs) <= BLOCK else words.where(F.col("lang").isin(list(block)))
        table = np.full((len(pieces) + 1, len(block)), 1 / max(1, len(pieces)))
        table[-1] = UNKNOWN
        for _ in range(ROUNDS):
            sums = np.zeros_like(table)
            for row in _expected(part, pieces, block, table).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
                sums[row["piece"], block.index(row["lang"])] = row["n"]
            table[:-1] = (sums[:-1] + SMOOTHING) / (sums[:-1].sum(axis=0) + SMOOTHING * len(pieces))
        for k in range(len(block)):
            numbers = np.flatnonzero(sums[:-1, k])
            own.append((numbers.astype(np.int32), table[numbers, k]))
            rest.append(float(SMOOTHING / (sums[:-1, k].sum() + SMOOTHING * len(pieces))) if pieces else UNKNOWN)
    return Model(langs, np.array([sizes[name] / total for name in langs]), len(pieces), tuple(own), tuple(rest))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letter_words(text))
        rows = [(lang, word, n) for lang, each in words.items() for word, n in each.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
            names=["lang", "word", "n"])


def _expected(words: DataFrame, pieces: list[str], langs: tuple[str, ...], table: np.ndarray) -> DataFrame:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(pieces)
        found = np.zeros_like(table)
        for batch in batches:
            of, words_, counts = (batch.column(i).to_pylist() for i in range(3))
            for k, lang in enumerate(langs):
                own = [i for i, x in enumerate(of) if x == lang]
                if own:
                    found[:, k] += expected_counts([words_[i] for i in own], np.array([counts[i] for i in own]), lattices, table[:, [k]])
        piece, k = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs[i] for i in k], pa.string()), pa.array(piece, pa.int64()), pa.array(found[piece, k])],
            names=["lang", "piece", "n"])

    return words.mapInArrow(sums, "lang string, piece long, n double")


class Scorer:
    """Log probabilities of words in all languages, remembered while a task lasts."""

    def __init__(self, model: Model, pieces: list[str]) -> None:
        self.model, self.lattices, self.first = model, Lattices(pieces), -1
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.langs)))

    def _table(self, first: int) -> np.ndarray:
        if first != self.first:
            self.first, self.table = first, self.model.dense(first, first + BLOCK)
        return self.table

    def _learn(self, words: list[str]) -> None:
        edges = self.lattices.edges(words)
        at = np.arange(len(words)), [len(word) for word in words]
        logs = [np.log(forward(edges, len(words), self._table(first))[at]) for first in range(0, len(self.model.langs), BLOCK)]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.logs = np.concatenate((self.logs, np.concatenate(logs, axis=1)))

    def _sums(self, each: list[list[str]]) -> list[np.ndarray]:
        """Log probabilities of some texts' words in all languages."""
        n = len(self.model.langs)
        fresh = list({word for words in each for word in words}.difference(self.place))
        if n * len(fresh) > MAX_REMEMBERED and sum(map(len, each)) > 1:
            # halves of the texts, or of the one text that there is
            self.forget()
            if len(each) > 1:
                return self._sums(each[: len(each) // 2]) + self._sums(each[len(each) // 2:])
            half = len(each[0]) // 2
            return [self._sums([each[0][:half]])[0] + self._sums([each[0][half:]])[0]]
        if (len(self.place) + 1) * n > MAX_REMEMBERED:
            self.forget()
            fresh = list({word for words in each for word in words})
        for first in range(0, len(fresh), 4096):
            self._learn(fresh[first: first + 4096])
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(each)), np.int64, sum(map(len, each)))
        ends = np.cumsum([len(words) for words in each])
        return [self.logs[places[end - len(words): end]].sum(axis=0) for words, end in zip(each, ends, strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability given that it is one of those known."""
        each = [letter_words(text) for text in texts]
        if not self.model.langs:
            return [UNDETERMINED] * len(each), [0.0] * len(each)
        langs, scores = [], []
        for words, logs in zip(each, self._sums(each), strict=True):
            if not words:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            sums = np.log(self.model.priors) + logs
            best = int(np.argmax(sums))
            langs.append(self.model.langs[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        return langs, scores


def language_column(model: Model, pieces: list[str], text: Column) -> Column:
    """Language and probability of a text, as one struct."""
    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model, pieces)
        for batch in batches:
            langs, scores = [], []
            for first in range(0, len(batch), 256):
                some = scorer.predict(batch.slice(first, 256).to_pylist())
                langs += some[0]
                scores += some[1]
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=list(_OWN))

    return predicted(text.cast("string"))


def with_language(docs: DataFrame, model: Model, pieces: list[str], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every document, from its whole text alone; nothing is shuffled.

    Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if the model knows
    no language; ties go to the language that sorts first; copies of a row each get their own result; columns named
    like the added ones are replaced; an empty table gives an empty result.
    """
    columns = [named(c) for c in kept_columns(docs, _OWN)]
    found = docs.select(*columns, language_column(model, pieces, named(text)).alias("_language"))
    return found.select(*columns, *[F.col("_language")[c].alias(c) for c in _OWN])
