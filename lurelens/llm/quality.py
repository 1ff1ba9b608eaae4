"""Quality rules: base counts per document, and the divergence of its histograms from references of languages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import SPACE, kept_columns, named, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Words a document must have before the histogram of its words is judged, characters before that of its classes is.
MIN_WORDS_JUDGED = 100
MIN_CHARS_JUDGED = 200
#: A language needs this share of the labelled documents or this many words to be a reference.
MIN_LANGUAGE_SHARE = 0.01
MIN_REFERENCE_WORDS = 1000
#: A script is a document's, or a language's, if this share of its characters but white space, or of its documents, has it.
MIN_SCRIPT_SHARE = 0.5
MIN_SCRIPT_DOCS = 0.1
COMMON_WORDS = 100
#: A word needs this share of all words of its language to be common.
MIN_WORD_SHARE = 0.001
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is unlike every reference.
MAX_CLASS_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.55
_FLUSH = 200_000
_ROWS = 256

CLASSES = (
    "lower", "upper", "digit", "space", "line_end", "stop", "mark", "symbol", "control", "latin_lower", "latin_upper", "other",
)
_OWN = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
    "word_distance", "nearest", "kept",
)
_RESULT_SQL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "class_distance double, word_distance double, nearest string, kept boolean"
)
_RESULT = pa.struct([
    *[(name, pa.int64()) for name in _OWN[:5]], ("base_failed", pa.bool_()), ("class_distance", pa.float64()),
    ("word_distance", pa.float64()), ("nearest", pa.string()), ("kept", pa.bool_()),
])


@dataclass(frozen=True)
class Reference:
    """What documents of one language look like: shares of character classes, and of its common words among all words."""

    lang: str
    classes: tuple[float, ...]
    words: tuple[tuple[bytes, float], ...]
    #: Scripts that its documents are written in.
    scripts: tuple[str, ...] = ()


def _class_table() -> np.ndarray:
    """The class of each code point below 0x250; all others are ``other``."""
    def name(c: str) -> str:
        if c == "\n":
            return "line_end"
        if c in SPACE:
            return "space"
        if c in ".,;:!?'\"-()":
            return "stop" if c in ".,;:!?" else "mark"
        if ord(c) < 32 or 127 <= ord(c) < 160:
            return "control"
        if c.isdigit():
            return "digit"
        if c.isalpha():
            return ("" if ord(c) < 128 else "latin_") + ("upper" if c.isupper() else "lower")
        return "symbol"

    return np.array([CLASSES.index(name(chr(i))) for i in range(0x250)] + [CLASSES.index("other")], np.uint8)


_CLASS_OF = _class_table()


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class a text has."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(_CLASS_OF[np.minimum(points, 0x250)], minlength=len(CLASSES))


#: First code points of runs of letters outside Latin, and their scripts; "" is none.
_SCRIPTS = (
    (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"),
    (0x780, "thaana"), (0x7C0, "nko"), (0x800, ""), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"),
    (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2DE0, "cyrillic"), (0x2E00, ""),
    (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xA640, "cyrillic"), (0xA6A0, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, ""), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0x20000, "han"), (0x32000, ""),
)
_SCRIPT_STARTS = np.array([0, *[first for first, _ in _SCRIPTS]], np.uint32)
_SCRIPT_NAMES = ("", *[name for _, name in _SCRIPTS])
_LATIN = [CLASSES.index(c) for c in ("lower", "upper", "latin_lower", "latin_upper")]
_WHITE = [CLASSES.index(c) for c in ("space", "line_end")]


def script_of(classes: np.ndarray, text: str) -> str | None:
    """The script that most characters of a text have, white space left out; none if they have several or are no letters."""
    least = MIN_SCRIPT_SHARE * (classes.sum() - classes[_WHITE].sum())
    if least <= 0:
        return None
    if classes[_LATIN].sum() >= least:
        return "latin"
    if classes[CLASSES.index("other")] < least:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts: Counter = Counter()
    for at, n in enumerate(np.bincount(np.searchsorted(_SCRIPT_STARTS, points[points >= 0x250], side="right") - 1)):
        counts[_SCRIPT_NAMES[at]] += int(n)
    del counts[""]
    name, most = max(counts.items(), key=lambda x: x[1], default=(None, 0))
    return name if most >= least else None


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text; all 0 for null."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), _repeated_words(words),
    )


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of three words found twice or more."""
    if len(words) < 4:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    mixed = np.sort(hashes[:-2] * 1_000_003 + hashes[1:-1] * 998_244_353 + hashes[2:])
    if (mixed[1:] != mixed[:-1]).all():
        return 0  # equal runs would have equal sums
    numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, runs, counts = np.unique(pairs[:-1] * np.int64(len(numbers)) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[runs] > 1
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift: shift + len(twice)] |= twice
    return int(hit.sum())


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from the histogram ``q``: the root of the divergence in bits, 0 for
    equal and 1 for disjoint histograms."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1) for x in (p, np.broadcast_to(q, p.shape))) / 2
    return np.sqrt(np.maximum(bits, 0.0))


def with_rest(shares: np.ndarray) -> np.ndarray:
    """Shares of some words, and behind them that of all other words."""
    return np.concatenate((shares, np.maximum(0.0, 1 - shares.sum(axis=-1, keepdims=True))), axis=-1)


class Judge:
    """Counts of texts, their distances to every reference, and the verdicts."""

    def __init__(self, references: list[Reference]) -> None:
        self.langs = [r.lang for r in references]
        self.scripts = {script for r in references for script in r.scripts}
        self.classes = [np.array(r.classes) for r in references]
        #: One column for each word that is common in any reference.
        self.column = {word: i for i, word in enumerate(dict.fromkeys(w for r in references for w, _ in r.words))}
        self.words = [
            (np.array([self.column[w] for w, _ in r.words], np.int64), with_rest(np.array([s for _, s in r.words])))
            for r in references
        ]

    def results(self, texts: list[str | None]) -> pa.StructArray:
        n = len(texts)
        known = np.ones(n, bool)
        base = np.array([base_counts(text) for text in texts], np.int64).reshape(n, 5)
        classes, words = np.zeros((n, len(CLASSES))), np.zeros((n, len(self.column)))
        for i, text in enumerate(texts):
            if text and self.langs:
                classes[i] = class_counts(text)
                script = script_of(classes[i], text)
                known[i] = script is None or script in self.scripts
                for word, count in Counter(lower_words(text)).items():
                    if (at := self.column.get(word)) is not None:
                        words[i, at] = count
        n_words, chars = base[:, 0], classes.sum(axis=1)
        failed = (n_words < MIN_WORDS) | (100 * base[:, 4] > 50 * n_words)
        classes /= np.maximum(chars, 1)[:, None]
        words /= np.maximum(n_words, 1)[:, None]
        by_class = self._nearest([divergence(classes, q) for q in self.classes], known & (chars >= MIN_CHARS_JUDGED))
        by_word = self._nearest([divergence(with_rest(words[:, own]), q) for own, q in self.words], known & (n_words >= MIN_WORDS_JUDGED))
        far = (np.nan_to_num(by_class[0]) > MAX_CLASS_DISTANCE) | (np.nan_to_num(by_word[0]) > MAX_WORD_DISTANCE)
        return pa.StructArray.from_arrays([
            *[pa.array(base[:, i]) for i in range(5)], pa.array(failed),
            pa.array(by_class[0], mask=np.isnan(by_class[0])), pa.array(by_word[0], mask=np.isnan(by_word[0])),
            pa.array([self.langs[i] if i >= 0 else None for i in by_word[1]], pa.string()), pa.array(~failed & ~far),
        ], fields=list(_RESULT))

    def _nearest(self, distances: list[np.ndarray], judged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least distance and its reference; not a number and -1 for texts that are not judged."""
        if not distances:
            return np.full(len(judged), np.nan), np.full(len(judged), -1)
        each = np.stack(distances)
        return np.where(judged, each.min(axis=0), np.nan), np.where(judged, each.argmin(axis=0), -1)


def lower_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def language_references(docs: DataFrame, lang: str = "lang", text: str = "text") -> list[Reference]:
    """References of the languages named in the table, counted over all its documents.

    Every document with a language and a text counts, in whole. Most words are rare, so they are counted in two scans.
    In the first, tasks sum what they have read and hand on words that are common there; the sums fall short of the
    truth by a tenth of ``MIN_WORD_SHARE`` at most, so they show every word that can be common. The second counts
    these exactly. A language needs ``MIN_REFERENCE_WORDS`` words, or ``MIN_LANGUAGE_SHARE`` of the documents, and a word
    ``MIN_WORD_SHARE`` of its language's words, which bounds what reaches the driver for each language.
    """
    source = docs.select(named(lang).cast("string").alias("lang"), named(text).cast("string").alias("text")).where(
        "lang is not null and text is not null")
    schema = "lang string, kind string, name string, n long"
    sums = stored(source.mapInArrow(_common_words, schema).groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")), "words")
    totals = sums.where("kind <> 'word'").groupBy("lang").agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in ("docs", "words")])
    large = [row["lang"] for row in _largest(totals)]
    if not large:
        return []
    words = sums.where(F.col("kind") == "word").join(totals, "lang").where(
        F.col("lang").isin(large) & (F.col("n") >= 0.9 * MIN_WORD_SHARE * F.col("words")))
    candidates: dict[str, set[bytes]] = {name: set() for name in large}
    for row in words.select("lang", "name").collect():
        candidates[row["lang"]].add(row["name"].encode())
    exact = source.where(F.col("lang").isin(large)).mapInArrow(lambda batches: _exact(batches, candidates), schema)
    found = {name: {"class": {}, "word": {}, "words": {"": 0}, "script": {}} for name in large}
    for row in exact.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")).collect():
        found[row["lang"]][row["kind"]][row["name"]] = row["n"]
    return [_reference(name, **parts) for name, parts in sorted(found.items())]


def _largest(totals: DataFrame) -> list:
    """Languages with enough words or their share of the documents."""
    documents = totals.agg(F.sum("docs")).first()[0] or 0
    return totals.where((F.col("words") >= MIN_REFERENCE_WORDS) | (F.col("docs") >= MIN_LANGUAGE_SHARE * documents)).select("lang").collect()


def _reference(lang: str, **parts: dict[str, int]) -> Reference:
    chars, words = max(1, sum(parts["class"].values())), max(1, parts["words"][""])
    common = sorted(((w, n / words) for w, n in parts["word"].items() if n >= MIN_WORD_SHARE * words), key=lambda x: (-x[1], x[0]))
    return Reference(
        lang, tuple(parts["class"].get(c, 0) / chars for c in CLASSES),
        tuple((word.encode(), share) for word, share in common[:COMMON_WORDS]),
        tuple(s for s, n in sorted(parts["script"].items()) if n >= MIN_SCRIPT_DOCS * sum(parts["script"].values())))


def _counted(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[i], pa.string() if i < 3 else pa.int64()) for i in range(4)], names=["lang", "kind", "name", "n"])


def _common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that are common in what was read since the last output, which comes whenever ``_FLUSH`` words are known."""
    documents: Counter = Counter()
    words: dict[str, Counter] = {}

    def flushed() -> pa.RecordBatch:
        rows = [(lang, "docs", "", n) for lang, n in documents.items()]
        for lang, each in words.items():
            total = each.total()
            rows.append((lang, "words", "", total))
            rows += [(lang, "word", w.decode("utf-8", "replace"), n) for w, n in each.items() if n >= MIN_WORD_SHARE / 10 * total]
        documents.clear()
        words.clear()
        return _counted(rows)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            documents[lang] += 1
            words.setdefault(lang, Counter()).update(lower_words(text))
            if sum(map(len, words.values())) > _FLUSH:
                yield flushed()
    yield flushed()


def _exact(batches: Iterator[pa.RecordBatch], candidates: dict[str, set[bytes]]) -> Iterator[pa.RecordBatch]:
    """Classes, scripts, words, and each candidate word of a language, summed over the whole task."""
    classes = {lang: np.zeros(len(CLASSES), np.int64) for lang in candidates}
    total: Counter = Counter()
    scripts: Counter = Counter()
    found: dict[str, Counter] = {lang: Counter() for lang in candidates}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            classes[lang] += (own := class_counts(text))
            if (script := script_of(own, text)) is not None:
                scripts[lang, script] += 1
            words = lower_words(text)
            total[lang] += len(words)
            found[lang].update(filter(candidates[lang].__contains__, words))
    rows = [(lang, "class", c, n) for lang, each in classes.items() for c, n in zip(CLASSES, each.tolist(), strict=True) if n]
    rows += [(lang, "script", script, n) for (lang, script), n in scripts.items()]
    rows += [(lang, "words", "", n) for lang, n in total.items()]
    rows += [(lang, "word", w.decode(), n) for lang, each in found.items() for w, n in each.items()]
    yield _counted(rows)


def quality_column(references: list[Reference], text: Column) -> Column:
    """All counts, distances and the verdict of a text, as one struct."""
    @F.arrow_udf(_RESULT_SQL)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = Judge(references)
        for batch in texts:
            parts = []
            # one count for each row and common word, so fewer rows at a time where there are many references
            some = max(1, min(_ROWS, 4_000_000 // max(1, len(judged.column))))
            for first in range(0, len(batch), some):
                parts.append(judged.results(batch.slice(first, some).to_pylist()))
            yield pa.concat_arrays(parts) if parts else pa.array([], _RESULT)

    return judge(text.cast("string"))


def with_quality(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Add counts, distances to the nearest reference and the verdict to every document.

    Base rules: a document fails with under 50 words, or if more than half of its words lie in runs of three words that
    it has twice or more. ``kept`` is false for these, and for documents whose character classes or common words are
    far from those of every language of the table. Distances are null, and don't count, for texts too short to be
    judged (under 200 characters, under 100 words), for texts in a script that no reference is written in, and where no
    document has a language. Only the base rules decide on these.

    Defined results: null and empty texts have no words and fail; copies of a row each get their own result; a
    document's own language label plays no part in its verdict; columns named like the added ones are replaced. An
    empty table gives an empty result.
    """
    references = language_references(docs, lang, text)
    columns = [named(c) for c in kept_columns(docs, _OWN)]
    judged = docs.select(*columns, quality_column(references, named(text)).alias("_quality"))
    return judged.select(*columns, *[F.col("_quality")[c].alias(c) for c in _OWN])


def good_documents(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Documents that pass, with the columns they came with."""
    references = language_references(docs, lang, text)
    judged = docs.select(F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row"), quality_column(references, named(text)).alias("quality"))
    return judged.where("quality.kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
