"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised words."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import kept_columns, named

WINDOW = 10
#: Normalised bytes of items for one automaton; a larger benchmark is dealt to several.
MAX_AUTOMATON_BYTES = 16_000_000

#: Lower case for A-Z, a blank for every other byte that is no part of a word, all else as it is.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_OWN = ("n_words", "items", "hits", "spans")
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.struct([
    ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.int64())), ("spans", pa.list_(_SPAN)),
])
_RESULT_SQL = "n_words long, items array<string>, hits array<long>, spans array<struct<start: long, end: long>>"

Item = tuple[str | None, bytes]


def normalised(text: str | None) -> bytes:
    """Words of a text, lower-cased, parted and enclosed by single blanks; only a blank if there are none."""
    words = (text or "").encode("utf-8", "replace").translate(_NORMAL).split()
    return b" " + b"".join(word + b" " for word in words)


def item_windows(words: list[bytes], window: int) -> list[bytes]:
    """Runs of ``window`` words, each enclosed by blanks; one run of all words if there are fewer."""
    runs = [words[i: i + window] for i in range(max(1, len(words) - window + 1))] if words else []
    return [b" " + b" ".join(run) + b" " for run in runs]


class Scanner:
    """All windows of some items in one automaton."""

    def __init__(self, items: list[Item], window: int) -> None:
        owners: dict[bytes, set[str]] = {}
        for item, flat in items:
            for pattern in item_windows(flat.split(), window):
                owners.setdefault(pattern, set()).update(() if item is None else (item,))
        self.owners = list(owners.values())
        self.automaton = ahocorasick.Automaton()
        for number, pattern in enumerate(owners):
            self.automaton.add_word(pattern.decode("latin-1"), (number, pattern.count(b" ") - 1))
        self.automaton.make_automaton()

    def result(self, text: str | None) -> dict:
        """Words, items found, numbers of the hit words and the bytes of the original that they cover."""
        flat = normalised(text)
        out = {"n_words": flat.count(b" ") - 1, "items": [], "hits": [], "spans": []}
        matches = list(self.automaton.iter(flat.decode("latin-1"))) if self.owners else []
        if matches:
            blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
            after = np.searchsorted(blanks, [end for end, _ in matches])  # the word that follows the match
            cover = np.zeros(out["n_words"] + 1, np.int64)
            lengths = np.array([length for _, (_, length) in matches])
            np.add.at(cover, after - lengths, 1)
            np.add.at(cover, after, -1)
            hits = np.flatnonzero(np.cumsum(cover) > 0)
            items = set().union(*(self.owners[number] for number in {number for _, (number, _) in matches}))
            out |= {"items": sorted(items), "hits": hits.tolist(), "spans": _spans(text, hits)}
        return out


def _spans(text: str, hits: np.ndarray) -> list[dict[str, int]]:
    """Bytes of the original text from the first to the last word of each run of hit words."""
    word = np.frombuffer(text.encode("utf-8", "replace").translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    first = np.flatnonzero(np.diff(hits, prepend=-2) > 1)
    last = np.append(first[1:], len(hits)) - 1
    return [{"start": a, "end": b} for a, b in zip(starts[hits[first]].tolist(), ends[hits[last]].tolist(), strict=True)]


def _scan_column(text: Column, items: list[Item], window: int) -> Column:
    @F.arrow_udf(_RESULT_SQL)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(items, window)
        for batch in texts:
            yield pa.array([scanner.result(text.as_py()) for text in batch], _RESULT)

    return scan(text)


def benchmark_hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", max_bytes: int = MAX_AUTOMATON_BYTES,
) -> DataFrame:
    """Add what benchmark windows occur in each document; rows stay where they are, nothing is shuffled.

    Adds ``n_words``, ``items`` (ids as strings, sorted), ``hits`` (numbers of hit words, from 0) and ``spans`` (their
    bytes in the UTF-8 text). A window is ``window`` consecutive words of an item; an item of fewer words is one
    window. The items are the stated query set: they travel to every task, in one automaton for up to ``max_bytes`` of
    normalised text and in several beyond it, whose findings are united per document.

    Defined results: null or wordless texts have no words and no hits; items without words match nothing; a null item
    id marks words but names no item; items of equal id count once; copies of a row each get their own result; columns
    of the input named like the added ones are replaced.
    """
    blocks: list[list[Item]] = [[]]
    size = 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        flat = normalised(row[1])
        if size and size + len(flat) > max_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], flat))
        size += len(flat)
    columns = [named(c) for c in kept_columns(docs, _OWN)]
    found = [_scan_column(named(text).cast("string"), block, window) for block in blocks]
    if len(found) == 1:
        return docs.select(*columns, found[0].alias("_found")).select(*columns, *[F.col("_found")[c].alias(c) for c in _OWN])
    scanned = docs.select(*columns, F.array(*found).alias("_found"))
    united = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda x: x[field]))))
    return scanned.select(*columns, F.col("_found")[0]["n_words"].alias("n_words"), *[united(c).alias(c) for c in _OWN[1:]])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The digest of ``benchmark_hits``: counts, the SHA-256 of the comma-joined item ids, and the verdict."""
    hits = benchmark_hits(docs.select(named(key).alias("doc_id"), named(options.get("text", "text"))), items, **options)
    return hits.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents in which no window occurs, with the columns they came with."""
    marked = docs.withColumn("_row", F.struct(*[named(c).alias(c) for c in docs.columns])).select("_row", named(options.get("text", "text")))
    hits = benchmark_hits(marked, items, **options).where(F.size("hits") == 0)
    return hits.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
