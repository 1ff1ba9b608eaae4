"""Word-piece counts by a linear longest-match automaton that never builds the pieces."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import kept_columns, named

#: Distinct words a task remembers before it starts anew.
MAX_REMEMBERED = 300_000
_OWN = ("n_words", "n_tokens", "n_unknown")
_RESULT = pa.struct([(name, pa.int64()) for name in _OWN])


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a public vocabulary file with a base64 piece and its rank in each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """A trie of pieces. Where a node has no way on, the pieces that are certain by then are popped: ``pops`` says how
    many, ``fail`` where matching goes on, none if no pieces can spell what was read."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.ways: list[dict[int, int]] = [{}]
        ends = set()
        for piece in pieces:
            node = 0
            for byte in piece:
                step = self.ways[node].get(byte)
                if step is None:
                    step = self.ways[node][byte] = len(self.ways)
                    self.ways.append({})
                node = step
            ends.add(node)
        self.fail: list[int | None] = [None] * len(self.ways)
        self.pops = [0] * len(self.ways)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in self.ways[node].items():
                    self._link(node, byte, child, child in ends)
                    below.append(child)
            level = below

    def _link(self, node: int, byte: int, child: int, is_piece: bool) -> None:
        if is_piece:
            self.fail[child], self.pops[child] = 0, 1
            return
        at, popped = self.fail[node], self.pops[node]
        while at is not None and byte not in self.ways[at]:
            popped += self.pops[at]
            at = self.fail[at]
        if at is not None:
            self.fail[child], self.pops[child] = self.ways[at][byte], popped

    def count(self, word: bytes) -> int | None:
        """How many pieces the longest match from left to right takes; none if it can't spell the word."""
        ways, fail, pops = self.ways, self.fail, self.pops
        node = popped = 0
        for byte in word:
            step = ways[node].get(byte)
            while step is None:
                at = fail[node]
                if at is None:
                    return None
                popped += pops[node]
                node = at
                step = ways[node].get(byte)
            node = step
        while node:
            at = fail[node]
            if at is None:
                return None
            popped += pops[node]
            node = at
        return popped


def with_token_counts(docs: DataFrame, pieces: list[bytes], before_word: bytes = b" ", text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_tokens`` and ``n_unknown`` to every document; nothing is shuffled.

    Words are parted by white space. A word is matched with ``before_word`` in front, by which the vocabulary marks
    pieces that begin a word; a word that the pieces cannot spell is one unknown token. Whole words are looked at once,
    byte by byte, in time linear in their length; counts of words seen before are remembered within a task.

    Defined results: null and blank texts have no words and no tokens; copies of a row each get their own result;
    columns named like the added ones are replaced; an empty table gives an empty result.
    """
    columns = [named(c) for c in kept_columns(docs, _OWN)]

    @F.arrow_udf("n_words long, n_tokens long, n_unknown long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(pieces)
        known: dict[bytes, int] = {}  # pieces of a word; 0 if unknown
        for batch in batches:
            rows: list[list[int]] = [[], [], []]
            for value in batch:
                words = (value.as_py() or "").encode("utf-8", "replace").split()
                if len(known) > MAX_REMEMBERED:
                    known.clear()
                for word in set(words).difference(known):
                    known[word] = automaton.count(before_word + word) or 0
                sizes = list(map(known.__getitem__, words))
                unknown = sizes.count(0)
                for column, n in zip(rows, (len(words), sum(sizes) + unknown, unknown), strict=True):
                    column.append(n)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in rows], fields=list(_RESULT))

    counts = docs.select(*columns, counted(named(text).cast("string")).alias("_counts"))
    return counts.select(*columns, *[F.col("_counts")[c].alias(c) for c in _OWN])
