"""Whole graphs as nested JSON documents, one per target, written from sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The sections of a document; lists and single objects.
_SECTIONS = (("target", False), ("states", True), ("transitions", True), ("evidence", True), ("verdict", False))
PIECE_CHARS = 1 << 20


class _Document:
    """One document while its rows come in, cut into pieces of text."""

    def __init__(self, target: str) -> None:
        self.target, self.texts, self.size, self.part, self.section, self.count = target, ["{"], 1, 0, -1, 0

    def _put(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)

    def _close_section(self) -> None:
        if _SECTIONS[self.section][1]:
            self._put("]")
        elif not self.count:
            self._put("null")

    def go_to(self, section: int) -> None:
        while self.section < section:
            if self.section >= 0:
                self._close_section()
            self.section, self.count = self.section + 1, 0
            name, many = _SECTIONS[self.section]
            self._put(("," if self.section else "") + f'"{name}":' + ("[" if many else ""))

    def add(self, section: int, body: str) -> None:
        self.go_to(section)
        if _SECTIONS[section][1] or not self.count:
            self._put(("," if self.count else "") + body)
            self.count += 1

    def close(self) -> None:
        self.go_to(len(_SECTIONS) - 1)
        self._close_section()
        self._put("}")

    def piece(self) -> tuple[str, int, str]:
        found = (self.target, self.part, "".join(self.texts))
        self.texts, self.size, self.part = [], 0, self.part + 1
        return found


def _batch(pieces: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p in pieces], pa.string()), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.string()),
    ], names=["target_id", "part", "text"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    document, pieces, size = None, [], 0
    for batch in batches:
        for target, section, body in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if document is None or document.target != target:
                if document is not None:
                    document.close()
                    pieces.append(document.piece())
                document = _Document(target)
            document.add(section, body)
            if document.size >= PIECE_CHARS:
                pieces.append(document.piece())
            if pieces and (size := size + len(pieces[-1][2])) >= PIECE_CHARS:
                yield _batch(pieces)
                pieces, size = [], 0
    if document is not None:
        document.close()
        pieces.append(document.piece())
    yield _batch(pieces)


def graph_documents(rows: DataFrame) -> DataFrame:
    """Documents from the rows of ``graph_rows``: ``target_id, part, text``.

    A document is ``{"target":..,"states":[..],"transitions":[..],"evidence":[..],"verdict":..}``, children in their order;
    a missing target or verdict is null. The rows of a target are sorted and read as a stream by one task, which
    holds no more than a piece of about a million characters: the texts of all parts of a target, in their order,
    are its document. All but very large graphs have one part.
    """
    ordered = rows.where("target_id is not null").repartitionByRange("target_id").sortWithinPartitions("target_id", "section", "sort_key", "body")
    return ordered.select(ordered["target_id"].cast("string"), "section", "body").mapInArrow(_documents, "target_id string, part int, text string")


def write_documents(documents: DataFrame, path: str) -> None:
    """Write documents as text files of JSON; a document of several parts goes over as many lines, in order, in one file."""
    order = ["target_id", "part"]
    documents.repartitionByRange("target_id").sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)
