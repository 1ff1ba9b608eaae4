"""Byte strings of a given length that occur earlier: repeated intervals of merged Burrows-Wheeler transforms.

One transform of all suffixes of a corpus would be one sorted list that every step passes over. Only suffixes that share
``width`` bytes matter here, and those can be told apart beforehand: each string of that length has an anchor, the
``GRAM`` bytes in it with the least hash, so equal strings have equal anchors. Consecutive strings with one anchor
position are a *stretch*. Stretches meet by anchor; a bucket of anchors is a closed collection of short texts, and its
suffixes never have to be compared with those of another bucket.

1. Stretches of all documents meet by anchor. Those whose whole bytes (by hash) stand earlier are repeated throughout;
   those whose anchor occurs with other bytes around it are candidates; all others cannot have a repeated string.
2. Bytes of the candidates are dealt to buckets. A shard is what one task sends to one bucket. Each shard has its own
   Burrows-Wheeler transform; those of a bucket are merged by refining their interleave, and the places where it
   splits are the common prefixes. Suffixes that are never split within ``width`` bytes are the repeated intervals.
3. An anchor that very many candidates share (a common line in unlike surroundings) cannot be one bucket. Its strings
   are grouped one by one instead, by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import Rolling, mixed, named, stored, text_blocks

WIDTH = 100
GRAM = 20
#: Stretches with unlike bytes around one anchor that a batch of rows reports; the rest become candidates unseen.
MAX_REPORTED = 8
#: Candidates of one anchor that go into one bucket; at least so many, and this share of all stretches.
MAX_BUCKETED, HOT_SHARE = 4096, 1e-6
#: Bytes of text behind one group of stretches, bytes of candidates in one bucket, and bytes a step looks at together.
GROUP_BYTES, BUCKET_BYTES, PIECE_BYTES = 32 << 20, 1 << 19, 1 << 20
#: Bytes that are one letter of the transforms' alphabet: 8, doubled a few times.
BLOCK = 32
_FIRST = -(1 << 63)
_POSITION = np.uint64((1 << 21) - 1)
_REPEATED, _CANDIDATE = 1, 2


# --- stretches -------------------------------------------------------------------------------------------------------


def _least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every ``size`` consecutive values."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[size - 1: size - 1 + n])


def _stretches_of_piece(data: np.ndarray, offsets: np.ndarray, width: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, anchor and hash of the bytes of every stretch in at most 2 MB of rows."""
    lengths = np.diff(offsets)
    fits = lengths >= width
    if len(data) < width or not fits.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    least = _least_in_windows((grams & ~_POSITION) | at.astype(np.uint64), width - GRAM + 1)
    valid = np.zeros(len(data) + 1, np.int8)
    valid[offsets[:-1][fits]] += 1
    valid[offsets[1:][fits] - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid[: len(least)]))
    anchors = (least[starts] & _POSITION).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    first, counts = starts[heads], np.diff(np.append(heads, len(starts)))
    hashes = rolling.of(first, first + counts + width - 1)
    rows = np.searchsorted(offsets, first, side="right") - 1
    # rows without bytes share an offset; the last of equal offsets is the row that has the byte
    return rows, first - offsets[rows], counts, grams[anchors[heads]], hashes


def _pieces(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Bytes of rows in pieces: rows, where in the row each begins, bytes, offsets. A very long row is cut so that every
    string of ``width`` bytes starts in one piece and lies in it whole."""
    for first, end, data, offsets in text_blocks(column, PIECE_BYTES):
        if len(data) <= 2 * PIECE_BYTES - width:
            yield np.arange(first, end), 0, data, offsets
            continue
        for base in range(0, len(data) - width + 1, PIECE_BYTES):  # this is a single row
            part = data[base: base + PIECE_BYTES + width - 1]
            yield np.array([first]), base, part, np.array([0, len(part)])


def _stretches(column: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Stretches of all rows of a batch, in the order of rows and starts."""
    found = [[] for _ in range(5)]
    for rows, base, data, offsets in _pieces(column, width):
        row, first, counts, anchors, hashes = _stretches_of_piece(data, offsets, width)
        for out, values in zip(found, (rows[row], first + base, counts, anchors, hashes), strict=True):
            out.append(values)
    empty = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, empty, strict=True))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the group of each, and the first place of each group."""
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def _later(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Entries whose key stands at a smaller ``(doc, start)`` too."""
    order = np.argsort(keys, kind="stable")
    group, heads = _groups(keys[order])
    sizes = np.diff(np.append(heads, len(keys)))
    out = np.zeros(len(keys), bool)
    several = order[sizes[group] > 1]
    if len(several):
        by = several[np.lexsort((starts[several], docs[several], keys[several]))]
        group, heads = _groups(keys[by])
        lead = by[heads][group]
        out[by] = (docs[by] != docs[lead]) | (starts[by] != starts[lead])
    return out


_MEETING = "bucket int, docs binary, versions binary, counts binary, kinds binary, starts binary, sizes binary, anchors binary, hashes binary"
_PACKED_FLAGS = "part int, docs binary, versions binary, counts binary, kinds binary, starts binary, sizes binary, anchors binary"
_FLAGS = "doc long, version long, kinds binary, starts binary, sizes binary, anchors binary"


def _reports(batches: Iterator[pa.RecordBatch], n_buckets: int, width: int, max_reported: int) -> Iterator[pa.RecordBatch]:
    """What one batch of documents knows of its stretches, packed per bucket of anchors.

    Kind 0 asks the others. Kind 1, a copy of a stretch in this batch, and kind 2, one of many round its anchor, are
    settled and travel only to be handed on, in any bucket.
    """
    for batch in batches:
        docs, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row, starts, sizes, anchors, hashes = _stretches(batch.column(2), width)
        kinds = np.where(_later(hashes, docs[row], starts), _REPEATED, 0).astype(np.int8)
        asks = np.flatnonzero(kinds == 0)
        order = asks[np.argsort(anchors[asks], kind="stable")]
        group, heads = _groups(anchors[order])
        place = np.arange(len(order)) - heads[group] if len(order) else order
        kinds[order[place >= max_reported]] = _CANDIDATE
        bucket = (anchors % np.uint64(n_buckets)).astype(np.int64)
        settled = kinds != 0
        bucket[settled] = (mixed(docs[row[settled]].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[k]: bounds[k + 1]]
            _, heads = _groups(row[own])
            at = row[own][heads]
            asking = kinds[own] == 0
            yield _packed(k, docs[at], versions[at], np.diff(np.append(heads, len(own))).astype(np.int32), kinds[own],
                          starts[own].astype(np.int32), sizes[own].astype(np.int8), anchors[own][kinds[own] != _REPEATED], hashes[own][asking])


def _packed(bucket: int, *arrays: np.ndarray) -> pa.RecordBatch:
    names = [part.split()[0] for part in _MEETING.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=names)


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column]) if len(column) else np.zeros(0, kind)


def _meet(frame: pd.DataFrame, n_parts: int) -> pd.DataFrame:
    """Settle the stretches of one bucket of anchors."""
    counts = _joined(frame["counts"], np.int32)
    docs = np.repeat(_joined(frame["docs"], np.int64), counts)
    versions = np.repeat(_joined(frame["versions"], np.int64), counts)
    kinds, starts, sizes = _joined(frame["kinds"], np.int8).copy(), _joined(frame["starts"], np.int32), _joined(frame["sizes"], np.int8)
    anchors = np.zeros(len(kinds), np.uint64)
    anchors[kinds != _REPEATED] = _joined(frame["anchors"], np.uint64)
    asks = np.flatnonzero(kinds == 0)
    hashes = _joined(frame["hashes"], np.uint64)
    later = _later(hashes, docs[asks], starts[asks])
    kinds[asks[later]] = _REPEATED
    rest, its_hash = asks[~later], hashes[~later]
    order = np.lexsort((its_hash, anchors[rest]))
    group, heads = _groups(anchors[rest][order])
    # equal bytes that are left are of equal keys and starts, so none is earlier
    fresh = np.concatenate(([True], its_hash[order][1:] != its_hash[order][:-1]))[: len(order)]
    fresh[heads] = True
    unlike = np.bincount(group[fresh], minlength=len(heads))
    kinds[rest[order[(unlike > 1)[group]]]] = _CANDIDATE
    said = np.flatnonzero(kinds)
    return _packed_flags(docs[said], versions[said], kinds[said], starts[said], sizes[said], anchors[said], n_parts)


def _packed_flags(
    docs: np.ndarray, versions: np.ndarray, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, n_parts: int,
) -> pd.DataFrame:
    """What is known of stretches, one row for each part of the documents."""
    part = (mixed(docs.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    order = np.lexsort((starts, versions, docs, part))
    part, docs, versions, kinds, starts, sizes, anchors = (x[order] for x in (part, docs, versions, kinds, starts, sizes, anchors))
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (versions[1:] != versions[:-1])
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.append(heads, len(docs)))
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(docs)) if len(docs) else [0]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = slice(*np.searchsorted(heads, (a, b)))
        own = slice(a, b)
        rows.append((
            int(part[a]), docs[heads[some]].tobytes(), versions[heads[some]].tobytes(), counts[some].astype(np.int32).tobytes(),
            kinds[own].astype(np.int8).tobytes(), starts[own].astype(np.int32).tobytes(), sizes[own].astype(np.int8).tobytes(),
            anchors[own][kinds[own] == _CANDIDATE].tobytes()))
    return pd.DataFrame(rows, columns=[name.split()[0] for name in _PACKED_FLAGS.split(", ")])


def _by_document(frame: pd.DataFrame) -> pd.DataFrame:
    """All that is known of the stretches of each document of one part, in one row."""
    counts = _joined(frame["counts"], np.int32)
    docs = np.repeat(_joined(frame["docs"], np.int64), counts)
    versions = np.repeat(_joined(frame["versions"], np.int64), counts)
    kinds, starts, sizes = _joined(frame["kinds"], np.int8), _joined(frame["starts"], np.int32), _joined(frame["sizes"], np.int8)
    anchors = np.zeros(len(kinds), np.uint64)
    anchors[kinds == _CANDIDATE] = _joined(frame["anchors"], np.uint64)
    order = np.lexsort((versions, docs))
    docs, versions, kinds, starts, sizes, anchors = (x[order] for x in (docs, versions, kinds, starts, sizes, anchors))
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (versions[1:] != versions[:-1])
    cuts = np.append(np.flatnonzero(fresh), len(docs)).tolist()
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = slice(a, b)
        rows.append((docs[a], versions[a], kinds[own].tobytes(), starts[own].tobytes(), sizes[own].tobytes(), anchors[own][kinds[own] == _CANDIDATE].tobytes()))
    return pd.DataFrame(rows, columns=[name.split()[0] for name in _FLAGS.split(", ")])


# --- merged transforms -----------------------------------------------------------------------------------------------


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of codes below 2 ** 32 by two passes over 16 bits each, one if they fit."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if len(codes) and int(codes.max()) > 0xFFFF:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _words(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number of the same order; nought beyond the end of its text."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k: len(data) + k] << np.uint64(56 - 8 * k)
    left = ends - np.arange(len(data))
    short = np.flatnonzero(left < 8)
    out[short] &= ~((np.uint64(1) << (8 * (8 - left[short])).astype(np.uint64)) - np.uint64(1))
    return out


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the distinct ones."""
    order = np.argsort(keys)
    differ = np.zeros(len(keys), bool)
    differ[1:] = (ordered := keys[order])[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(differ)
    return out


def _longer(numbers: np.ndarray, further: np.ndarray, reach: int, ends: np.ndarray) -> np.ndarray:
    """Numbers of what stands at each place and ``reach`` bytes on; the end of a text comes before all else."""
    ahead = np.zeros(len(numbers), np.int64)
    ahead[:-reach] = further[reach:] + np.int64(1)
    ahead[np.arange(len(numbers)) + reach >= ends] = 0
    return _numbers(numbers.astype(np.int64) * (int(further.max(initial=0)) + 2) + ahead)


class Shard:
    """Sorted suffixes of some texts, over an alphabet of blocks of ``BLOCK`` bytes.

    ``suffixes`` are places in sorted order; ``before`` is the transform: the block in front of each of them, by its
    number in the bucket's alphabet, -1 where the text has no whole block in front. ``last`` are the suffixes of which
    no other is left a block further on.
    """

    def __init__(self, firsts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, width: int) -> None:
        ranks, reach = blocks, BLOCK
        while reach < width:
            ranks = _longer(ranks, ranks, reach, ends)
            reach *= 2
        self.suffixes = np.argsort(ranks, kind="stable").astype(np.int32)
        source = self.suffixes - BLOCK
        self.before = np.where(source >= firsts[self.suffixes], blocks[source], -1)
        self.last = self.suffixes[self.suffixes + BLOCK >= ends[self.suffixes]]


def repeated_intervals(texts: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Merge the transforms of shards ``(bytes, offsets)``: for every place of all of them one after the other, the
    number of the interval of suffixes that share its next ``width`` bytes.

    The interleave starts out sorted by the first bytes, so few that the rest is whole blocks. Each round passes once
    over the transforms in the order of the interleave and deals their entries to the blocks in front, which sorts all
    suffixes by one more block. An interval splits where neighbours differ in that block, or were in unlike intervals
    before: there their common prefix ends. No shard is sorted again. Rounds end early when nothing splits any more.
    """
    data = np.concatenate([np.zeros(0, np.uint8), *[data for data, _ in texts]])
    if not len(data):
        return np.zeros(0, np.int64)
    bounds = np.cumsum([0, *[len(data) for data, _ in texts]])
    spans = [(a + offsets[:-1], np.diff(offsets)) for (_, offsets), a in zip(texts, bounds[:-1], strict=True)]
    lengths = np.concatenate([n for _, n in spans])
    firsts = np.repeat(np.concatenate([first for first, _ in spans]), lengths)
    ends = firsts + np.repeat(lengths, lengths)

    words = _words(data, ends)
    blocks, reach = _numbers(words), 8
    head = width % BLOCK or BLOCK
    heads = _numbers(words >> np.uint64(64 - 8 * min(8, head)))
    for at in range(8, head, 8):
        heads = _longer(heads, _numbers(words >> np.uint64(64 - 8 * min(8, head - at))), at, ends)
    while reach < BLOCK:
        blocks = _longer(blocks, blocks, reach, ends)
        reach *= 2
    shards = [Shard(firsts[a:b] - a, ends[a:b] - a, blocks[a:b], width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    of_shard = np.repeat(np.arange(len(shards), dtype=np.int32), np.diff(bounds))
    suffixes = np.concatenate([shard.suffixes + np.int32(a) for shard, a in zip(shards, bounds[:-1], strict=True)])
    before = np.concatenate([shard.before for shard in shards])
    last = np.concatenate([shard.last + np.int32(a) for shard, a in zip(shards, bounds[:-1], strict=True)])
    last_shard = np.repeat(np.arange(len(shards), dtype=np.int32), [len(shard.last) for shard in shards])

    heads = heads[suffixes]
    order = _stable_order(heads)
    interleave, interval = of_shard[order], _numbered(heads[order])
    for _ in range((width - head) // BLOCK):
        # the k-th entry of a shard in the interleave is the k-th entry of its transform
        front = np.empty(len(before), np.int32)
        front[_stable_order(interleave)] = before
        whole = np.flatnonzero(front >= 0)
        dealt = np.concatenate((blocks[last], front[whole]))
        order = _stable_order(dealt)
        came_from = np.concatenate((np.full(len(last), -1, np.int32), interval[whole]))[order]
        interleave = np.concatenate((last_shard, interleave[whole]))[order]
        split = _numbered(dealt[order], came_from)
        done = split[-1] == interval[-1]
        interval = split
        if done:
            break
    found = np.empty(len(before), np.int32)
    found[_stable_order(interleave)] = suffixes
    out = np.empty(len(before), np.int64)
    out[found] = interval
    return out


def _numbered(*sorted_keys: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal keys."""
    differ = np.zeros(len(sorted_keys[0]), bool)
    for keys in sorted_keys:
        differ[1:] |= keys[1:] != keys[:-1]
    return np.cumsum(differ, dtype=np.int32)


# --- candidates in buckets -------------------------------------------------------------------------------------------

_TEXTS, _STRINGS, _SETTLED = 0, 1, 2
_DEALT = "bucket int, kind int, docs binary, versions binary, starts binary, sizes binary, content binary"


def _dealt(batches: Iterator[pa.RecordBatch], n_buckets: int, hot: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Bytes of candidates, and the strings of those with a hot anchor by their hashes, packed per bucket."""
    names = [part.split()[0] for part in _DEALT.split(", ")]

    def row(bucket: int, kind: int, docs: np.ndarray, versions: np.ndarray, starts: np.ndarray, sizes: np.ndarray, content: bytes) -> pa.RecordBatch:
        binary = [docs, versions, starts.astype(np.int32), sizes.astype(np.int8)]
        return pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()),
            *[pa.array([x.tobytes()], pa.binary()) for x in binary], pa.array([content], pa.binary())], names=names)

    for batch in batches:
        found: list[list] = [[], [], [], [], [], []]
        for doc, version, text, kinds, starts, sizes, anchors in zip(*(batch.column(i) for i in range(7)), strict=True):
            data, chosen = text.as_py().encode("utf-8", "replace"), np.frombuffer(kinds.as_py(), np.int8) == _CANDIDATE
            starts, sizes = np.frombuffer(starts.as_py(), np.int32)[chosen], np.frombuffer(sizes.as_py(), np.int8)[chosen]
            anchors = np.frombuffer(anchors.as_py(), np.uint64)
            n = len(starts)
            ends = starts + sizes + (width - 1)
            parts = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for out, values in zip(found, (np.full(n, doc.as_py()), np.full(n, version.as_py()), starts, sizes, anchors, parts), strict=True):
                out.append(values)
        if not found[0]:
            continue
        docs, versions, starts, sizes, anchors = (np.concatenate(x) for x in found[:5])
        sizes = sizes.astype(np.int64)
        parts = [part for some in found[5] for part in some]
        is_hot = np.isin(anchors, hot)
        bucket = (mixed(anchors) % np.uint64(n_buckets)).astype(np.int64)
        order = np.flatnonzero(~is_hot)
        order = order[np.argsort(bucket[order], kind="stable")]
        bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[k]: bounds[k + 1]]
            yield row(k, _TEXTS, docs[own], versions[own], starts[own], sizes[own], b"".join([parts[i] for i in own.tolist()]))

        own = np.flatnonzero(is_hot)
        if not len(own):
            continue
        joined = np.frombuffer(b"".join([parts[i] for i in own.tolist()]), np.uint8)
        each = np.repeat(own, sizes[own])
        ahead = np.arange(len(each)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        bases = np.cumsum(sizes[own] + (width - 1)) - (sizes[own] + (width - 1))
        first = np.repeat(bases, sizes[own]) + ahead
        # two hashes with unlike values of bytes
        one, two = (Rolling(x).of(first, first + width) for x in (joined, joined ^ 0xFF))
        keys = one ^ mixed(two)
        its_doc, its_version, its_start = docs[each], versions[each], starts[each] + ahead
        later = _later(keys, its_doc, its_start)
        of_string = (keys % np.uint64(n_buckets)).astype(np.int64)
        of_string[later] = (mixed(its_doc[later].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        for kind, chosen in ((_STRINGS, np.flatnonzero(~later)), (_SETTLED, np.flatnonzero(later))):
            order = chosen[np.argsort(of_string[chosen], kind="stable")]
            bounds = np.searchsorted(of_string[order], np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[k]: bounds[k + 1]]
                content = np.stack((one[own], two[own]), axis=1).tobytes() if kind == _STRINGS else b""
                yield row(k, kind, its_doc[own], its_version[own], its_start[own], np.ones(len(own)), content)


def _settled(frame: pd.DataFrame, width: int, n_parts: int) -> pd.DataFrame:
    """Strings of one bucket that stand earlier."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    arrays = lambda rows: (_joined(rows["docs"], np.int64), _joined(rows["versions"], np.int64), _joined(rows["starts"], np.int32))
    found.append(arrays(frame[frame["kind"] == _SETTLED]))

    hot = frame[frame["kind"] == _STRINGS]
    docs, versions, starts = arrays(hot)
    both = _joined(hot["content"], np.uint64).reshape(-1, 2)
    _, key = np.unique(both, axis=0, return_inverse=True) if len(both) else (None, np.zeros(0, np.int64))
    later = _later(key.reshape(-1), docs, starts)
    found.append((docs[later], versions[later], starts[later]))

    rows = frame[frame["kind"] == _TEXTS]
    docs, versions, starts = arrays(rows)
    sizes = _joined(rows["sizes"], np.int8).astype(np.int64)
    texts = []
    for own, content in zip(rows["sizes"], rows["content"], strict=True):
        lengths = np.frombuffer(own, np.int8).astype(np.int64) + (width - 1)
        texts.append((np.frombuffer(content, np.uint8), np.concatenate(([0], np.cumsum(lengths)))))
    if texts:
        interval = repeated_intervals(texts, width)
        bases = np.cumsum(sizes + (width - 1)) - (sizes + (width - 1))
        ahead = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        docs, versions, starts = np.repeat(docs, sizes), np.repeat(versions, sizes), np.repeat(starts, sizes) + ahead
        later = _later(interval[np.repeat(bases, sizes) + ahead], docs, starts)
        found.append((docs[later], versions[later], starts[later]))

    docs, versions, starts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((starts, versions, docs))
    docs, versions, starts = docs[order], versions[order], starts[order]
    # neighbours become one entry with the number of starts; an entry holds 127 at most
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (versions[1:] != versions[:-1])
    run = np.flatnonzero(fresh | (np.diff(starts, prepend=starts[:1]) != 1))
    lengths = np.diff(np.append(run, len(docs)))
    pieces = -(-lengths // 127)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(run, pieces) + 127 * piece
    sizes = np.minimum(127, np.repeat(lengths, pieces) - 127 * piece)
    kinds = np.full(len(at), _REPEATED, np.int8)
    return _packed_flags(docs[at], versions[at], kinds, starts[at], sizes, np.zeros(len(at), np.uint64), n_parts)


def _counted_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many candidates each anchor has in a batch."""
    for batch in batches:
        anchors = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(0)]])
        values, counts = np.unique(anchors, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["anchor", "n"])


# --- the operator ----------------------------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Documents without the bytes under their repeated strings."""
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, kinds, begins, lengths in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
            data = (text.as_py() or "").encode("utf-8", "replace")
            sizes.append(len(data))
            gone = np.frombuffer(kinds.as_py() or b"", np.int8) == _REPEATED
            if not gone.any():
                spans.append([])
                kept.append(data)
                continue
            starts = np.frombuffer(begins.as_py(), np.int32)[gone]
            lengths = np.frombuffer(lengths.as_py(), np.int8)[gone]
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + lengths.astype(np.int64) + (width - 1), -1)
            gone = np.cumsum(depth[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "spans", "kept"])


def repeated_flags(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Strings of ``docs (doc, version, text)`` that start earlier too, packed per document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups, n_stretches = -(-size // GROUP_BYTES) or 1, 2 * size // (width - GRAM + 2)
    max_reported = MAX_REPORTED
    met = docs.mapInArrow(lambda batches: _reports(batches, n_groups, width, max_reported), _MEETING)
    reports = stored(met.groupBy("bucket").applyInPandas(lambda frame: _meet(frame, n_groups), _PACKED_FLAGS), "stretches")
    by_document = lambda rows: rows.groupBy("part").applyInPandas(_by_document, _FLAGS)

    candidates = reports.where(F.octet_length("anchors") > 0)
    anchors = stored(candidates.select("anchors").mapInArrow(_counted_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    limit = max(MAX_BUCKETED, int(HOT_SHARE * n_stretches))
    hot = np.array([row["anchor"] for row in anchors.where(F.col("n") > limit).select("anchor").collect()], np.int64).view(np.uint64)
    n_candidates = anchors.where(F.col("n") <= limit).agg(F.sum("n")).first()[0] or 0
    n_buckets = -(-n_candidates * (width + (width - GRAM) // 2) // BUCKET_BYTES) or 1
    chosen = by_document(candidates).where(F.octet_length("anchors") > 0)
    dealt = docs.join(chosen, ["doc", "version"]).select("doc", "version", "text", "kinds", "starts", "sizes", "anchors").mapInArrow(
        lambda batches: _dealt(batches, n_buckets, hot, width), _DEALT)
    settled = dealt.groupBy("bucket").applyInPandas(lambda frame: _settled(frame, width, n_groups), _PACKED_FLAGS)
    return by_document(reports.unionByName(settled)).select("doc", "version", "kinds", "starts", "sizes")


def without_repeated_bytes(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte under a string of ``width`` bytes that also starts earlier: in a document of smaller key, or
    before in the same one. Returns ``doc_id, n_bytes, spans`` (runs removed, in bytes) and ``kept`` (the other bytes,
    which need not be whole characters).

    Strings never cross documents, overlapping ones count, and all are judged on the input.

    Defined results: a null text is empty; a null key is smaller than all keys; strings at equal places of documents of
    equal key are no earlier than each other, so rows alike are cut alike; texts under ``width`` bytes stay whole. Extra
    columns are not handed on. An empty table gives an empty result.
    """
    content = named(text).cast("string")
    rows = docs.select(named(key).cast("long").alias("doc_id"), content.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), F.xxhash64("text").alias("version"))
    flags = repeated_flags(rows.where(F.octet_length("text") >= width).select("doc", "version", "text"), width)
    return rows.join(flags, ["doc", "version"], "left").select("doc_id", "text", "kinds", "starts", "sizes").mapInArrow(
        lambda batches: _cut(batches, width), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
