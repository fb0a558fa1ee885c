"""Suffix-array dedup: a logarithmic family of sparse suffix arrays over shared strings of ``LENGTH`` bytes.

Each byte covered by a string of LENGTH bytes that also starts earlier (smaller
doc_id, or same document and smaller start) is removed.

Sampling: each window of LENGTH bytes is anchored at its smallest ``GRAM``-byte
hash, so equal windows have equal anchors at equal distances. Neighbouring
windows with one anchor form a run. The sampled suffix of a run starts at its
anchor and is held as text: the bytes from the anchor to the end of the run's
last window, then those before the anchor, nearest first.

A first pass counts the anchors' grams by hash. A gram that occurs once cannot
be part of a match, so only suffixes whose gram may repeat are sampled: a filter
of a size fixed by ``FILTER_BYTES`` is broadcast, whose false positives cost
work and nothing else. No hash stands for a string where matches are decided.

* A new batch (some MB of text) gets its suffix array, sorted lexicographically,
  and is merge-scanned against every level of its family: of two equal runs the
  later one is a match. What is new becomes a level; levels of about equal size
  are merged in one pass without sorting again, so a suffix takes part in
  O(log n) merges.
* Each worker keeps a family over its own batches, and only the first place of
  each run goes on, so a passage that a third of all documents share costs one
  entry for each task. Families of buckets of anchors, fed with the workers'
  arrays, find the first place of all.
* Runs that share an anchor but not the whole run are neighbours in a bucket's
  array. Where the longest common prefix with a neighbour leaves room for a
  common window, the run's windows are sorted as text and compared.
* An anchor with over ``HOT`` runs in one task is known to need that in many
  tasks, so its runs are dealt out by run, a marker stands for them in the
  anchor's bucket, and their windows are dealt out once more, by window.

Defined cases: null or empty texts have nothing to remove, as have texts
shorter than LENGTH; very long texts are processed whole, in memory in
proportion to their length; rows of one doc_id and one text are one document,
whose repetitions all get its result; unlike texts under one doc_id, or under
none, are documents of their own, in the order of a hash of the text; null
doc_ids come last; the bytes 0xFE and 0xFF, which UTF-8 never has, count as
one; an empty table gives an empty result; only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BASE, MIX1, drop_table, give_back, mix, parts_for, table_bytes, texts_only, utf8, write_table

LENGTH = 100
GRAM = 32
HOT = 32
BATCH_BYTES = 2 << 20
#: Entries that a worker gathers before it sends them on; 14 MB of text that all repeats.
SHIP = 400_000
#: Windows compared at once.
WINDOWS_AT_ONCE = 150_000
BUCKETS_EACH = 4
#: Most bytes of the filter of repeated grams.
FILTER_BYTES = 32 << 20
#: Gram hashes that a worker gathers before it sends them on.
SHIP_GRAMS = 2_000_000
LAST_ID = np.iinfo(np.int64).max

_rng = np.random.default_rng(20240301)
#: A random number for each byte; the polynomial's base and its inverse modulo 2**64.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.dtype([("doc", "<i8"), ("rank", "<i8"), ("start", "<i8")])
SPAN = np.dtype([("doc", "<i8"), ("rank", "<i8"), ("start", "<i8"), ("stop", "<i8")])
BLOBS = "bucket int, kind int, blob binary"
FOUND = "doc long, rank long, start long, stop long, bucket int, blob binary"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS, SUFFIXES, MARKS = 0, 1, 2


def sizes_of(length: int) -> tuple[int, int, int]:
    """Most bytes before an anchor, width of a suffix and of a window key, in multiples of 8."""
    left = length - GRAM
    return left, -(-(length + left) // 8) * 8, -(-(length + 1) // 8) * 8


@dataclass
class Suffixes:
    """Rows of a suffix array: text, place of the run, the run's windows but one, bytes before the anchor, hot anchor."""

    text: np.ndarray
    place: np.ndarray
    size: np.ndarray
    left: np.ndarray
    many: np.ndarray

    def __len__(self) -> int:
        return len(self.text)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(*(x[at] for x in self.columns()))

    def columns(self) -> list[np.ndarray]:
        return [self.text, self.place, self.size, self.left, self.many]

    def matrix(self) -> np.ndarray:
        return self.text.view(np.uint8).reshape(len(self.text), self.text.itemsize)

    def spans(self, length: int) -> np.ndarray:
        return as_spans(self.place, self.size.astype(np.int64) + length)


@dataclass
class Windows:
    """Rows of an array of windows: the distance to the anchor and the text, and the place."""

    text: np.ndarray
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.text)

    def take(self, at: np.ndarray) -> Windows:
        return Windows(self.text[at], self.place[at])

    def columns(self) -> list[np.ndarray]:
        return [self.text, self.place]

    def spans(self, length: int) -> np.ndarray:
        return as_spans(self.place, np.full(len(self.place), length))


def as_spans(place: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), SPAN)
    for name in ("doc", "rank", "start"):
        out[name] = place[name]
    out["stop"] = place["start"] + width
    return out


def _hash(text: np.ndarray, n_bytes: int | None = None) -> np.ndarray:
    """Hash of the first bytes of each row, only to deal rows out."""
    words = text.view(np.uint64).reshape(len(text), text.itemsize // 8)[:, : None if n_bytes is None else n_bytes // 8]
    out = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            out = (out ^ words[:, k]) * MIX1
            out ^= out >> np.uint64(29)
    return mix(out)


class Hasher:
    """Hashes of all grams of a buffer, by prefix sums."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            if len(Hasher.powers) <= n:
                size = max(n + 1, BATCH_BYTES + BATCH_BYTES // 4)
                for name, base in (("powers", BASE), ("inverses", INVERSE)):
                    table = np.full(size, base, np.uint64)
                    table[0] = 1
                    setattr(Hasher, name, np.cumprod(table, dtype=np.uint64))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE[data] * Hasher.powers[:n], out=self.sums[1:])

    def grams(self) -> np.ndarray:
        n = len(self.sums) - 1
        with np.errstate(over="ignore"):
            return mix((self.sums[GRAM:] - self.sums[: n - GRAM + 1]) * Hasher.inverses[: n - GRAM + 1])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and anchor of each run, as places in ``data``, and the hash of the anchor's gram."""
    span = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    grams = Hasher(data).grams()
    bits = np.uint64(32)  # the same for every batch, so that ties fall to the leftmost gram everywhere
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchors = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # windows that lie in one text
    inside = np.zeros(len(data) + 1, np.int32)
    long_ = np.flatnonzero(np.diff(offsets) >= length)
    inside[offsets[:-1][long_]] += 1
    np.subtract.at(inside, offsets[1:][long_] - length + 1, 1)
    valid = np.cumsum(inside)[: len(anchors)] > 0
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1])
    head[offsets[:-1][long_]] = True
    first = np.flatnonzero(head)
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | head[1:]
    anchor = anchors[first]
    return first, np.flatnonzero(tail), anchor, grams[anchor]


@dataclass
class Filter:
    """Bits of the gram hashes that occur more than once, in a slice for each bucket of hashes."""

    bits: np.ndarray  # a row of bytes for each bucket

    @staticmethod
    def places(grams: np.ndarray, slice_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(grams ^ BASE)
        size = np.uint64(8 * slice_bytes)
        return ((x & np.uint64(0xFFFFFFFF)) % size).astype(np.int64), ((x >> np.uint64(32)) % size).astype(np.int64)

    @classmethod
    def slice_of(cls, grams: np.ndarray, slice_bytes: int) -> np.ndarray:
        out = np.zeros(8 * slice_bytes, bool)
        for at in cls.places(grams, slice_bytes):
            out[at] = True
        return np.packbits(out, bitorder="little")

    def may_repeat(self, grams: np.ndarray) -> np.ndarray:
        bucket, out = _spread(grams, len(self.bits)), np.ones(len(grams), bool)
        for at in self.places(grams, self.bits.shape[1]):
            out &= (self.bits[bucket, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def repeated_grams(rows: DataFrame, n: int, length: int = LENGTH, input_bytes: int = 0) -> Filter:
    """Filter of the anchors' grams that occur at more than one place of ``rows`` (doc, rank, text)."""
    buckets = n * BUCKETS_EACH
    slice_bytes = max(64, min(FILTER_BYTES, max(1 << 16, input_bytes // 64)) // buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def ship() -> Iterator[pa.RecordBatch]:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for kind, x in ((0, found[times == 1]), (1, found[times > 1])):
                yield from _blob_rows(kind, _dealt([x], _spread(x, buckets), differences=True))

        for _, _, data, offsets in _text_batches(batches):
            held.append(runs_of(data, offsets, length)[3])
            if sum(map(len, held)) > SHIP_GRAMS:
                yield from ship()
        if held:
            yield from ship()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            once, more = [], []
            for kind, blob in rows:
                (more if kind else once).append(np.cumsum(_unpack(blob, [np.dtype(np.uint64)])[0], dtype=np.uint64))
            x = np.sort(np.concatenate([*once, *(y for m in more for y in (m, m))]))
            bits = Filter.slice_of(x[1:][x[1:] == x[:-1]], slice_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(bits.tobytes())], pa.binary())], names=["bucket", "blob"])

    found = write_table(rows.mapInArrow(scan, BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, "bucket int, blob binary"), "suffix-grams")
    bits = np.zeros((buckets, slice_bytes), np.uint8)
    for r in found.toLocalIterator():  # FILTER_BYTES at most
        bits[r.bucket] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.blob), np.uint8)
    drop_table(found)
    return Filter(bits)


def suffix_array(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, ranks: np.ndarray, length: int = LENGTH, repeated: Filter | None = None) -> tuple[Suffixes, np.ndarray]:
    """The sorted sampled suffixes of some texts, of equal runs the first, and the spans of the others."""
    left_most, width, _ = sizes_of(length)
    first, last, anchor, grams = runs_of(data, offsets, length)
    if repeated is not None:
        use = repeated.may_repeat(grams)
        first, last, anchor = first[use], last[use], anchor[use]
    text = np.searchsorted(offsets, first, side="right") - 1
    place = np.zeros(len(first), PLACE)
    place["doc"], place["rank"], place["start"] = ids[text], ranks[text], first - offsets[text]
    size, left = (last - first).astype(np.uint8), (anchor - first).astype(np.uint8)
    matrix = np.zeros((len(first), width), np.uint8)
    if len(first):
        around = np.zeros(left_most + len(data) + length, np.uint8)
        around[left_most : left_most + len(data)] = np.minimum(data, 254) + np.uint8(1)  # 0 is left for padding
        surroundings = sliding_window_view(around, left_most + length)
        for a in range(0, len(first), 1 << 14):
            part = slice(a, a + (1 << 14))
            near = surroundings[anchor[part]]
            near_left, near_right = near[:, :left_most][:, ::-1], near[:, left_most:]
            matrix[part, :length] = near_right * (np.arange(length) < (last + length - anchor)[part, None])
            matrix[part, length : length + left_most] = near_left * (np.arange(left_most) < left[part, None])
    order = np.lexsort((place["start"], place["rank"], place["doc"]))
    texts = matrix.view(f"S{width}").reshape(-1)
    order = order[np.argsort(texts[order], kind="stable")]
    return split_first(Suffixes(texts, place, size, left, np.zeros(len(first), bool)).take(order), length)


def _same(text: np.ndarray) -> np.ndarray:
    """Whether each row but the first equals the one before it."""
    words = text.view(np.uint64).reshape(len(text), text.itemsize // 8)
    out = np.ones(max(0, len(text) - 1), bool)
    for k in range(words.shape[1]):
        out &= words[1:, k] == words[:-1, k]
    return out


def split_first(x, length: int):
    """Of rows sorted by text and then by place: the first of each text, and the spans of the others at other places."""
    if not len(x):
        return x, as_spans(x.place, np.zeros(0, np.int64))
    twin = np.concatenate([[False], _same(x.text)])
    other = np.flatnonzero(twin)
    moved = x.place[other] != x.place[other - 1]
    return x.take(np.flatnonzero(~twin)), x.take(other[moved]).spans(length)


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] < b["doc"]) | ((a["doc"] == b["doc"]) & ((a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["start"] < b["start"]))))


class Family:
    """Levels of sorted arrays without common texts. ``add`` returns the spans of what turned out not to be first."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list = []

    def add(self, new) -> list[np.ndarray]:
        found = []
        for level in self.levels:
            if not len(new):
                break
            at = np.minimum(np.searchsorted(level.text, new.text), len(level) - 1)
            twin = level.text[at] == new.text
            if twin.any():
                mine, theirs = np.flatnonzero(twin), at[twin]
                a, b = new.place[mine], level.place[theirs]
                earlier, later = _before(a, b), _before(b, a)
                matched = new.take(mine)
                matched.place = np.where(earlier, b, a)
                found.append(matched.spans(self.length)[earlier | later])
                level.place[theirs[earlier]] = a[earlier]
                if hasattr(new, "many"):
                    level.many[theirs] |= new.many[mine]
                new = new.take(np.flatnonzero(~twin))
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self._merge()
        return found

    def _merge(self) -> None:
        """The two last levels as one: each row of the shorter one finds its place in the longer one."""
        b, a = self.levels.pop(), self.levels.pop()
        at = np.searchsorted(a.text, b.text) + np.arange(len(b))
        rest = np.ones(len(a) + len(b), bool)
        rest[at] = False
        merged = []
        for x, y in zip(a.columns(), b.columns(), strict=True):
            both = np.empty(len(rest), x.dtype)
            both[rest], both[at] = x, y
            merged.append(both)
        self.levels.append(type(a)(*merged))

    def close(self):
        """One array of all levels, or none."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels.pop() if self.levels else None


def neighbours(x: Suffixes, length: int) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it, 0 for the first; bytes before the anchor don't count."""
    out = np.zeros(len(x), np.int64)
    rights = length + x.size.astype(np.int64) - x.left
    matrix = x.matrix()
    for a in range(1, len(x), 1 << 15):
        b = min(len(x), a + (1 << 15))
        unlike = matrix[a:b, :length] != matrix[a - 1 : b - 1, :length]
        out[a:b] = np.where(unlike.any(1), unlike.argmax(1), length)
    out[1:] = np.minimum(out[1:], np.minimum(rights[1:], rights[:-1]))
    return out


def windows_of(x: Suffixes, least: np.ndarray, length: int) -> Iterator[Windows]:
    """The windows that lie at least ``least`` bytes before the anchor."""
    left_most, _, width = sizes_of(length)
    far = x.left.astype(np.int64)
    near = np.maximum(least, far - x.size)
    counts = np.maximum(far - near + 1, 0)
    ends = np.cumsum(counts)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WINDOWS_AT_ONCE, side="right")))
        row = np.repeat(np.arange(a, b), counts[a:b])
        if len(row):
            begin = ends[a:b] - counts[a:b] - (ends[a - 1] if a else 0)
            off = np.repeat(near[a:b] - begin, counts[a:b]) + np.arange(len(row))
            matrix = x.matrix()[a:b]
            natural = np.concatenate([matrix[:, length : length + left_most][:, ::-1], matrix[:, :length]], axis=1)
            out = np.zeros((len(row), width), np.uint8)
            out[:, 0] = off + 1
            out[:, 1 : length + 1] = sliding_window_view(natural, length, axis=1)[row - a, left_most - off]
            place = x.place[row]
            place["start"] += far[row] - off
            yield Windows(out.view(f"S{width}").reshape(-1), place)
        a = b


def sorted_windows(x: Windows, length: int) -> tuple[Windows, np.ndarray]:
    order = np.lexsort((x.place["start"], x.place["rank"], x.place["doc"]))
    order = order[np.argsort(x.text[order], kind="stable")]
    return split_first(x.take(order), length)


def compare_runs(x: Suffixes, length: int) -> Iterator[np.ndarray]:
    """Spans of the windows of one array that also lie in an earlier run of the same anchor."""
    if len(x) < 2:
        return
    common = neighbours(x, length)
    group = np.cumsum(common < GRAM)
    reach = np.maximum(common, np.append(common[1:], 0))
    least = length - reach  # a window so far before the anchor has all its other bytes in the common prefix
    use = np.flatnonzero((reach >= GRAM) & (least <= x.left))
    x, least, group = x.take(use), least[use], group[use]
    counts = np.maximum(x.left.astype(np.int64) - np.maximum(least, x.left.astype(np.int64) - x.size) + 1, 0)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(x) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    a = 0
    while a < len(heads):  # some whole groups at a time; a larger group alone
        base = ends[heads[a] - 1] if heads[a] else 0
        stops = np.append(heads[1:], len(x))
        b = max(a + 1, int(np.searchsorted(ends[stops - 1], base + WINDOWS_AT_ONCE, side="right")))
        part = np.arange(heads[a], stops[b - 1])
        family = Family(length)
        for w in windows_of(x.take(part), least[part], length):
            first, matched = sorted_windows(w, length)
            yield matched
            yield from family.add(first)
        a = b


def joined(spans: np.ndarray) -> np.ndarray:
    """Unions of overlapping or touching spans of each document."""
    if not len(spans):
        return spans
    x = spans[np.lexsort((spans["start"], spans["rank"], spans["doc"]))]
    other = (x["doc"][1:] != x["doc"][:-1]) | (x["rank"][1:] != x["rank"][:-1])
    group = np.concatenate([[0], np.cumsum(other)])
    wide = int(x["stop"].max()) + 2
    reach = np.maximum.accumulate(x["stop"] + group * wide) - group * wide
    new = np.ones(len(x), bool)
    new[1:] = other | (x["start"][1:] > reach[:-1])
    heads = np.flatnonzero(new)
    out = x[heads]
    out["stop"] = np.maximum.reduceat(x["stop"], heads)
    return out


def _pack(columns: list[np.ndarray]) -> bytes:
    """Number of rows, then column by column; places by their fields, the bytes of numbers apart."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for x in columns:
        for name in x.dtype.names or [None]:
            column = np.ascontiguousarray(x[name] if name else x)
            parts.append(column.tobytes() if column.dtype.kind == "S" else column.view(np.uint8).reshape(len(x), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(blob: bytes, dtypes: list[np.dtype]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for dtype in dtypes:
        x = np.empty(n, dtype)
        for name in dtype.names or [None]:
            kind = dtype[name] if name else dtype
            column = raw[at : at + n * kind.itemsize]
            at += n * kind.itemsize
            column = column.copy() if kind.kind == "S" else np.ascontiguousarray(column.reshape(kind.itemsize, n).T).reshape(-1)
            if name:
                x[name] = column.view(kind)
            else:
                x[:] = column.view(kind)
        out.append(x)
    return out


def _dealt(columns: list[np.ndarray], bucket: np.ndarray, most: int = 1 << 16, differences: bool = False) -> Iterator[tuple[int, bytes]]:
    """Packed rows of each bucket, in their order; or the differences from row to row."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
        for c in range(a, b, most):
            part = [x[order[c : min(b, c + most)]] for x in columns]
            yield int(bucket[a]), _pack([np.diff(x, prepend=x.dtype.type(0)) for x in part] if differences else part)


def _blob_rows(kind: int, dealt: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for bucket, blob in dealt:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])


def _found_rows(spans: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    x = joined(np.concatenate(spans)) if spans else np.zeros(0, SPAN)
    for a in range(0, len(x), 1 << 16):
        part = x[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([*[pa.array(part[c]) for c in ("doc", "rank", "start", "stop")], pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], names=["doc", "rank", "start", "stop", "bucket", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Buckets, each with its (kind, blob) rows, of rows sorted by bucket."""
    def rows():
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(batch.column(c)[k].as_py() for c in range(3))

    for bucket, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield bucket, ((r[1], r[2]) for r in group)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, ranks, bytes and offsets of some MB of text at a time."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, ranks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, side="right")) - 1)
            yield ids[a:b], ranks[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            give_back()
            a = b


def _spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x % np.uint64(buckets)).astype(np.int64)


def find_runs(rows: DataFrame, n: int, length: int, repeated: Filter) -> DataFrame:
    """Spans to remove, and packed windows of hot anchors to compare by bucket (``blob`` not null)."""
    buckets, limit = n * BUCKETS_EACH, HOT
    known = rows.sparkSession.sparkContext.broadcast(repeated)
    _, width, window_width = sizes_of(length)
    suffix_types = [np.dtype(f"S{width}"), PLACE, np.dtype("u1"), np.dtype("u1"), np.dtype("?")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(length)
        spans: list[np.ndarray] = []
        held = 0

        def ship() -> Iterator[pa.RecordBatch]:
            array = family.close()
            if array is not None:
                gram = _hash(array.text, GRAM)
                group = np.cumsum(neighbours(array, length) < GRAM) - 1
                hot = np.bincount(group)[group] > limit
                array.many |= hot
                yield from _blob_rows(SUFFIXES, _dealt(array.columns(), _spread(np.where(hot, _hash(array.text), gram), buckets)))
                marks = np.unique(gram[hot])
                yield from _blob_rows(MARKS, _dealt([marks], _spread(marks, buckets)))
            if spans:
                found = joined(np.concatenate(spans))
                spans.clear()
                yield from _blob_rows(SPANS, _dealt([found], _spread(mix(found["doc"].view(np.uint64) ^ found["rank"].view(np.uint64)), buckets)))
            give_back()

        for ids, ranks, data, offsets in _text_batches(batches):
            array, matched = suffix_array(data, offsets, ids, ranks, length, known.value)
            held += len(array)
            spans += [joined(x) for x in (matched, *family.add(array))]
            if held > SHIP:
                yield from ship()
                held = 0
        yield from ship()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            family, spans, marks = Family(length), [], []
            for kind, blob in rows:
                if kind == SUFFIXES:
                    spans += family.add(Suffixes(*_unpack(blob, suffix_types)))
                elif kind == MARKS:
                    marks += _unpack(blob, [np.dtype(np.uint64)])
                else:
                    spans += _unpack(blob, [SPAN])
            array = family.close()
            if array is not None:
                many = array.many | np.isin(_hash(array.text, GRAM), np.concatenate(marks)) if marks else array.many
                spans += [joined(x) for x in compare_runs(array.take(np.flatnonzero(~many)), length)]
                hot = array.take(np.flatnonzero(many))
                for w in windows_of(hot, np.zeros(len(hot), np.int64), length):
                    first, matched = sorted_windows(w, length)
                    spans.append(joined(matched))
                    for bucket, blob in _dealt(first.columns(), _spread(_hash(first.text), buckets)):
                        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["doc", "rank", "start", "stop", "bucket", "blob"])
            yield from _found_rows(spans)
            give_back()

    return rows.mapInArrow(scan, BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, FOUND)


def compare_windows(blobs: DataFrame, n: int, length: int = LENGTH) -> DataFrame:
    """Spans of the windows that also start earlier. blobs: bucket, blob."""
    types = [np.dtype(f"S{sizes_of(length)[2]}"), PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            family, spans = Family(length), []
            for _, blob in rows:
                spans += [joined(x) for x in family.add(Windows(*_unpack(blob, types)))]
            yield from _found_rows(spans)
            give_back()

    packed = blobs.select("bucket", F.lit(SUFFIXES).alias("kind"), "blob")
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def dedup(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``texts`` also the bytes that remain, as ``kept``."""
    if not GRAM < length <= 255:
        raise ValueError(f"length must be over {GRAM} and at most 255")
    id_ = F.col("doc_id").cast("long")
    rows = texts_only(docs).select(id_.alias("doc_id"), F.coalesce(id_, F.lit(int(LAST_ID))).alias("doc"), F.xxhash64("text").alias("rank"), "text")
    n = parts_for(docs)
    narrow = rows.select("doc", "rank", "text")
    found = write_table(find_runs(narrow, n, length, repeated_grams(narrow, n, length, table_bytes(docs))), "suffix-found")
    spans = found.where("blob is null").unionByName(compare_windows(found.where("blob is not null"), n, length))
    removed = spans.groupBy("doc", "rank").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))  # no more than a document has runs

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([squeeze.compress(x) for x in part.column(3).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "doc", "rank", "blob"])
            give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, blob, starts, stops in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = expand.decompress(blob.as_py())
                spans = np.zeros(len(starts.values) if starts.is_valid else 0, SPAN)
                if len(spans):
                    spans["start"], spans["stop"] = starts.values.to_numpy(), stops.values.to_numpy()
                    spans = joined(spans)
                bounds = [0, *np.column_stack([spans["start"], spans["stop"]]).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                out.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())] + ([pa.array(columns[5], pa.binary())] if texts else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts])
            give_back()

    packed = rows.mapInArrow(pack, "doc_id long, doc long, rank long, blob binary").repartition(n, "doc", "rank")
    both = packed.join(removed, ["doc", "rank"], "left").select("doc_id", "blob", "starts", "stops")
    return both.mapInArrow(cut, SCHEMA + (", kept binary" if texts else ""))
