"""Suffix-array dedup: later copies of long byte strings go, the first stays.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (at a
smaller doc_id, or earlier in the same document) is removed, judged on the input.

How a corpus is cut so that no suffix array ever holds it all:

1. Each string of ``LENGTH`` bytes has an anchor: the leftmost of its ``GRAM``-grams with
   the least hash. Equal strings have equal anchors at equal distances, so a string can
   only be found again where the gram of its anchor is. Grams met once are dropped. A task
   that meets a gram often sends two of its anchors to be counted and the others past the
   count, so no gram brings all its anchors to one task.
2. The strings of one anchor are one window of text around it. Windows with the same gram
   come together; of those with the same bytes the earliest is compared. The suffixes that
   start at the anchors are put in suffix order, with the longest common prefixes of
   neighbours. Sorting that order by the byte before gives the order of the suffixes one byte
   earlier, and so on, as far as strings start before their anchors. In each order the
   previous and the next smaller position give every suffix its longest previous factor
   (`longest_previous_factor`); a string goes where that is LENGTH or more.
3. A gram of more than ``HOT`` windows is split, as one group would outgrow a task: its
   strings travel one by one, by the digest of the whole string. Which grams are split is a
   bit filter of fixed size; a gram that it takes by mistake is split as well, by all tasks.

Rows: one result for each input row. A null text is empty; a null doc_id is smallest.
Rows that share a doc_id are versions of one document: positions are compared by doc_id
and start alone, so equal rows get equal results and no version is a copy of another at
the same start. An empty table gives no row. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm import arrowkit
from weftgraph.session import materialize

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams of a string
HOT = 4096
#: Bits of the filter that spares a shuffle texts without a match: 4 MB at any size.
FILTER_BITS = 25

_PIECE = 1 << 20
_WINDOWS = 30_000
_LEAST = -(1 << 63)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the gram that starts at each byte, by doubling."""
    h, m = _TABLE[data], 1
    while m < GRAM:
        h = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchor_places(h: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes, where its anchor is: leftmost least hash of SPAN."""
    value, place, m = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * m <= SPAN:
        first = value[:-m] <= value[m:]
        place = np.where(first, place[:-m], place[m:])
        value = np.where(first, value[:-m], value[m:])
        m *= 2
    if rest := SPAN - m:
        place = np.where(value[:-rest] <= value[rest:], place[:-rest], place[rest:])
    return place


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each starts (and the last ends)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of whole documents, and parts of long ones that overlap: document range, byte range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > _PIECE:
            for at in range(int(offsets[i]), int(offsets[i + 1]) - LENGTH + 1, _PIECE):
                yield i, i + 1, at, min(int(offsets[i + 1]), at + _PIECE + LENGTH - 1)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        yield i, j, int(offsets[i]), int(offsets[j])
        i = j


_ANCHORS = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("place", pa.int64()), ("salt", pa.int32())])
ANCHORS = "gram long, doc_id long, tie long, place long, salt int"
#: Anchors of a gram that a task sends to be counted, and the grams whose others it remembers.
_COUNTED, _REMEMBERED = 2, 200_000


class _Often:
    """Grams that a task has met more than ``_COUNTED`` times: they are repeated whatever other tasks hold."""

    def __init__(self) -> None:
        self.grams = np.zeros(0, np.uint64)

    def salts(self, grams: np.ndarray) -> np.ndarray:
        """0 for anchors to be counted, else a number that spreads them."""
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        nth = np.empty(len(grams), np.int64)
        nth[order] = np.arange(len(grams)) - np.repeat(new, np.diff(np.r_[new, len(grams)]))
        past = (nth >= _COUNTED) | np.isin(grams, self.grams)
        if past.any():
            self.grams = np.union1d(self.grams, grams[past])[:_REMEMBERED]
        return np.where(past, 1 + np.arange(len(grams)) % 4093, 0).astype(np.int32)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place: the anchor's offset, the bytes before it and the strings after the first, packed."""
    often = _Often()
    for batch in batches:
        raw, offsets = _text_buffer(batch.column("text"))
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        ties = batch.column("tie").to_numpy(zero_copy_only=False)
        for i, j, low, high in _pieces(offsets):
            if high - low < LENGTH:
                continue
            h = gram_hashes(raw[low:high])
            at = anchor_places(h)
            starts, ends = np.maximum(offsets[i:j], low) - low, np.minimum(offsets[i + 1 : j + 1], high) - low
            strings = np.maximum(ends - starts - LENGTH + 1, 0)
            doc = np.repeat(np.arange(i, j), strings)
            if not len(doc):
                continue
            first = np.cumsum(strings) - strings
            pos = np.arange(len(doc)) - np.repeat(first, strings) + np.repeat(starts, strings)
            anchor = at[pos].astype(np.int64)
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            count = np.diff(np.r_[new, len(doc)])
            a, own = anchor[new], doc[new]
            offset = a + low - offsets[own]
            place = offset << 14 | (a - pos[new]) << 7 | (count - 1)
            arrays = [h[a].view(np.int64), docs[own], ties[own], place, often.salts(h[a])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=_ANCHORS)


WINDOWS = "gram long, doc_id long, tie long, at long, gap int, count int, window binary"
_WINDOW_SCHEMA = pa.schema(
    [
        ("gram", pa.int64()),
        ("doc_id", pa.int64()),
        ("tie", pa.int64()),
        ("at", pa.int64()),
        ("gap", pa.int32()),
        ("count", pa.int32()),
        ("window", pa.large_binary()),
    ]
)


class _HotStrings:
    """Strings of hot grams in one task: of equal ones only the first is sent on.

    The others are covered by it, whatever other tasks hold, so their spans are final.
    """

    def __init__(self) -> None:
        self.first: dict[bytes, tuple[int, int, int]] = {}
        self.out: dict[str, list] = {k: [] for k in _WINDOW_SCHEMA.names}

    def _row(self, gram: int, doc: int, tie: int, at: int, gap: int, count: int, window: bytes) -> None:
        for k, v in zip(_WINDOW_SCHEMA.names, (gram, doc, tie, at, gap, count, window), strict=True):
            self.out[k].append(v)

    def _send(self, digest: bytes, doc: int, at: int, tie: int) -> None:
        self._row(int.from_bytes(digest[:8], "little", signed=True), doc, tie, at, _STRING, 1, digest)

    def _covered(self, doc: int, tie: int, start: int, stop: int) -> None:
        spread = (doc * 0x9E3779B1 + start) & 0x7FFFFFFF
        self._row(spread, doc, tie, start, _COVERED, stop - start, b"")

    def add(self, data: np.ndarray, doc: int, tie: int, at: int, count: int) -> None:
        """The ``count`` strings of ``data`` from ``at`` on."""
        start = stop = -1
        for i in range(at, at + count):
            digest = hashlib.blake2b(data[i : i + LENGTH].tobytes(), digest_size=16).digest()
            old = self.first.get(digest)
            if old is None:
                self.first[digest] = (doc, i, tie)
            elif (doc, i) > old[:2]:
                if stop < 0:
                    start = i
                elif i > stop:
                    self._covered(doc, tie, start, stop)
                    start = i
                stop = i + LENGTH
            elif (doc, i) < old[:2]:
                self._covered(old[0], old[2], old[1], old[1] + LENGTH)
                self.first[digest] = (doc, i, tie)
            else:  # another version of the document
                self._send(digest, doc, i, tie)
        if stop >= 0:
            self._covered(doc, tie, start, stop)

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        if last or len(self.first) > 10 * _WINDOWS:
            for digest, (doc, at, tie) in self.first.items():
                self._send(digest, doc, at, tie)
            self.first.clear()
        if self.out["gram"] and (last or len(self.out["gram"]) > _WINDOWS):
            yield arrowkit.emit(self.out, _WINDOW_SCHEMA)
            self.out = {k: [] for k in _WINDOW_SCHEMA.names}


#: ``gap`` of a row that is one string, by its digest, or a span that is covered already.
_STRING, _COVERED = -1, -2


def _cut(shared):
    """The windows around repeated grams; strings one by one where a gram is hot (``shared``: a filter of those)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hots, bits = _HotStrings(), shared.value
        for batch in arrowkit.sliced(batches, 64):
            raw, offsets = _text_buffer(batch.column("text"))
            marks = batch.column("marks")
            rows = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            flat = marks.flatten()
            place, gram = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("place", "gram"))
            bit = (gram.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hot = (bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
            gap, count = (place >> 7) & 127, (place & 127) + 1
            at = (place >> 14) - gap
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows]
            ties = batch.column("tie").to_numpy(zero_copy_only=False)[rows]
            cold = np.flatnonzero(~hot)
            for k in range(0, len(cold), _WINDOWS):
                s = cold[k : k + _WINDOWS]
                size = count[s] + LENGTH - 1
                ends = np.cumsum(size)
                take = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(offsets[rows[s]] + at[s], size)
                buffers = [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(raw[take].tobytes())]
                window = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), buffers)
                plain = [gram[s], docs[s], ties[s], at[s], gap[s].astype(np.int32), count[s].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), window], schema=_WINDOW_SCHEMA)
            for m in np.flatnonzero(hot):
                own = raw[offsets[rows[m]] : offsets[rows[m] + 1]]
                hots.add(own, int(docs[m]), int(ties[m]), int(at[m]), int(count[m]))
            yield from hots.rows(last=False)
        yield from hots.rows(last=True)

    return run


def _rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """LENGTH bytes of ``data`` from each start on, zero past each end."""
    at = starts[:, None] + np.arange(LENGTH)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in byte order, and what each of that order shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.r_[0, shared].astype(np.uint8)


def _levels(values: np.ndarray, count: int) -> list[np.ndarray]:
    """Level k holds the least of the 2 ** k values from each place on."""
    out = [values]
    for k in range(count - 1):
        out.append(np.minimum(out[k][: -(1 << k)], out[k][1 << k :]))
    return out


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values`` from each ``low`` to its ``high``, both included."""
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), values.dtype)
    for k, least in enumerate(_levels(values, int(level.max(initial=0)) + 1)):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(least[low[own]], least[high[own] - (1 << k) + 1])
    return out


def _thinned(order: np.ndarray, shared: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix order and its common prefixes without the suffixes that aren't kept."""
    at = np.flatnonzero(keep)
    if len(at) == len(order):
        return order, shared
    out = np.zeros(len(at), shared.dtype)
    if len(at) > 1:
        out[1:] = np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1)
    return order[at], out


def _beside(shared: np.ndarray, least: int) -> np.ndarray:
    """Which suffixes share ``least`` bytes with a neighbour."""
    enough = shared >= least
    return enough | np.r_[enough[1:], False]


def _one_earlier(order: np.ndarray, shared: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start one byte earlier, at ``byte``: sorted by that byte alone.

    Suffixes with the same byte keep their order, and share one more than all between them did.
    """
    by = np.argsort(byte, kind="stable")
    same = np.flatnonzero(byte[by[1:]] == byte[by[:-1]])
    out = np.zeros(len(by), shared.dtype)
    out[1 + same] = np.minimum(_least_between(shared, by[same] + 1, by[1 + same]), LENGTH - 1) + 1
    return order[by], out


def _previous_smaller(position: np.ndarray, shared: np.ndarray, levels: int) -> np.ndarray:
    """What each suffix shares with the last one before it in suffix order whose position is smaller.

    Each goes back by falling powers of two, over suffixes with greater or equal positions. It
    stops where fewer than LENGTH bytes are shared: what lies behind is no match.
    """
    at = np.arange(len(position))
    positions, common = _levels(position, levels), _levels(shared, levels)
    for k in reversed(range(levels)):
        low = at - (1 << k)
        here = np.maximum(low, 0)
        back = (low >= 0) & (positions[k][here] >= position) & (common[k][here + 1] >= LENGTH)
        at = np.where(back, low, at)
    smaller = (at > 0) & (position[at - 1] < position)
    return np.where(smaller, shared[at], 0)


def longest_previous_factor(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, the length of the longest match that starts earlier, cut at LENGTH.

    Such a match begins at the previous or at the next smaller position. Below LENGTH the
    value is a lower bound.
    """
    size = np.diff(np.r_[np.flatnonzero(shared < LENGTH), len(shared)])
    levels = int(size.max(initial=1) - 1).bit_length()
    if not levels:
        return np.zeros(len(shared), shared.dtype)
    before = _previous_smaller(position, shared, levels)
    after = _previous_smaller(position[::-1], np.r_[shared[:1], shared[:0:-1]], levels)[::-1]
    return np.maximum(before, after)


def _first_of_equal(windows: list[bytes], position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring windows with the same bytes the one with the least position, and each window's number in that list."""
    new = np.r_[True, [a != b for a, b in zip(windows, windows[1:], strict=False)]].astype(bool)
    group = np.cumsum(new) - 1
    return np.lexsort((position, group))[np.flatnonzero(new)], group


def later_strings(
    windows: list[bytes], gap: np.ndarray, count: np.ndarray, doc: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """First and last string of each window that starts earlier in another window; -1 for none.

    Strings are numbered within their window by ``gap`` minus their distance to the anchor.
    Of windows with the same bytes the earliest is compared; it holds all strings of the others.
    """
    anchor = at + gap
    order = np.lexsort((anchor, doc))
    new = np.r_[False, (doc[order][1:] != doc[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]
    position = np.empty(len(order), np.int32)
    position[order] = np.cumsum(new)

    one, group = _first_of_equal(windows, position)
    gaps, least, place = gap[one], (gap - count + 1)[one], position[one]
    ends = np.cumsum([len(windows[i]) for i in one])
    data = np.frombuffer(b"".join(windows[i] for i in one), np.uint8)
    anchors = np.r_[0, ends[:-1]] + gaps
    first, last = np.full(len(one), -1), np.full(len(one), -1)
    order, shared = suffix_order(_rows(data, anchors, ends))
    for d in range(SPAN):
        if d:
            order, shared = _thinned(order, shared, gaps[order] >= d)
            order, shared = _one_earlier(order, shared, data[anchors[order] - d])
        # who shares the gram and all from here to it with nobody has no match further on
        order, shared = _thinned(order, shared, _beside(shared, GRAM + d))
        if len(order) < 2:
            break
        own, common = _thinned(order, shared, least[order] <= d)
        own, common = _thinned(own, common, _beside(common, LENGTH))
        found = own[longest_previous_factor(place[own], common) >= LENGTH]
        k = gaps[found] - d
        last[found] = np.where(last[found] < 0, k, last[found])
        first[found] = k
    later = position > place[group]
    return np.where(later, 0, first[group]), np.where(later, count - 1, last[group])


SPANS = "doc_id long, tie long, start long, stop long"
_SPANS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows ordered by gram to spans of bytes; a group is complete before it is matched."""
    held: pa.Table | None = None
    last: tuple | None = None  # the first single string of the digest at hand

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gap, count, doc, at = (table.column(k).to_numpy() for k in ("gap", "count", "doc_id", "at"))
        tie = table.column("tie").to_numpy()
        whole = np.flatnonzero(gap >= 0)
        if len(whole) > 1:
            windows = table.column("window").take(pa.array(whole)).to_pylist()
            gap, count, doc, at, tie = (x[whole] for x in (gap, count, doc, at, tie))
            first, end = later_strings(windows, gap.astype(np.int64), count.astype(np.int64), doc, at)
            hit = np.flatnonzero(first >= 0)
            arrays = [doc[hit], tie[hit], at[hit] + first[hit], at[hit] + end[hit] + LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=_SPANS)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        kind = table.column("gap").to_numpy()
        if (done := kind == _COVERED).any():
            rows = table.filter(pa.array(done))
            start = rows.column("at").to_numpy()
            stop = start + rows.column("count").to_numpy()
            yield pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks() for k in ("doc_id", "tie")), pa.array(start), pa.array(stop)], schema=_SPANS)
            table = table.filter(pa.array(~done))
            kind = kind[~done]
        single = kind == _STRING
        if single.any():
            rows = table.filter(pa.array(single)).select(["window", "doc_id", "tie", "at"]).to_pydict()
            out: dict[str, list] = {k: [] for k in _SPANS.names}
            for digest, doc, tie, at in zip(*rows.values(), strict=True):
                if last is None or last[0] != digest:
                    last = (digest, doc, at)
                elif (doc, at) > last[1:]:
                    for k, v in zip(_SPANS.names, (doc, tie, at, at + LENGTH), strict=True):
                        out[k].append(v)
            yield arrowkit.emit(out, _SPANS)
            table = table.filter(pa.array(~single))
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= _WINDOWS:
            gram = held.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1], "left"))
            if cut:
                yield from spans(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield from spans(held)


def _bits(numbers: DataFrame) -> np.ndarray:
    """A bit for each number ``bit`` below 2 ** FILTER_BITS: 4 MB, whatever the number of rows."""
    words = numbers.select((F.col("bit") / 32).cast("int").alias("word"), (F.col("bit") % 32).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed doc_id."""
    return _bits(ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit")))


def _maybe(docs: DataFrame, bits: np.ndarray):
    """A column: may this doc_id be among those of the filter?"""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def known(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy()
        return pd.Series((shared.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1)

    return known(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (null as the least), ``tie`` (tells versions of a document apart) and ``text``."""
    key = F.coalesce("doc_id", F.lit(_LEAST))
    shared = docs.groupBy(key.alias("doc_id")).count().filter("count > 1").limit(1).count()
    text = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(text) if shared else F.lit(0).cast("long")
    return docs.select(*more, key.alias("doc_id"), tie.alias("tie"), text.alias("text"))


def later_spans(keyed: DataFrame) -> DataFrame:
    """``doc_id``, ``tie``, ``start`` and ``stop`` of bytes that are covered; spans overlap."""
    arrowkit.small_batches(keyed.sparkSession)
    anchors = keyed.mapInArrow(_anchors, ANCHORS)
    n = F.count("*").over(Window.partitionBy("gram", "salt"))
    again = anchors.withColumn("n", n).filter("n > 1 or salt > 0")
    marks = again.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("place", "gram")).alias("marks"))
    marks = materialize(marks, "lpf-marks")
    sizes = marks.select(F.explode("marks.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > HOT).select(F.shiftrightunsigned("gram", 64 - FILTER_BITS).alias("bit"))
    shared = keyed.sparkSession.sparkContext.broadcast(_bits(hot))
    texts = keyed.filter(_maybe(keyed, _filter(marks)))
    windows = texts.join(marks, ["doc_id", "tie"]).mapInArrow(_cut(shared), WINDOWS)
    dealt = windows.repartition("gram").sortWithinPartitions("gram", "window", "doc_id", "at")
    return dealt.mapInArrow(_match, SPANS)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((x["start"], x["stop"]) for x in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_bytes(text: str, runs: list[tuple[int, int]]) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    at, out = 0, []
    for start, stop in runs:
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, 128):
        rows: dict[str, list] = {k: [] for k in _RESULT.names}
        for text, spans in zip(arrowkit.strings(batch, "text"), arrowkit.strings(batch, "spans"), strict=True):
            runs = union_of(spans or [])
            kept = kept_bytes(text, runs)
            removed = sum(b - a for a, b in runs)
            rows["n_bytes"].append(len(kept) + removed)
            rows["n_removed"].append(removed)
            rows["n_spans"].append(len(runs))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        rows["doc_id"] = arrowkit.strings(batch, "id")
        yield arrowkit.emit(rows, _RESULT)


def with_spans(docs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Documents that may have spans, joined with theirs, and all others; both keyed."""
    keyed = _keyed(docs, *more)
    found = later_spans(keyed.select("doc_id", "tie", "text"))
    spans = materialize(
        found.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "lpf-spans"
    )
    marked = keyed.withColumn("_maybe", _maybe(keyed, _filter(spans)))
    return marked.filter("_maybe").join(spans, ["doc_id", "tie"], "left"), marked.filter("not _maybe")


def dedup_report(docs: DataFrame) -> DataFrame:
    """What is removed of each document, and the digest of what stays."""
    some, none = with_spans(docs.select("doc_id", "text", F.col("doc_id").alias("id")), "id")
    cut = some.select("id", "text", "spans").mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    zero = F.lit(0).cast("long")
    whole = none.select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"),
        zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
    )
    return cut.unionByName(whole)


def deduped_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with what is removed gone from ``text`` (and ``n_chars`` counted anew).

    A character that loses some of its bytes goes whole. A document that loses all
    stays, with an empty text, and so does one whose text is null.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", F.struct("doc_id", *own).alias("_row"))
    some, none = with_spans(renamed, "_row")

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        cut = [kept_bytes(t, union_of([] if s is None else list(s))).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)]
        return pd.Series(cut, dtype=object)

    both = some.select("_row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept("text", "spans")).alias("text"))
    both = both.unionByName(none.select("_row", "text"))
    out = [F.col("text") if c == "text" else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    if "n_chars" in own:
        out = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, out, strict=True)]
    return both.select(*out)
