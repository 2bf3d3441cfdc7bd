"""N-gram Jaccard join by grouped prefixes.

A document's set holds the 64-bit hashes of its distinct shingles of ``size`` words (of
all its words if it has fewer). Two documents link where 100 times the shared shingles
are at least ``percent`` times all of theirs. Both are the caller's; ``SHINGLE`` and
``PERCENT`` are those of the query op6.

1. Documents with equal sets are one class, named by a 128-bit digest. Shingles are
   ordered by how rare they and their words are, counted over all documents in tables of
   fixed size, then by hash. Linked sets share one of the first
   ``n - ceil(percent n / 100) + 1`` shingles, the prefix.
2. Classes with the same prefix and size are one group, of whose rows one goes on. Most
   prefix shingles are met once: a filter of fixed size, from 32 bits of each, keeps nearly
   all of those from any shuffle.
   Groups that share a prefix shingle are tied: pair by pair where at most ``FEW`` hold it,
   and only if they can share enough of their prefixes; else each to the least group of its
   shingle and band of sizes, and the bands to their neighbours if a pair across can link.
   Of a prefix entry come at most ``FEW - 1`` pairs; those that meet by chance go again.
3. What ties connect is a bag; linked classes are always in one. A bag is one task; a bag
   of more than ``BLOCK`` shingles is dealt in blocks by band of sizes, and only blocks of
   equal or neighbouring bands meet.
4. A task joins its groups by an inverted index of their prefixes, filters group pairs by
   size and by the places of the shingles they share, expands those that are left and
   verifies members on whole sets, but for members that links have already connected. It
   returns a forest of its links, and the forests give the components.

Each step's shuffle files go when its table is written, and its tables when the next step
has what it needs, so that the disk holds one step at a time.

Rows: one result for each input row; the result of a row depends on its set alone, so
equal rows get equal results. A null or wordless text has an empty set and is its own
component (its doc_id, null for null). An empty table gives no row. Extra columns are
left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.llm import arrowkit
from weftgraph.llm.lpf_dedup import _filter as doc_filter
from weftgraph.llm.lpf_dedup import _maybe as may_hold
from weftgraph.session import Scratch

SHINGLE = 3
PERCENT = 90
#: Counters of words and of shingles: a byte each, in steps of an eighth of a power of two.
WORD_BITS, SHINGLE_BITS = 21, 23
COUNTERS = (1 << WORD_BITS) + (1 << SHINGLE_BITS)
FILTER_BITS = 25
#: Bits of the filter of prefix shingles that are met again: 16 MB.
AGAIN_BITS = 27
#: Groups of a shingle up to which pairs are counted; beyond, chance ties grow into bags of all texts.
FEW = 64
#: Shingles of one block of a bag.
BLOCK = 500_000
_CHUNK = 1 << 15
_PIECE = 1 << 20

_RNG = np.random.default_rng(714)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z as a-z
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_MIX += list(_RNG.integers(1, 1 << 63, 13, dtype=np.uint64) | np.uint64(1))  # shingles of up to 16 words
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[2]
    h = (h ^ (h >> np.uint64(29))) * _MIX[0]
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of a number and its inverse modulo 2 ** 64, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, x in (("up", _PRIME), ("down", _INVERSE)):
                steps = np.full(max(n, _PIECE), np.uint64(x))
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of UTF-8 bytes, A-Z as a-z, and where it starts."""
    white = _IS_WHITE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, white, True].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _Powers.upto(len(raw))
    value = _TABLE[raw] * up
    value[white] = 0
    return _finish(np.add.reduceat(value, starts) * down[starts]), starts


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle of a document's words, in text order."""
    n = len(words)
    if n >= size:
        parts = [words[i : n - size + 1 + i] * _MIX[i] for i in range(size)]
    elif n:
        parts = [words[i : i + 1] * _MIX[i] for i in range(n)] + [np.array([n], np.uint64)]
    else:
        return words
    return _finish(sum(parts[1:], parts[0]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    """doc_id and word hashes of each document; texts are hashed in runs of about a MB."""
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ids = arrowkit.strings(batch, "doc_id")
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
            piece = raw[offsets[i] : offsets[j]]
            cut = offsets[i : j + 1] - offsets[i]
            if j > i + 1:  # a word ends where its document does
                lens = np.diff(cut)
                spaced = np.full(len(piece) + j - i, 32, np.uint8)
                spaced[np.arange(len(piece)) + np.repeat(np.arange(j - i), lens)] = piece
                piece, cut = spaced, cut + np.arange(j - i + 1)
            words, starts = word_hashes(piece)
            at = np.searchsorted(starts, cut)
            for k in range(j - i):
                yield ids[i + k], words[at[k] : at[k + 1]]
            i = j


# --- counts of words over all documents ----------------------------------------

_COUNTS = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])


def _counter(size: int):
    """Counters of words, then those of shingles, in one row of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        counts = np.zeros(COUNTERS, np.int32)
        for _, words in _documents(batches):
            np.add.at(counts, _word_counter(np.unique(words)), 1)
            np.add.at(counts, _shingle_counter(np.unique(shingles(words, size))), 1)
        for k in range(0, COUNTERS, _CHUNK):
            part = counts[k : k + _CHUNK]
            if part.any():
                yield arrowkit.emit({"chunk": [k // _CHUNK], "counts": [zlib.compress(part.tobytes(), 1)]}, _COUNTS)

    return run


def _word_counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _shingle_counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64) + (1 << WORD_BITS)


_STEPS = pa.schema([("chunk", pa.int32()), ("steps", pa.binary())])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all tasks, on a scale of eighths of powers of two."""
    import zlib

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(arrowkit.strings(batch, "chunk"), arrowkit.strings(batch, "counts"), strict=True):
            part = np.frombuffer(zlib.decompress(data), np.int32)
            if k not in sums:
                sums[k] = part.astype(np.int64)
            else:
                sums[k] += part
    for k, part in sums.items():
        steps = np.minimum(np.rint(8 * np.log2(1.0 + part)), 255).astype(np.uint8)
        yield arrowkit.emit({"chunk": [k], "steps": [steps.tobytes()]}, _STEPS)


def rarities(texts: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How many documents have a word, or a shingle, of each counter, over all documents: 10 MB."""
    parts = texts.mapInArrow(_counter(size), "chunk int, counts binary")
    out, scratch = np.zeros(COUNTERS, np.uint8), Scratch()
    sums = parts.repartition("chunk").mapInArrow(_sum, "chunk int, steps binary")
    for r in scratch.table(sums, "jaccard-rarities").collect():
        part = np.frombuffer(bytes(r["steps"]), np.uint8)
        out[r["chunk"] * _CHUNK :][: len(part)] = part
    scratch.drop(texts.sparkSession)
    return out


# --- sets and prefixes ----------------------------------------------------------

_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("group", pa.binary()), ("prefix", pa.list_(pa.int64()))]
)
SETS = "doc_id long, n long, class binary, group binary, prefix array<long>"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _digest(found: np.ndarray, salt: bytes = b"") -> bytes:
    """A 128-bit digest of an ordered set."""
    import hashlib

    return hashlib.blake2b(found.tobytes(), digest_size=16, salt=salt).digest()


def _ordered(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles by hash, and their order from the rarest on."""
    found, first = np.unique(shingles(words, size), return_index=True)
    df = counts[_word_counter(words)]
    rare = counts[_shingle_counter(found)]
    for i in range(min(size, len(words))):
        rare = np.minimum(rare, df[first + i])
    return found, np.lexsort((found, rare))


def _prefixer(shared, percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        rows: dict[str, list] = {k: [] for k in _SETS.names}
        held = 0
        for doc, words in _documents(batches):
            found, order = _ordered(words, counts, size)
            prefix = found[order[: prefix_length(len(found), percent)]].view(np.int64)
            group = _digest(prefix, len(found).to_bytes(8, "little"))
            for k, v in zip(_SETS.names, (doc, len(found), _digest(found), group, prefix), strict=True):
                rows[k].append(v)
            held += len(prefix) + 8
            if held > _PIECE // 4:
                yield arrowkit.emit(rows, _SETS)
                rows, held = {k: [] for k in _SETS.names}, 0
        if rows["doc_id"]:
            yield arrowkit.emit(rows, _SETS)

    return run


_MEMBERS = pa.schema([("class", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def _setter(shared_counts, shared_bits, size: int):
    """Whole sets, the rarest shingle first, of the documents whose class may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bits = shared_counts.value, shared_bits.value
        sent: set[bytes] = set()  # copies within a task go once
        rows: dict[str, list] = {k: [] for k in _MEMBERS.names}
        held = 0
        for _, words in _documents(batches):
            found = np.unique(shingles(words, size))
            if not len(found):
                continue
            kind = _digest(found)
            bit = int.from_bytes(kind[:4], "big") >> (32 - FILTER_BITS)
            if kind in sent or not bits[bit >> 5] >> np.uint32(bit & 31) & 1:
                continue
            if len(sent) > _PIECE // 4:
                sent.clear()
            sent.add(kind)
            found, order = _ordered(words, counts, size)
            rows["class"].append(kind)
            rows["shingles"].append(found[order].view(np.int64))
            held += len(found)
            if held > _PIECE // 4:
                yield arrowkit.emit(rows, _MEMBERS)
                rows, held = {k: [] for k in _MEMBERS.names}, 0
        if rows["class"]:
            yield arrowkit.emit(rows, _MEMBERS)

    return run


def _lead(digest: str) -> F.Column:
    """The leading bits of a digest, which are its bit in a filter."""
    lead = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.shiftrightunsigned(lead, 32 - FILTER_BITS)


def class_filter(classes: DataFrame) -> np.ndarray:
    """A bit for each class by its leading bits: 4 MB at any size."""
    bit = _lead("class")
    words = classes.select((bit / 32).cast("int").alias("word"), (bit % 32).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


# --- one row of each group ------------------------------------------------------


def _sifter(shared, copied: bool):
    """The rows whose group has its bit in the filter, or those whose group has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            lead = [int.from_bytes(x[:4], "big") for x in arrowkit.strings(batch, "group")]
            bit = np.array(lead, np.uint32) >> np.uint32(32 - FILTER_BITS)
            found = bits[bit >> np.uint32(5)] >> (bit & np.uint32(31)) & np.uint32(1) == 1
            yield batch.filter(pa.array(found == copied))

    return run


def group_rows(rows: DataFrame, scratch: Scratch) -> list[tuple]:
    """``group``, ``n`` and ``prefix`` of each group once: tables, and what sifts the batches of each.

    Only rows whose group a filter doesn't clear of a second row are dealt. One Python
    function sifts and goes on, so that a task has one worker.
    """
    again = rows.groupBy("group").agg(F.count("*").alias("rows")).filter("rows > 1")
    again = scratch.table(again.select(F.col("group").alias("class")), "jaccard-copies")
    shared = rows.sparkSession.sparkContext.broadcast(class_filter(again))
    rows = rows.select("group", "n", "prefix")
    several = rows.mapInArrow(_sifter(shared, True), rows.schema).groupBy("group").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return [(rows, _sifter(shared, False)), (scratch.table(several, "jaccard-groups"), iter)]


def mapped(parts: list[tuple], run, schema: str) -> DataFrame:
    """``run`` over the sifted batches of all parts."""

    def over(sift):
        return lambda batches: run(sift(batches))

    first, *more = [rows.mapInArrow(over(sift), schema) for rows, sift in parts]
    for x in more:
        first = first.union(x)
    return first


# --- prefix shingles that are met again -------------------------------------------

_SLOTS = pa.schema([("chunk", pa.int32()), ("slots", pa.binary())])
_BITS = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])
_CHUNK_BITS = 10  # of 32 bits of a shingle, those that name its chunk


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each prefix shingle of a task, in order, by chunk."""
    parts: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        found = np.sort(np.concatenate(parts))
        kinds = found >> np.uint32(32 - _CHUNK_BITS)
        at = np.r_[0, np.flatnonzero(np.diff(kinds)) + 1, len(found)]
        cut = [found[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return arrowkit.emit({"chunk": kinds[at[:-1]].tolist(), "slots": cut}, _SLOTS)

    held = 0
    for batch in batches:
        flat = batch.column("prefix").flatten().to_numpy().view(np.uint64)
        if len(flat):
            parts.append((flat >> np.uint64(32)).astype(np.uint32))
            held += len(flat)
        if held > 4 * _PIECE:
            yield rows()
            parts, held = [], 0
    if parts:
        yield rows()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's part of each chunk: a bit for what came at least twice."""
    chunks: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, data in zip(arrowkit.strings(batch, "chunk"), arrowkit.strings(batch, "slots"), strict=True):
            chunks.setdefault(k, []).append(data)
    for k, parts in chunks.items():
        found = np.sort(np.frombuffer(b"".join(parts), np.uint32))
        twice = found[1:][found[1:] == found[:-1]]
        bits = np.zeros(1 << (AGAIN_BITS - _CHUNK_BITS), bool)
        bits[(twice >> np.uint32(32 - AGAIN_BITS)) & np.uint32(len(bits) - 1)] = True
        yield arrowkit.emit({"chunk": [k], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, _BITS)


def again_filter(rows: DataFrame | list[tuple]) -> np.ndarray:
    """Bits of the prefix shingles of a table, or of parts, that may be met again: 16 MB at any size."""
    groups = rows if isinstance(rows, list) else [(rows, iter)]
    parts = mapped(groups, _slots, "chunk int, slots binary")
    wide = 1 << (AGAIN_BITS - _CHUNK_BITS - 3)
    out, scratch = np.zeros(wide << _CHUNK_BITS, np.uint8), Scratch()
    found = parts.repartition("chunk").mapInArrow(_again, "chunk int, bits binary")
    for r in scratch.table(found, "jaccard-again").collect():
        out[r["chunk"] * wide :][:wide] = np.frombuffer(bytes(r["bits"]), np.uint8)
    scratch.drop(parts.sparkSession)
    return out


def _pruner(shared):
    """Of each prefix the shingles that may be met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy()
            bit = (flat.view(np.uint64) >> np.uint64(64 - AGAIN_BITS)).astype(np.int64)
            keep = bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            ends = np.cumsum(prefix.value_lengths().to_numpy())
            ends = np.r_[0, np.cumsum(keep)][np.r_[0, ends]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("n"), lists], ["group", "n", "prefix"])

    return run


# --- candidates, links and components --------------------------------------------


class GroupJoin:
    """Links among the sets of one task, by group pairs from an index of prefixes.

    ``sets``: distinct sets in one order of shingles, the rarest first. ``side``: only
    sets of different sides are compared; None compares all. ``parent`` becomes a forest
    whose trees are what the links connect.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None):
        self.percent, self.side = percent, side
        self.size = np.array([len(x) for x in sets], np.int64)
        self.end = np.cumsum(self.size)
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        self.parent = np.arange(len(sets))
        self.cut = np.array([prefix_length(n, percent) for n in self.size.tolist()], np.int64)
        self._group()
        for g in range(len(self.start)):
            self._probe(g)

    def _group(self) -> None:
        """Groups in order of size, their members, and the index: entries by shingle, then group."""
        begin = self.end - self.size
        kinds: dict[tuple, list[int]] = {}
        for m in np.argsort(self.size, kind="stable").tolist():
            own = self.flat[begin[m] : begin[m] + self.cut[m]].tobytes()
            kinds.setdefault((self.size[m], own, 0 if self.side is None else self.side[m]), []).append(m)
        self.members = [np.array(x) for x in kinds.values()]
        first = np.array([x[0] for x in self.members])
        self.n, cut = self.size[first], self.cut[first]
        owner = np.repeat(np.arange(len(first)), cut)
        self.start = np.cumsum(cut) - cut
        place = np.arange(len(owner)) - np.repeat(self.start, cut)
        shingle = self.flat[begin[first][owner] + place]
        by = np.lexsort((owner, shingle))
        self.owner, self.place = owner[by], place[by]
        self.at = np.empty(len(by), np.int64)  # where in the index an entry is
        self.at[by] = np.arange(len(by))
        ordered = shingle[by]
        self.low = np.searchsorted(ordered, ordered)  # where its shingle begins
        self.cuts = cut

    def _roots(self, of: np.ndarray) -> np.ndarray:
        root = self.parent[of]
        while (up := self.parent[root] != root).any():
            root = np.where(up, self.parent[root], root)
        self.parent[of] = root
        return root

    def _probe(self, g: int) -> None:
        """Compare a group with the groups before it that share a shingle of its prefix, and with itself."""
        members = self.members[g]
        if self.side is None:
            for k in range(1, len(members)):
                self._verify(int(members[k]), members[:k])
        own = self.at[self.start[g] : self.start[g] + self.cuts[g]]
        low = self.low[own]
        count = own - low
        if not count.sum():
            return
        take = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        other, there, here = self.owner[take], self.place[take], np.repeat(np.arange(len(own)), count)
        fits = 100 * self.n[other] >= self.percent * self.n[g]
        if self.side is not None:
            fits &= self.side[self._first(other)] != self.side[members[0]]
        other, there, here = other[fits], there[fits], here[fits]
        if len(other) > 4 * len(members):  # most often it links with the component that shares most
            roots = self._roots(self._first(other))
            best = int(np.bincount(roots).argmax())
            with_ = other[np.flatnonzero(roots == best)[-1]]
            for m in members.tolist():
                self._verify(m, self.members[with_])
            if len(members) == 1:
                stay = self._roots(self._first(other)) != self._roots(members)[0]
                other, there, here = other[stay], there[stay], here[stay]
        if not len(other):
            return
        pairs, which, shared = np.unique(other, return_inverse=True, return_counts=True)
        last_here, last_there = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        np.maximum.at(last_here, which, here)
        np.maximum.at(last_there, which, there)
        # beyond the last shingle that both prefixes hold, no more than the shorter rest is shared
        most = shared + np.minimum(self.n[g] - last_here - 1, self.n[pairs] - last_there - 1)
        need = -(-self.percent * (self.n[g] + self.n[pairs]) // (100 + self.percent))
        pairs = pairs[most >= need]
        if len(pairs):
            targets = np.concatenate([self.members[h] for h in pairs.tolist()])
            for m in members.tolist():
                self._verify(m, targets)

    def _first(self, groups: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_firsts"):
            self._firsts = np.array([x[0] for x in self.members])
        return self._firsts[groups]

    def _verify(self, m: int, targets: np.ndarray) -> None:
        """Link a set with the targets that share enough of the whole sets."""
        own = self._roots(np.array([m]))[0]
        targets = targets[self._roots(targets) != own]
        if not len(targets):
            return
        self.mark[self.flat[self.end[m] - self.size[m] : self.end[m]]] = True
        size = self.size[targets]
        for part in np.split(np.arange(len(targets)), np.flatnonzero(np.diff(np.cumsum(size) // _PIECE)) + 1):
            n, ends = size[part], np.cumsum(size[part])
            take = np.arange(int(ends[-1])) + np.repeat(self.end[targets[part]] - ends, n)
            shared = np.add.reduceat(self.mark[self.flat[take]].astype(np.int64), ends - n)
            linked = targets[part][100 * shared >= self.percent * (n + self.size[m] - shared)]
            if len(linked):
                roots = np.unique(np.r_[self._roots(linked), self._roots(np.array([m]))])
                self.parent[roots] = roots[0]
        self.mark[self.flat[self.end[m] - self.size[m] : self.end[m]]] = False


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _forest(percent: int):
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return _LINKS.empty_table()
        table = table.combine_chunks()
        sets = [x.values.to_numpy(zero_copy_only=False) for x in table.column("shingles")]
        alone = all(table.column(x)[0] == table.column(y)[0] for x, y in (("band", "next"), ("i", "j")))
        join = GroupJoin(sets, percent, None if alone else table.column("side").to_numpy())
        root = join._roots(np.arange(len(sets)))
        other = np.flatnonzero(root != np.arange(len(root)))
        classes = table.column("class")
        return pa.table([classes.take(pa.array(root[other])), classes.take(pa.array(other))], schema=_LINKS)

    return run


def components(links: DataFrame) -> DataFrame:
    """``class``, ``component``: the least class reachable, for classes with a link.

    Each round hooks a class to its least neighbour and that one's least neighbour, then
    contracts: links go between what their ends became, and those within one go.
    """
    links = links.toDF("a", "b")
    known, scratch = None, Scratch()
    while True:
        both = links.union(links.select("b", "a")).toDF("class", "other")
        near = scratch.table(both.groupBy("class").agg(F.least(F.col("class"), F.min("other")).alias("near")), "near")
        next_ = near.select(F.col("class").alias("near"), F.col("near").alias("far"))
        to = scratch.table(
            near.join(next_, "near", "left").select("class", F.least("near", F.coalesce("far", "near")).alias("component")), "hooks"
        )
        if known is None:
            known = to
        else:
            step = to.select(F.col("class").alias("component"), F.col("component").alias("further"))
            known = known.join(step, "component", "left").select("class", F.coalesce("further", "component").alias("component"))
            known = scratch.table(known, "components")
        a = to.select(F.col("class").alias("a"), F.col("component").alias("x"))
        b = to.select(F.col("class").alias("b"), F.col("component").alias("y"))
        links = links.join(a, "a").join(b, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = scratch.table(links.distinct(), "contracted")
        if links.limit(1).count() == 0:
            return known


def _counted_ties(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that share enough prefix shingles.

    Of two linked sets, the one whose prefix ends first has all but ``n - need`` of its
    prefix in the other's, where ``need`` is the least overlap of linked sets of their
    sizes. Shingles of few groups are counted pair by pair; of the others, two groups
    share no more than the fewer of either.
    """
    held = small.groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("n", "group"))).alias("g"))  # FEW at most
    i, j = "sequence(0, size(g) - 2)", "sequence(i + 1, size(g) - 1)"
    pairs = held.select(F.explode(F.expr(f"flatten(transform({i}, i -> transform({j}, j -> struct(g[i] as a, g[j] as b))))")).alias("p"))
    pairs = pairs.select(F.col("p.a.group").alias("a"), F.col("p.b.group").alias("b"), F.col("p.a.n").alias("a_n"), F.col("p.b.n").alias("b_n"))
    pairs = pairs.filter(100 * F.col("a_n") >= percent * F.col("b_n")).groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("shared"))
    more = large.groupBy("group").agg(F.count("*").alias("more"))
    for x in "ab":
        pairs = pairs.join(more.select(F.col("group").alias(x), F.col("more").alias(f"{x}_more")), x, "left")
    need = F.ceil(F.col("a_n") * percent / (100 + percent) + F.col("b_n") * percent / (100 + percent) - 1e-6)

    def least(n: str) -> F.Column:
        return F.floor(F.col(n) * (100 - percent) / 100 + 1e-6) + 1 - F.col(n) + need

    most = F.col("shared") + F.least(F.coalesce("a_more", F.lit(0)), F.coalesce("b_more", F.lit(0)))
    return pairs.filter(most >= F.least(least("a_n"), least("b_n"))).select("a", "b")


def _band(n: str, percent: int) -> F.Column:
    """Sizes of a band may link with sizes of the same band and of its neighbours, with no others."""
    if percent >= 100:
        return F.col(n).cast("int")
    wide = float(np.log(100 / percent)) * (1 + 1e-6)  # rounding can't part what may link
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(wide)).cast("int")


def _band_ties(entries: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Each group with the least of its shingle and band, and those of neighbouring bands that may link."""
    banded = entries.withColumn("band", _band("n", percent))
    heads = banded.groupBy("shingle", "band").agg(F.min("group").alias("head"), F.min("n").alias("low"), F.max("n").alias("high"))
    heads = scratch.table(heads, "jaccard-heads")
    own = banded.join(heads, ["shingle", "band"]).filter("group != head").select(F.col("head").alias("a"), F.col("group").alias("b"))
    above = heads.select("shingle", (F.col("band") - 1).alias("band"), F.col("head").alias("next"), F.col("low").alias("next_low"))
    across = heads.join(above, ["shingle", "band"]).filter(100 * F.col("high") >= percent * F.col("next_low"))
    return own.union(across.select(F.col("head").alias("a"), F.col("next").alias("b")))


def bags(sets: DataFrame, percent: int, scratch: Scratch | None = None) -> DataFrame:
    """``bag``, ``class`` and ``n`` of the classes that may link with another.

    Ties name a group by 64 bits: groups that share them come into one bag, no more.
    The result reads tables of ``scratch``.
    """
    scratch = scratch or Scratch()
    rows = sets.filter("n > 0")
    groups = group_rows(rows, scratch)
    shared = sets.sparkSession.sparkContext.broadcast(again_filter(groups))
    pruned = mapped(groups, _pruner(shared), "group binary, n long, prefix array<long>").filter("size(prefix) > 0")
    pruned = scratch.table(pruned.select(F.xxhash64("group").alias("group"), "n", "prefix"), "jaccard-pruned")
    entries = pruned.select("group", "n", F.explode("prefix").alias("shingle"))
    counts = entries.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    entries = scratch.table(entries.join(counts, "shingle"), "jaccard-index")
    few, large = entries.filter(F.col("held") <= FEW), entries.filter(F.col("held") > FEW)
    ties = _band_ties(large, percent, scratch).union(_counted_ties(few, large, percent)).distinct()
    tied = components(scratch.table(ties, "jaccard-ties")).select(F.col("class").alias("group"), F.col("component").alias("bag"))
    members = rows.select(F.xxhash64("group").alias("group"), "class", "n").distinct().join(tied, "group", "left").withColumn("bag", F.coalesce("bag", "group"))
    several = members.groupBy("bag").agg(F.count("*").alias("members")).filter("members > 1")
    return members.join(several, "bag").select("bag", "class", "n")


def dealt(members: DataFrame, percent: int) -> DataFrame:
    """``class`` and the tasks it takes part in: ``bag``, ``band``, ``i``, ``next``, ``j`` and its ``side``.

    A bag of up to ``BLOCK`` shingles is one task. Of a larger one, each band of sizes has
    a block for every ``BLOCK`` shingles, and blocks of a band or of two neighbours meet.
    """
    banded = members.withColumn("band", _band("n", percent))
    sums = banded.groupBy("bag", "band").agg(F.sum("n").alias("shingles"))
    whole = F.sum("shingles").over(Window.partitionBy("bag"))  # one row for each band
    w = Window.partitionBy("bag").orderBy("band")

    def blocks(step: int) -> F.Column:
        near = F.lead("band").over(w) if step > 0 else F.lag("band").over(w)
        n = F.lead("shingles").over(w) if step > 0 else F.lag("shingles").over(w)
        return F.when(near == F.col("band") + step, F.ceil(n / BLOCK).cast("int")).otherwise(F.lit(0))

    plan = sums.select(
        "bag", "band", (whole > BLOCK).alias("large"), F.ceil(F.col("shingles") / BLOCK).cast("int").alias("own"),
        blocks(1).alias("above"), blocks(-1).alias("below"),
    )
    at = F.pmod(F.xxhash64("class"), F.col("own")).cast("int")
    band = F.col("band")

    def task(b: F.Column, i: F.Column, c: F.Column, j: F.Column, side: F.Column) -> F.Column:
        return F.struct(b.alias("band"), i.alias("i"), c.alias("next"), j.alias("j"), side.cast("int").alias("side"))

    def each(n: str, f) -> F.Column:
        return F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), f)

    within = each("own", lambda k: task(band, F.least(k, at), band, F.greatest(k, at), at > k))
    up = each("above", lambda k: task(band, at, band + 1, k, F.lit(0)))
    down = each("below", lambda k: task(band - 1, k, band, at, F.lit(1)))
    zero = F.lit(0)
    tasks = F.when(F.col("large"), F.concat(within, up, down)).otherwise(F.array(task(zero, zero, zero, zero, zero)))
    return banded.join(plan, ["bag", "band"]).select("class", "bag", F.explode(tasks).alias("t")).select("class", "bag", "t.*")


def linked_classes(found: DataFrame, texts: DataFrame, counts, percent: int, size: int) -> DataFrame:
    """``class``, ``component`` of the classes of bags ``found`` that link with another."""
    spark: SparkSession = found.sparkSession
    shared = spark.sparkContext.broadcast(class_filter(found.select("class")))
    whole = texts.mapInArrow(_setter(counts, shared, size), "class binary, shingles array<long>")
    # each class once; then to its tasks
    wanted = whole.join(found.select("class"), "class", "left_semi").dropDuplicates(["class"])
    tasks = wanted.join(dealt(found, percent), "class").groupBy("bag", "band", "i", "next", "j")
    return components(Scratch().table(tasks.applyInArrow(_forest(percent), "a binary, b binary"), "jaccard-links"))


def labelled_rows(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n``, ``class`` and ``component_id`` of each row."""
    spark = docs.sparkSession
    arrowkit.small_batches(spark)
    texts = arrowkit.texts_of(docs, "doc_id")
    shared = spark.sparkContext.broadcast(rarities(texts, size))
    step, kept = Scratch(), Scratch()
    prefixes = step.table(texts.mapInArrow(_prefixer(shared, percent, size), SETS), "jaccard-prefixes")
    sets = kept.table(prefixes.select("doc_id", "n", "class"), "jaccard-sets")
    found = kept.table(bags(prefixes, percent, step), "jaccard-bags")
    step.drop(spark)  # whole sets are dealt next
    labels = linked_classes(found, texts, shared, percent, size)
    least = sets.groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.select("class", "component").join(of, "component").select("class", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = sets.select("doc_id", "n", "class").join(known, "class", "left")
    return out.select("doc_id", "n", "class", own.alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each document."""
    return labelled_rows(docs, percent, size).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _class_of_text(text: F.Column, size: int) -> F.Column:
    @F.pandas_udf(T.BinaryType())
    def found(text: pd.Series) -> pd.Series:
        out = []
        for x in text:
            words, _ = word_hashes(np.frombuffer((x or "").encode("utf-8", "surrogatepass"), np.uint8))
            out.append(_digest(np.unique(shingles(words, size))))
        return pd.Series(out, dtype=object)

    return found(text)


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document whose id names it.

    Of rows with the same id and set one stays. Documents without a set all stay.
    """
    kept = Scratch()
    rows = kept.table(labelled_rows(docs.select("doc_id", "text"), percent, size), "jaccard-rows")
    named = F.col("component_id").eqNullSafe(F.col("doc_id"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(named).alias("stays"))
    ids = kept.table(ids.filter("rows > 1 or not stays"), "jaccard-ids")
    # texts that a filter of fixed size clears stay where they are; only the others are dealt
    maybe = may_hold(docs, doc_filter(ids))
    marked = docs.withColumn("_jaccard_maybe", maybe)
    away = ids.select(F.col("doc_id").alias("_jaccard_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_jaccard_id"))
    doubt = marked.filter("_jaccard_maybe").join(away, same, "left_anti")
    out = marked.filter("not _jaccard_maybe").unionByName(doubt).select(docs.columns)
    again = ids.filter("rows > 1").select(F.col("doc_id").alias("_jaccard_id"))
    if again.limit(1).count() == 0:
        return out
    stay = rows.filter(named)
    # rows that share an id are told apart by their sets
    kinds = stay.select(F.col("doc_id").alias("_jaccard_id"), F.col("class").alias("_jaccard_kind"), F.col("n").alias("_jaccard_n")).distinct()
    versions = docs.join(again, same, "left_semi").withColumn("_jaccard_class", _class_of_text(F.col("text"), size))
    found = versions.join(kinds, same & (F.col("_jaccard_class") == F.col("_jaccard_kind")))
    several = found.filter("_jaccard_n > 0").dropDuplicates(["doc_id", "_jaccard_class"]).union(found.filter("_jaccard_n = 0"))
    return out.unionByName(several.select(docs.columns))
