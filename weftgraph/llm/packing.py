"""Best-fit packing by a plan over the histogram of lengths.

Documents become pieces of at most ``capacity`` ids; only longer ones are cut, and
then the first piece is the short one. The histogram of piece lengths has at most
``capacity`` rows at any input size, so the plan is made on the driver: best-fit
decreasing over counts, where each step moves a run of equal pieces into a run of
equal bins. A piece finds its slot by its rank among the pieces of its length.

Rows: each input row is packed, repeated rows included. A null text is empty and
gives the end id alone. An empty table gives no piece. Extra columns are left behind.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm import arrowkit
from weftgraph.llm.bpe_ids import encoder
from weftgraph.session import materialize

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("task", pa.int32()),
        ("nth", pa.int64()),
    ]
)
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PACKED = pa.schema(
    [*[_PIECES.field(i) for i in range(5)], ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids; only the first may be shorter than the rest."""
    head = n % capacity or min(n, capacity)
    return [0, *range(head, n, capacity)]


def _cutter(tokenizer: str, capacity: int, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        seen: Counter[int] = Counter()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in _PIECES.names}
            found = encode(arrowkit.strings(batch, "text"))
            for doc, ids in zip(arrowkit.strings(batch, "doc_id"), found, strict=True):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                at = [*cuts(n, capacity), n]
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    rows["doc_id"].append(doc)
                    rows["piece"].append(i)
                    rows["start"].append(a)
                    rows["length"].append(b - a)
                    rows["ids_crc32"].append(zlib.crc32(raw[4 * a : 4 * b]))
                    rows["task"].append(task)
                    rows["nth"].append(seen[b - a])
                    seen[b - a] += 1
            yield arrowkit.emit(rows, _PIECES)

    return run


class Plan:
    """Runs of slots: pieces of ``length`` ranked ``low`` to ``high`` go, one each, into
    the sequences from ``sequence`` on, at ``offset``."""

    def __init__(self, histogram: Mapping[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.sequences = 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self._room: list[int] = []
        self._bins: dict[int, list[tuple[int, int]]] = {}
        for length in sorted(histogram, reverse=True):
            self._place(length, histogram[length])

    def _leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self._bins:
                bisect.insort(self._room, room)
                self._bins[room] = []
            self._bins[room].append((sequence, count))

    def _take(self, length: int) -> tuple[int, int, int]:
        """The fullest bins with room for ``length``; new ones if there are none."""
        at = bisect.bisect_left(self._room, length)
        if at == len(self._room):
            return self.capacity, self.sequences, -1
        room = self._room[at]
        sequence, count = self._bins[room].pop()
        if not self._bins[room]:
            del self._bins[room], self._room[at]
        return room, sequence, count

    def _place(self, length: int, left: int) -> None:
        rank = 0
        while left:
            room, sequence, count = self._take(length)
            each = room // length
            if count < 0:  # open as many as are needed
                count = -(-left // each)
                self.sequences += count
            filled = min(count, left // each)
            start = self.capacity - room
            if filled:
                for k in range(each):
                    self.runs[length].append((rank, rank + filled, sequence, start + k * length))
                    rank += filled
                left -= filled * each
                self._leave(room - each * length, sequence, filled)
            if filled < count and 0 < left < each:  # the last few share a bin
                for k in range(left):
                    self.runs[length].append((rank, rank + 1, sequence + filled, start + k * length))
                    rank += 1
                self._leave(room - left * length, sequence + filled, 1)
                filled, left = filled + 1, 0
            self._leave(room, sequence + filled, count - filled)

    def slots(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            low, _, first, place = map(np.array, zip(*self.runs[int(length)], strict=True))
            where = lengths == length
            run = np.searchsorted(low, ranks[where], "right") - 1
            sequence[where] = first[run] + ranks[where] - low[run]
            offset[where] = place[run]
        return sequence, offset


def _placer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            sequence, offset = plan.slots(length, rank)
            kept = [batch.column(n) for n in _PACKED.names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=_PACKED)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, written to the shared folder.

    ``task`` and ``nth`` number the pieces of a length within the task that made them;
    once written they don't change, whatever is lost later.
    """
    arrowkit.small_batches(docs.sparkSession)
    cut = arrowkit.texts_of(docs, "doc_id").mapInArrow(_cutter(tokenizer, capacity, end_id), PIECES)
    return materialize(cut, "pieces")


def ranked(found: DataFrame) -> DataFrame:
    """``rank`` of each piece among all pieces of its length.

    Counts for each length and task come first, so a length that a third of all
    pieces share is never sorted in one task.
    """
    counts = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document; one row for each piece."""
    found = pieces(docs, tokenizer, capacity, end_id)
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity)
    return ranked(found).select(*_PACKED.names[:5], "rank").mapInArrow(_placer(plan), PACKED)
