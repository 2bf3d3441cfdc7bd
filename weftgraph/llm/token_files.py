"""Token files: ids stored in the fewest bits that the vocabulary needs.

Format (a folder of Parquet files, readable through any store that Spark reads). One
row is a segment: whole documents in ascending ``doc_id``, at most ``segment_ids`` ids
unless one document alone has more.

===========  ==========================================================
shard        number of the range of ids of documents; shards ascend
segment      number within the shard
first        ids of the shard before this segment
n_ids        ids in the segment
bits         width of an id
doc_ids      ids of its documents
doc_lens     their lengths, the end id included
payload      ids packed little-endian, ``bits`` bits each
===========  ==========================================================

The id at position i of a segment starts at bit ``i * bits``, so any slice is unpacked
by numpy alone, without what stands before it.

Rows: one result for each input row. A null text is an empty one and holds just the
end id; a null doc_id comes first; rows that share a doc_id follow each other, by text.
An empty table gives no segment and no result. Extra columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm import arrowkit
from weftgraph.llm.bpe_ids import encoder
from weftgraph.session import new_path, shuffle_partitions

END_ID = 0
SEGMENT_IDS = 1 << 18
_BLOCK = 1 << 16

SEGMENTS = (
    "shard int, segment int, first long, n_ids int, bits int, "
    "doc_ids array<long>, doc_lens array<int>, payload binary"
)
_SEGMENTS = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int32()),
        ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lens", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to little-endian bit fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    step = _BLOCK  # a multiple of 8: each block ends on a whole byte
    for at in range(0, len(ids), step):
        block = ids[at : at + step].astype(np.uint64)
        fields = (block[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of packed bytes, as unsigned 32-bit."""
    if bits in (8, 16, 32):
        kind = np.dtype(f"<u{bits // 8}")
        return np.frombuffer(payload, kind, stop - start, start * kind.itemsize).astype("<u4")
    at = np.arange(start, stop, dtype=np.int64) * bits
    first = int(at[0]) >> 3 if len(at) else 0
    last = ((stop * bits) >> 3) + 1
    raw = np.frombuffer(payload[first:last] + b"\0" * 8, np.uint8)
    byte = (at >> 3) - first
    value = np.zeros(len(at), np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    value >>= (at & 7).astype(np.uint64)
    return (value & np.uint64((1 << bits) - 1)).astype("<u4")


def _packer(tokenizer: str, bits: int, end_id: int, segment_ids: int):
    short = bits == 16  # then ids come packed
    end = (np.uint16 if short else np.uint32)(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer, "H" if short else "I").encode
        segment, first = 0, 0
        docs: list = []
        lens: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = b"".join(held)
            row = {
                "shard": [shard],
                "segment": [segment],
                "first": [first],
                "n_ids": [size],
                "bits": [bits],
                "doc_ids": [list(docs)],
                "doc_lens": [list(lens)],
                "payload": [ids if short else pack(np.frombuffer(ids, "<u4"), bits)],
            }
            return arrowkit.emit(row, _SEGMENTS)

        for batch in batches:
            found = encode(arrowkit.strings(batch, "text"))
            for doc, ids in zip(arrowkit.strings(batch, "doc_id"), found, strict=True):
                n = len(ids) // len(end) + 1
                if size and size + n > segment_ids:
                    yield close()
                    segment, first = segment + 1, first + size
                    size = 0
                    docs.clear(), lens.clear(), held.clear()
                docs.append(doc)
                lens.append(n)
                held += (ids, end)
                size += n
        if size:
            yield close()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    vocabulary: int,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every document and write the segments below ``path``.

    The only shuffle deals whole texts by ranges of ``doc_id``; each task then sorts
    its range and packs it in passing.
    """
    spark = docs.sparkSession
    arrowkit.small_batches(spark)
    ordered = (
        arrowkit.texts_of(docs, "doc_id")
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    packed = ordered.mapInArrow(_packer(tokenizer, width(vocabulary), end_id, segment_ids), SEGMENTS)
    packed.write.option("compression", "zstd").parquet(path)


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, 8):
        rows: dict[str, list] = {k: [] for k in _FOUND.names}
        for x in batch.to_pylist():
            ids = unpack(x["payload"], x["bits"], 0, x["n_ids"])
            raw = memoryview(ids).cast("B")
            at = 0
            for doc, n in zip(x["doc_ids"], x["doc_lens"], strict=True):
                rows["doc_id"].append(doc)
                rows["start"].append(x["base"] + x["first"] + at)
                rows["n_tokens"].append(n)
                rows["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                at += n
        yield arrowkit.emit(rows, _FOUND)


def shard_bases(files: DataFrame) -> DataFrame:
    """Ids before each shard: one row for each shard, so a running sum over few rows."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Each document's place, length and checksum, from the files alone.

    The table of bases has one row for each shard, and shards are at most the
    partitions of the write.
    """
    arrowkit.small_batches(spark)
    files = spark.read.schema(SEGMENTS).parquet(path)
    placed = files.join(F.broadcast(shard_bases(files)), "shard")
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, vocabulary)
    return read_token_files(docs.sparkSession, path)
