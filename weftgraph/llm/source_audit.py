"""Divergence of sources within their language, by tiles of group blocks.

Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. A language
keeps the terms that at least ``LEAST_DOCS`` of its documents hold. With ``v`` kept terms
and ``total`` occurrences of them in a group, a term met ``n`` times there has the share
``1 + floor(10 ** 9 (n + 5) / (total + 5 v))``. All arithmetic is exact.

1. Tasks count terms of whole texts for each (language, source) in a table of bounded
   size, which they pass on when it is full; Spark adds up.
2. Kept terms are dealt into chunks of about ``CHUNK``, with a place in their chunk. A group's
   counts in a chunk are one packed vector: places, then counts in the fewest bytes.
3. Sources are dealt into blocks of about ``BLOCK`` by hash. Each vector is replicated to
   the tiles of its block with every block. A tile is a task that takes ``SLAB`` chunks one
   after the other, spreads two blocks of vectors to shares and adds up its submatrix of
   absolute differences; slabs of a tile are then added. Memory is that of one chunk.

Part ``pair`` has every other source of a group's language, part ``term`` the terms whose
share in the group exceeds the language's, at most ``TOP`` of a group.

Rows: a null text, language or source is ''. A group without kept terms still has its pairs;
with no kept term in a language all values are 0. Repeated rows count each. A language with
one source has no pairs; an empty table gives no row. Extra columns are left behind.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm import arrowkit
from weftgraph.session import materialize

LEAST_DOCS = 30
TOP = 50
BILLION, PRIOR = 1_000_000_000, 5
#: Terms of a chunk, about; chunks that one tile task takes; sources of a block, about.
CHUNK, SLAB, BLOCK = 8192, 64, 32
#: Entries that a task's table of counts holds before it is passed on, and bytes of a text counted at once.
ENTRIES, PIECE = 400_000, 1 << 20

#: What isn't part of a term becomes a space; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = re.compile(rb" ")


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces; no term is cut."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = _SPACES.search(raw, end)
            end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS = "lang string, source string, term string, n long, docs long"


def _emptied(n: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for group, found in n.items():
        terms = list(found)
        for k in range(0, len(terms), 1 << 16):
            part = terms[k : k + (1 << 16)]
            yield pa.record_batch(
                [
                    pa.array([group[0]] * len(part), pa.string()), pa.array([group[1]] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([found[t] for t in part], pa.int64()), pa.array([docs[group][t] for t in part], pa.int64()),
                ],
                schema=_COUNTS,
            )
        yield arrowkit.emit({"lang": [group[0]], "source": [group[1]], "term": [None], "n": [0], "docs": [0]}, _COUNTS)
    n.clear()
    docs.clear()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)
    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(arrowkit.strings(batch, "lang"), arrowkit.strings(batch, "source"), texts, strict=True):
            group, own = (lang, source), set()
            mine, there = n[group], docs[group]
            before = len(mine) + len(there)
            for words in terms_of(text.as_py().translate(_TABLE)):
                mine.update(words)
                own.update(words)
            there.update(own)
            held += len(mine) + len(there) - before
            if held > ENTRIES:
                yield from _emptied(n, docs)
                held = 0
    yield from _emptied(n, docs)


def term_counts(docs: DataFrame) -> DataFrame:
    """``n`` occurrences and ``docs`` documents of each term in each group; a group's row without term is always there."""
    arrowkit.small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(_counter, COUNTS)
    return materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Width of a count in bytes, places in two bytes each, counts."""
    most = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + places.astype("<u2").tobytes() + counts.astype(f"<u{width}").tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = packed[0]
    n = (len(packed) - 1) // (2 + width)
    return np.frombuffer(packed, "<u2", n, 1), np.frombuffer(packed, f"<u{width}", n, 1 + 2 * n).astype(np.int64)


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """Exact shares; long division in steps of a thousand where the product would outgrow a long."""
    a, base = counts + PRIOR, total + PRIOR * v
    if (int(a.max(initial=0)) * BILLION).bit_length() < 63:
        return 1 + a * BILLION // base
    if (base * 1000).bit_length() >= 63:
        return (1 + a.astype(object) * BILLION // base).astype(np.int64)
    out, rest = a // base, a % base
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // base, rest * 1000 % base
    return 1 + out


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for entries in batch.column("entries"):
            rows = entries.values
            packed.append(pack(rows.field("place").to_numpy(), rows.field("n").to_numpy()))
        columns = [batch.column(c) for c in ("lang", "source", "chunk")]
        yield pa.record_batch([*columns, pa.array(packed, pa.binary())], ["lang", "source", "chunk", "packed"])


_TILE = ("lang", "slab", "low", "high")
_VALUES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _spread(rows: list[dict]) -> np.ndarray:
    """Shares of the rows' groups over the terms of one chunk."""
    out = np.empty((len(rows), rows[0]["width"]), np.int64)
    for k, r in enumerate(rows):
        dense = np.zeros(r["width"], np.int64)
        if r["packed"] is not None:
            places, counts = unpack(r["packed"])
            dense[places] = counts
        out[k] = shares(dense, r["total"], r["v"]) if r["width"] else 0
    return out


class Tile:
    """One pair of blocks: chunks are added one after the other."""

    def __init__(self, lang: str):
        self.lang, self.sums, self.names = lang, None, ((), ())

    def add(self, chunk: list[dict], alone: bool) -> None:
        left = [r for r in chunk if not r["side"]]
        right = left if alone else [r for r in chunk if r["side"]]
        if self.sums is None:
            self.names = tuple([r["source"] for r in side] for side in (left, right))
            self.sums = np.zeros((len(left), len(right)), np.int64)
        if len(left) and len(right):
            a, b = _spread(left), _spread(right)
            for k in range(len(left)):
                self.sums[k] += np.abs(b - a[k]).sum(1)

    def values(self, alone: bool) -> pa.RecordBatch:
        pairs = [(a, b, int(self.sums[i, j])) for i, a in enumerate(self.names[0]) for j, b in enumerate(self.names[1]) if a != b]
        if not alone:
            pairs += [(b, a, v) for a, b, v in pairs]
        rows = {"lang": [self.lang] * len(pairs), "source": [p[0] for p in pairs], "item": [p[1] for p in pairs], "value": [p[2] for p in pairs]}
        return arrowkit.emit(rows, _VALUES)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile and chunk; one chunk of a tile is held at a time."""
    key, chunk, tile = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[c] for c in _TILE)
            if chunk and (at != key or row["chunk"] != chunk[0]["chunk"]):
                tile.add(chunk, key[2] == key[3])
                chunk = []
            if at != key:
                if tile is not None:
                    yield tile.values(key[2] == key[3])
                key, tile = at, Tile(row["lang"])
            chunk.append(row)
    if tile is not None:
        tile.add(chunk, key[2] == key[3])
        yield tile.values(key[2] == key[3])


def pair_values(held: DataFrame, groups: DataFrame, widths: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: sums of absolute differences of shares, both ways."""
    entries = held.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("entries"))  # a chunk's terms at most
    packed = entries.mapInArrow(_packer, "lang string, source string, chunk long, packed binary")
    frame = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    vectors = frame.join(widths, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = vectors.join(sources, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    tile = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high"), (F.col("block") > k).cast("int").alias("side")),
    )
    tiles = dealt.select(
        "lang", F.floor(F.col("chunk") / SLAB).alias("slab"), "chunk", "source", "total", "v",
        F.coalesce("width", F.lit(0)).cast("int").alias("width"), "packed", F.explode(tile).alias("t"),
    ).select("lang", "slab", "t.low", "t.high", "t.side", "chunk", "source", "total", "v", "width", "packed")
    order = [*_TILE, "chunk", "side", "source"]
    submatrices = tiles.repartition(*_TILE).sortWithinPartitions(*order).mapInArrow(_tiles, "lang string, source string, item string, value long")
    return submatrices.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: str, total: str) -> F.Column:
    """The share of a row, exact, as a long."""
    return F.expr(f"1 + cast({BILLION} as decimal(10, 0)) * cast({n} + {PRIOR} as decimal(20, 0)) div cast({total} + {PRIOR} * v as decimal(20, 0))")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``."""
    counts = term_counts(docs)
    found = counts.filter("term is not null")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "lang_n"), "audit-kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    size = materialize(size.withColumn("chunks", F.ceil(F.col("v") / CHUNK)), "audit-vocabularies")
    # two bytes hold a place: hashed chunks stay far below eight times their mean
    dealt = kept.join(size.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    nth = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    placed = materialize(dealt.select("lang", "term", "lang_n", "chunk", nth.alias("place")), "audit-places")
    held = materialize(found.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "audit-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(size, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"),
        F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("chunks", F.lit(1).cast("long")).alias("chunks"),
    )
    groups = materialize(groups, "audit-groups")
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(held, groups.drop("lang_total"), widths).withColumn("rank", F.row_number().over(by))
    own = held.join(groups.drop("chunks"), ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})
    terms = own.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))
