"""Near duplicates by SimHash fingerprints, linked by vantage-point trees.

A fingerprint has a bit for each bit of a 64-bit hash: 1 if more than half of the hashes
of a text's shingles have it. Two link where at most ``radius`` bits differ.

Distances between whole fingerprints of unlike texts crowd around 32, too near each
other for triangle bounds to prune. So the 64 bits are cut into as few bands as bring the
radius down to one: of ``radius + 1`` over two bands, rounded up, at least one differs in a
bit at most. Each band has a tree:

1. The upper levels are shards. A node parts its fingerprints by their Hamming distance from
   its vantage point, a shell for each distance; ``DEPTH`` levels and more as the fingerprints
   grow, so that a shard stays at about ``SHARD``. By the triangle bound, fingerprints whose
   band differs in one bit lie in shells one apart, and the parity of the distance says: in
   exactly one apart at every level. So a fingerprint resides in its own shard and is a guest
   in those across a boundary, of every two shards in one of them.
2. A shard of more than ``BLOCK`` residents is dealt in blocks that meet in pairs.
3. A task goes on with the tree over its residents and guests until a node has ``LEAF``
   residents or their bands are equal, and compares whole fingerprints there: all that links is
   found, nothing else is kept. It returns links that span its components, not all pairs.

Equal fingerprints travel once. Components come from contracting links.

Rows: one result for each input row, the same for equal texts. Null, empty and wordless texts
have the fingerprint zero, and link like any other. A null doc_id names no component; one of
such rows alone has null. An empty table gives no row. Extra columns are left behind.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import arrowkit
from weftgraph.llm.jaccard_join import components
from weftgraph.session import materialize

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
#: Levels of shards at least, and the residents of a shard that further levels aim at.
DEPTH, SHARD = 2, 20_000
#: Residents of a task, of a leaf.
BLOCK, LEAF = 50_000, 256
#: Comparisons made at once.
_CELLS = 1 << 20
_RUN = 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def fingerprint(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's UTF-8 bytes: XXH64 of word shingles, repeats included."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    white = data == 32
    again = white.copy()
    again[1:] &= white[:-1]
    again[:1] = False
    joined = data[~again].tobytes().strip(b" ")
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(joined)]
    if len(starts) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), _RUN):
        part = zip(starts[k : k + _RUN].tolist(), ends[k : k + _RUN].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], seed) for a, b in part], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


_PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


def _printer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
            yield arrowkit.emit({"doc_id": batch.column("doc_id").cast(pa.int64()), "print": found}, _PRINTS)

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint as a long."""
    arrowkit.small_batches(docs.sparkSession)
    return arrowkit.texts_of(docs, "doc_id").mapInArrow(_printer(size), "doc_id long, print long")


def bands(radius: int) -> list[int]:
    """Masks of the bands: so many that two fingerprints within the radius differ in one bit of some band at most."""
    n = (radius + 2) // 2
    cut = [BITS * k // n for k in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(cut)]


def vantage_points(masks: list[int], depth: int) -> list[list[int]]:
    """For each band its vantage points, level by level: fixed, and unlike each other."""
    rng = np.random.default_rng(64)
    return [[int(v) & m for v in rng.integers(0, 1 << 64, depth, dtype=np.uint64, endpoint=False)] for m in masks]


def _long(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def depth_for(prints: int) -> int:
    """Shells of a level part a shard in about eight."""
    return max(DEPTH, math.ceil(math.log(max(1, prints / SHARD), 8)))


def shards(prints: DataFrame, radius: int, depth: int) -> DataFrame:
    """``shard``, ``print``, ``guest``: every fingerprint as resident and as guest across boundaries."""
    masks = bands(radius)
    places = []
    for band, (mask, points) in enumerate(zip(masks, vantage_points(masks, depth), strict=True)):
        shells = [F.bit_count(F.col("print").bitwiseAND(F.lit(_long(mask))).bitwiseXOR(F.lit(_long(v)))) for v in points]

        def shard(steps: tuple[int, ...], band: int = band, shells: list = shells) -> F.Column:
            return F.array(F.lit(band), *(s + F.lit(k) for s, k in zip(shells, steps, strict=True)))

        places.append(F.struct(shard((0,) * depth).alias("shard"), F.lit(False).alias("guest")))
        # across the first level's boundary one way only: of two shards one gets the guest
        for steps in itertools.product((-1,), *[(-1, 1)] * (depth - 1)):
            places.append(F.struct(shard(steps).alias("shard"), F.lit(True).alias("guest")))
    rows = prints.select("print", F.explode(F.array(*places)).alias("p"))
    return rows.select("p.shard", "print", "p.guest").filter(F.array_min("shard") >= 0)


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows with their task's blocks ``i``, ``j`` and their ``side``: 0 resident, 1 guest, 2 resident of the other block."""
    sizes = rows.filter("not guest").groupBy("shard").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sizes = materialize(sizes.filter("blocks > 1"), "simhash-large")
    own = F.pmod(F.xxhash64("print"), F.col("blocks"))

    def task(i: F.Column, j: F.Column, side: F.Column) -> F.Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    zero = F.lit(0)
    every = F.sequence(zero.cast("long"), F.col("blocks") - 1)
    met = F.transform(every, lambda k: F.when(F.col("guest"), task(k, k, F.lit(1))).otherwise(task(F.least(k, own), F.greatest(k, own), F.when(own > k, 2).otherwise(0))))
    tasks = F.when(F.col("blocks").isNull(), F.array(task(zero, zero, F.col("guest")))).otherwise(met)
    return rows.join(sizes, "shard", "left").select("shard", "print", F.explode(tasks).alias("t")).select("shard", "print", "t.*")


def _alike(x: np.ndarray, radius: int) -> np.ndarray:
    """A number for each fingerprint, equal where links connect them."""
    n = len(x)
    label = np.arange(n)
    if n * n <= _CELLS:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        if near.sum() == n:
            return label
    label[:] = -1
    left = np.arange(n)
    while len(left):
        first, left = left[:1], left[1:]
        label[first] = first[0]
        edge = first
        while len(edge) and len(left):
            rows = max(1, _CELLS // len(left))
            part, edge = edge[:rows], edge[rows:]
            met = (np.bitwise_count(x[part][:, None] ^ x[left][None, :]) <= radius).any(0)
            label[left[met]] = first[0]
            edge, left = np.r_[edge, left[met]], left[~met]
    return label


def leaf_links(own: np.ndarray, label: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of residents within their components, and one of each other to every component it links with."""
    moved = label != np.arange(len(own))
    yield own[label[moved]], own[moved]
    if not len(others) or not len(own):
        return
    order = np.argsort(label, kind="stable")
    heads = np.flatnonzero(np.diff(label[order], prepend=-1))
    for k in range(0, len(others), step := max(1, _CELLS // len(own))):
        part = others[k : k + step]
        near = np.bitwise_count(part[:, None] ^ own[order][None, :]) <= radius
        at, which = np.nonzero(np.logical_or.reduceat(near, heads, axis=1))
        yield own[label[order[heads[which]]]], part[at]


def tree_links(own: np.ndarray, guests: np.ndarray, met: np.ndarray, mask: int, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links of the residents ``own`` with each other, with ``guests`` and with residents of another block (``met``).

    With ``met``, residents aren't compared with each other. Guests differ from residents
    they link with in one bit of the band, all others in none: that is what shells prune by.
    """
    inside = not len(met)
    band = np.uint64(mask)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    nodes = [(own, guests, met)]
    while nodes:
        r, g, m = nodes.pop()
        if not len(r):
            continue
        vantage = r[len(r) // 2] & band
        away = np.bitwise_count((r & band) ^ vantage)
        if len(r) <= leaf or not away.any():
            label = _alike(r, radius) if inside else np.arange(len(r))
            found += leaf_links(r, label, np.r_[g, m], radius)
            continue
        far_g, far_m = np.bitwise_count((g & band) ^ vantage), np.bitwise_count((m & band) ^ vantage)
        for shell in np.unique(away):
            across = (far_g == shell + 1) | (far_g + 1 == shell)
            nodes.append((r[away == shell], g[across], m[far_m == shell]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linker(radius: int):
    masks = bands(radius)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        prints = table.column("print").to_numpy().view(np.uint64)
        mask = masks[table.column("shard")[0].as_py()[0]]
        a, b = tree_links(*(prints[side == k] for k in (0, 1, 2)), mask, radius)
        return pa.table([pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b)], schema=_LINKS)

    return run


def print_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """``a``, ``b``: links that connect whatever fingerprints within the radius connect."""
    depth = depth_for(prints.count()) if depth is None else depth
    tasks = dealt(shards(prints, radius, depth), block)
    return materialize(tasks.groupBy("shard", "i", "j").applyInArrow(_linker(radius), "a long, b long").filter("a != b"), "simhash-links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs, size), "simhash-prints")
    least = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = components(print_links(least.select("print"), radius)).withColumnRenamed("class", "print")
    named = least.join(labels, "print", "left").withColumn("component", F.coalesce("component", "print"))
    of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.select("print", "component").join(of, "component").select("print", "component_id")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(known, "print").select("doc_id", digits.alias("fingerprint"), "component_id")
