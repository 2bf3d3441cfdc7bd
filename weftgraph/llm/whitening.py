"""Embedding whitening by exact integer scatter.

An entry ``c`` becomes the whole number ``x = floor(64 c) + SHIFT`` (64 c is first held
to plus or minus 2 ** 62). The fit list is each distinct x vector once. Tasks subtract
the shift and add up sums and cross-products in arbitrary precision: a batch by a matrix
product of doubles while every partial sum stays below 2 ** 53, of longs below 2 ** 63,
of Python's numbers beyond. Totals travel as limbs of 32 bits, which Spark adds up per
entry; so no total ever overflows. ``n XᵀX - SSᵀ`` is formed exactly, then divided by
``n ** 2`` to correctly rounded doubles and decomposed by ``eigh``.

The driver holds the scatter alone, whose size is the square of the dimension. Vectors
travel to be told apart as bytes of the least width that holds their entries.

Rows: one result for each input row and component, repeated rows alike (equal to the last
bit). Rows whose vector is null or holds null or non-finite entries go. Vectors of other
lengths count as filled up with 0.0. Components whose eigenvalue is zero in double
precision can't be whitened and are left out; with one distinct vector, or none, there is
no row. ``deviation`` is null where it exceeds a long; ``deviation_exact`` has its digits
at any size. A null vec_id stays null. Extra columns are left behind.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import arrowkit
from weftgraph.session import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Scaled entries are held to this; with the shift they stay in a long.
MOST = 1 << 62
_LIMB = 32
_EXACT_DOUBLE, _EXACT_LONG = 1 << 53, 1 << 63
_WIDTHS = (1, 2, 4, 8)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` in doubles of the rows whose entries are all finite."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.col("embedding").isNotNull() & finite)


def less_shift(column: pa.Array) -> np.ndarray:
    """``x - SHIFT`` of each vector, a row each; shorter ones are filled up with zeros."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(np.clip(column.flatten().to_numpy(zero_copy_only=False) * SCALE, -float(MOST), float(MOST))).astype(np.int64)
    width = int(lens.max(initial=0))
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    return out


def as_keys(rows: np.ndarray) -> list[bytes]:
    """One string of bytes for each vector, equal for equal vectors: width, then entries up to the last that isn't zero."""
    keys: list[bytes] = [b"\x01"] * len(rows)
    if not rows.size:
        return keys
    low, high = rows.min(1), rows.max(1)
    used = rows.shape[1] - np.argmax(rows[:, ::-1] != 0, axis=1)
    used[(low == 0) & (high == 0)] = 0
    left = np.ones(len(rows), bool)
    for w in _WIDTHS:
        fits = left & (low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1))
        at = np.flatnonzero(fits)
        raw, step = rows[at].astype(f"<i{w}").tobytes(), rows.shape[1] * w
        for k, i in enumerate(at):
            keys[i] = bytes([w]) + raw[k * step : k * step + int(used[i]) * w]
        left &= ~fits
    return keys


def from_keys(keys: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(keys), width), np.int64)
    kinds: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, k in enumerate(keys):
        kinds[k[0], len(k)].append(i)
    for (w, size), at in kinds.items():
        n = (size - 1) // w
        if n:
            out[at, :n] = np.frombuffer(b"".join(keys[i][1:] for i in at), f"<i{w}").reshape(len(at), n)
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(as_keys(less_shift(batch.column("embedding"))), pa.binary())], ["key"])


def scatter(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of whole numbers, as Python's numbers."""
    most = max(1, abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0))))
    bound = len(rows) * most * most
    if bound < _EXACT_DOUBLE:
        x = rows.astype(np.float64)
        return x.sum(0).astype(np.int64).astype(object), (x.T @ x).astype(np.int64).astype(object)
    if bound >= _EXACT_LONG:
        rows = rows.astype(object)
    return rows.sum(0).astype(object), (rows.T @ rows).astype(object)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """Place and value of the parts of 32 bits that aren't zero; all have the number's sign."""
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        if part := value & ((1 << _LIMB) - 1):
            yield k, sign * part
        value, k = value >> _LIMB, k + 1


_LIMBS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("part", pa.int64())])


def _scatter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            rows = from_keys(arrowkit.strings(batch, "key"), width)
            s, p = scatter(rows)
            n, sums, products = n + len(rows), sums + s, products + p
        # -1 stands for the constant one: its product with itself is the count
        totals = {(-1, -1): n} | {(-1, j): sums[j] for j in range(width)}
        totals |= {(i, j): products[i, j] for i in range(width) for j in range(i, width)}
        out = [(i, j, k, part) for (i, j), v in totals.items() for k, part in limbs(int(v))]
        yield arrowkit.emit(dict(zip(_LIMBS.names, zip(*out, strict=True), strict=True)) if out else {k: [] for k in _LIMBS.names}, _LIMBS)

    return run


@dataclass
class Whitening:
    """A fit: ``n`` vectors with sums ``sums`` (shift subtracted), axes over root of eigenvalue, shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``n x - S``, exact; the shift cancels."""
        most = max(1, abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0))))
        if self.n * most + max(map(abs, self.sums), default=0) < MOST:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, rows: np.ndarray) -> list[int]:
        z = self.centred(rows)
        most = max(1, int(z.max(initial=0)), -int(z.min(initial=0)))
        if z.dtype != object and z.shape[1] * most * most >= _EXACT_LONG:
            z = z.astype(object)
        return [int(v) for v in (z * z).sum(1)]

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Each row by the same sums in the same order, so that equal rows get equal values."""
        x = (self.centred(rows) / self.n).astype(np.float64)
        out = np.zeros((len(x), self.axes.shape[1]))
        for k in range(x.shape[1]):
            out += x[:, k : k + 1] * self.axes[k]
        return out


def decompose(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of ``(n XᵀX - SSᵀ) / n ** 2``, by falling eigenvalue."""
    d = len(sums)
    exact = {(i, j): n * products.get((i, j), 0) - sums[i] * sums[j] for i in range(d) for j in range(i, d)}
    v = np.zeros((d, d))
    for (i, j), x in exact.items():
        v[i, j] = v[j, i] = x / (n * n)  # of two whole numbers: correctly rounded
    values, vectors = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = 8 * d * np.finfo(float).eps * values[0] if d else 0.0
    kept = int((values[:components] > floor).sum()) if d and values[0] > 0 else 0
    trace = sum(exact[i, i] for i in range(d)) / (n * n) if n else 0.0
    return Whitening(n, sums, vectors[:, :kept] / np.sqrt(values[:kept]), [float(e / trace) for e in values[:kept]])


def fit_list(vectors: DataFrame) -> DataFrame:
    """``key``: each distinct x vector once."""
    arrowkit.small_batches(vectors.sparkSession)
    return materialize(vectors.select("embedding").mapInArrow(_encode, "key binary").distinct(), "whitening-fit")


def fit(keys: DataFrame, components: int = COMPONENTS) -> Whitening:
    width = keys.agg(F.max((F.length("key") - 1) / F.ascii(F.substring("key", 1, 1).cast("string")))).first()[0]
    parts = keys.mapInArrow(_scatter(int(width or 0)), "i int, j int, place int, part long")
    totals: dict[tuple[int, int], int] = defaultdict(int)
    # as many rows as the scatter has entries, times the limbs of one
    for r in parts.groupBy("i", "j", "place").agg(F.sum("part").alias("part")).collect():
        totals[r["i"], r["j"]] += r["part"] << (_LIMB * r["place"])
    sums = [totals[-1, j] for j in range(int(width or 0))]
    return decompose(totals[-1, -1], sums, totals, components)


def identity_error(keys: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    width, k = len(model.sums), len(model.explained)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += model.whitened(from_keys(arrowkit.strings(batch, "key"), width)).sum(0)
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(total)], ["i", "part"])

    means = {r["i"]: r["part"] / model.n for r in keys.mapInArrow(sums, "i int, part double").groupBy("i").agg(F.sum("part").alias("part")).collect()}
    mean = np.array([means[i] for i in range(k)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = model.whitened(from_keys(arrowkit.strings(batch, "key"), width)) - mean
            total += x.T @ x
        yield pa.record_batch([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["i", "part"])

    cov = np.zeros(k * k)
    for r in keys.mapInArrow(products, "i int, part double").groupBy("i").agg(F.sum("part").alias("part")).collect():
        cov[r["i"]] = r["part"] / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


_OUT = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("deviation_exact", pa.string()), ("whitened", pa.list_(pa.float64()))])


def _apply(model: Whitening):
    width = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = less_shift(batch.column("embedding"))[:, :width]  # what lies beyond is zero in all rows
            rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
            exact = model.deviations(rows)
            yield arrowkit.emit(
                {
                    "vec_id": batch.column("vec_id").cast(pa.int64()),
                    "deviation": [v if v < _EXACT_LONG else None for v in exact],
                    "deviation_exact": [str(v) for v in exact],
                    "whitened": list(model.whitened(rows)),
                },
                _OUT,
            )

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``deviation_exact``."""
    rows = usable(vectors)
    keys = fit_list(rows)
    model = fit(keys, components)
    error = identity_error(keys, model) if model.explained else 0.0
    done = rows.mapInArrow(_apply(model), "vec_id long, deviation long, deviation_exact string, whitened array<double>")
    each = done.select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
