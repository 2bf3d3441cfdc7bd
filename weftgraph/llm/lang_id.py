"""Language identification by string kernels.

A text's features are the character n-grams (lengths 1 to 3, lower case, hashed to
``BUCKETS``) that occur in its whole text at least once. The blended-spectrum presence
kernel of two texts is the number of n-grams they share over the root of the product
of their own numbers. ``LANDMARKS`` training texts span a Nyström map, in which
one-versus-rest kernel ridge regression is solved in closed form. A kernel value is a
product of presence vectors, so landmarks and coefficients fold into one matrix and a
batch of texts is scored by one matrix product.

The classifier is fitted on at most ``MAX_TRAIN`` labelled rows, as many of each
language as that allows, taken in the order of a checksum of their ids. Each is a bit
vector of 8 KB when it reaches the driver, whatever its length.

Rows: one result for each input row, repeated rows alike. A null text or one without a
letter is ``und`` with score 0. Where no row is labelled, all are ``und``. A null
doc_id isn't held out. An empty table gives no row. Other columns are never inputs of
a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm import arrowkit
from weftgraph.session import materialize

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
MAX_TRAIN = 1200
LANDMARKS = 192
RIDGE = 1e-3
SHARPNESS = 4.0
FOLDS = 5
UNDETERMINED = "und"
_BLOCK = 64
#: Bytes of a packed row that are spread out at once.
_BYTES = 512
_PIECE = 1 << 20


def presence(texts: list[str]) -> np.ndarray:
    """One row of zeros and ones for each text: which hashed n-grams it has."""
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    overlap = max(LENGTHS) - 1
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), _PIECE):  # long texts in pieces that overlap
            piece = text[max(0, at - overlap) : at + _PIECE].lower()
            chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
            gram = chars
            for n in LENGTHS:
                if n > 1:
                    gram = gram[:-1] * np.uint32(0x01000193) + chars[n - 1 :]
                if len(gram):
                    mixed = (gram ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                    row[mixed >> np.uint32(16)] = 1
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """``weights``: buckets by languages. A score is the weights of a text's n-grams,
    summed and divided by the root of their number."""

    languages: list[str]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(rows), _BLOCK):
            block = rows[at : at + _BLOCK]
            x = presence([texts[i] for i in block])
            size = np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1))
            margin = (x.astype(np.float32) @ self.weights) / size[:, None]
            odds = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
            odds /= odds.sum(1, keepdims=True)
            best = odds.argmax(1)
            for i, k, p in zip(block, best, odds.max(1), strict=True):
                names[i], scores[i] = self.languages[k], p
        return names, scores


def _wide(bits: np.ndarray) -> Iterator[np.ndarray]:
    """Packed presence rows, unpacked a range of buckets at a time."""
    for at in range(0, bits.shape[1], _BYTES):
        yield np.unpackbits(bits[:, at : at + _BYTES], axis=1)


def _kernel(bits: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel of all rows with the landmarks, and the root of each row's number of n-grams.

    Buckets go by in ranges, so that neither the rows nor the landmarks are ever spread
    out whole; counts are whole numbers, exact in any order.
    """
    shared, held = np.zeros((len(bits), len(marks))), np.zeros(len(bits), np.int64)
    for x in _wide(bits):
        held += x.sum(1, dtype=np.int64)
        x = x.astype(np.float32)
        shared += x @ x[marks].T
    size = np.sqrt(np.maximum(held, 1))
    return shared / size[:, None] / size[marks], size


def solve(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström map and one-versus-rest ridge regression. ``bits``: packed presence rows."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    y = np.array([languages.index(x) for x in labels])
    # landmarks: of each language in turn
    turn = np.empty(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    marks = np.lexsort((y, turn))[:landmarks]
    across, size = _kernel(bits, marks)
    values, vectors = np.linalg.eigh(across[marks])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = across @ root
    weight = 1.0 / np.bincount(y)[y]  # each language counts alike
    weight *= len(y) / weight.sum()
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    zw = z * weight[:, None]
    beta = np.linalg.solve(z.T @ zw + ridge * len(y) * np.eye(z.shape[1]), zw.T @ target)
    shares = ((root @ beta) / size[marks, None]).astype(np.float32)
    folded = [x.astype(np.float32).T @ shares for x in _wide(bits[marks])]
    return Model(languages, np.concatenate(folded).astype(np.float32))


_BITS = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("bits", pa.binary())])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, _BLOCK):
        packed = np.packbits(presence(arrowkit.strings(batch, "text")), axis=1)
        rows = {k: arrowkit.strings(batch, k) for k in ("lang", "order")}
        yield arrowkit.emit(rows | {"bits": [x.tobytes() for x in packed]}, _BITS)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> Model:
    """Fit on labelled rows outside the held-out fold, at most ``max_train`` of them.

    A first draw by checksum leaves about twice the quota of each language; only those
    are ranked, so no task sorts a common language.
    """
    arrowkit.small_batches(docs.sparkSession)
    order = F.crc32(F.concat(F.lit("order "), F.col("doc_id").cast("string")))
    labelled = docs.select(
        "text", "lang", order.alias("order"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    ).filter("lang is not null and text is not null and not held_out and text rlike '\\\\p{L}'")
    # lengths and letters aside, counting needs the labels alone
    counts = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    kinds = counts.count()
    if not kinds:
        return solve(np.zeros((0, BUCKETS // 8), np.uint8), [])
    quota = max(1, max_train // kinds)
    drawn = labelled.join(counts, "lang").filter(F.col("order") * F.col("n") < F.lit(float(2 * quota + 50)) * 2**32)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    chosen = drawn.withColumn("rank", rank).filter(F.col("rank") <= quota).select("lang", "order", "text")
    rows = chosen.orderBy("lang", "order").limit(max_train).mapInArrow(_bits, "lang string, order long, bits binary")
    found = sorted(rows.collect(), key=lambda r: (r["order"], r["lang"], bytes(r["bits"])))
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in found]).reshape(-1, BUCKETS // 8)
    return solve(bits, [r["lang"] for r in found], landmarks)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def prediction(spark: SparkSession, model: Model):
    """A function of a text column: struct of ``lang_pred`` and ``score``.

    The model is some bytes for each bucket and language.
    """
    arrowkit.small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.weights))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        names, scores = Model(*shared.value).predict([x if isinstance(x, str) else None for x in text])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predicted


def identify(docs: DataFrame, **limits: int) -> DataFrame:
    """Predict the language of every document by a model fitted on the labelled ones."""
    predicted = prediction(docs.sparkSession, fit(docs, **limits))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return docs.select("doc_id", out.alias("held_out"), predicted("text").alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def spoken_documents(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows, with their own columns.

    A document goes where it has no letter or where the likeliest language stays
    below ``min_score``.
    """
    found = docs.withColumn("_lang_id", prediction(docs.sparkSession, fit(docs))("text"))
    known = (F.col("_lang_id.lang_pred") != UNDETERMINED) & (F.col("_lang_id.score") >= min_score)
    return found.filter(known).select(docs.columns)
