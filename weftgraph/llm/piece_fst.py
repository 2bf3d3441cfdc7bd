"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer of a byte-pair model is compiled from the model's own file and composed of
four parts. The normaliser rewrites the strings of the model's character map, the longest
first, squeezes spaces if the model says so, writes a mark for each space and, if the
model says so, one before the text. The piece transducer is a trie: reading a piece's
characters emits its id at the cost of its negative score. The byte fallback reads a
character that no piece holds and emits a byte piece for each of its UTF-8 bytes, at a
cost above any path without one. The last part accepts a piece after another only if the
model's merges leave the two standing when they are run on both alone; merges on either
side of a boundary don't depend on each other until one crosses it, so exactly the model's
own segmentation passes at every boundary.

Composed with an input, this is a lattice over its positions. Its tropical shortest path is
found left to right: an arc relaxes the cost of the position where it ends, and of the arcs
that the last part accepts the cheapest stays. No piece joins a character to a mark behind
it, so a text falls into chunks at spaces, and chunks recur.

Rows: one result for each input row. A null or empty text has no ids. A mark that
stands in a text itself reads as a space, as in the library. An empty table gives no
row. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm import arrowkit
from weftgraph.llm.bpe_ids import _BARE, ChunkEncoder, ChunkMemory

MARK = "▁"
#: Cost of a byte piece: above any path without one.
FALLBACK = 1e10


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The rewritings of a compiled map: a double-array trie of keys, then the strings they become."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = array("I", blob[4 : 4 + size])
    strings = blob[4 + size :]
    out = {}
    todo = [(b"", 0)]
    while todo:
        key, node = todo.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
        if key and unit & 256:  # a key ends here
            start = units[base] & 0x7FFFFFFF
            out[key.decode("utf-8", "replace")] = strings[start : strings.index(b"\0", start)].decode("utf-8", "replace")
        for b in range(1, 256):
            if (at := base ^ b) < len(units) and units[at] & 0x800000FF == b:
                todo.append((key + bytes([b]), at))
    return out


#: Kinds of pieces in a model file.
_NORMAL, _USER, _BYTE = 1, 4, 6


class PieceTransducer(ChunkEncoder):
    """Encodes texts to ids of pieces, and back."""

    def __init__(self, path: str, max_chunks: int = 400_000, max_pairs: int = 1_000_000, max_chars: int = 48):
        with open(path, "rb") as f:
            self._compile(f.read())
        #: Marks before which no piece holds a letter: they end a chunk's word.
        self.stops = {c: array("I", [self.ids[c]]).tobytes() for c in ".," if c in self.ids}
        for p in self.ids:
            for c in set(p[1:]) & self.stops.keys():
                if any(x.isalpha() and y == c for x, y in zip(p, p[1:], strict=False)):
                    del self.stops[c]
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        #: For each left piece what the last part says of right pieces; ``asked`` counts them all.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.asked = 0
        self.max_chunks, self.max_pairs = max_chunks, max_pairs
        self.known = ChunkMemory(self._make, max_chars)

    def _compile(self, model: bytes) -> None:
        """The parts of the transducer from the model's file."""
        self.pieces: list[str] = []
        self.bytes_: dict[int, int] = {}
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        #: A state of the trie: what it emits (piece, cost, id; None if no piece ends there), and its arcs.
        self.trie: list = [None, {}]
        spec: dict[int, int | bytes] = {}
        for field, value in _fields(model):
            if field == 3:
                spec = dict(_fields(value))
            if field != 1:
                continue
            own = dict(_fields(value))
            i, piece, kind = len(self.pieces), own.get(1, b"").decode(), own.get(3, _NORMAL)
            self.pieces.append(piece)
            if kind == _BYTE:
                self.bytes_[int(piece[3:-1], 16)] = i
            elif kind == _NORMAL:
                self.scores[piece] = struct.unpack("<f", own.get(2, bytes(4)))[0]
                self.ids[piece] = i
                node = self.trie
                for c in piece:
                    node = node[1].setdefault(c, [None, {}])
                node[0] = (piece, -self.scores[piece], i)
            elif kind == _USER:
                raise ValueError("pieces that a user defined aren't supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind another character: texts don't fall into chunks")
        self.rewrites = character_map(spec.get(2, b""))
        self.keys = re.compile("|".join(map(re.escape, sorted(self.rewrites, key=len, reverse=True)))) if self.rewrites else None
        self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("the model doesn't write marks for spaces")

    def vocabulary(self) -> int:
        return len(self.pieces)

    # the normaliser; marks are written chunk by chunk

    def normalise(self, text: str) -> str:
        """The text as pieces see it, with spaces where marks will stand."""
        if self.keys is not None:
            text = self.keys.sub(lambda m: self.rewrites[m[0]], text)
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text

    def _chunks(self, text: str) -> list[str]:
        text = self.normalise(text)
        if not text:
            return []
        if _BARE in text:
            return [f"{_BARE}{' ' if self.dummy else ''}{text}"]
        first, *rest = ChunkEncoder._chunks(text)
        if not self.dummy:
            return [first, *rest]
        # alone, a line feed is a chunk without a mark
        return [first[1:] if first != _BARE + "\n" else _BARE + " \n", *rest]

    @staticmethod
    def _plain(chunk: str) -> str:
        if chunk[:1] == _BARE:
            return chunk[1:].replace(" ", MARK)
        return chunk if chunk == "\n" else MARK + chunk.replace(" ", MARK)

    # composition and shortest path

    def merged(self, symbols: list[str]) -> list[str]:
        """The model's merges on a few symbols: the best score first, leftmost of equals."""
        scores = self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _accepts(self, left: str, right: str) -> bool:
        """Do the merges leave both pieces standing? ``left`` may be empty."""
        if self.asked > self.max_pairs:
            for row in self.pairs.values():
                row.clear()
            self.asked = 0
        self.asked += 1
        says = self.merged([*left, *right]) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = says
        return says

    def path(self, text: str) -> list[int]:
        """The shortest path's ids for a normalised text."""
        n = len(text)
        starts, pairs = self.trie[1], self.pairs
        far = float("inf")
        # for each position the best cost, the last piece with its id ("" after a fallback), and where it starts
        cost, last, back = [0.0] + [far] * n, [("", 0.0, -1)] * (n + 1), [0] * (n + 1)
        for i in range(n):
            before = cost[i]
            if before == far:
                continue
            node = starts.get(text[i])
            if (node is None or node[0] is None) and before + FALLBACK < cost[i + 1]:  # no piece for the character
                cost[i + 1], last[i + 1], back[i + 1] = before + FALLBACK, ("", 0.0, -1), i
            left = last[i][0]
            if (row := pairs.get(left)) is None:
                row = pairs[left] = {}
            j = i
            while node is not None:
                arc, arcs = node
                j += 1
                # relax: only an arc that is cheaper and accepted
                if arc is not None and (total := before + arc[1]) < cost[j]:
                    if (says := row.get(arc[0])) is None:
                        says = self._accepts(left, arc[0])
                    if says:
                        cost[j], last[j], back[j] = total, arc, i
                if j == n:
                    break
                node = arcs.get(text[j])
        out: list[int] = []
        j = n
        while j:
            i = back[j]
            if last[j][2] >= 0:
                out.append(last[j][2])
            else:
                out += [self.bytes_[b] for b in reversed(text[i:j].encode("utf-8", "surrogatepass"))]
            j = i
        return out[::-1]

    def _make(self, chunk: str) -> bytes:
        if chunk[-1:] in self.stops and (stem := chunk[:-1])[-1:].isalpha():
            return self.known[stem] + self.stops[chunk[-1]]
        return array("I", self.path(self._plain(chunk))).tobytes()

    # decoding

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces in a row, byte pieces as the bytes they stand for."""
        pieces, byte_of = self.pieces, self.byte_of
        row = array("I", ids)
        if not byte_of.keys().isdisjoint(row):
            out: list[str] = []
            held = bytearray()
            for i in row:
                if (b := byte_of.get(i)) is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(pieces[i])
            if held:
                out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(pieces.__getitem__, row))
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
ENCODED = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
_ENCODED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_ids", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("decoded_sha256", pa.string()),
        ("round_trip", pa.bool_()),
    ]
)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` of each document."""
    arrowkit.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            found = fst.encode(arrowkit.strings(batch, "text"))
            rows = {"doc_id": arrowkit.strings(batch, "doc_id"), "ids": [array("i", x) for x in found]}
            yield arrowkit.emit(rows, _IDS)

    return arrowkit.texts_of(docs, "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Encode every document and decode its ids; digests of both, and whether the text came back."""
    arrowkit.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            texts = arrowkit.strings(batch, "text")
            found = fst.encode(texts)
            decoded = [fst.decode(x) for x in found]
            yield arrowkit.emit(
                {
                    "doc_id": arrowkit.strings(batch, "doc_id"),
                    "n_ids": [len(x) // 4 for x in found],
                    "ids_crc32": [zlib.crc32(x) for x in found],
                    "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded],
                    "round_trip": [a == b for a, b in zip(texts, decoded, strict=True)],
                },
                _ENCODED,
            )

    return arrowkit.texts_of(docs, "doc_id").mapInArrow(run, ENCODED)
