"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of chunks.

A byte-level tokenizer starts a new pre-token at a space or line feed that stands
alone between two characters that are not white space. The chunks between them are
encoded alone and give the same ids as the whole text. Chunks recur, so each worker
keeps the ids of the chunks it has met. Past ``max_chunks`` those that aren't met again
before as many others are forgotten. A text with other white space is cut only where the
rule holds.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: A single space between two characters that are not white space.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed, and the mark below: such a text is cut by ``_BREAK``.
_RARE = re.compile("[\t\r\x01\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Marks a chunk before which no space stands.
_BARE = "\x01"


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkMemory(dict):
    """Ids of chunks, of an older generation too; ``make`` gives those of a new one."""

    def __init__(self, make, max_chars: int):
        self.make, self.max_chars = make, max_chars
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= self.max_chars:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Encodes texts to little-endian unsigned ids: of 32 bits, or 16 with ``code`` H."""

    def __init__(self, path: str, code: str = "I", max_chunks: int = 300_000, max_chars: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.space = self.alphabet[ord(" ")]
        self.code = code
        self.marks = {x: self._whole(x) for x in ".,"}
        self.max_chunks = max_chunks
        self.known = ChunkMemory(self._make, max_chars)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _whole(self, plain: str) -> bytes:
        return array(self.code, self.tokenizer.encode(plain, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, space: str) -> bytes:
        """The ids of letters alone: one pre-token, so the model takes it as it is."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [x.id for x in self.model.tokenize(space + word)]).tobytes()

    @staticmethod
    def _plain(chunk: str) -> str:
        if chunk[:1] == _BARE:
            return chunk[1:]
        return chunk if chunk == "\n" else " " + chunk

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if text and not (
            text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS) or _RARE.search(text)
        ):
            return (_BARE + text.replace("\n", " \n " + _BARE)).split(" ")
        if _BARE in text:
            return [_BARE + text]
        first, *rest = _BREAK.split(text)
        return [_BARE + first, *rest]

    def _make(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk, self.space)
        if chunk[-1:] in (".", ",") and (stem := chunk[:-1]).isalpha():
            # letters and one mark are two pre-tokens
            return self.known[stem] + self.marks[chunk[-1]]
        if chunk[:1] == _BARE and chunk[1:].isalpha():
            return self._word(chunk[1:], "")
        return self._whole(self._plain(chunk))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes. An empty text has none."""
        if len(self.known) > self.max_chunks:
            self.known.age()
        ids = self.known.__getitem__
        return [b"".join(map(ids, self._chunks(x))) for x in texts]


@lru_cache(maxsize=2)
def encoder(path: str, code: str = "I") -> ChunkEncoder:
    """One encoder for each tokenizer file and Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path, code)
