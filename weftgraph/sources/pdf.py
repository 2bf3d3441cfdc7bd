"""Text spans from the bytes of PDF files.

A reader of our own for what text needs: objects and object streams, deflated streams, the
page tree, fonts with their code maps and widths, and the operators that place text. Files
are read in parallel; a file that can't be read is one row with its error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = (
    "doc_id string, page int, line int, span int, text string, font_size double, is_bold boolean, is_italic boolean, "
    "x0 double, y0 double, x1 double, y1 double, page_height double, error string"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in SPANS.split(","))])
#: Baselines that are closer are one line; a gap of so many font sizes parts two spans.
SAME_LINE, SPAN_GAP = 2.0, 0.15
_ASCENT, _DESCENT, _WIDTH = 0.8, 0.2, 0.5


class Name(str):
    """A PDF name."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    about: dict
    raw: bytes

    def data(self) -> bytes:
        kind = self.about.get("Filter")
        kinds = kind if isinstance(kind, list) else [kind] if kind else []
        out = self.raw
        for k in kinds:
            if k not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {k}")
            out = zlib.decompressobj().decompress(out)
        return out


class Operator(str):
    """A word of a content stream."""


_SPACE = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*")
_PLAIN = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Lexer:
    """Values of PDF syntax, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def _string(self) -> bytes:
        out, depth = bytearray(), 1
        d = self.data
        while self.at < len(d):
            c = d[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = d[self.at : self.at + 1]
                if octal := re.match(rb"[0-7]{1,3}", d[self.at : self.at + 3]):
                    out.append(int(octal[0], 8) & 255)
                    self.at += len(octal[0])
                    continue
                self.at += 1
                out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if depth == 0:
                break
            out += c
        return bytes(out)

    def value(self):
        """The next value; an ``Operator`` for a bare word, None at the end."""
        self.skip()
        d, at = self.data, self.at
        two = d[at : at + 2]
        if not two:
            return None
        if two == b"<<":
            self.at += 2
            out = {}
            while (key := self.value()) is not None and key != ">>":
                out[str(key)] = self.value()
            return out
        if two == b">>":
            self.at += 2
            return Operator(">>")
        c = two[:1]
        self.at += 1
        if c == b"(":
            return self._string()
        if c == b"<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            items = []
            while (item := self.value()) is not None and item != "]":
                items.append(item)
            return items
        if c in b"]{})>":
            return Operator(c.decode())
        if c == b"/":
            m = _PLAIN.match(d, self.at)
            word = m[0] if m else b""
            self.at += len(word)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), word).decode("latin-1"))
        m = _PLAIN.match(d, at)
        if m is None:
            return self.value()
        self.at = m.end()
        word = m[0].decode("latin-1")
        if re.fullmatch(r"[+-]?\d+", word):
            if ref := re.compile(rb"[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+R(?![A-Za-z])").match(d, self.at):
                self.at = ref.end()
                return Ref(int(word))
            return int(word)
        if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return {"true": True, "false": False, "null": Name("")}.get(word, Operator(word))


class Document:
    """The objects of a file; later ones with a number replace earlier ones."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.trailers: list[dict] = []
        for m in re.finditer(rb"(?<!\d)(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+obj\b", data):
            lexer = Lexer(data, m.end())
            about = lexer.value()
            lexer.skip()
            if isinstance(about, dict) and data.startswith(b"stream", lexer.at):
                start = lexer.at + 6
                start += 2 if data.startswith(b"\r\n", start) else 1
                size = about.get("Length")
                end = start + size if isinstance(size, int) and data.startswith(b"endstream", _SPACE.match(data, start + size).end()) else data.find(b"endstream", start)
                about = Stream(about, data[start : len(data) if end < 0 else end])
            self.objects[int(m[1])] = about
        for x in [x for x in self.objects.values() if isinstance(x, Stream) and x.about.get("Type") == "ObjStm"]:
            inner = x.data()
            heads = Lexer(inner)
            places = [(heads.value(), heads.value()) for _ in range(self.get(x.about.get("N"), 0))]
            for number, at in places:
                self.objects.setdefault(number, Lexer(inner, self.get(x.about.get("First"), 0) + at).value())
        for m in re.finditer(rb"trailer", data):
            if isinstance(about := Lexer(data, m.end()).value(), dict):
                self.trailers.append(about)
        self.trailers += [x.about for x in self.objects.values() if isinstance(x, Stream) and x.about.get("Type") == "XRef"]
        if any("Encrypt" in x for x in self.trailers):
            raise ValueError("encrypted")

    def get(self, x, default=None):
        """What a reference points to."""
        for _ in range(32):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return default if x is None else x

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        root = next((r for t in reversed(self.trailers) if isinstance(r := self.get(t.get("Root")), dict)), None)
        root = root or next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), {})
        todo: list[tuple[object, dict]] = [(root.get("Pages"), {})]
        met: set[int] = set()
        while todo:
            at, inherited = todo.pop()
            if isinstance(at, Ref):
                if at.number in met:
                    continue
                met.add(at.number)
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            own = inherited | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["Kids"], []))]
            else:
                yield inherited | node


class Font:
    """How codes of a font become text and widths."""

    def __init__(self, doc: Document, about: dict):
        base = str(about.get("BaseFont", ""))
        inner = doc.get(about.get("DescendantFonts"), [])
        self.wide = about.get("Subtype") == "Type0"
        descendant = doc.get(inner[0], {}) if inner else {}
        facts = doc.get((descendant or about).get("FontDescriptor"), {})
        flags = doc.get(facts.get("Flags"), 0)
        self.bold = bool(re.search("bold|black|heavy", base, re.I)) or doc.get(facts.get("FontWeight"), 400) >= 600
        self.italic = bool(re.search("italic|oblique", base, re.I)) or bool(flags & 64)
        self.codes: dict[int, str] = {}
        if isinstance(to := doc.get(about.get("ToUnicode")), Stream):
            self._map(to.data())
        encoding = doc.get(about.get("Encoding"))
        self.charset = "mac-roman" if "MacRomanEncoding" in (encoding, encoding.get("BaseEncoding") if isinstance(encoding, dict) else None) else "cp1252"
        self.widths: dict[int, float] = {}
        self.default = float(doc.get(descendant.get("DW"), 1000)) if self.wide else 1000 * _WIDTH
        if self.wide:
            row = doc.get(descendant.get("W"), [])
            i = 0
            while i + 1 < len(row):
                if isinstance(listed := doc.get(row[i + 1]), list):
                    self.widths |= {row[i] + k: float(w) for k, w in enumerate(listed)}
                    i += 2
                else:
                    self.widths |= dict.fromkeys(range(row[i], min(row[i + 1], 65535) + 1), float(row[i + 2])) if i + 2 < len(row) else {}
                    i += 3
        else:
            first = doc.get(about.get("FirstChar"), 0)
            self.widths = {first + k: float(doc.get(w, 0)) for k, w in enumerate(doc.get(about.get("Widths"), []))}

    def _map(self, data: bytes) -> None:
        """Codes of the character map."""
        text = lambda x: x.decode("utf-16-be", "replace") if isinstance(x, bytes) else ""
        number = lambda x: int.from_bytes(x, "big")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            lexer = Lexer(block)
            while (code := lexer.value()) is not None:
                self.codes[number(code)] = text(lexer.value())
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            lexer = Lexer(block)
            while (low := lexer.value()) is not None:
                high, to = lexer.value(), lexer.value()
                for k in range(min(number(high) - number(low), 65535) + 1):
                    self.codes[number(low) + k] = text(to[k]) if isinstance(to, list) else text((number(to) + k).to_bytes(len(to), "big"))

    def read(self, raw: bytes) -> tuple[str, float, int]:
        """Text, width in thousandths and number of spaces."""
        step = 2 if self.wide else 1
        codes = [int.from_bytes(raw[i : i + step], "big") for i in range(0, len(raw), step)]
        plain = "" if self.wide else self.charset
        out = [self.codes.get(c) if c in self.codes else bytes([c]).decode(plain, "replace") if plain else "�" for c in codes]
        return "".join(out), sum(self.widths.get(c, self.default) for c in codes), 0 if self.wide else codes.count(32)


def _times(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Canvas:
    """Runs the content of a page and keeps the pieces of text where they stand."""

    def __init__(self, doc: Document, fonts: dict[str, Font]):
        self.doc, self.fonts = doc, fonts
        self.pieces: list[dict] = []
        self.stack: list[tuple] = []
        self.state = {"matrix": _ONE, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "lead": 0.0, "scale": 1.0, "rise": 0.0}
        self.at = self.line = _ONE

    def show(self, raw: bytes) -> None:
        s = self.state
        font = s["font"]
        if font is None or not raw:
            return
        text, width, spaces = font.read(raw)
        place = _times(self.at, s["matrix"])
        size = s["size"] * (place[2] ** 2 + place[3] ** 2) ** 0.5
        across = (width / 1000 * s["size"] + s["char"] * len(text) + s["word"] * spaces) * s["scale"]
        self.at = _times((1, 0, 0, 1, across, 0), self.at)
        end = _times(self.at, s["matrix"])
        self.pieces.append({"text": text, "font_size": round(size, 1), "is_bold": font.bold, "is_italic": font.italic, "x0": place[4], "x1": end[4], "base": place[5] + s["rise"]})

    def move(self, x: float, y: float) -> None:
        self.line = self.at = _times((1, 0, 0, 1, x, y), self.line)

    def run(self, data: bytes) -> None:
        lexer, args = Lexer(data), []
        s = self.state
        while (word := lexer.value()) is not None:
            if not isinstance(word, Operator):
                args.append(word)
                continue
            if word == "q":
                self.stack.append(tuple(s.items()))
            elif word == "Q" and self.stack:
                s.update(self.stack.pop())
            elif word == "cm" and len(args) >= 6:
                s["matrix"] = _times(tuple(args[-6:]), s["matrix"])
            elif word == "BT":
                self.at = self.line = _ONE
            elif word == "Tf" and len(args) >= 2:
                s["font"], s["size"] = self.fonts.get(str(args[-2])), float(args[-1])
            elif word in ("Tc", "Tw", "TL", "Tz", "Ts") and args:
                s[{"Tc": "char", "Tw": "word", "TL": "lead", "Tz": "scale", "Ts": "rise"}[word]] = args[-1] / (100 if word == "Tz" else 1)
            elif word in ("Td", "TD") and len(args) >= 2:
                if word == "TD":
                    s["lead"] = -args[-1]
                self.move(args[-2], args[-1])
            elif word == "Tm" and len(args) >= 6:
                self.at = self.line = tuple(args[-6:])
            elif word == "T*":
                self.move(0, -s["lead"])
            elif word == "Tj" and args:
                self.show(args[-1])
            elif word in ("'", '"') and args:
                if word == '"' and len(args) >= 3:
                    s["word"], s["char"] = args[-3], args[-2]
                self.move(0, -s["lead"])
                self.show(args[-1])
            elif word == "TJ" and args:
                for x in args[-1]:
                    if isinstance(x, bytes):
                        self.show(x)
                    elif isinstance(x, int | float):
                        self.at = _times((1, 0, 0, 1, -x / 1000 * s["size"] * s["scale"], 0), self.at)
            elif word == "BI":  # an inline image
                end = data.find(b"EI", lexer.at)
                lexer.at = len(data) if end < 0 else end + 2
            args = []


def page_spans(doc: Document, page: dict) -> tuple[list[list[dict]], float]:
    """Lines of spans from the top down, and the page's height."""
    resources = doc.get(page.get("Resources"), {})
    fonts = {k: Font(doc, doc.get(v, {})) for k, v in doc.get(resources.get("Font"), {}).items()}
    box = [float(doc.get(x, 0)) for x in doc.get(page.get("MediaBox"), [0, 0, 612, 792])]
    content = doc.get(page.get("Contents"), [])
    parts = [doc.get(x) for x in (content if isinstance(content, list) else [content])]
    canvas = Canvas(doc, fonts)
    canvas.run(b"\n".join(x.data() for x in parts if isinstance(x, Stream)))
    lines: list[list[dict]] = []
    for piece in sorted(canvas.pieces, key=lambda p: -p["base"]):
        if lines and abs(lines[-1][0]["base"] - piece["base"]) < SAME_LINE:
            lines[-1].append(piece)
        else:
            lines.append([piece])
    out = []
    for line in lines:
        spans: list[dict] = []
        for p in sorted(line, key=lambda p: p["x0"]):
            same = spans and all(spans[-1][k] == p[k] for k in ("font_size", "is_bold", "is_italic"))
            if same and p["x0"] - spans[-1]["x1"] < SPAN_GAP * p["font_size"]:
                spans[-1]["text"] += p["text"]
                spans[-1]["x1"] = p["x1"]
            else:
                spans.append(dict(p))
        for p in spans:
            p["y0"], p["y1"] = box[3] - p["base"] - _ASCENT * p["font_size"], box[3] - p.pop("base") + _DESCENT * p["font_size"]
        if any(p["text"].strip() for p in spans):
            out.append(spans)
    return out, box[3] - box[1]


def file_spans(doc_id: str, data: bytes) -> list[dict]:
    """The spans of a file, or one row with its error."""
    rows: list[dict] = []
    try:
        doc = Document(data)
        for n, page in enumerate(doc.pages()):
            lines, height = page_spans(doc, page)
            for i, line in enumerate(lines):
                rows += [{"doc_id": doc_id, "page": n, "line": i, "span": k, "page_height": height, "error": None, **p} for k, p in enumerate(line)]
    except Exception as e:
        return [{"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"}]
    return rows


def spans(files: DataFrame) -> DataFrame:
    """``files``: path, content. One row for each span, named by the file's stem; errors as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(file_spans(path, content), schema=_SCHEMA)

    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "(?i)\\.pdf$", "")
    return files.select(stem.alias("doc_id"), "content").mapInArrow(run, SPANS)


def plain_text(span_rows: DataFrame) -> DataFrame:
    """``doc_id``, ``text``: lines joined by line feeds, pages by an empty line."""
    t = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "t"))), lambda x: x["t"]), "")
    good = span_rows.filter("error is null")
    lines = good.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("t"))
    pages = lines.withColumn("t", F.concat("t", F.lit("\n"))).groupBy("doc_id", "page").agg(t("line").alias("t"))
    whole = pages.withColumn("t", F.concat("t", F.lit("\n"))).groupBy("doc_id").agg(t("page").alias("text"))
    return whole.select("doc_id", F.rtrim(F.col("text"), F.lit("\n")).alias("text"))
