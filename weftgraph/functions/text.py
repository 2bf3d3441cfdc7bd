"""Text functions: normalization, anchoring, chunking, JSON repair, mojibake.

Built-in functions wherever they can express the rule; Python only for Unicode NFC, fuzzy
matching and re-decoding, and only for rows that need it.
"""

from __future__ import annotations

import difflib
import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Smart quotes and dashes and their plain forms.
QUOTES, PLAIN_QUOTES = "‘’“”", "''\"\""
DASHES, PLAIN_DASHES = "–—", "--"
#: Fixed values of the fuzzy locator.
FUZZY_OVER, FUZZY_MARGIN, FUZZY_RATIO = 20, 50, 0.85
#: Characters of a run that fuzzy matches are looked for by.
SEED = 3


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize(df: DataFrame, column: str, out: str) -> DataFrame:
    """NFC, white space collapsed, trimmed. ASCII rows never leave the JVM."""
    ascii_ = ~F.col(column).rlike("[^\\x00-\\x7F]")
    plain = df.filter(F.col(column).isNull() | ascii_).withColumn(out, collapse(F.col(column)))
    other = df.filter(F.col(column).isNotNull() & ~ascii_).withColumn(out, collapse(_nfc(column)))
    return plain.unionByName(other)


def strip_markdown(c: Column) -> Column:
    """Without ``**``, ``__`` and single marks outside of words; smart quotes plain."""
    c = F.replace(F.replace(c, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    for mark in ("_", "\\*"):
        c = F.regexp_replace(c, f"(?U)(?<!\\w){mark}|{mark}(?!\\w)", "")
    return F.translate(c, QUOTES, PLAIN_QUOTES)


def searchable(c: Column) -> Column:
    """White space collapsed, quotes and dashes plain; not trimmed."""
    return F.translate(F.regexp_replace(c, "(?U)\\s+", " "), QUOTES + DASHES, PLAIN_QUOTES + PLAIN_DASHES)


def grams_needed(sizes: int) -> int:
    """Runs of ``SEED`` characters that two texts of ``sizes`` characters together must share to reach FUZZY_RATIO.

    A ratio r means m = r sizes / 2 matched characters. They lie in blocks, and between two
    blocks at least one of the sizes - 2 m others, so there are at most sizes - 2 m + 1 blocks.
    A block of n characters has n - SEED + 1 runs. More matches mean fewer blocks, so the
    least number of runs is that at r = FUZZY_RATIO.
    """
    matched = FUZZY_RATIO * sizes / 2
    return max(0, math.ceil(matched - (SEED - 1) * (sizes * (1 - FUZZY_RATIO) + 1) - 1e-6))


def _gram_codes(text: str) -> np.ndarray:
    """A number for each run of ``SEED`` characters, equal for equal runs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < SEED:
        return np.zeros(0, np.uint64)
    codes = np.zeros(len(points) - SEED + 1, np.uint64)
    for k in range(SEED):  # 21 bits a character
        codes = codes << np.uint64(21) | points[k : len(points) - SEED + 1 + k]
    return codes


def windows(text: str, doc: str) -> list[int]:
    """Starts of the windows of a document that share enough runs with a text to match it."""
    size, step = len(text) + FUZZY_MARGIN, max(1, len(text) // 4)
    starts = np.arange(0, max(1, len(doc) - len(text) + 1), step)
    shared = np.r_[0, np.cumsum(np.isin(_gram_codes(doc), _gram_codes(text)))]
    ends = np.minimum(starts + size, len(doc))
    last = len(shared) - 1
    met = shared[np.clip(ends - SEED + 1, 0, last)] - shared[np.minimum(starts, last)]
    needed = np.array([grams_needed(len(text) + n) for n in range(size + 1)])
    return starts[met >= needed[ends - starts]].tolist()


def fuzzy_find(text: str, doc: str) -> int:
    """Start of the first window with the best ratio of at least FUZZY_RATIO; -1 if none.

    Only windows with enough runs of characters in common are compared; no other can match.
    """
    if len(text) <= FUZZY_OVER:
        return -1
    window = len(text) + FUZZY_MARGIN
    matcher = difflib.SequenceMatcher(autojunk=True)
    matcher.set_seq2(text)
    best, at = FUZZY_RATIO, -1
    for i in windows(text, doc):
        matcher.set_seq1(doc[i : i + window])
        if matcher.real_quick_ratio() >= best and matcher.quick_ratio() >= best and (r := matcher.ratio()) >= best and (r > best or at < 0):
            best, at = r, i
    return at


@F.pandas_udf(T.IntegerType())
def _fuzzy(text: pd.Series, doc: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_find(t, d) for t, d in zip(text, doc, strict=True)], dtype="int32")


def locate(rows: DataFrame, text: str, doc: str, fuzzy: bool = True) -> DataFrame:
    """Adds ``offset`` and ``kind`` of ``text`` in ``doc``: exact, normalized, fuzzy or none.

    Offsets of the last two kinds count in the normalized document. Only rows that the
    first two miss reach the fuzzy matcher, and of them only those long enough to pass it.
    """
    exact = F.position(F.col(text), F.col(doc)) - 1
    near = F.position(searchable(F.col(text)), searchable(F.col(doc))) - 1
    out = rows.withColumn("_exact", exact)
    out = out.withColumn("_near", F.when(F.col("_exact") < 0, near).otherwise(-1))
    kind = F.when(F.col("_exact") >= 0, "exact").when(F.col("_near") >= 0, "normalized").otherwise("none")
    out = out.withColumns({"kind": kind, "offset": F.greatest("_exact", "_near")}).drop("_exact", "_near")
    if not fuzzy:
        return out
    missed = out.filter((F.col("kind") == "none") & (F.length(text) > FUZZY_OVER))
    rest = out.filter(~((F.col("kind") == "none") & (F.length(text) > FUZZY_OVER)) | F.col(text).isNull())
    found = missed.withColumn("offset", _fuzzy(searchable(F.col(text)), searchable(F.col(doc))))
    found = found.withColumn("kind", F.when(F.col("offset") >= 0, "fuzzy").otherwise("none"))
    return rest.unionByName(found)


def section_number(c: Column) -> Column:
    """``SEC-02a`` to ``2.1``, ``SEC-03a1`` to ``3.1.1``; anything else unchanged."""
    shape = "^SEC-0*(\\d+)([a-z])?(\\d+)?$"
    part = lambda i: F.regexp_extract(c, shape, i)
    letter = F.when(part(2) != "", (F.ascii(part(2)) - 96).cast("string"))
    last = F.when((part(2) != "") & (part(3) != ""), part(3))
    return F.when(c.rlike(shape) & ~((part(2) == "") & (part(3) != "")), F.concat_ws(".", part(1), letter, last)).otherwise(c)


def split_sections(df: DataFrame, column: str, mark: str = "## ") -> DataFrame:
    """Chunks that start at lines with a mark; empty ones go, numbers stay those before that."""
    pattern = f"(?m)(?=^{mark})"
    out = df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(column, pattern)).alias("chunk_index", "chunk"))
    return out.withColumn("chunk", F.btrim(F.col("chunk"), F.lit(" \t\n\r\f\v"))).filter("chunk != ''")


def fixed_chunks(df: DataFrame, column: str, size: int, overlap: int) -> DataFrame:
    """Chunks of a fixed number of characters that overlap."""
    if size <= overlap:
        raise ValueError("size must be above overlap")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length(column) - 1, F.lit(step))
    out = df.filter(F.length(column) > 0).select(*[c for c in df.columns if c != column], column, F.posexplode(starts).alias("chunk_index", "start"))
    return out.withColumn("chunk", F.substring(F.col(column), F.col("start") + 1, F.lit(size))).drop(column)


def repaired_json(c: Column) -> Column:
    """The first form that parses: as it is, without code fences, without control characters; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", "")
    clean = F.regexp_replace(bare, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")

    def valid(x: Column) -> Column:
        # as the one item of a list, so that nothing may follow it
        v = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        one = F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
        return F.when(one, x)

    return F.coalesce(valid(c), valid(bare), valid(clean))


def canonical_type(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Known type names in their own case; unknown ones stay."""
    known = names.select(F.col("type").alias("_type"), F.lower("type").alias("_key"))
    return df.join(F.broadcast(known), F.lower(column) == F.col("_key"), "left").withColumn(
        "canonical", F.coalesce("_type", column)
    ).drop("_type", "_key")


def fix_mojibake_text(text: str) -> str:
    """UTF-8 that was read as Latin-1, turned back character by character.

    Each lead character says how many follow it; what isn't a whole sequence stays.
    """
    out, i = [], 0
    while i < len(text):
        lead = ord(text[i])
        size = 3 if 0xE0 <= lead <= 0xEF else 2 if 0xC2 <= lead <= 0xDF else 1
        tail = [ord(c) for c in text[i + 1 : i + size]]
        if size > 1 and len(tail) == size - 1 and all(0x80 <= c <= 0xBF for c in tail):
            code = lead & (0x0F if size == 3 else 0x1F)
            for c in tail:
                code = code << 6 | c & 0x3F
            if code >= (0x800 if size == 3 else 0x80) and not 0xD800 <= code <= 0xDFFF:
                out.append(chr(code))
                i += size
                continue
        out.append(text[i])
        i += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def _fix(s: pd.Series) -> pd.Series:
    return s.map(fix_mojibake_text, na_action="ignore")


def fix_mojibake(df: DataFrame, column: str, out: str) -> DataFrame:
    """Only rows with such a pair of characters reach Python."""
    odd = F.coalesce(F.col(column).rlike("[Â-ï][\u0080-¿]"), F.lit(False))
    return df.filter(~odd).withColumn(out, F.col(column)).unionByName(df.filter(odd).withColumn(out, _fix(column)))


def mojibake_census(df: DataFrame, column: str) -> DataFrame:
    """Count of each character from U+0080 to U+00FF."""
    chars = F.explode(F.regexp_extract_all(column, F.lit("([\u0080-ÿ])"), F.lit(1)))
    return df.select(chars.alias("char")).groupBy("char").agg(F.count("*").alias("n")).select(
        "char", F.upper(F.hex(F.encode("char", "UTF-16BE"))).alias("code"), "n"
    )


def mojibake_patterns(df: DataFrame, column: str, around: int = 20) -> DataFrame:
    """``pattern``, ``n``, ``sample``: each pair or triple that reads like UTF-8 in Latin-1, its count, and words around the least one."""
    found = F.explode(F.regexp_extract_all(column, F.lit("(?s)(.{0,%d}(?:[à-ï][\u0080-¿]{2}|[Â-ß][\u0080-¿]).{0,%d})" % (0, around)), F.lit(1)))
    rows = df.select(found.alias("sample"))
    pattern = F.regexp_extract("sample", "^([à-ï][\u0080-¿]{2}|[Â-ß][\u0080-¿])", 1)
    return rows.select(pattern.alias("pattern"), "sample").groupBy("pattern").agg(F.count("*").alias("n"), F.min("sample").alias("sample"))


def first_text_block(blocks: Column) -> Column:
    """The text of the first block that isn't a thought."""
    return F.get(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(0))["text"]
