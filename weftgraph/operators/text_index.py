"""Searches by an index of trigrams, so that a keyword reads a few buckets instead of all nodes.

``entries`` holds the nodes, dealt into ``PARTS`` by id. ``postings`` says for each run of
one to three characters of a node's searched text which node has it; ``counts`` how many
have it. Both are dealt into ``BUCKETS`` by the run. A search takes the rarest of the
keyword's runs, intersects their postings, reads the parts that the hits are in (Spark
prunes the others when it runs) and tests the whole keyword. A keyword of up to three
characters is a run itself, so short ones cost no scan either; patterns have no meaning.

The index is files alone and can be opened again by its path. A posting row has the nodes of
one part and block that share a run, so a run that many nodes share is split over rows, files
and tasks, and what is shuffled are lists instead of a row for each run of each node. A null
text has no runs; an empty keyword is in every text that isn't null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import haystack
from weftgraph.session import new_path

BUCKETS, PARTS = 32, 32
LONGEST = 3
#: Runs of a keyword whose postings are intersected: the rarest ones.
RAREST = 3
#: What can be searched, and the text of it.
FIELDS = {"all": haystack, "name": lambda: F.lower("name")}
#: A block of postings holds this many nodes or characters at most, but for its last batch.
BLOCK_NODES, BLOCK_CHARS = 8192, 1 << 20
#: Bits of a character in the number of a run.
_BITS = 21
_POSTED = pa.schema([("run", pa.string()), ("part", pa.int32()), ("ids", pa.list_(pa.string())), ("n", pa.int64()), ("field", pa.string()), ("bucket", pa.int32())])
_POSTINGS = "run string, part int, ids array<string>, n long, field string, bucket int"


def bucket_of(run: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(run.encode()) % buckets


def _run_of(code: int) -> str:
    chars = []
    while code:
        chars.append(chr((code & (1 << _BITS) - 1) - 1))
        code >>= _BITS
    return "".join(reversed(chars))


def postings_of(ids: pa.Array, parts: np.ndarray, texts: list[str | None], field: str, buckets: int) -> pa.RecordBatch:
    """A row for each part and distinct run of one to ``LONGEST`` characters, with the nodes that have it."""
    texts = [t or "" for t in texts]
    # from 1, so that runs of different lengths have different numbers
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes, owners, code = [chars], [owner], chars
    for n in range(1, LONGEST):
        code = code[:-1] << _BITS | chars[n:]
        within = owner[n:] == owner[: len(code)]
        codes.append(code[within])
        owners.append(owner[n:][within])
    known, run = np.unique(np.concatenate(codes), return_inverse=True)
    if not len(known):
        return pa.RecordBatch.from_pylist([], schema=_POSTED)
    own = np.concatenate(owners)
    group, own = np.divmod(np.unique((parts[own] * len(known) + run) * len(texts) + own), len(texts))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    part, run = np.divmod(group[first], len(known))
    names = [_run_of(c) for c in known.tolist()]
    ends = np.append(first, len(group))
    columns = [
        pa.array(names, pa.string()).take(pa.array(run)), pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(own))),
        pa.array(np.diff(ends), pa.int64()), pa.array([field] * len(run), pa.string()), pa.array([bucket_of(x, buckets) for x in names], pa.int32()).take(pa.array(run)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_POSTED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, nodes, size = [], 0, 0
    for b in batches:
        held.append(b)
        nodes, size = nodes + b.num_rows, size + b.nbytes
        if nodes >= BLOCK_NODES or size >= BLOCK_CHARS:
            yield pa.Table.from_batches(held)
            held, nodes, size = [], 0, 0
    if nodes:
        yield pa.Table.from_batches(held)


@dataclass
class TextIndex:
    """An index below ``path``; ``buckets`` is what it was built with."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @classmethod
    def build(cls, nodes: DataFrame, path: str | None = None, buckets: int = BUCKETS, parts: int = PARTS) -> TextIndex:
        spark = nodes.sparkSession
        path = path or new_path(spark, "text-index")
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        # a column for the part at the end, whatever the nodes' own are called
        dealt = nodes.withColumn("_part", part)
        dealt.filter("false").write.parquet(f"{path}/shape")  # the schema, if there is no entry
        dealt.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path}/entries")
        built = cls(spark, path, buckets)
        texts = built.entries.select(F.col("id").cast("string").alias("id"), F.col("_part").alias("part"), *(text().alias(f"text_{f}") for f, text in FIELDS.items()))

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                ids, parts = block.column("id").combine_chunks().cast(pa.string()), block.column("part").to_numpy().astype(np.int64)
                for f in FIELDS:
                    yield postings_of(ids, parts, block.column(f"text_{f}").to_pylist(), f, buckets)

        texts.mapInArrow(post, _POSTINGS).hint("rebalance", "bucket").write.partitionBy("field", "bucket").parquet(f"{path}/postings")
        posted = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
        counts = posted.groupBy("field", "bucket", "run").agg(F.sum("n").alias("n"))
        counts.hint("rebalance", "bucket").write.partitionBy("field", "bucket").parquet(f"{path}/counts")
        return built

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/entries")

    def _of(self, name: str, columns: str, field: str, wanted: list[str]) -> DataFrame:
        rows = self.spark.read.schema(f"{columns}, run string, field string, bucket int").parquet(f"{self.path}/{name}")
        buckets = sorted({bucket_of(r, self.buckets) for r in wanted})
        return rows.filter((F.col("field") == field) & F.col("bucket").isin(buckets) & F.col("run").isin(wanted))

    def hits(self, keyword: str, field: str) -> DataFrame | None:
        """``id`` and ``part`` of nodes that have the rarest runs of a keyword; None if one is in no text."""
        wanted = sorted({keyword[i : i + LONGEST] for i in range(max(1, len(keyword) - LONGEST + 1))})
        # a row for each run of the keyword at most
        known = {r["run"]: r["n"] for r in self._of("counts", "n long", field, wanted).collect()}
        if len(known) < len(wanted):
            return None
        rarest = sorted(wanted, key=lambda r: (known[r], r))[:RAREST]
        rows = self._of("postings", "part int, ids array<string>", field, rarest).select("run", "part", F.explode("ids").alias("id")).distinct()
        return rows.groupBy("id", "part").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("id", F.col("part").alias("_part"))

    def matches(self, keyword: str, field: str = "all") -> DataFrame:
        """The nodes whose text contains a keyword, whatever the case."""
        keyword = keyword.lower()
        entries = self.entries
        if keyword:
            hits = self.hits(keyword, field)
            entries = entries.filter(F.lit(False)) if hits is None else entries.join(hits, ["_part", "id"], "left_semi")
        return entries.filter(F.contains(FIELDS[field](), F.lit(keyword))).drop("_part")

    def search(self, keyword: str, limit: int | None = None) -> DataFrame:
        """As ``graph.search``."""
        out = self.matches(keyword)
        if limit is not None:
            out = out.orderBy("ord").limit(limit)
        return out.select("id", "type", "name", "description")

    def autocomplete(self, typed: str, limit: int = 8) -> DataFrame:
        """As ``graph.autocomplete``."""
        return self.matches(typed, "name").orderBy("ord").limit(limit).select("id", "name")
