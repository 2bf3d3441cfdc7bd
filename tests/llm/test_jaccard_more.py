"""What the n-gram Jaccard join deals to tasks: no chance meetings, no shingles met once."""

import hashlib
import uuid

import numpy as np
import pytest
from test_llm import SF, rows_of

from weftgraph import session
from weftgraph.llm import jaccard_join
from weftgraph.session import Scratch


def prefixes(spark, lists, n):
    """Sets of ``n`` shingles with these prefixes, each a class of its own."""
    rows = []
    for i, x in enumerate(lists):
        kind = hashlib.blake2b(b"class %d" % i, digest_size=16).digest()
        group = hashlib.blake2b(np.array(x, np.int64).tobytes(), digest_size=16).digest()
        rows.append((i, n, bytearray(kind), bytearray(group), [int(s) for s in x]))
    return spark.createDataFrame(rows, jaccard_join.SETS).repartition(3)


@pytest.mark.parametrize("percent", [80, 90])  # the pipeline's and op6's
def test_chance_meetings_make_no_bag(spark, percent):
    """Thirty sets that share one prefix shingle each with all others can't link; the two that share theirs may."""
    r = np.random.default_rng(5)
    length = jaccard_join.prefix_length(400, percent)
    own = r.integers(-(1 << 63), 1 << 63, (31, length), dtype=np.int64)
    own[:30, 0] = 12345
    own[30] = own[29]
    own[30, -1] = 7
    sets = prefixes(spark, own.tolist(), 400)
    classes = {bytes(x["class"]): x["doc_id"] for x in sets.collect()}
    found = jaccard_join.bags(sets, percent).collect()
    assert sorted(classes[bytes(x["class"])] for x in found) == [29, 30]
    assert len({x["bag"] for x in found}) == 1


def test_prefix_shingles_met_once_are_not_dealt(spark):
    """All shingles that two prefixes hold are kept, in order; of the others next to none."""
    r = np.random.default_rng(6)
    own = r.integers(-(1 << 63), 1 << 63, (300, 41), dtype=np.int64)
    shared = r.integers(-(1 << 63), 1 << 63, 100, dtype=np.int64)
    for i in range(200):
        own[i, 5], own[i, 9] = shared[i % 100], shared[(i + 1) % 100]
    sets = prefixes(spark, own.tolist(), 400)
    bits = spark.sparkContext.broadcast(jaccard_join.again_filter(sets))
    pruned = sets.select("group", "n", "prefix").mapInArrow(jaccard_join._pruner(bits), "group binary, n long, prefix array<long>")
    left = {bytes(x["group"]): list(x["prefix"]) for x in pruned.collect()}
    want = {bytes(x["group"]): [s for s in x["prefix"] if s in set(shared.tolist())] for x in sets.collect()}
    assert left.keys() == want.keys() and sum(map(len, want.values())) == 400
    for group, kept in left.items():
        assert [s for s in kept if s in want[group]] == want[group]
    assert sum(map(len, left.values())) < 410


def test_ties_by_bands_give_the_same_components(spark, monkeypatch):
    """Shingles of more than two groups by bands, against pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {p: rows_of(jaccard_join.jaccard_components(docs, p)) for p in (80, 90)}
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    for p, rows in want.items():
        assert rows_of(jaccard_join.jaccard_components(docs, p)) == rows


def test_copies_of_a_group_are_no_second_meeting(spark):
    """A prefix that twelve equal rows hold is in one group: none of its shingles is met again."""
    r = np.random.default_rng(7)
    own = r.integers(-(1 << 63), 1 << 63, (40, 41), dtype=np.int64).tolist()
    own[1][3] = own[0][5]  # the one shingle of two groups
    once = prefixes(spark, own, 400)
    sets = once
    for _ in range(11):
        sets = sets.union(once)
    scratch = Scratch()
    groups = jaccard_join.group_rows(sets, scratch)
    whole = jaccard_join.mapped(groups, iter, "group binary, n long, prefix array<long>")
    assert sorted(bytes(x["group"]) for x in whole.collect()) == sorted(bytes(x["group"]) for x in once.collect())
    bits = spark.sparkContext.broadcast(jaccard_join.again_filter(groups))
    pruned = jaccard_join.mapped(groups, jaccard_join._pruner(bits), "group binary, n long, prefix array<long>").collect()
    assert sum(len(x["prefix"]) for x in pruned) < 5
    assert [s for x in pruned for s in x["prefix"]].count(own[0][5]) == 2


def test_steps_leave_no_files_behind(spark, tmp_path, monkeypatch):
    """Prefixes, index and ties go before whole sets are dealt."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}

    def watched(found, *rest, real=jaccard_join.linked_classes):
        seen["tables"] = {x.name.rpartition("-")[0] for x in tmp_path.glob("weftgraph/*")}
        return real(found, *rest)

    def path(spark, tag):
        return f"{tmp_path}/weftgraph/{tag}-{uuid.uuid4().hex}"

    monkeypatch.setattr(session, "new_path", path)
    monkeypatch.setattr(jaccard_join, "linked_classes", watched)
    before = spark.conf.get(session._FREED, None)
    rows = jaccard_join.jaccard_components(docs, 80, 5)
    assert rows.count() == docs.count()
    gone = {"jaccard-prefixes", "jaccard-groups", "jaccard-pruned", "jaccard-index", "jaccard-ties", "jaccard-heads"}
    assert {"jaccard-sets", "jaccard-bags"} <= seen["tables"] and not gone & seen["tables"]
    assert spark.conf.get(session._FREED, None) == before
