"""Walks, paths, components, ranks and betweenness against brute force; the text index; table functions."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_operators import NODES, edges, ids, nodes

from weftgraph.operators import graph, metrics, traverse
from weftgraph.operators.text_index import TextIndex
from weftgraph.plans import table_functions, tools
from weftgraph.session import Buckets


def near_of(links):
    near = collections.defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def random_links(seed, n, m, trees=0):
    r = random.Random(seed)
    links = [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)]
    return links + [(f"t{i}", r.choice([f"v{r.randrange(n)}", f"t{r.randrange(max(1, i))}"])) for i in range(trees)]


def graph_of(spark, links, *alone):
    names = sorted({x for e in links for x in e} | set(alone))
    return nodes(spark, *names), edges(spark, *((a, b, "T") for a, b in links)), names


def brute_betweenness(names, links):
    near, out = near_of(links), dict.fromkeys(names, 0.0)
    for s in names:
        dist, paths, order = {s: 0}, collections.defaultdict(float), [s]
        paths[s] = 1.0
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist.get(v) == dist[w] - 1:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
            if w != s:
                out[w] += owed[w]
    return {v: x / 2 for v, x in out.items()}


@pytest.mark.parametrize("seed,n,m,trees", [(1, 12, 16, 8), (2, 14, 10, 10), (3, 9, 30, 0), (4, 6, 0, 12)])
def test_betweenness_with_cycles_and_trees(spark, seed, n, m, trees):
    links = random_links(seed, n, m, trees)
    v, e, names = graph_of(spark, links, "alone")
    got = {r["id"]: r["betweenness"] for r in metrics.betweenness(v, e, normalized=False, block_rows=40).collect()}
    want = brute_betweenness(names, links)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaves_are_peeled_whole(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("x", "z"), ("p", "q")]
    _, e, _ = graph_of(spark, links)
    core, hung = metrics.peeled(traverse.both_ways(e))
    assert {r["a"] for r in core.collect()} == {"a", "b", "c"}
    assert {(r["id"], r["parent"], r["size"]) for r in hung.collect()} == {("y", "x", 1), ("z", "x", 1), ("x", "c", 3), ("q", "p", 1)}


def brute_components(names, links):
    near, root = near_of(links), {}
    for s in sorted(names):
        todo = [] if s in root else [s]
        while todo:
            v = todo.pop()
            if v not in root:
                root[v] = s
                todo += near[v]
    return root


@pytest.mark.parametrize("seed,n,m", [(1, 60, 30), (2, 60, 55), (3, 40, 200), (4, 5, 0)])
def test_components_of_random_graphs(spark, seed, n, m):
    links = random_links(seed, n, m)
    v, e, names = graph_of(spark, links, "alone", "zz")
    assert {r["id"]: r["component"] for r in metrics.components(v, e).collect()} == brute_components(names, links)


def test_long_chains_and_stars_take_few_rounds(spark):
    k = 20_000
    chain = spark.range(k).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    # the same chain with its names mixed up, and a star of as many leaves around its largest id
    mixed = chain.select(*((F.col(c) * 7919 % 20_011).alias(c) for c in "ab"))
    star = spark.range(k).select(F.col("id").alias("a"), F.lit(k).cast("long").alias("b"))
    for links, most in ((chain, 18), (mixed, 18), (star, 2)):
        found, rounds = metrics.contracted(links)
        assert found.count() == k + 1 and found.select("component").distinct().count() == 1
        assert rounds <= most


def test_pagerank_shuffles_contributions_alone(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    b = Buckets(spark)
    try:
        links = b.write(spark.range(3000).select((F.col("id") % 97).alias("src"), (F.col("id") % 89).alias("dst")), "src", "t")
        ranks = b.write(spark.range(97).select("id", F.lit(1.0).alias("rank"), F.lit(2).alias("fan")), "id", "t")
        plan = metrics.pagerank_round(links, ranks)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert plan.index("Exchange hashpartitioning") < plan.index("SortMergeJoin")  # above the join, not below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        b.drop(0)


def test_pagerank_equals_plain_rounds(spark):
    links = [(a, b) for a, b in random_links(5, 15, 40) if a != b]
    v, e, names = graph_of(spark, links, "alone")
    out = collections.defaultdict(set)
    for a, b in links:
        out[a].add(b)
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(7):
        sunk = sum(rank[x] for x in names if not out[x])
        rank = {x: 0.15 / len(names) + 0.85 * (sunk / len(names) + sum(rank[y] / len(out[y]) for y in names if x in out[y])) for x in names}
    got = {r["id"]: r["rank"] for r in metrics.pagerank(v, e, 7, None).collect()}
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in names)
    assert metrics.pagerank(v.filter("false"), e.filter("false")).count() == 0


def brute_paths(near, source, target, cutoff):
    def arms(path):
        if path[-1] == target:
            yield path
        elif len(path) <= cutoff:
            for w in sorted(near[path[-1]] - set(path)):
                yield from arms([*path, w])

    return [p for p in arms([source]) if len(p) > 1]


@pytest.mark.parametrize("cutoff", [1, 3, 5])
def test_paths_equal_all_simple_ones(spark, cutoff):
    links = random_links(6, 9, 16)
    _, e, names = graph_of(spark, links)
    pairs = list(itertools.permutations(names[:4], 2)) + [("v0", "v0"), ("v0", "nowhere")]
    p = spark.createDataFrame(pairs, "source string, target string")
    got = sorted((r["source"], r["target"], tuple(r["path"])) for r in traverse.simple_paths(e, p, cutoff).collect())
    near = near_of(links)
    want = sorted((s, t, tuple(x)) for s, t in pairs if s != t for x in brute_paths(near, s, t, cutoff))
    assert got == want and (cutoff == 1 or want)
    steps = traverse.path_steps(traverse.simple_paths(e, p, cutoff), e, 2)
    found = collections.Counter((s, t) for s, t, _ in want)
    assert {(r["source"], r["target"]): r["found"] for r in steps.collect()} == dict(found)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_recursive_walks_equal_loops(spark):
    links = random_links(7, 20, 30)
    _, e, names = graph_of(spark, links)
    start = ids(spark, *names[:3], "nowhere")
    for depth in (0, 1, 3):
        for directed in (False, True):
            assert rows_of(traverse.walk(e, start, depth, directed)) == rows_of(traverse.k_hop(e, start, depth, directed))
    tree = edges(spark, *((f"n{i // 2}", f"n{i}", "T") for i in range(1, 40)))
    assert rows_of(traverse.walk(tree, ids(spark, "n1", "n5"), None, True)) == rows_of(traverse.k_hop(tree, ids(spark, "n1", "n5"), None, True))
    with pytest.raises(ValueError, match="never ends"):
        traverse.walk(tree, start, None)
    chain = edges(spark, ("a", "b", "FOLLOWED_BY"), ("a", "c", "FOLLOWED_BY"), ("b", "a", "FOLLOWED_BY"), ("b", "d", "FOLLOWED_BY"), ("d", "a", "OTHER"))
    assert rows_of(traverse.chains(chain, ids(spark, "a", "x"))) == rows_of(traverse.workflow_chains(chain, ids(spark, "a", "x")))


TEXTS = [("a1", "50%_x"), ("b2", "50yx"), ("c3", None), ("d4", "Äpfel und Birnen"), ("e5", ""), ("f6", "aaaa"), ("g7", "ab"), ("h8", "the whole name of it"), ("h8", "again")]


def test_text_index_equals_scan(spark):
    n = spark.createDataFrame([(i, x, "Kind", t, None if i % 3 else f"said {t}", {"k": f"v{i}"} if i % 2 else {}) for i, (x, t) in enumerate(TEXTS)], NODES)
    clash = n.withColumns({"_x": F.lit(1), "part": F.lit("p"), "run": F.lit("r")})
    words = ("50%_", "_", "AA", "aaaaa", "äpf", "und B", "nothing here", "", "v5", "whole name")
    for rows, asked in ((n, words), (clash, words[:2])):
        again = TextIndex(spark, TextIndex.build(rows, buckets=3, parts=2).path, 3)
        for k in asked:
            assert rows_of(again.search(k)) == rows_of(graph.search(n, k)), k
        assert rows_of(again.autocomplete("A", 3)) == rows_of(graph.autocomplete(n, "A", 3))
        assert again.search("n", 2).count() == 2
    assert TextIndex.build(n.filter("false"), buckets=1, parts=1).search("x").count() == 0


def test_text_index_reads_a_keywords_buckets_alone(spark):
    n = spark.range(4000).select(F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("id"), F.lit("T").alias("type"), F.concat(F.lit("name "), F.hex("id")).alias("name"), F.lit("").alias("description"), F.expr("cast(map() as map<string, string>)").alias("attrs"))
    index = TextIndex.build(n)
    hits = index.hits("7ab", "all")
    read = {f.split("bucket=")[1].split("/")[0] for f in hits.inputFiles() if "bucket=" in f}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert len(read) <= 64 and hits.count() < 10
    assert "dynamicpruning" in index.search("7ab")._jdf.queryExecution().executedPlan().toString()


def test_table_functions_equal_tools(spark):
    n = spark.createDataFrame(
        [(i, x, "T" if i % 2 else "U", x.upper(), f"about {x}", {"k": f"Value{i}", "source_text": "s", "source_offset": str(i)}) for i, x in enumerate("abcdef")], NODES
    )
    e = edges(spark, ("a", "b", "X"), ("b", "c", "FOLLOWED_BY"), ("a", "c", "X"), ("c", "d", "FOLLOWED_BY"), ("d", "b", "FOLLOWED_BY"), ("d", "e", "FOLLOWED_BY"), ("b", "a", "Y"))
    table_functions.register(spark, n, e)
    t = tools.GraphTools(n, e)
    calls = [
        ("list_entity_types", ()), ("find_entities", ("u",)), ("search_entities", ("ABOUT",)), ("get_entity", ("b",)), ("get_neighbors", ("a", 2)), ("get_neighbors", ("a",)),
        ("find_paths", ("a", "e", 7)), ("get_graph_summary", ()), ("traverse_workflow", ("b",)), ("find_by_attribute", ("k", "VALUE")), ("find_by_attribute", ("source_offset", "1")),
    ]
    for name, args in calls:
        sql = spark.sql(f"SELECT * FROM {name}({', '.join(repr(a) for a in args)})")
        want = getattr(t, name)(*args)
        assert sorted(sql.columns) == sorted(want.columns) and rows_of(sql) == rows_of(want) and want.count() > 0, name
    calls = ("get_entity('no')", "get_neighbors('no', 3)", "find_paths('no', 'a')", "find_paths('a', 'no')", "traverse_workflow('no')")
    assert sum(spark.sql(f"SELECT * FROM {call}").count() for call in calls) == 0
    other = n.filter("id != 'a'")
    table_functions.register(spark, other, graph.known_edges(e, other))
    assert spark.sql("SELECT * FROM get_entity('a')").count() == 0


def test_answers_of_tools_are_whole(spark):
    n = spark.range(130).select(F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("id"), F.lit("T").alias("type"), F.lit("x").alias("name"), F.lit("").alias("description"), F.expr("cast(map() as map<string, string>)").alias("attrs"))
    t = tools.GraphTools(n, edges(spark), TextIndex.build(n, buckets=4, parts=2))
    assert len(tools.text(t.find_entities("t")).splitlines()) == 130 and len(tools.text(t.search_entities("N1")).splitlines()) == 41


def test_stage_filter_joins_each_end_once(spark):
    from weftgraph.functions import registry
    from weftgraph.operators import validate

    rules = registry.relation_table(spark, {"X": (["T"], ["U"])})
    n = spark.createDataFrame([(0, "a", "T", "A", "", {}), (1, "b", "U", "B", "", {}), (2, "n", None, "N", "", {})], NODES)
    rows = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "gone"), ("gone", "b"), ("a", "n"), ("a", "gone"), ("a", "a")]
    c = edges(spark, *((s, d, "X") for s, d in rows), ("a", "b", "ODD"))
    old = edges(spark, ("b", "a", "X"))
    got = {r["ord"]: r["outcome"] for r in validate.stage_filter(c, old, n, rules).collect()}
    assert got == {0: "valid", 1: "duplicate", 2: "duplicate", 3: "orphan", 4: "orphan", 5: "invalid", 6: "orphan", 7: "invalid", 8: "invalid"}
    got = {r["ord"]: r["outcome"] for r in validate.stage_filter(c, old.filter("false"), n, rules).collect()}
    assert got[2] == "valid" and got[1] == "duplicate"


def test_text_index_packs_nodes_that_share_a_run(spark):
    n = spark.range(600).select(F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("id"), F.lit("T").alias("type"), F.lit("Same 😀é name").alias("name"), F.lit(None).cast("string").alias("description"), F.expr("cast(map() as map<string, string>)").alias("attrs"))
    index = TextIndex.build(n.coalesce(1), buckets=2, parts=2)
    posted = spark.read.parquet(f"{index.path}/postings")
    shared = posted.filter("field = 'name' and run = '😀é '")
    assert 1 <= shared.count() <= 4 and shared.selectExpr("sum(size(ids))").first()[0] == 600
    for k in ("😀", "😀É n", "n59", "e 😀é name"):
        assert rows_of(index.search(k)) == rows_of(graph.search(n, k)), k
