"""Graph metrics: degree, PageRank, betweenness, components, importance.

Iterations are tables in the shared folder; a loop removes those it is done with.
Betweenness is exact: trees by counting, the core by blocks of sources.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.traverse import both_ways
from weftgraph.session import Buckets, Rounds, materialize

DAMPING = 0.85
#: Shares of betweenness, PageRank and degree in importance.
WEIGHTS = (0.40, 0.35, 0.25)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``degree``: both directions, a loop twice; 0 where none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.count()
    scale = 1.0 / (n - 1) if n > 1 else 1.0
    return degrees(nodes, edges).select("id", "degree", (F.col("degree") * F.lit(scale)).alias("centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 200, tolerance: float | None = 1e-6, damping: float = DAMPING) -> DataFrame:
    """``id``, ``rank``: uniform start, the mass of sinks spread evenly.

    Stops when the change summed over nodes is below ``tolerance`` times their number;
    without tolerance it makes all rounds. Links lie in buckets by their source and ranks in
    as many by id: a round shuffles contributions alone, added up before they travel.
    """
    spark = nodes.sparkSession
    out = edges.select("src", "dst").distinct()
    fan = out.groupBy("src").agg(F.count("*").alias("fan"))
    links, ranks = Buckets(spark), Buckets(spark)
    sources = links.write(out.repartition(links.count, "src"), "src", "pagerank-links")
    own = nodes.select("id").join(fan.withColumnRenamed("src", "id"), "id", "left").repartition(ranks.count, "id")
    own = links.write(own, "id", "pagerank-nodes")
    sunk_of = F.sum(F.when(F.col("fan").isNull(), F.col("rank")).otherwise(0.0))
    n, sinks = own.agg(F.count("*"), F.count_if(F.col("fan").isNull())).first()
    if n == 0:
        links.drop(0)
        return nodes.select("id", F.lit(0.0).alias("rank"))
    now, sunk = own.select("id", "fan", F.lit(1.0 / n).alias("rank")), sinks / n
    for _ in range(rounds):
        given = pagerank_round(sources, now)
        base = (1 - damping) / n + damping * sunk / n
        after = now.join(given, "id", "left").select(
            "id", "fan", (F.lit(base) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("rank"), F.col("rank").alias("was")
        )
        after = ranks.write(after, "id", "pagerank")
        ranks.drop(1)
        sunk, moved = after.agg(sunk_of, F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        now = after.drop("was")
        if tolerance is not None and moved < tolerance * n:
            break
    done = materialize(now.select("id", "rank"), "pagerank-ranks")
    links.drop(0), ranks.drop(0)
    return done


def pagerank_round(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """``id``, ``given``: what each node gets from the ranks of its sources."""
    ranked = links.join(ranks.select(F.col("id").alias("src"), (F.col("rank") / F.col("fan")).alias("each")), "src")
    return ranked.groupBy(F.col("dst").alias("id")).agg(F.sum("each").alias("given"))


def contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """``id``, ``component`` of every node with a link, and the rounds it took.

    Alternating star contraction over links ``a``, ``b``: every node hands its larger
    neighbours to its least one, then its smaller neighbours and itself. Links never grow in
    number, paths halve, and what is left are stars around the least id of each component.
    Each step is an aggregate, which combines before it shuffles, and a join, whose hubs
    adaptive execution splits.
    """
    rounds, larges = Rounds("components"), Rounds("components-large")
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = rounds.next(links.select("a", "b").filter("a != b").select(high, low).distinct())
    for k in count():
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("head")).unionByName(
            now.select(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("head"))
        )
        roles = ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("head").alias("head"))
        if roles.filter("leaf > 1 or (leaf = 1 and head = 1)").limit(1).count() == 0:
            heads = now.select("v").distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads.select("v", "v")), k
        both = now.select("u", "v").union(now.select("v", "u")).toDF("n", "other")
        least = both.groupBy("n").agg(F.min("other").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("other > n").join(least, "n").filter("other != m").select(F.col("other").alias("u"), F.col("m").alias("v"))
        large = larges.next(large.distinct())
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows)
        now = rounds.next(small.distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``component``: the least id that undirected edges reach."""
    found, _ = contracted(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Rows of one level that a block of sources may fill: blocks are as many as that takes.
BLOCK_ROWS = 500_000_000


def betweenness(nodes: DataFrame, edges: DataFrame, normalized: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id``, ``betweenness`` on the undirected view, exact.

    Trees that hang on the graph are taken off leaf by leaf, and what goes through their nodes
    follows from the sizes of their branches. Only the core, where every node has two
    neighbours or more, is walked: shortest paths are counted from all sources of a block at
    once, level by level, and owed back the same way; a core node weighs as much as hangs on it.
    Every step is a join or an aggregate. Rounds of peeling are as many as the deepest tree has
    levels.
    """
    n = nodes.count()
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0) if normalized else 0.5
    links = materialize(both_ways(edges), "betweenness-links")
    core, hung = peeled(links)
    # of each node the nodes in its branches, and their squares: pairs of one branch don't pass it
    branches = hung.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"), F.sum(F.col("size") * F.col("size")).alias("squares"))
    whole = components(nodes, edges)
    sizes = whole.groupBy("component").agg(F.count("*").alias("whole"))
    rows = whole.join(sizes, "component").join(branches, "id", "left").join(hung.select("id", F.lit(True).alias("peeled")), "id", "left")
    below, squares = (F.coalesce(c, F.lit(0)).cast("double") for c in ("below", "squares"))
    others, rest = F.col("whole") - 1, F.col("whole") - 1 - below
    # what is left above a peeled node is one branch more; of a core node it is walked
    through = F.when(F.col("peeled"), others * others - squares - rest * rest).otherwise(below * below - squares + 2 * below * rest)
    own = materialize(rows.select("id", below.alias("below"), through.alias("through")), "betweenness-trees")
    inner = core.select(F.col("a").alias("id")).distinct().join(own.select("id", (F.col("below") + 1).alias("weight")), "id")
    inner = materialize(inner, "betweenness-core")
    m = inner.count()
    blocks = -(-m * m // block_rows)
    total = own.filter("false").select("id", F.col("through").alias("part"))
    sums = Rounds("betweenness-sums")
    for k in range(blocks):
        sources = inner.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        part = _dependencies(sources, inner, core).groupBy("id").agg(F.sum("part").alias("part"))
        total = sums.next(total.union(part).groupBy("id").agg(F.sum("part").alias("part")))
    both = own.join(total, "id", "left").select("id", (F.col("through") + F.coalesce("part", F.lit(0.0))).alias("b"))
    return nodes.select("id").join(both, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def peeled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of links (both ways) when leaves are taken off again and again, and the leaves.

    Leaves: ``id``, ``parent`` and ``size``, the nodes of the branch that hangs on the parent by it.
    """
    sizes = links.select(F.col("a").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("size"))
    left, weights = Rounds("peel-links"), Rounds("peel-sizes")
    now, sizes, gone = links, weights.next(sizes), None
    while True:
        ends = now.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).filter("n = 1").select("a", "b")
        # of two leaves that hang on each other the smaller one stays
        twins = ends.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("twin"))
        ends = ends.join(twins, ["a", "b"], "left").filter("twin is null or a > b").select(F.col("a").alias("id"), F.col("b").alias("parent"))
        leaves = materialize(ends.join(sizes, "id"), "peel-leaves")
        if leaves.limit(1).count() == 0:
            return now, leaves if gone is None else gone
        gone = leaves if gone is None else gone.unionByName(leaves)
        off = leaves.select(F.col("id").alias("a"))
        more = leaves.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("more"))
        sizes = sizes.join(off.withColumnRenamed("a", "id"), "id", "left_anti").join(more, "id", "left")
        sizes = weights.next(sizes.select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        now = left.next(now.join(off, "a", "left_anti").join(off.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))


def _dependencies(sources: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``part``: dependencies of the sources by joins, forward by level and back; ``weight`` counts nodes."""
    levels = [sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"))]
    while True:
        last = levels[-1]
        reach = last.join(links, last.id == links.a).groupBy("s", F.col("b").alias("id")).agg(F.sum("paths").alias("paths"))
        # on an undirected graph only the last two levels can be met again
        for old in levels[-2:]:
            reach = reach.join(old.select("s", "id"), ["s", "id"], "left_anti")
        fresh = materialize(reach, "betweenness")
        if fresh.limit(1).count() == 0:
            break
        levels.append(fresh)
    own = sources.select(F.col("id").alias("s"), F.col("weight").alias("of"))
    weigh = nodes.select(F.col("id").alias("b"), "weight")
    owed = levels[-1].withColumn("owed", F.lit(0.0))
    out = None
    for upper in reversed(levels[:-1]):
        low = owed.select("s", F.col("id").alias("b"), "paths", "owed").join(weigh, "b").select("s", "b", ((F.col("weight") + F.col("owed")) / F.col("paths")).alias("each"))
        up = upper.join(links, upper.id == links.a).join(low, ["s", "b"]).groupBy("s", "id").agg(F.sum("each").alias("each"))
        owed = materialize(
            upper.join(up, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("owed")), "betweenness"
        )
        part = owed.filter("s != id").join(own, "s").select("id", (F.col("of") * F.col("owed")).alias("part"))
        out = part if out is None else out.union(part)
    return levels[0].select("id", F.lit(0.0).alias("part")) if out is None else out


def min_max(df: DataFrame, *names: str) -> DataFrame:
    """Each column scaled to 0 to 1 over all rows; a constant one is 0.5."""
    ends = df.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max)))).first()
    scaled = {}
    for n in names:
        low, high = ends[f"low_{n}"], ends[f"high_{n}"]
        flat = low is None or high - low < 1e-12
        scaled[n] = F.lit(0.5) if flat else (F.col(n) - F.lit(low)) / F.lit(high - low)
    return df.withColumns(scaled)


def importance(nodes: DataFrame, edges: DataFrame, rounds: int = 200, tolerance: float | None = 1e-6) -> DataFrame:
    """``id``, ``betweenness``, ``pagerank``, ``degree``, ``importance``.

    The first three are scaled to 0 to 1 over all nodes and weighed into the fourth; all
    are rounded to 4 digits.
    """
    d = degree_centrality(nodes, edges).select("id", F.col("centrality").alias("degree"))
    p = pagerank(nodes, edges, rounds, tolerance).withColumnRenamed("rank", "pagerank")
    rows = materialize(betweenness(nodes, edges).join(p, "id").join(d, "id"), "importance")
    b, r, g = WEIGHTS
    total = b * F.col("betweenness") + r * F.col("pagerank") + g * F.col("degree")
    scaled = min_max(rows, "betweenness", "pagerank", "degree").withColumn("importance", total)
    return scaled.select("id", *(F.round(c, 4).alias(c) for c in ("betweenness", "pagerank", "degree", "importance")))


def edge_weights(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """The mean importance of an edge's ends."""
    s = scores.select(F.col("id").alias("src"), F.col("importance").alias("s"))
    d = scores.select(F.col("id").alias("dst"), F.col("importance").alias("d"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", "type", ((F.col("s") + F.col("d")) / 2).alias("weight"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density, isolated nodes, mean and largest degree, components."""
    d = degrees(nodes, edges).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"), F.min_by("id", F.struct(-F.col("degree"), "id")).alias("top_node"),
    )
    e = edges.agg(F.count("*").alias("edges"))
    c = components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    n = F.col("nodes")
    density = F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0)
    return d.join(e).join(c).select(
        "nodes", "edges", F.round(density, 6).alias("density"), "isolated", F.round("mean_degree", 4).alias("mean_degree"), "max_degree", "top_node", "components"
    )


def clusters(nodes: DataFrame, labels: DataFrame, names: int = 5) -> DataFrame:
    """Components by size with some of their names."""
    rows = nodes.select("id", "name", "ord").join(labels, "id")
    few = F.row_number().over(Window.partitionBy("component").orderBy("ord"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("size"))
    first = rows.withColumn("nth", few).filter(F.col("nth") <= names).groupBy("component").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]), ", ").alias("names")
    )
    return sizes.join(first, "component").orderBy(F.desc("size"), "component")
