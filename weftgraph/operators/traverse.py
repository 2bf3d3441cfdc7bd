"""Traversal: neighbourhoods, paths, cascades, workflows and collapsed subtrees.

Walks go level by level. A level is a join of the frontier with the edges, so work
follows what is reached; each level is a table in the shared folder, and a lost
executor costs one level. No walk pairs all nodes.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import materialize

#: After so many levels what was found is written as one table, so that plans of deep walks stay small.
LEVELS = 16


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once for each pair."""
    ab = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return ab.union(ab.select("b", "a")).toDF("a", "b").filter("a != b").distinct()


def k_hop(edges: DataFrame, starts: DataFrame, depth: int | None, directed: bool = False) -> DataFrame:
    """``start``, ``id``, ``hops``: nodes within ``depth`` of each start (None: all), each at its least distance."""
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct() if directed else both_ways(edges)
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for d in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(step, frontier.id == step.a).select("start", F.col("b").alias("id")).distinct()
        frontier = materialize(
            reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(d)), "k-hop"
        )
        if frontier.limit(1).count() == 0:
            break
        seen = seen.union(frontier)
        if d % LEVELS == 0:
            seen = materialize(seen, "k-hop")
    return seen


#: Levels of a recursive walk at most; deeper walks take the loop of ``k_hop``.
RECURSIVE_LEVELS = 1_000


def walk(edges: DataFrame, starts: DataFrame, depth: int | None, directed: bool = False) -> DataFrame:
    """As ``k_hop``, in one plan: a recursive common table expression, a level a step.

    Levels hold distinct nodes but know nothing of the levels before, so a node comes back
    on every way that leads to it again: right for few levels, which is what ``k_hop`` pays a
    written table each for. A closure (``depth`` None) stops at the first empty level, so it
    needs a graph without directed cycles. Deep walks, cycles and walks that have to survive
    lost executors level by level take ``k_hop``.
    """
    spark = edges.sparkSession
    if depth is None and not directed:
        raise ValueError("a closure of undirected edges never ends: take k_hop")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct() if directed else both_ways(edges)
    within = "" if depth is None else f"WHERE hops < {int(depth)}"
    return spark.sql(
        f"""WITH RECURSIVE w(start, id, hops) MAX RECURSION LEVEL {RECURSIVE_LEVELS} AS (SELECT DISTINCT id, id, 0 FROM {{starts}}
          UNION ALL SELECT DISTINCT w.start, s.b, w.hops + 1 FROM w JOIN {{step}} s ON s.a = w.id {within})
        SELECT start, id, min(hops) AS hops FROM w GROUP BY start, id""",
        starts=starts,
        step=step,
    )


def chains(edges: DataFrame, starts: DataFrame, relation: str = "FOLLOWED_BY") -> DataFrame:
    """As ``workflow_chains``, in one plan, for chains of at most ``RECURSIVE_LEVELS`` steps."""
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    nexts = edges.filter(F.col("type") == relation).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("nexts"))
    none = "CAST(array() AS ARRAY<STRUCT<ord: BIGINT, dst: STRING>>)"
    return spark.sql(
        f"""WITH RECURSIVE w(start, step, id, been, open) MAX RECURSION LEVEL {RECURSIVE_LEVELS} AS (
          SELECT s.id, 0, s.id, array(s.id), filter(coalesce(n.nexts, {none}), x -> x.dst != s.id) FROM {{starts}} s LEFT JOIN {{nexts}} n ON n.src = s.id
          UNION ALL SELECT w.start, w.step + 1, w.open[0].dst, array_append(w.been, w.open[0].dst),
            filter(coalesce(n.nexts, {none}), x -> NOT array_contains(array_append(w.been, w.open[0].dst), x.dst)) FROM w LEFT JOIN {{nexts}} n ON n.src = w.open[0].dst WHERE size(w.open) > 0)
        SELECT start, step, id, greatest(size(open) - 1, 0) AS branches FROM w""",
        starts=starts,
        nexts=nexts,
    )


def induced(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with both ends in one start's neighbourhood."""
    s = reached.select("start", F.col("id").alias("src"))
    d = reached.select("start", F.col("id").alias("dst"))
    return edges.join(s, "src").join(d, ["start", "dst"]).select("start", "src", "dst", "type")


def simple_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 5) -> DataFrame:
    """``source``, ``target``, ``path``: all simple undirected paths of at most ``cutoff`` edges.

    Each target's distances come first; an arm grows to a node only if the target can still be
    reached from there with the edges that are left, so no arm is grown in vain but for
    those that would have to cross themselves. ``pairs`` with equal ends have none.
    """
    step = materialize(both_ways(edges), "path-links")
    pairs = pairs.select("source", "target").filter("source != target").distinct()
    away = k_hop(edges, pairs.select(F.col("target").alias("id")).distinct(), cutoff - 1)
    away = materialize(away.select(F.col("start").alias("target"), F.col("id").alias("b"), "hops"), "path-distances")
    arms = pairs.select("source", "target", F.array("source").alias("path"))
    found = None
    for n in range(1, cutoff + 1):
        grown = arms.join(step, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        grown = grown.join(away, ["target", "b"]).filter(F.col("hops") <= cutoff - n)
        grown = materialize(grown.select("source", "target", F.array_append("path", F.col("b")).alias("path"), (F.col("hops") == 0).alias("there")), "paths")
        met = grown.filter("there").drop("there")
        found = met if found is None else found.union(met)
        arms = grown.filter("not there").drop("there")
    return found


def path_steps(paths: DataFrame, edges: DataFrame, first: int = 5) -> DataFrame:
    """The first paths of each pair, shortest first, as steps with direction and edge type.

    ``found`` counts all paths. Where edges go both ways, the forward one is shown.
    """
    # counted apart, so that no task holds all paths of a pair to number them
    found = paths.groupBy("source", "target").agg(F.count("*").alias("found"))
    nth = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.size("path"), F.array_join("path", ">")))
    rows = paths.withColumn("nth", nth).filter(F.col("nth") <= first).join(found, ["source", "target"])
    hop = F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(i.alias("step"), F.get("path", i).alias("a"), F.get("path", i + 1).alias("b"))))
    steps = rows.select("source", "target", "found", "nth", hop.alias("h")).select("source", "target", "found", "nth", "h.*")
    kind = edges.groupBy("src", "dst").agg(F.max_by("type", "ord").alias("type"))
    there = kind.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("forward"))
    back = kind.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("type").alias("backward"))
    out = steps.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left")
    return out.select(
        "source", "target", "found", "nth", "step", "a", "b", F.coalesce("forward", "backward").alias("type"),
        F.when(F.col("forward").isNotNull(), "forward").otherwise("backward").alias("direction"),
    )


def cascade(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """Directed breadth-first walk: ``start``, ``id``, ``depth``, ``parent``, ``type``, ``rank``.

    A node's parent is the first of its level's discoverers: the parent found first, by
    the edge that comes first. ``rank`` are the numbers of the edges from the start; in one
    level they sort by discovery, so no level has to be numbered in one task.
    """
    step = edges.select("src", "dst", "type", "ord")
    none, here = F.lit(None).cast("string"), F.expr("cast(array() as array<bigint>)")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), none.alias("parent"), none.alias("type"), here.alias("rank")).distinct()
    frontier = seen
    for d in range(1, max_depth + 1):
        met = frontier.select("start", F.col("id").alias("parent"), F.col("rank").alias("before")).join(step, F.col("parent") == F.col("src"))
        rank = F.concat("before", F.array(F.col("ord").cast("long"))).alias("rank")
        met = met.groupBy("start", F.col("dst").alias("id")).agg(F.min(F.struct(rank, "parent", "type")).alias("m"))
        fresh = met.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = materialize(fresh.select("start", "id", F.lit(d).alias("depth"), "m.parent", "m.type", "m.rank"), "cascade")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.union(frontier)
    return seen


def cascade_summary(walk: DataFrame) -> DataFrame:
    """Nodes, tree edges and depth of each walk."""
    return walk.groupBy("start").agg(
        F.count("*").alias("nodes"), F.count("parent").alias("edges"), F.max("depth").alias("depth")
    )


def workflow_chains(edges: DataFrame, starts: DataFrame, relation: str = "FOLLOWED_BY") -> DataFrame:
    """``start``, ``step``, ``id``, ``branches``: follow the first unvisited successor until there is none.

    ``branches`` counts the successors that were not taken.
    """
    nexts = edges.filter(F.col("type") == relation).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("nexts"))
    at = starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), "id", F.array("id").alias("been"))
    out = None
    for n in count(1):
        here = at.join(nexts, at.id == nexts.src, "left")
        open_ = F.filter(F.coalesce("nexts", F.expr("cast(array() as array<struct<ord: bigint, dst: string>>)")), lambda x: ~F.array_contains("been", x["dst"]))
        here = materialize(here.select("start", "step", "id", "been", open_.alias("open")), "chains")
        steps = here.select("start", "step", "id", F.greatest(F.size("open") - 1, F.lit(0)).alias("branches"))
        out = steps if out is None else out.union(steps)
        if n % LEVELS == 0:
            out = materialize(out, "chains")
        at = here.filter(F.size("open") > 0).select("start", (F.col("step") + 1).alias("step"), F.get("open", F.lit(0))["dst"].alias("id"), "been")
        at = at.withColumn("been", F.array_append("been", F.col("id")))
        if at.limit(1).count() == 0:
            break
    return out


def hidden(edges: DataFrame, collapsed: DataFrame) -> DataFrame:
    """``root``, ``id``: all descendants of collapsed nodes, themselves left out."""
    reach = k_hop(edges, collapsed, None, directed=True)
    return reach.filter("start != id").select(F.col("start").alias("root"), "id")


def visible_edges(edges: DataFrame, hidden_ids: DataFrame) -> DataFrame:
    gone = hidden_ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def neighbour_highlight(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes and edge keys next to each id: ``focus``, ``kind`` (node or edge), ``key``."""
    want = ids.select(F.col("id").alias("focus")).distinct()
    near = edges.join(want, (edges.src == want.focus)).select("focus", "src", "dst").unionByName(
        edges.join(want, (edges.dst == want.focus)).select("focus", "src", "dst")
    )
    keys = near.select("focus", F.lit("edge").alias("kind"), F.concat_ws("->", "src", "dst").alias("key"))
    ends = near.select("focus", F.lit("node").alias("kind"), F.explode(F.array("src", "dst")).alias("key"))
    return keys.union(ends).distinct()


def path_highlight(steps: DataFrame) -> DataFrame:
    """Nodes and direction-aware edge keys over all steps."""
    key = F.when(F.col("direction") == "forward", F.concat_ws("->", "a", "b")).otherwise(F.concat_ws("->", "b", "a"))
    e = steps.select("source", "target", F.lit("edge").alias("kind"), key.alias("key"))
    n = steps.select("source", "target", F.lit("node").alias("kind"), F.explode(F.array("a", "b")).alias("key"))
    return e.union(n).distinct()
