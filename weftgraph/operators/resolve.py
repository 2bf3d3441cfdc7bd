"""Entity resolution: exact merges, remaps, edge dedup and orphans.

``mentions``: ord, id, type, name, description, section, attrs (map of strings).
Every choice falls to the longest description and then to the input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

EMPTY = ("", "null", "[]")


def merge_groups(mentions: DataFrame, *key: str, typed: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group: the canonical mention, all anchors and sections, merged attributes.

    Mentions rank by the longest description, then input order. An attribute's values are
    joined in that order. Where an attribute named in ``typed``, which isn't text, has
    several, the canonical mention's own attributes stay. Every step is an aggregate that
    combines before it shuffles, so a group of any number of mentions is no hot key.
    """
    rank = F.struct((-F.length("description")).alias("longest"), "ord")
    top = F.min_by(F.struct("type", "name", "description", "attrs"), rank)
    base = mentions.groupBy(*key).agg(
        F.min("ord").alias("ord"), F.count("*").alias("size"), top.alias("top"), F.array_sort(F.collect_set("section")).alias("appears_in")
    )
    anchors = mentions.groupBy(*key, "description").agg(F.min(rank).alias("rank"))
    anchors = anchors.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "description"))).alias("anchors"))
    values = mentions.select(*key, rank.alias("rank"), F.explode("attrs").alias("k", "v")).filter(F.col("v").isNotNull() & ~F.col("v").isin(*EMPTY))
    values = values.groupBy(*key, "k", "v").agg(F.min("rank").alias("rank"))
    merged = values.groupBy(*key, "k").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("vs"))
    clash = F.col("k").isin(*typed) & (F.size("vs") > 1) if typed else F.lit(False)
    merged = merged.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.array_join(F.transform("vs", lambda x: x["v"]), "; "))))).alias("merged"),
        F.bool_or(clash).alias("fallback"),
    )
    out = base.join(anchors, list(key)).join(merged, list(key), "left")
    fallback = F.coalesce("fallback", F.lit(False))
    own = [F.col("top.type")] if "type" not in key else []
    return out.select(
        *key, "ord", "size", *own, F.col("top.name"), F.col("top.description"), "appears_in",
        F.transform("anchors", lambda x: x["description"]).alias("anchors"),
        F.when(fallback, F.col("top.attrs")).otherwise(F.coalesce("merged", "top.attrs")).alias("attrs"),
        fallback.alias("fallback"),
    )


def exact_dedup(mentions: DataFrame, typed: tuple[str, ...] = ()) -> DataFrame:
    """Merge mentions with the same id and type."""
    return merge_groups(mentions, "id", "type", typed=typed)


def merges(merged: DataFrame) -> DataFrame:
    """How many mentions went into others."""
    return merged.agg(F.count("*").alias("entities"), F.sum(F.col("size") - 1).alias("merges"))


# --- remaps -------------------------------------------------------------------


def checked_remaps(remaps: DataFrame, entities: DataFrame) -> DataFrame:
    """Remaps with ``problem``: unknown old id, onto itself, or in a cycle of two; else null.

    ``remaps``: ord, old_id, new_id. The last of several for one old id holds for edges.
    """
    ids = entities.select(F.col("id").alias("old_id"), F.lit(True).alias("known")).distinct()
    back = remaps.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("old_id"), F.lit(True).alias("cycle")).distinct()
    out = remaps.join(ids, "old_id", "left").join(back, ["old_id", "new_id"], "left")
    problem = (
        F.when(F.col("known").isNull(), "unknown old id")
        .when(F.col("old_id") == F.col("new_id"), "onto itself")
        .when(F.col("cycle").isNotNull(), "cycle")
    )
    return out.select("ord", "old_id", "new_id", problem.alias("problem"))


def resolved_remaps(entities: DataFrame, remaps: DataFrame) -> DataFrame:
    """``old_id``, ``new_id`` of the remaps that hold, each new id one that an entity has.

    The members of a new id that no entity has go to the one of them with the most
    sections, then the longest description, then the first remap; it keeps its own id, and
    so does a member that is alone. Unknown old ids, remaps onto themselves and cycles of
    two, which would leave no entity, are left out; ``checked_remaps`` lists them. Of
    several remaps of one old id the last holds.
    """
    ok = checked_remaps(remaps, entities).filter("problem is null")
    last = ok.groupBy("old_id").agg(F.max_by(F.struct("new_id", "ord"), "ord").alias("r")).select("old_id", "r.new_id", "r.ord")
    known = entities.select(F.col("id").alias("new_id")).distinct().withColumn("known", F.lit(True))
    last = materialize(last.join(known, "new_id", "left"), "remaps")
    if "appears_in" in entities.columns:
        sections = F.max(F.size("appears_in"))
    else:
        sections = F.count_distinct("section")
    merit = entities.groupBy(F.col("id").alias("old_id")).agg(sections.alias("sections"), F.max(F.length("description")).alias("length"))
    members = last.filter("known is null").join(merit, "old_id")
    order = F.struct(-F.col("sections"), -F.col("length"), "ord")
    best = members.groupBy("new_id").agg(F.min_by("old_id", order).alias("canonical"))
    made = members.join(best, "new_id").select("old_id", F.col("canonical").alias("new_id")).filter("old_id != new_id")
    return last.filter("known").select("old_id", "new_id").union(made)


def resolve_chains(remaps: DataFrame) -> DataFrame:
    """Follow ``old_id``, ``new_id`` to their ends: each round doubles the steps taken.

    Remaps in a cycle have no end; they stay at the id where the rounds met it.
    """
    out = remaps.select("old_id", "new_id")
    n = out.count()
    steps = 1
    while steps < n:
        step = out.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("further"))
        moved = out.join(step, "new_id", "left").select("old_id", F.coalesce("further", "new_id").alias("new_id"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(moved, "chains")
        out = moved.select("old_id", "new_id")
        if moved.filter("moved").limit(1).count() == 0:
            break
        steps *= 2
    return out


def apply_remaps(entities: DataFrame, remaps: DataFrame, typed: tuple[str, ...] = ()) -> DataFrame:
    """Merge entities that ``resolved_remaps`` brings together; the merged id is the canonical one.

    An entity goes where the chain of its remaps ends.
    """
    target = resolve_chains(materialize(resolved_remaps(entities, remaps), "resolved"))
    here = entities.join(target, entities.id == target.old_id, "left").drop("old_id")
    here = here.withColumn("final_id", F.coalesce("new_id", "id")).drop("new_id")
    out = merge_groups(here.withColumnRenamed("id", "was"), "final_id", typed=typed)
    return out.withColumnRenamed("final_id", "id")


def remap_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Ends by ``old_id``, ``new_id`` of ``resolved_remaps``, one hop only; loops that this makes stay."""
    s = resolved.select(F.col("old_id").alias("src"), F.col("new_id").alias("to_src"))
    d = resolved.select(F.col("old_id").alias("dst"), F.col("new_id").alias("to_dst"))
    out = edges.join(s, "src", "left").join(d, "dst", "left")
    return out.withColumns({"src": F.coalesce("to_src", "src"), "dst": F.coalesce("to_dst", "dst")}).select(edges.columns)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each source, target and type, whole as it is."""
    own = [c for c in edges.columns if c not in ("src", "dst", "type")]
    first = F.min_by(F.struct(*own), "ord")
    return edges.groupBy("src", "dst", "type").agg(first.alias("f"), F.count("*").alias("copies")).select("src", "dst", "type", "f.*", "copies")


def new_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The first of each new edge that doesn't exist yet."""
    return dedup_edges(new).join(existing.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti")


def orphan_sample(edges: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """How many edges miss an end, and the first missing ids."""
    from weftgraph.operators.graph import dangling_edges

    lost = dangling_edges(edges, nodes)
    n = lost.agg(F.count("*").alias("orphans"))
    ids = lost.select(F.explode("missing").alias("id")).distinct().orderBy("id").limit(limit)
    return n.join(ids.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample")))


def foreign_dedup(nodes: DataFrame) -> DataFrame:
    """Nodes equal but for case of id: the first, with what it lacks taken from later ones."""
    key = ["key", "type"]
    rows = nodes.withColumn("key", F.lower("id"))
    first = rows.groupBy(*key).agg(F.min_by(F.struct("ord", "id", "name"), "ord").alias("f"), F.count("*").alias("size"))
    values = rows.select(*key, "ord", F.explode("attrs").alias("k", "v")).filter(F.col("v").isNotNull() & (F.col("v") != ""))
    values = values.groupBy(*key, "k").agg(F.min_by("v", "ord").alias("v"))
    attrs = values.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    return first.join(attrs, key, "left").select("f.ord", "f.id", "type", "f.name", "attrs", "size")


def reconstruction_problems(merged: DataFrame, sources: DataFrame) -> DataFrame:
    """Merged entities against their sources: type changed, an attribute lost that every source has, id new."""
    ids = sources.groupBy("id").agg(F.count("*").alias("n"), F.collect_set("type").alias("types"))
    kept = sources.select("id", F.explode("attrs").alias("k", "v")).filter(F.col("v").isNotNull() & ~F.col("v").isin(*EMPTY))
    always = kept.groupBy("id", "k").agg(F.count("*").alias("has")).join(ids.select("id", "n"), "id").filter("has = n")
    always = always.groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("always"))
    out = merged.join(ids, "id", "left").join(always, "id", "left")
    lost = F.filter(F.coalesce("always", F.array().cast("array<string>")), lambda k: ~F.map_contains_key("attrs", k))
    problems = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "id is new"),
        F.when(F.col("n").isNotNull() & ~F.array_contains("types", F.col("type")), "type changed"),
        F.when(F.size(lost) > 0, F.concat(F.lit("lost "), F.array_join(lost, ","))),
    ))
    return out.select("id", "type", F.array_join(problems, "; ").alias("problems"))
