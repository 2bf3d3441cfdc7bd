"""Property graphs as two DataFrames: building, lookups, searches and counts.

``nodes``: ord, id, type, name, description, attrs (map of strings). ``edges``: ord, src,
dst, type, description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import materialize

#: Keys of a node of its own; attributes of these names are dropped.
RESERVED = ("id", "type", "name", "description", "source_text", "source_section", "source_offset")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that miss an end, with ``missing``: the ids in question, sorted."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(
        ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left"
    )
    missing = F.array_compact(F.array(F.when(F.col("has_src").isNull(), F.col("src")), F.when(F.col("has_dst").isNull(), F.col("dst"))))
    return out.filter("has_src is null or has_dst is null").select(*edges.columns, F.array_sort(F.array_distinct(missing)).alias("missing"))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: the last type and description at the first place."""
    last = F.max(F.struct("ord", "type", "description"))
    return edges.groupBy("src", "dst").agg(F.min("ord").alias("ord"), last.alias("l"), F.count("*").alias("parallel")).select(
        "ord", "src", "dst", "l.type", "l.description", "parallel"
    )


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each id: the last one's fields at the first one's place, and every
    attribute that any of them has, later ones first."""
    w = Window.partitionBy("id")
    last = nodes.withColumns({"_last": F.max("ord").over(w), "_first": F.min("ord").over(w)})
    own = last.filter("ord = _last").select(F.col("_first").alias("ord"), "id", "type", "name", "description")
    pairs = nodes.select("id", "ord", F.explode("attrs").alias("k", "v")).filter(~F.col("k").isin(*RESERVED))
    attrs = pairs.groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    attrs = attrs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    empty = F.expr("cast(map() as map<string, string>)")
    return own.join(attrs, "id", "left").withColumn("attrs", F.coalesce("attrs", empty))


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The simple directed graph of some entities and relationships."""
    own = first_nodes(nodes)
    return own, collapse_edges(known_edges(edges, own))


# --- lookups ------------------------------------------------------------------


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind).select("id")


def find_entities(nodes: DataFrame, kind: str) -> DataFrame:
    """Entities of a type, whatever the case."""
    return nodes.filter(F.lower("type") == kind.lower()).select("id", "name", "description")


def haystack() -> Column:
    """All that a search reads: id, name, description, type and attribute values."""
    return F.lower(F.concat_ws(" ", "id", "name", "description", "type", F.map_values("attrs")))


def search(nodes: DataFrame, keyword: str, limit: int | None = None) -> DataFrame:
    """Entities that contain a keyword as plain text, in input order where limited."""
    out = nodes.filter(F.contains(haystack(), F.lit(keyword.lower())))
    if limit is not None:
        out = out.orderBy("ord").limit(limit)
    return out.select("id", "type", "name", "description")


#: Attributes that hold whole numbers; they match only as a whole.
WHOLE = ("source_offset",)


def find_by_attribute(nodes: DataFrame, key: str, value: str, whole: tuple[str, ...] = WHOLE) -> DataFrame:
    """Entities whose attribute contains a value, whatever the case; an attribute named in ``whole`` has to equal it."""
    held = F.lower(F.col("attrs")[key])
    hit = held == F.lit(value.lower()) if key in whole else F.contains(held, F.lit(value.lower()))
    return nodes.filter(held.isNotNull() & hit).select("id", "name", "type", F.col("attrs")[key].alias("value"))


def autocomplete(nodes: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """The first entities whose name contains what was typed."""
    return nodes.filter(F.contains(F.lower("name"), F.lit(typed.lower()))).orderBy("ord").limit(limit).select("id", "name")


def relations(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of some ids with the neighbour's name and type."""
    around = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    want = ids.select("id").distinct()
    out = edges.join(want, edges.src == want.id, "left_semi").select(
        F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("type").alias("relation"), F.col("dst").alias("other")
    )
    into = edges.join(want, edges.dst == want.id, "left_semi").select(
        F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("type").alias("relation"), F.col("src").alias("other")
    )
    return out.unionByName(into).join(around, "other", "left").select(
        "id", "direction", "relation", "other", F.coalesce("other_name", "other").alias("other_name"), "other_type"
    )


def entity_view(nodes: DataFrame, edges: DataFrame, entity_id: str) -> DataFrame:
    """An entity's own fields, its attributes and its relationships both ways; nothing for an unknown id.

    ``part``: entity, attribute, out or in. ``key`` is a field's name or the relationship's
    type, ``value`` what it holds or the neighbour's name.
    """
    own = nodes.filter(F.col("id") == entity_id)
    null = F.lit(None).cast("string")
    fields = F.create_map(*(x for c in ("type", "name", "description") for x in (F.lit(c), F.col(c))))

    def of(part: str, pairs: Column) -> DataFrame:
        rows = own.select("id", F.lit(part).alias("part"), F.explode(pairs).alias("key", "value"))
        return rows.select("*", null.alias("other"), null.alias("other_type"), null.alias("description"))

    around = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    ways = (("out", "src", "dst"), ("in", "dst", "src"))
    near = [
        edges.filter(F.col(a) == entity_id).select(F.col(a).alias("id"), F.lit(way).alias("part"), F.col("type").alias("key"), F.col(b).alias("other"), "description")
        for way, a, b in ways
    ]
    near = near[0].unionByName(near[1]).join(own.select("id"), "id", "left_semi").join(around, "other", "left")
    relations_ = near.select("id", "part", "key", F.coalesce("other_name", "other").alias("value"), "other", "other_type", "description")
    return of("entity", fields).unionByName(of("attribute", F.map_filter("attrs", lambda k, _: ~k.isin(*RESERVED)))).unionByName(relations_)


def attributes(nodes: DataFrame) -> DataFrame:
    """Attributes of each entity that aren't reserved, one row each."""
    return nodes.select("id", F.explode("attrs").alias("key", "value")).filter(~F.col("key").isin(*RESERVED))


def source_text(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The source of each asked id, or why there is none."""
    found = ids.join(nodes.select("id", F.col("attrs")["source_text"].alias("text"), F.lit(True).alias("found")), "id", "left")
    said = F.when(F.col("found").isNull(), "Entity not found").when(F.coalesce("text", F.lit("")) == "", "No source text").otherwise(F.col("text"))
    return found.select("id", said.alias("source_text"))


def section_text(sections: DataFrame) -> DataFrame:
    """The text of the first section of each number."""
    return sections.groupBy("section_number").agg(F.min_by("text", "ord").alias("text"))


def referenced(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Summaries of the ids that are entities; others go."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "type", "name")


def coloured(nodes: DataFrame, colours: DataFrame, colour: str = "#999999", level: int = 5, group: str = "") -> DataFrame:
    """Colour, level and group of each node by its type, with defaults."""
    return nodes.join(F.broadcast(colours), "type", "left").select(
        "id", "type", F.coalesce("colour", F.lit(colour)).alias("colour"), F.coalesce("level", F.lit(level)).alias("level"),
        F.coalesce("group", F.lit(group)).alias("group"),
    )


# --- counts -------------------------------------------------------------------


def type_counts(rows: DataFrame) -> DataFrame:
    """Counts by type, the largest first and ties by first appearance."""
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").select("type", "n")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals and counts by type of both nodes and edges: ``what``, ``type`` (null: total), ``n``."""
    parts = [
        df.rollup("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
        for what, df in (("entity", nodes), ("relationship", edges))
    ]
    return parts[0].unionByName(parts[1])


def grouped(rows: DataFrame, key: str = "id") -> DataFrame:
    """Members of each type, one row each with the size ``n`` of their type, by type: no row holds a whole type."""
    sizes = rows.groupBy("type").agg(F.count("*").alias("n"))
    return rows.select("type", key).join(sizes, "type").orderBy("type", key).select("type", "n", key)


def legend(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Types by group with their counts; types of no group fall to ''."""
    return counts.join(F.broadcast(groups), "type", "left").select(F.coalesce("group", F.lit("")).alias("group"), "type", "n")


def text_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of text in input order."""
    n = nodes.select(F.lit(0).alias("part"), "ord", F.format_string("[%s] %s (%s): %s", "type", "name", "id", "description").alias("line"))
    e = edges.select(F.lit(1).alias("part"), "ord", F.format_string("%s -[%s]-> %s", "src", "type", "dst").alias("line"))
    return n.unionByName(e).orderBy("part", "ord").select("part", "ord", "line")


def numbered(edges: DataFrame, prefix: str = "r") -> DataFrame:
    """Edges numbered in input order: a rank within ranges of ``ord``, then the range's base.

    No single task sorts all edges.
    """
    # written, so that a row keeps its range
    ranged = materialize(edges.repartitionByRange("ord").withColumn("_part", F.spark_partition_id()), "ranges")
    ranged = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("ord", "src", "dst", "type", "description")))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = (F.col("_base") + F.col("_at") - 1).cast("string")
    return ranged.join(F.broadcast(bases), "_part").select(F.concat(F.lit(prefix), number).alias("edge_id"), *edges.columns)
