"""Graphs, mentions and workflows seen in the relational tables.

Every view carries ``ord``, the input order: a table has none of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Each kind's share of ``ord``.
STRIDE = 10_000_000_000_000
#: More turns than any conversation has.
TURNS = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attrs(*pairs: tuple[str, Column]) -> Column:
    if not pairs:
        return F.expr("cast(map() as map<string, string>)")
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v.cast("string"))))


def _nodes(df: DataFrame, rank: int, prefix: str, kind: str, key: str, name: str, *attrs: tuple[str, Column]) -> DataFrame:
    return df.select(
        (F.lit(rank * STRIDE) + F.col(key)).cast("long").alias("ord"),
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
        F.lit(kind).alias("type"),
        F.col(name).alias("name"),
        F.concat_ws(" ", F.lit(kind), F.col(name)).alias("description"),
        _attrs(*attrs).alias("attrs"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord``, ``id``, ``type``, ``name``, ``description`` and ``attrs`` of six node types."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    parts = [
        _nodes(t("region"), 0, "R:", "Region", "r_regionkey", "r_name"),
        _nodes(t("nation"), 1, "N:", "Nation", "n_nationkey", "n_name", ("region", c("n_regionkey"))),
        _nodes(t("supplier"), 2, "S:", "Supplier", "s_suppkey", "s_name", ("nation", c("s_nationkey"))),
        _nodes(t("customer"), 3, "C:", "Customer", "c_custkey", "c_name", ("nation", c("c_nationkey")), ("segment", c("c_mktsegment"))),
        _nodes(t("part"), 4, "P:", "Part", "p_partkey", "p_name", ("brand", c("p_brand")), ("kind", c("p_type")), ("size", c("p_size"))),
        _nodes(t("orders"), 5, "O:", "Order", "o_orderkey", "o_orderpriority", ("status", c("o_orderstatus")), ("priority", c("o_orderpriority"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edges(df: DataFrame, rank: int, kind: str, src: tuple[str, str], dst: tuple[str, str], key: Column, text: Column) -> DataFrame:
    return df.select(
        (F.lit(rank * STRIDE) + key).cast("long").alias("ord"),
        F.concat(F.lit(src[0]), F.col(src[1]).cast("string")).alias("src"),
        F.concat(F.lit(dst[0]), F.col(dst[1]).cast("string")).alias("dst"),
        F.lit(kind).alias("type"),
        text.alias("description"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord``, ``src``, ``dst``, ``type`` and ``description``; orders repeat some pairs."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    none = F.lit("")
    parts = [
        _edges(t("nation"), 0, "PART_OF", ("N:", "n_nationkey"), ("R:", "n_regionkey"), F.col("n_nationkey"), none),
        _edges(t("supplier"), 1, "LOCATED_IN", ("S:", "s_suppkey"), ("N:", "s_nationkey"), F.col("s_suppkey"), none),
        _edges(t("customer"), 2, "LOCATED_IN", ("C:", "c_custkey"), ("N:", "c_nationkey"), F.col("c_custkey"), none),
        _edges(t("orders"), 3, "PLACED_BY", ("O:", "o_orderkey"), ("C:", "o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")),
        _edges(line, 4, "CONTAINS", ("O:", "l_orderkey"), ("P:", "l_partkey"), at, F.col("l_returnflag")),
        _edges(line, 5, "FULFILLED_BY", ("O:", "l_orderkey"), ("S:", "l_suppkey"), at, F.col("l_linestatus")),
    ]
    return reduce(DataFrame.unionByName, parts)


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the graph that stays small: regions, nations, suppliers."""
    return nodes(spark, sf_dir).filter(F.col("type").isin("Region", "Nation", "Supplier"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter((F.col("type") == "PART_OF") | F.col("src").startswith("S:"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers."""
    return nodes(spark, sf_dir).filter(F.col("type").isin("Region", "Nation", "Supplier", "Customer"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter(F.col("type").isin("PART_OF", "LOCATED_IN"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mentions of users: an id occurs under several types and in many sections."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("U:"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.col("props").alias("description"),
        day.alias("section"),
        F.create_map(F.lit("k"), k, F.lit("parity"), F.when(k.cast("int") % 2 == 0, "even").otherwise("odd")).alias("attrs"),
    )


#: Events of one range of a day: a task orders one range, not a day.
RANGE = 1 << 20


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event links its user to the user of the event before it in the same day's section.

    The first event of a range takes the last one of the range before it that has any.
    """
    m = mentions(spark, sf_dir).withColumn("range", F.floor(F.col("ord") / RANGE))
    within = F.lag("id").over(Window.partitionBy("section", "range").orderBy("ord"))
    lasts = m.groupBy("section", "range").agg(F.max_by("id", "ord").alias("last"))
    carried = lasts.select("section", "range", F.lag("last").over(Window.partitionBy("section").orderBy("range")).alias("carried"))  # a row a range
    rows = m.withColumn("before", within).join(carried, ["section", "range"])
    return rows.select(
        "ord", F.col("id").alias("src"), F.coalesce("before", "carried").alias("dst"), F.upper("type").alias("type"), "section", F.col("name").alias("description")
    ).filter("dst is not null")


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as workflows: nodes are turns, each followed by the next."""
    t = table(spark, sf_dir, "conversations")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    at = F.col("conv_id") * TURNS + F.col("turn")
    n = t.select(at.alias("ord"), key.alias("id"), F.initcap("role").alias("type"), F.col("role").alias("name"), F.col("text").alias("description"), _attrs(("turn", F.col("turn"))).alias("attrs"))
    later = F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
    e = t.select(at.alias("ord"), key.alias("src"), later.alias("dst"), F.lit("FOLLOWED_BY").alias("type"), F.lit("").alias("description"))
    return n, e
