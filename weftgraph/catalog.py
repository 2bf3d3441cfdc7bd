"""The named queries of the library and their SQL counterparts.

Each query is a pair: a Spark function of (spark, sf_dir), and the same rows in SQL over
the tables. Lists come back as joined text and scores rounded, so that both sides hash
alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import registry
from weftgraph.functions import text as txt
from weftgraph.operators import graph, metrics, reports, resolve, traverse, validate
from weftgraph.operators.text_index import TextIndex
from weftgraph.plans import prompts, table_functions
from weftgraph.sources import files, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Asked of searches and walks.
KEYWORD, SEGMENT, TYPED = "an", "build", "1"
ROOTS = ("R:0", "R:1")
STRIDE = tables.STRIDE

# --- the views of ``sources.tables`` in SQL -------------------------------------

_NODES = f"""nodes AS (
 SELECT 0 + r_regionkey AS ord, 'R:' || r_regionkey AS id, 'Region' AS type, r_name AS name, 'Region ' || r_name AS description,
   CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS nation, CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS VARCHAR) AS brand,
   CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS priority FROM region
 UNION ALL SELECT {STRIDE} + n_nationkey, 'N:' || n_nationkey, 'Nation', n_name, 'Nation ' || n_name, CAST(n_regionkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
 UNION ALL SELECT {2 * STRIDE} + s_suppkey, 'S:' || s_suppkey, 'Supplier', s_name, 'Supplier ' || s_name, NULL, CAST(s_nationkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
 UNION ALL SELECT {3 * STRIDE} + c_custkey, 'C:' || c_custkey, 'Customer', c_name, 'Customer ' || c_name, NULL, CAST(c_nationkey AS VARCHAR), c_mktsegment, NULL, NULL, NULL, NULL, NULL FROM customer
 UNION ALL SELECT {4 * STRIDE} + p_partkey, 'P:' || p_partkey, 'Part', p_name, 'Part ' || p_name, NULL, NULL, NULL, p_brand, p_type, CAST(p_size AS VARCHAR), NULL, NULL FROM part
 UNION ALL SELECT {5 * STRIDE} + o_orderkey, 'O:' || o_orderkey, 'Order', o_orderpriority, 'Order ' || o_orderpriority, NULL, NULL, NULL, NULL, NULL, NULL, o_orderstatus, o_orderpriority FROM orders)"""
_EDGES = f"""edges AS (
 SELECT 0 + n_nationkey AS ord, 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst, 'PART_OF' AS type, '' AS description FROM nation
 UNION ALL SELECT {STRIDE} + s_suppkey, 'S:' || s_suppkey, 'N:' || s_nationkey, 'LOCATED_IN', '' FROM supplier
 UNION ALL SELECT {2 * STRIDE} + c_custkey, 'C:' || c_custkey, 'N:' || c_nationkey, 'LOCATED_IN', '' FROM customer
 UNION ALL SELECT {3 * STRIDE} + o_orderkey, 'O:' || o_orderkey, 'C:' || o_custkey, 'PLACED_BY', o_orderstatus FROM orders
 UNION ALL SELECT {4 * STRIDE} + l_orderkey * 10 + l_linenumber, 'O:' || l_orderkey, 'P:' || l_partkey, 'CONTAINS', l_returnflag FROM lineitem
 UNION ALL SELECT {5 * STRIDE} + l_orderkey * 10 + l_linenumber, 'O:' || l_orderkey, 'S:' || l_suppkey, 'FULFILLED_BY', l_linestatus FROM lineitem)"""
_GRAPH = f"WITH RECURSIVE {_NODES}, {_EDGES}"
_WHOLE = f"{_GRAPH}, tn AS (SELECT * FROM nodes), te AS (SELECT * FROM edges)"
#: The part of the graph for betweenness: places and who is there.
_PLACE = f"""{_GRAPH}, tn AS (SELECT * FROM nodes WHERE type IN ('Region', 'Nation', 'Supplier', 'Customer')),
 te AS (SELECT * FROM edges WHERE type IN ('PART_OF', 'LOCATED_IN')),
 pn AS (SELECT * FROM tn), pe AS (SELECT * FROM te)"""
_MENTIONS = """WITH m AS (SELECT event_id AS ord, 'U:' || user_id AS id, event_type AS type, 'user ' || user_id AS name, props AS description,
  strftime(ts, '%Y-%m-%d') AS section, json_extract_string(props, '$.k') AS k,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events)"""
_MENTION_EDGES = f"""{_MENTIONS}, me AS (SELECT * FROM (SELECT ord, id AS src, lag(id) OVER (PARTITION BY section ORDER BY ord) AS dst,
  upper(type) AS type, section, name AS description FROM m) WHERE dst IS NOT NULL)"""
_RANKED = f"{_MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY length(description) DESC, ord) AS rank FROM m)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


# --- lookups and counts -----------------------------------------------------------


@query("type_counts", f"{_GRAPH} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def type_counts(spark, d):
    return graph.type_counts(tables.nodes(spark, d))


@query(
    "graph_summary",
    f"{_GRAPH} SELECT 'entity' AS what, type, count(*) AS n FROM nodes GROUP BY ROLLUP (type) "
    "UNION ALL SELECT 'relationship', type, count(*) FROM edges GROUP BY ROLLUP (type)",
)
def graph_summary(spark, d):
    return graph.summary(tables.nodes(spark, d), tables.edges(spark, d))


@query("nodes_of_type", f"{_GRAPH} SELECT id FROM nodes WHERE type = 'Supplier'")
def nodes_of_type(spark, d):
    return graph.of_type(tables.nodes(spark, d), "Supplier")


@query("find_entities", f"{_GRAPH} SELECT id, name, description FROM nodes WHERE lower(type) = 'nation'")
def find_entities(spark, d):
    return graph.find_entities(tables.nodes(spark, d), "NATION")


_HAY = "lower(concat_ws(' ', id, name, description, type, region, nation, segment, brand, kind, size, status, priority))"


@query("search_entities", f"{_GRAPH} SELECT id, type, name, description FROM nodes WHERE contains({_HAY}, '{KEYWORD}')")
def search_entities(spark, d):
    return graph.search(tables.nodes(spark, d), KEYWORD.upper())


@query("search_first", f"{_GRAPH} SELECT id, type, name, description FROM nodes WHERE contains({_HAY}, 'customer') ORDER BY ord LIMIT 12")
def search_first(spark, d):
    return graph.search(tables.nodes(spark, d), "customer", 12)


@query("find_by_attribute", f"{_GRAPH} SELECT id, name, type, segment AS value FROM nodes WHERE contains(lower(segment), '{SEGMENT}')")
def find_by_attribute(spark, d):
    return graph.find_by_attribute(tables.nodes(spark, d), "segment", SEGMENT)


@query("autocomplete", f"{_GRAPH} SELECT id, name FROM nodes WHERE contains(lower(name), '{TYPED}') ORDER BY ord LIMIT 8")
def autocomplete(spark, d):
    return graph.autocomplete(tables.nodes(spark, d), TYPED)


@query("search_indexed", f"{_GRAPH} SELECT id, type, name, description FROM nodes WHERE contains({_HAY}, 'urgent')")
def search_indexed(spark, d):
    return TextIndex.build(tables.nodes(spark, d)).search("Urgent")


@query("search_short", f"{_GRAPH} SELECT id, type, name, description FROM nodes WHERE contains({_HAY}, ':7')")
def search_short(spark, d):
    return TextIndex.build(tables.nodes(spark, d)).search(":7")


@query("search_percent", f"{_GRAPH} SELECT id, type, name, description || ' 7%_' AS description FROM nodes WHERE ord % 7 = 0 AND contains(lower(concat_ws(' ', id, name, description || ' 7%_', type)), 'low 7%')")
def search_percent(spark, d):
    marked = F.when(F.col("ord") % 7 == 0, F.concat("description", F.lit(" 7%_"))).otherwise(F.col("description"))
    n = tables.nodes(spark, d).withColumns({"description": marked, "attrs": F.expr("cast(map() as map<string, string>)")})
    return TextIndex.build(n).search("LOW 7%")


@query("autocomplete_indexed", f"{_GRAPH} SELECT id, name FROM nodes WHERE contains(lower(name), '{TYPED}') ORDER BY ord LIMIT 8")
def autocomplete_indexed(spark, d):
    return TextIndex.build(tables.nodes(spark, d)).autocomplete(TYPED)


@query(
    "entity_detail",
    f"""{_GRAPH}, x AS (SELECT src AS id, 'out' AS direction, type AS relation, dst AS other FROM edges WHERE src IN ('N:3', 'S:5')
      UNION ALL SELECT dst, 'in', type, src FROM edges WHERE dst IN ('N:3', 'S:5'))
    SELECT x.id, direction, relation, other, coalesce(n.name, other) AS other_name, n.type AS other_type FROM x LEFT JOIN nodes n ON n.id = other""",
)
def entity_detail(spark, d):
    return graph.relations(tables.nodes(spark, d), tables.edges(spark, d), _ids(spark, "N:3", "S:5"))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT id, '{k}' AS key, {k} AS value FROM nodes WHERE {k} IS NOT NULL"
    for k in ("region", "nation", "segment", "brand", "kind", "size", "status", "priority")
)


@query("entity_attributes", f"{_GRAPH} {_UNPIVOT}")
def entity_attributes(spark, d):
    return graph.attributes(tables.nodes(spark, d))


@query("grouped_members", f"{_GRAPH} SELECT type, count(*) OVER (PARTITION BY type) AS n, id FROM nodes")
def grouped_members(spark, d):
    return graph.grouped(tables.nodes(spark, d))


@query(
    "graph_colours",
    f"""{_GRAPH} SELECT id, type, CASE type WHEN 'Region' THEN '#123456' WHEN 'Nation' THEN '#654321' ELSE '#999999' END AS colour,
    CASE type WHEN 'Region' THEN 1 WHEN 'Nation' THEN 2 ELSE 5 END AS level, CASE WHEN type IN ('Region', 'Nation') THEN 'places' ELSE '' END AS "group" FROM nodes""",
)
def graph_colours(spark, d):
    colours = spark.createDataFrame([("Region", "#123456", 1, "places"), ("Nation", "#654321", 2, "places")], "type string, colour string, level int, group string")
    return graph.coloured(tables.nodes(spark, d), colours)


@query(
    "legend",
    f"""{_GRAPH} SELECT CASE WHEN type IN ('Region', 'Nation') THEN 'places' ELSE '' END AS "group", type, count(*) AS n FROM nodes GROUP BY type""",
)
def legend(spark, d):
    groups = spark.createDataFrame([("Region", "places"), ("Nation", "places")], "type string, group string")
    return graph.legend(graph.type_counts(tables.nodes(spark, d)), groups)


@query(
    "edge_numbers",
    f"{_GRAPH} SELECT 'r' || (row_number() OVER (ORDER BY ord, src, dst, type, description) - 1) AS edge_id, ord, src, dst, type, description FROM edges",
)
def edge_numbers(spark, d):
    return graph.numbered(tables.edges(spark, d))


@query(
    "graph_lines",
    f"""{_WHOLE} SELECT 0 AS part, ord, '[' || type || '] ' || name || ' (' || id || '): ' || description AS line FROM tn
    UNION ALL SELECT 1, ord, src || ' -[' || type || ']-> ' || dst FROM te""",
)
def graph_lines(spark, d):
    return graph.text_lines(tables.nodes(spark, d), tables.edges(spark, d))


# --- building ----------------------------------------------------------------------


@query(
    "edges_collapsed",
    f"""{_GRAPH} SELECT min(ord) AS ord, src, dst, max(struct_pack(o := ord, t := type, d := description)).t AS type, max(struct_pack(o := ord, t := type, d := description)).d AS description, count(*) AS parallel
    FROM edges GROUP BY src, dst""",
)
def edges_collapsed(spark, d):
    return graph.collapse_edges(tables.edges(spark, d))


@query(
    "dangling_edges",
    f"""{_GRAPH}, kept AS (SELECT id FROM nodes WHERE type <> 'Part') SELECT ord, src, dst, type, description, dst AS missing FROM edges
    WHERE dst NOT IN (SELECT id FROM kept) AND src IN (SELECT id FROM kept)""",
)
def dangling_edges(spark, d):
    kept = tables.nodes(spark, d).filter("type != 'Part'")
    return graph.dangling_edges(tables.edges(spark, d), kept).withColumn("missing", F.array_join("missing", ","))


@query(
    "graph_built",
    f"""{_GRAPH}, kept AS (SELECT id FROM nodes WHERE type <> 'Part'), e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept))
    SELECT src, dst, arg_max(type, ord) AS type, count(*) AS parallel FROM e GROUP BY src, dst""",
)
def graph_built(spark, d):
    _, e = graph.build(tables.nodes(spark, d).filter("type != 'Part'"), tables.edges(spark, d))
    return e.select("src", "dst", "type", "parallel")


@query(
    "merged_node_attrs",
    f"""{_MENTIONS} SELECT id, min(ord) AS ord, arg_max(type, ord) AS type, arg_max(description, ord) AS description, arg_max(k, ord) AS k FROM m GROUP BY id""",
)
def merged_node_attrs(spark, d):
    n = graph.first_nodes(tables.mentions(spark, d))
    return n.select("id", "ord", "type", "description", F.col("attrs")["k"].alias("k"))


# --- resolution --------------------------------------------------------------------


@query(
    "exact_id_dedup",
    f"""{_RANKED} SELECT id, type, min(ord) AS ord, count(*) AS size, arg_min(name, rank) AS name, arg_min(description, rank) AS description,
    string_agg(DISTINCT section, ',' ORDER BY section) AS appears_in FROM r GROUP BY id, type""",
)
def exact_id_dedup(spark, d):
    m = resolve.exact_dedup(tables.mentions(spark, d))
    return _long(m, "size").select("id", "type", "ord", "size", "name", "description", F.array_join("appears_in", ",").alias("appears_in"))


_FIRSTS = """f AS (SELECT id, type, description, min(rank) AS rank FROM r GROUP BY id, type, description),
 fk AS (SELECT id, type, k, min(rank) AS rank FROM r WHERE k IS NOT NULL GROUP BY id, type, k),
 fp AS (SELECT id, type, parity, min(rank) AS rank FROM r GROUP BY id, type, parity)"""


@query(
    "group_merge_attrs",
    f"""{_RANKED}, {_FIRSTS},
    a AS (SELECT id, type, string_agg(description, '|' ORDER BY rank) AS anchors FROM f GROUP BY id, type),
    b AS (SELECT id, type, string_agg(k, '; ' ORDER BY rank) AS k FROM fk GROUP BY id, type),
    c AS (SELECT id, type, string_agg(parity, '; ' ORDER BY rank) AS parity FROM fp GROUP BY id, type)
    SELECT * FROM a JOIN b USING (id, type) JOIN c USING (id, type)""",
)
def group_merge_attrs(spark, d):
    m = resolve.exact_dedup(tables.mentions(spark, d))
    return m.select("id", "type", F.array_join("anchors", "|").alias("anchors"), F.col("attrs")["k"].alias("k"), F.col("attrs")["parity"].alias("parity"))


@query(
    "group_merge_fallback",
    f"""{_RANKED}, t AS (SELECT id, type, arg_min(k, rank) AS k0, arg_min(parity, rank) AS p0, count(DISTINCT k) AS ks FROM r GROUP BY id, type), {_FIRSTS},
    c AS (SELECT id, type, string_agg(parity, '; ' ORDER BY rank) AS parity FROM fp GROUP BY id, type)
    SELECT id, type, k0 AS k, CASE WHEN ks > 1 THEN p0 ELSE parity END AS parity, ks > 1 AS fallback FROM t JOIN c USING (id, type)""",
)
def group_merge_fallback(spark, d):
    m = resolve.exact_dedup(tables.mentions(spark, d), typed=("k",))
    return m.select("id", "type", F.col("attrs")["k"].alias("k"), F.col("attrs")["parity"].alias("parity"), "fallback")


@query("merge_counts", f"{_MENTIONS} SELECT count(*) AS entities, CAST(sum(n - 1) AS BIGINT) AS merges FROM (SELECT count(*) AS n FROM m GROUP BY id, type)")
def merge_counts(spark, d):
    return resolve.merges(resolve.exact_dedup(tables.mentions(spark, d)))


# users 10k+1 become users 10k, and every third user becomes one that doesn't exist
_REMAPS = """remaps AS (SELECT u AS ord, 'U:' || u AS old_id, CASE WHEN u % 10 = 1 THEN 'U:' || (u - 1) ELSE 'U:x' || (u // 9) END AS new_id
  FROM (SELECT DISTINCT user_id AS u FROM events) WHERE u % 10 = 1 OR u % 3 = 0 AND u % 10 <> 0)"""


def _remaps(spark: SparkSession, d: str) -> DataFrame:
    u = tables.table(spark, d, "events").select(F.col("user_id").alias("u")).distinct().filter("u % 10 = 1 or (u % 3 = 0 and u % 10 != 0)")
    new = F.when(F.col("u") % 10 == 1, F.concat(F.lit("U:"), (F.col("u") - 1).cast("string"))).otherwise(F.concat(F.lit("U:x"), F.floor(F.col("u") / 9).cast("string")))
    return u.select(F.col("u").cast("long").alias("ord"), F.concat(F.lit("U:"), F.col("u").cast("string")).alias("old_id"), new.alias("new_id"))


# a new id that no user has goes to its member with the most sections, the longest description, the first remap
_RESOLVED = f"""{_REMAPS}, merit AS (SELECT id, count(DISTINCT section) AS sections, max(length(description)) AS longest FROM m GROUP BY id),
  good AS (SELECT remaps.*, sections, longest, new_id IN (SELECT id FROM m) AS known FROM remaps JOIN merit ON merit.id = old_id),
  best AS (SELECT new_id, old_id AS canonical FROM good WHERE NOT known QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY sections DESC, longest DESC, ord) = 1),
  resolved AS (SELECT old_id, coalesce(canonical, good.new_id) AS new_id FROM good LEFT JOIN best ON best.new_id = good.new_id WHERE known OR old_id <> canonical)"""


@query(
    "resolved_remaps",
    f"{_MENTIONS}, {_RESOLVED} SELECT old_id, new_id FROM resolved",
)
def resolved_remaps(spark, d):
    return resolve.resolved_remaps(tables.mentions(spark, d), _remaps(spark, d))


@query(
    "remap_merge",
    f"""{_MENTIONS}, {_RESOLVED}, x AS (SELECT m.* EXCLUDE id, m.id AS was, coalesce(new_id, m.id) AS id FROM m LEFT JOIN resolved ON old_id = m.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(description) DESC, ord) AS rank FROM x),
    p AS (SELECT id, parity, min(rank) AS rank FROM r GROUP BY id, parity), pa AS (SELECT id, string_agg(parity, '; ' ORDER BY rank) AS parity FROM p GROUP BY id)
    SELECT id, count(*) AS size, arg_min(type, rank) AS type, arg_min(name, rank) AS name, any_value(pa.parity) AS parity FROM r JOIN pa USING (id) GROUP BY id""",
)
def remap_merge(spark, d):
    m = resolve.apply_remaps(tables.mentions(spark, d), _remaps(spark, d))
    return _long(m, "size").select("id", "size", "type", "name", F.col("attrs")["parity"].alias("parity"))


@query(
    "remap_problems",
    f"""{_MENTIONS}, {_REMAPS}, more AS (SELECT * FROM remaps UNION ALL VALUES (9000001, 'U:nobody', 'U:1'), (9000002, 'U:2', 'U:2'), (9000003, 'U:4', 'U:5'), (9000004, 'U:5', 'U:4'))
    SELECT a.ord, a.old_id, a.new_id, CASE WHEN a.old_id NOT IN (SELECT id FROM m) THEN 'unknown old id' WHEN a.old_id = a.new_id THEN 'onto itself'
      WHEN EXISTS (SELECT 1 FROM more b WHERE b.old_id = a.new_id AND b.new_id = a.old_id) THEN 'cycle' END AS problem FROM more a""",
)
def remap_problems(spark, d):
    extra = spark.createDataFrame([(9000001, "U:nobody", "U:1"), (9000002, "U:2", "U:2"), (9000003, "U:4", "U:5"), (9000004, "U:5", "U:4")], "ord long, old_id string, new_id string")
    return resolve.checked_remaps(_remaps(spark, d).unionByName(extra), tables.mentions(spark, d))


@query(
    "remapped_edges",
    f"""{_MENTION_EDGES}, {_RESOLVED} SELECT me.ord, coalesce(a.new_id, src) AS src, coalesce(b.new_id, dst) AS dst, me.type, section, description
    FROM me LEFT JOIN resolved a ON a.old_id = src LEFT JOIN resolved b ON b.old_id = dst""",
)
def remapped_edges(spark, d):
    return resolve.remap_edges(tables.mention_edges(spark, d), resolve.resolved_remaps(tables.mentions(spark, d), _remaps(spark, d)))


@query(
    "dedup_edges",
    f"""{_MENTION_EDGES} SELECT src, dst, type, min(ord) AS ord, arg_min(section, ord) AS section, arg_min(description, ord) AS description, count(*) AS copies
    FROM me GROUP BY src, dst, type""",
)
def dedup_edges(spark, d):
    return resolve.dedup_edges(tables.mention_edges(spark, d))


@query(
    "new_edges",
    f"""{_MENTION_EDGES}, old AS (SELECT * FROM me WHERE ord % 3 = 0), new AS (SELECT * FROM me WHERE ord % 3 <> 0)
    SELECT src, dst, type, min(ord) AS ord, count(*) AS copies FROM new WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.src = new.src AND o.dst = new.dst AND o.type = new.type)
    GROUP BY src, dst, type""",
)
def new_edges(spark, d):
    e = tables.mention_edges(spark, d)
    return resolve.new_edges(e.filter("ord % 3 = 0"), e.filter("ord % 3 != 0")).select("src", "dst", "type", "ord", "copies")


@query(
    "orphans",
    f"""{_MENTION_EDGES}, kept AS (SELECT id FROM m WHERE CAST(substr(id, 3) AS INT) % 7 <> 0),
    lost AS (SELECT * FROM me WHERE src NOT IN (SELECT id FROM kept) OR dst NOT IN (SELECT id FROM kept)),
    ids AS (SELECT DISTINCT id FROM (SELECT src AS id FROM lost UNION ALL SELECT dst FROM lost) WHERE id NOT IN (SELECT id FROM kept) ORDER BY id LIMIT 10)
    SELECT (SELECT count(*) FROM lost) AS orphans, (SELECT string_agg(id, ',' ORDER BY id) FROM ids) AS sample""",
)
def orphans(spark, d):
    kept = tables.mentions(spark, d).filter(F.substring("id", 3, 20).cast("int") % 7 != 0)
    return resolve.orphan_sample(tables.mention_edges(spark, d), kept)


@query(
    "foreign_dedup",
    """WITH x AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS id, lang AS type, source AS name,
      CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'v' || (doc_id % 11) END AS a FROM documents)
    SELECT min(ord) AS ord, arg_min(id, ord) AS id, type, arg_min(name, ord) AS name, count(*) AS size, arg_min(a, ord) FILTER (a IS NOT NULL) AS a FROM x GROUP BY lower(id), type""",
)
def foreign_dedup(spark, d):
    x = tables.table(spark, d, "documents")
    a = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("v"), (F.col("doc_id") % 11).cast("string")))
    rows = x.select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("id"), F.col("lang").alias("type"), F.col("source").alias("name"), F.create_map(F.lit("a"), a).alias("attrs"))
    return resolve.foreign_dedup(rows).select("ord", "id", "type", "name", "size", F.col("attrs")["a"].alias("a"))


@query("reconstruction_problems", f"{_MENTIONS} SELECT DISTINCT id, type, CASE WHEN type = 'click' THEN 'lost parity' ELSE '' END AS problems FROM m")
def reconstruction_problems(spark, d):
    m = tables.mentions(spark, d)
    merged = resolve.exact_dedup(m)
    cut = merged.withColumn("attrs", F.when(F.col("type") == "click", F.map_filter("attrs", lambda k, _: k != "parity")).otherwise(F.col("attrs")))
    return resolve.reconstruction_problems(cut, m)


# --- validation --------------------------------------------------------------------

_KINDS = "kinds AS (SELECT id, type AS kind FROM nodes)"
#: Every fourth edge is turned, and some get a type that no rule allows them.
_TURNED = """cand AS (SELECT ord, CASE WHEN ord % 4 = 0 THEN dst ELSE src END AS src, CASE WHEN ord % 4 = 0 THEN src ELSE dst END AS dst,
  CASE WHEN ord % 13 = 0 THEN 'PART_OF' WHEN ord % 17 = 0 THEN 'ODD' ELSE type END AS type FROM te)"""
_FROM = "(({t} = 'PART_OF' AND {s} = 'Nation') OR ({t} = 'LOCATED_IN' AND {s} IN ('Supplier', 'Customer')) OR ({t} IN ('PLACED_BY', 'CONTAINS', 'FULFILLED_BY') AND {s} = 'Order'))"
_ONTO = "(({t} = 'PART_OF' AND {d} = 'Region') OR ({t} = 'LOCATED_IN' AND {d} = 'Nation') OR ({t} = 'PLACED_BY' AND {d} = 'Customer') OR ({t} = 'CONTAINS' AND {d} = 'Part') OR {t} = 'FULFILLED_BY')"
_ALLOW = f"({_FROM} AND {_ONTO})"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    e = tables.edges(spark, d)
    turn = F.col("ord") % 4 == 0
    kind = F.when(F.col("ord") % 13 == 0, "PART_OF").when(F.col("ord") % 17 == 0, "ODD").otherwise(F.col("type"))
    return e.select("ord", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), kind.alias("type"))


def _rules(spark: SparkSession) -> DataFrame:
    return registry.relation_table(spark, registry.TABLE_RELATIONS)


@query(
    "validate_edges",
    f"""{_WHOLE}, {_KINDS}, {_TURNED}, x AS (SELECT cand.*, coalesce(a.kind, 'Unknown') AS src_type, coalesce(b.kind, 'Unknown') AS dst_type FROM cand LEFT JOIN kinds a ON a.id = src LEFT JOIN kinds b ON b.id = dst),
    v AS (SELECT *, CASE WHEN type = 'ODD' THEN 'invalid' WHEN {_ALLOW.format(t='type', s='src_type', d='dst_type')} THEN 'valid' WHEN {_ALLOW.format(t='type', s='dst_type', d='src_type')} THEN 'flipped' ELSE 'invalid' END AS verdict FROM x)
    SELECT ord, src, dst, type, src_type, dst_type, verdict, CASE WHEN verdict <> 'invalid' THEN '' WHEN type = 'ODD' THEN 'unknown relationship type ODD'
      ELSE concat_ws('; ', CASE WHEN NOT {_FROM.format(t='type', s='src_type')} THEN 'source type ' || src_type END,
        CASE WHEN NOT {_ONTO.format(t='type', d='dst_type')} THEN 'target type ' || dst_type END) END AS warnings FROM v""",
)
def validate_edges(spark, d):
    return validate.validate_edges(_candidates(spark, d), tables.nodes(spark, d), _rules(spark))


@query(
    "flipped_edges",
    f"""{_WHOLE}, {_KINDS}, {_TURNED}, x AS (SELECT cand.*, a.kind AS s, b.kind AS t FROM cand JOIN kinds a ON a.id = src JOIN kinds b ON b.id = dst)
    SELECT ord, src, dst, type FROM x WHERE {_ALLOW.format(t='type', s='s', d='t')} UNION ALL SELECT ord, dst, src, type FROM x WHERE {_ALLOW.format(t='type', s='t', d='s')}""",
)
def flipped_edges(spark, d):
    return validate.flipped(validate.validate_edges(_candidates(spark, d), tables.nodes(spark, d), _rules(spark))).select("ord", "src", "dst", "type")


@query(
    "stage_filter",
    f"""{_WHOLE}, {_KINDS}, {_TURNED}, two AS (SELECT * FROM cand UNION ALL SELECT ord + 100000000000000, src, dst, type FROM cand WHERE ord % 5 = 0),
    old AS (SELECT DISTINCT src, dst, type FROM te WHERE ord % 6 = 0),
    x AS (SELECT two.*, a.kind AS s, b.kind AS t, min(ord) OVER (PARTITION BY src, dst, type) AS first, EXISTS (SELECT 1 FROM old o WHERE o.src = two.src AND o.dst = two.dst AND o.type = two.type) AS met
      FROM two LEFT JOIN kinds a ON a.id = src AND a.id NOT LIKE 'C:%7' LEFT JOIN kinds b ON b.id = dst AND b.id NOT LIKE 'C:%7')
    SELECT ord, src, dst, type, CASE WHEN s IS NULL OR t IS NULL THEN 'orphan' WHEN met OR ord > first THEN 'duplicate'
      WHEN {_ALLOW.format(t='type', s='s', d='t')} OR {_ALLOW.format(t='type', s='t', d='s')} THEN 'valid' ELSE 'invalid' END AS outcome FROM x""",
)
def stage_filter(spark, d):
    c = _candidates(spark, d)
    two = c.unionByName(c.filter("ord % 5 = 0").withColumn("ord", F.col("ord") + 100000000000000))
    known = tables.nodes(spark, d).filter("id not like 'C:%7'")
    old = tables.edges(spark, d).filter("ord % 6 = 0")
    return validate.stage_filter(two, old, known, _rules(spark)).drop("verdict")


@query(
    "section_integrity",
    f"""{_MENTION_EDGES}, own AS (SELECT DISTINCT section, id FROM m WHERE ord % 2 = 0)
    SELECT section, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS kept, count(*) FILTER (a.id IS NULL OR b.id IS NULL) AS lost
    FROM me LEFT JOIN own a ON a.section = me.section AND a.id = src LEFT JOIN own b ON b.section = me.section AND b.id = dst GROUP BY me.section""".replace("SELECT section, count", "SELECT me.section, count"),
)
def section_integrity(spark, d):
    return validate.section_integrity(tables.mention_edges(spark, d), tables.mentions(spark, d).filter("ord % 2 = 0"))


@query(
    "cross_section_edges",
    f"""{_MENTION_EDGES}, k AS (SELECT id, arg_max(type, ord) AS kind, arg_min(section, ord) AS s FROM m WHERE CAST(substr(id, 3) AS INT) % 9 <> 0 GROUP BY id)
    SELECT ord, src, dst, me.type, CASE WHEN a.s IS NULL THEN 'missing source' WHEN b.s IS NULL THEN 'missing target' WHEN a.s = b.s THEN 'same section'
      WHEN NOT ((me.type = 'CLICK' AND (a.kind = 'view' OR b.kind = 'view')) OR (me.type = 'VIEW')) THEN 'type constraint' END AS reason
    FROM me LEFT JOIN k a ON a.id = src LEFT JOIN k b ON b.id = dst""",
)
def cross_section_edges(spark, d):
    rules = registry.relation_table(spark, {"CLICK": (["view"], []), "VIEW": ([], [])})
    known = tables.mentions(spark, d).filter(F.substring("id", 3, 20).cast("int") % 9 != 0)
    first = known.groupBy("id").agg(F.min_by("section", "ord").alias("section"))
    return validate.cross_section(tables.mention_edges(spark, d), known, rules, first).select("ord", "src", "dst", "type", "reason")


_BAD = """CASE WHEN doc_id % 7 = 0 THEN 'Nothing' WHEN doc_id % 2 = 0 THEN 'Service' ELSE 'SeverityLevel' END"""


@query(
    "validate_entities",
    f"""WITH x AS (SELECT doc_id AS ord, {_BAD} AS type, CASE WHEN doc_id % 11 <> 0 THEN source END AS name,
      CASE WHEN doc_id % 5 = 0 THEN '"many"' WHEN doc_id % 5 = 1 THEN '"3"' WHEN doc_id % 5 = 2 THEN 'null' ELSE '4' END AS n FROM documents)
    SELECT ord, type, CASE WHEN type = 'Nothing' THEN 'unknown type: Nothing' ELSE concat_ws('; ', CASE WHEN n = '"many"' THEN 'bad value: ' || CASE type WHEN 'Service' THEN 'activation_severity_threshold' ELSE 'level' END END,
      CASE WHEN name IS NULL THEN 'missing: name' END) END AS errors, CASE WHEN type <> 'Nothing' AND n <> '"many"' AND name IS NOT NULL THEN 'extra field: colour' ELSE '' END AS warnings FROM x""",
)
def validate_entities(spark, d):
    c = F.col("doc_id")
    kind = F.when(c % 7 == 0, "Nothing").when(c % 2 == 0, "Service").otherwise("SeverityLevel")
    n = F.when(c % 5 == 0, '"many"').when(c % 5 == 1, '"3"').when(c % 5 == 2, "null").otherwise("4")
    attr = F.when(c % 2 == 0, "activation_severity_threshold").otherwise("level")
    raw = tables.table(spark, d, "documents").select(
        c.alias("ord"), c.cast("string").alias("id"), kind.alias("type"), F.when(c % 11 != 0, F.col("source")).alias("name"), F.lit("").alias("description"),
        F.create_map(attr, n, F.lit("colour"), F.lit('"red"')).alias("attrs"),
    )
    v = validate.validate_entities(raw, registry.attribute_table(spark))
    return v.select("ord", "type", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(
    "allowed_triples",
    """WITH t(type) AS (VALUES ('Customer'), ('Nation'), ('Order'), ('Part'), ('Region'), ('Supplier'))
    SELECT 'Nation' AS src_type, 'PART_OF' AS type, 'Region' AS dst_type UNION ALL SELECT 'Supplier', 'LOCATED_IN', 'Nation' UNION ALL SELECT 'Customer', 'LOCATED_IN', 'Nation'
    UNION ALL SELECT 'Order', 'PLACED_BY', 'Customer' UNION ALL SELECT 'Order', 'CONTAINS', 'Part' UNION ALL SELECT 'Order', 'FULFILLED_BY', type FROM t""",
)
def allowed_triples(spark, d):
    return registry.allowed_triples(_rules(spark), spark.createDataFrame([(t,) for t in registry.TABLE_TYPES], "type string"))


@query(
    "constraint_rollup",
    """SELECT * FROM (VALUES ('PART_OF', 'Nation', 'Region'), ('LOCATED_IN', 'Customer, Supplier', 'Nation'), ('PLACED_BY', 'Order', 'Customer'),
    ('CONTAINS', 'Order', 'Part'), ('FULFILLED_BY', 'Order', 'any')) AS t(type, sources, targets)""",
)
def constraint_rollup(spark, d):
    return registry.constraint_rollup(_rules(spark))


@query(
    "stamped_entities",
    """SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 4 = 0 THEN CAST(doc_id % 10 AS VARCHAR) ELSE 'SEC-' || (doc_id % 10) END AS source_section,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'SEC-' || (doc_id % 10) END AS appears_in FROM documents""",
)
def stamped_entities(spark, d):
    c = F.col("doc_id")
    rows = tables.table(spark, d, "documents").select(
        c.alias("ord"), F.when(c % 3 == 0, F.col("source")).otherwise("").alias("source_section"),
        F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("SEC-"), (c % 10).cast("string"))).alias("section_id"), (c % 10).cast("string").alias("section_number"),
    )
    return validate.stamp(rows).select("ord", "source_section", F.array_join("appears_in", ",").alias("appears_in"))


# --- traversal ---------------------------------------------------------------------

_BOTH = "both_ways AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM te UNION ALL SELECT dst, src FROM te))"
_DOWN = "down AS (SELECT row_number() OVER (ORDER BY ord) AS ord, dst AS src, src AS dst, type FROM te)"


@query(
    "khop_neighbors",
    f"""{_WHOLE}, {_BOTH}, w AS (SELECT id AS start, id, 0 AS hops FROM (VALUES ('R:0'), ('S:5')) AS t(id)
      UNION SELECT start, b, hops + 1 FROM w JOIN both_ways ON a = id WHERE hops < 2) SELECT start, id, min(hops) AS hops FROM w GROUP BY start, id""",
)
def khop_neighbors(spark, d):
    return traverse.k_hop(tables.edges(spark, d), _ids(spark, "R:0", "S:5"), 2)


@query(
    "walk_neighbors",
    f"""{_WHOLE}, {_BOTH}, w AS (SELECT id AS start, id, 0 AS hops FROM (VALUES ('R:0'), ('S:5')) AS t(id)
      UNION SELECT start, b, hops + 1 FROM w JOIN both_ways ON a = id WHERE hops < 2) SELECT start, id, min(hops) AS hops FROM w GROUP BY start, id""",
)
def walk_neighbors(spark, d):
    return traverse.walk(tables.edges(spark, d), _ids(spark, "R:0", "S:5"), 2)


@query(
    "walk_subtrees",
    f"""{_WHOLE}, w AS (SELECT id AS start, id, 0 AS hops FROM (VALUES ('R:1'), ('N:3')) AS t(id) UNION SELECT start, src, hops + 1 FROM w JOIN te ON dst = id)
    SELECT start, id, min(hops) AS hops FROM w GROUP BY start, id""",
)
def walk_subtrees(spark, d):
    down = tables.edges(spark, d).select("ord", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return traverse.walk(down, _ids(spark, "R:1", "N:3"), None, directed=True)


@query(
    "khop_edges",
    f"""{_WHOLE}, {_BOTH}, w AS (SELECT 'R:0' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN both_ways ON a = id WHERE hops < 1)
    SELECT 'R:0' AS start, src, dst, type FROM te WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)""",
)
def khop_edges(spark, d):
    e = tables.edges(spark, d)
    return traverse.induced(e, traverse.k_hop(e, _ids(spark, "R:0"), 1))


def _cascade_sql(levels: int) -> str:
    """Levels of a walk against the edges; a node's parent is the first found, by the first edge."""
    roots = ", ".join(f"('{r}')" for r in ROOTS)
    ctes = [f"l0 AS (SELECT id AS start, id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS type, 0::BIGINT AS rank FROM (VALUES {roots}) AS t(id))"]
    for k in range(1, levels + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} o WHERE o.start = m.start AND o.id = m.id)" for j in range(k))
        ctes += [
            f"m{k} AS (SELECT start, te.src AS id, arg_min(struct_pack(r := rank, o := te.ord, p := w.id, t := te.type), struct_pack(r := rank, o := te.ord)) AS m FROM l{k - 1} w JOIN te ON te.dst = w.id GROUP BY start, te.src)",
            f"l{k} AS (SELECT start, id, {k} AS depth, m.m.p AS parent, m.m.t AS type, row_number() OVER (PARTITION BY start ORDER BY m.m.r, m.m.o) AS rank FROM m{k} m WHERE {seen})",
        ]
    every = " UNION ALL ".join(f"SELECT start, id, depth, parent, type FROM l{k}" for k in range(levels + 1))
    return f"{_WHOLE}, {', '.join(ctes)}, walk AS ({every})"


@query("cascade_bfs", f"{_cascade_sql(10)} SELECT * FROM walk")
def cascade_bfs(spark, d):
    down = tables.edges(spark, d).select("ord", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return traverse.cascade(down, _ids(spark, *ROOTS)).drop("rank")


@query(
    "cascade_summary",
    f"{_cascade_sql(10)} SELECT start, count(*) AS nodes, count(parent) AS edges, max(depth) AS depth FROM walk GROUP BY start",
)
def cascade_summary(spark, d):
    down = tables.edges(spark, d).select("ord", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return traverse.cascade_summary(traverse.cascade(down, _ids(spark, *ROOTS)))


@query(
    "workflow_chain",
    """WITH RECURSIVE t AS (SELECT conv_id, turn FROM conversations), w AS (SELECT conv_id, 0 AS turn, 0 AS step FROM (SELECT DISTINCT conv_id FROM t WHERE turn = 0)
      UNION ALL SELECT w.conv_id, w.turn + 1, step + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1)
    SELECT conv_id || '/0' AS start, step, conv_id || '/' || turn AS id, 0 AS branches FROM w""",
)
def workflow_chain(spark, d):
    n, e = tables.turns(spark, d)
    known = graph.known_edges(e, n)
    return traverse.workflow_chains(known, n.filter(F.endswith("id", F.lit("/0"))).select("id"))


# a second turn after every other one is a branch that isn't taken, as it comes later
@query(
    "walk_chains",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), w AS (SELECT conv_id, 0 AS turn, 0 AS step FROM (SELECT DISTINCT conv_id FROM t WHERE turn = 0)
      UNION ALL SELECT w.conv_id, w.turn + 1, step + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1)
    SELECT w.conv_id || '/0' AS start, step, w.conv_id || '/' || w.turn AS id, (w.turn % 2 = 0 AND w.turn + 2 <= last)::INT AS branches FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn""",
)
def walk_chains(spark, d):
    n, e = tables.turns(spark, d)
    turn = F.element_at(F.split("src", "/"), -1).cast("int")
    later = F.concat_ws("/", F.element_at(F.split("src", "/"), 1), (turn + 2).cast("string"))
    more = e.filter(turn % 2 == 0).select((F.col("ord") + (1 << 60)).alias("ord"), "src", later.alias("dst"), "type", "description")
    return traverse.chains(graph.known_edges(e.unionByName(more), n), n.filter(F.endswith("id", F.lit("/0"))).select("id"))


#: The first and the last customer of three nations; the distances of each target prune what can't arrive.
_PATHS = f"""{_WHOLE}, {_BOTH}, pairs AS (SELECT 'C:' || min(c_custkey) AS source, 'C:' || max(c_custkey) AS target FROM customer WHERE c_nationkey < 3 GROUP BY c_nationkey HAVING min(c_custkey) < max(c_custkey)),
  back AS (SELECT DISTINCT target, target AS id, 0 AS hops FROM pairs UNION SELECT target, b, hops + 1 FROM back JOIN both_ways ON a = id WHERE hops < 4),
  away AS MATERIALIZED (SELECT target, id, min(hops) AS hops FROM back GROUP BY target, id),
  w AS (SELECT source, target, source AS here, [source] AS path FROM pairs
  UNION ALL SELECT source, w.target, b, list_append(path, b) FROM w JOIN both_ways ON a = here JOIN away ON away.target = w.target AND away.id = b
    WHERE here <> w.target AND len(path) + away.hops <= 5 AND NOT list_contains(path, b)),
  paths AS (SELECT source, target, path FROM w WHERE here = target AND len(path) > 1)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "customer").filter("c_nationkey < 3").groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).filter("a < b")
    pairs = c.select(*(F.concat(F.lit("C:"), F.col(x).cast("string")).alias(n) for n, x in (("source", "a"), ("target", "b"))))
    return traverse.simple_paths(tables.edges(spark, d), pairs)


@query("simple_paths", f"{_PATHS} SELECT source, target, array_to_string(path, '>') AS path FROM paths")
def simple_paths(spark, d):
    return _paths(spark, d).withColumn("path", F.array_join("path", ">"))


_STEPS = f"""{_PATHS}, n AS (SELECT *, count(*) OVER (PARTITION BY source, target) AS found, row_number() OVER (PARTITION BY source, target ORDER BY len(path), array_to_string(path, '>')) AS nth FROM paths),
  s AS (SELECT source, target, found, nth, unnest(range(len(path) - 1)) AS step, path FROM n WHERE nth <= 5),
  h AS (SELECT source, target, found, nth, step, path[step + 1] AS a, path[step + 2] AS b FROM s),
  k AS (SELECT src, dst, arg_max(type, ord) AS type FROM te GROUP BY src, dst),
  st AS (SELECT h.*, coalesce(f.type, r.type) AS type, CASE WHEN f.type IS NOT NULL THEN 'forward' ELSE 'backward' END AS direction
   FROM h LEFT JOIN k f ON f.src = a AND f.dst = b LEFT JOIN k r ON r.src = b AND r.dst = a)"""


@query("path_steps", f"{_STEPS} SELECT source, target, found, nth, CAST(step AS INT) AS step, a, b, type, direction FROM st")
def path_steps(spark, d):
    return traverse.path_steps(_paths(spark, d), tables.edges(spark, d))


@query(
    "path_highlight",
    f"""{_STEPS} SELECT DISTINCT source, target, 'edge' AS kind, CASE direction WHEN 'forward' THEN a || '->' || b ELSE b || '->' || a END AS key FROM st
    UNION SELECT source, target, 'node', unnest([a, b]) FROM st""",
)
def path_highlight(spark, d):
    return traverse.path_highlight(traverse.path_steps(_paths(spark, d), tables.edges(spark, d)))


_HIDDEN = f"""{_WHOLE}, w AS (SELECT id AS root, id FROM (VALUES ('R:1'), ('N:3')) AS t(id) UNION SELECT root, src FROM w JOIN te ON dst = id)"""


@query("subtree_hidden", f"{_HIDDEN} SELECT root, id FROM w WHERE id <> root")
def subtree_hidden(spark, d):
    down = tables.edges(spark, d).select("ord", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return traverse.hidden(down, _ids(spark, "R:1", "N:3"))


@query("visible_edges", f"{_HIDDEN}, g AS (SELECT id FROM w WHERE id <> root) SELECT ord, dst AS src, src AS dst, type FROM te WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")
def visible_edges(spark, d):
    down = tables.edges(spark, d).select("ord", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return traverse.visible_edges(down, traverse.hidden(down, _ids(spark, "R:1", "N:3")))


@query(
    "neighbor_highlight",
    f"""{_WHOLE}, x AS (SELECT 'N:3' AS focus, src, dst FROM te WHERE src = 'N:3' OR dst = 'N:3')
    SELECT DISTINCT focus, 'edge' AS kind, src || '->' || dst AS key FROM x UNION SELECT focus, 'node', unnest([src, dst]) FROM x""",
)
def neighbor_highlight(spark, d):
    return traverse.neighbour_highlight(tables.edges(spark, d), _ids(spark, "N:3"))


# --- tools in SQL ------------------------------------------------------------------


def _asked(spark: SparkSession, d: str, sql: str) -> DataFrame:
    table_functions.register(spark, tables.nodes(spark, d), tables.edges(spark, d))
    return spark.sql(sql)


@query(
    "sql_tool_lists",
    f"""{_GRAPH} SELECT 'types' AS tool, type AS a, count(*)::VARCHAR AS b FROM nodes GROUP BY type UNION ALL SELECT 'find', id, name FROM nodes WHERE type = 'Supplier'
    UNION ALL SELECT 'search', id, type FROM nodes WHERE contains({_HAY}, 'o:12') UNION ALL SELECT 'attribute', id, segment FROM nodes WHERE contains(lower(segment), '{SEGMENT}')
    UNION ALL SELECT 'summary entity', type, count(*)::VARCHAR FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'summary relationship', type, count(*)::VARCHAR FROM edges GROUP BY ROLLUP (type)""",
)
def sql_tool_lists(spark, d):
    return _asked(
        spark, d,
        f"""SELECT 'types' AS tool, type AS a, CAST(n AS STRING) AS b FROM list_entity_types() UNION ALL SELECT 'find', id, name FROM find_entities('supplier')
        UNION ALL SELECT 'search', id, type FROM search_entities('O:12') UNION ALL SELECT 'attribute', id, value FROM find_by_attribute('segment', '{SEGMENT.upper()}')
        UNION ALL SELECT concat('summary ', what), type, CAST(n AS STRING) FROM get_graph_summary()""",
    )


@query(
    "sql_tool_entity",
    f"""{_GRAPH}, x AS (SELECT src AS id, 'out' AS part, type AS key, dst AS other, description FROM edges WHERE src IN ('S:5', 'O:1') UNION ALL SELECT dst, 'in', type, src, description FROM edges WHERE dst IN ('S:5', 'O:1')),
    own AS (SELECT * FROM nodes WHERE id IN ('S:5', 'O:1'))
    SELECT x.id, part, key, coalesce(n.name, other) AS value, other, n.type AS other_type, x.description FROM x JOIN own ON own.id = x.id LEFT JOIN nodes n ON n.id = other
    UNION ALL SELECT id, 'entity', unnest(['type', 'name', 'description']), unnest([type, name, description]), NULL, NULL, NULL FROM own
    UNION ALL SELECT id, 'attribute', key, value, NULL, NULL, NULL FROM ({_UNPIVOT}) WHERE id IN (SELECT id FROM own)""",
)
def sql_tool_entity(spark, d):
    return _asked(spark, d, "SELECT * FROM get_entity('S:5') UNION ALL SELECT * FROM get_entity('O:1') UNION ALL SELECT * FROM get_entity('gone')")


@query(
    "sql_tool_neighbors",
    f"""{_WHOLE}, {_BOTH}, w AS (SELECT 'R:0' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN both_ways ON a = id WHERE hops < 2)
    SELECT 'R:0' AS start, w.id, min(hops) AS hops, any_value(n.type) AS type, any_value(n.name) AS name FROM w JOIN nodes n ON n.id = w.id GROUP BY w.id""",
)
def sql_tool_neighbors(spark, d):
    return _asked(spark, d, "SELECT * FROM get_neighbors('R:0', 2) UNION ALL SELECT * FROM get_neighbors('gone', 3)")


@query(
    "sql_tool_workflow",
    """WITH t AS (SELECT *, conv_id || '/' || turn AS id FROM conversations WHERE conv_id IN (SELECT min(conv_id) FROM conversations))
    SELECT conv_id || '/0' AS start, id, turn::INT AS step, 0 AS branches, upper(role[1]) || role[2:] AS type, role AS name FROM t""",
)
def sql_tool_workflow(spark, d):
    n, e = tables.turns(spark, d)
    table_functions.register(spark, n, graph.known_edges(e, n), "talk")
    first = tables.table(spark, d, "conversations").agg(F.min("conv_id")).first()[0]
    return spark.sql(f"SELECT * FROM traverse_workflow('{first}/0')")


_RING = "SELECT n_nationkey::BIGINT AS ord, 'N:' || n_nationkey AS src, 'N:' || (n_nationkey + 1) % (SELECT count(*) FROM nation) AS dst, 'NEXT_TO' AS type, '' AS description FROM nation"


def _rings(spark: SparkSession, d: str) -> DataFrame:
    """Places and who is there, and nations in a ring."""
    n = tables.table(spark, d, "nation")
    beside = F.concat(F.lit("N:"), F.pmod(F.col("n_nationkey") + 1, F.lit(n.count())).cast("string"))
    ring = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("src"), beside.alias("dst"), F.lit("NEXT_TO").alias("type"), F.lit("").alias("description"))
    return tables.trade_edges(spark, d).unionByName(ring)


@query(
    "sql_tool_paths",
    f"""{_PLACE}, l AS ({_RING} UNION ALL SELECT * FROM te), both_ways AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM l UNION ALL SELECT dst, src FROM l)),
    w AS (SELECT 'N:0' AS here, ['N:0'] AS path UNION ALL SELECT b, list_append(path, b) FROM w JOIN both_ways ON a = here WHERE here <> 'N:9' AND len(path) <= 5 AND NOT list_contains(path, b)),
    n AS (SELECT path, count(*) OVER () AS found, row_number() OVER (ORDER BY len(path), array_to_string(path, '>')) AS nth FROM w WHERE here = 'N:9'),
    h AS (SELECT found, nth, step, path[step + 1] AS a, path[step + 2] AS b FROM (SELECT *, unnest(range(len(path) - 1)) AS step FROM n WHERE nth <= 5)),
    k AS (SELECT src, dst, arg_max(type, ord) AS type FROM l GROUP BY src, dst)
    SELECT 'N:0' AS source, 'N:9' AS target, found, nth, step::INT AS step, a, b, coalesce(f.type, r.type) AS type, CASE WHEN f.type IS NOT NULL THEN 'forward' ELSE 'backward' END AS direction
    FROM h LEFT JOIN k f ON f.src = a AND f.dst = b LEFT JOIN k r ON r.src = b AND r.dst = a""",
)
def sql_tool_paths(spark, d):
    table_functions.register(spark, tables.trade_nodes(spark, d), _rings(spark, d), "ring")
    return spark.sql("SELECT * FROM find_paths('N:0', 'N:9')")


# --- metrics -----------------------------------------------------------------------

_DEGREE = "deg AS MATERIALIZED (SELECT n.id, count(e.x) AS degree FROM {n} n LEFT JOIN (SELECT src AS x FROM {e} UNION ALL SELECT dst FROM {e}) e ON e.x = n.id GROUP BY n.id)"


@query("degree", f"{_GRAPH}, {_DEGREE.format(n='nodes', e='edges')} SELECT * FROM deg")
def degree(spark, d):
    return metrics.degrees(tables.nodes(spark, d), tables.edges(spark, d))


@query("degree_centrality", f"{_WHOLE}, {_DEGREE.format(n='tn', e='te')} SELECT id, degree, round(degree / ((SELECT count(*) FROM tn) - 1)::DOUBLE, 8) AS centrality FROM deg")
def degree_centrality(spark, d):
    return metrics.degree_centrality(tables.nodes(spark, d), tables.edges(spark, d)).withColumn("centrality", F.round("centrality", 8))


# regions are joined by orders; what the first node doesn't reach stands alone, or the counts would differ
_COMPONENTS = f"""{_BOTH}, top AS (SELECT min(src) AS id FROM te), reach AS (SELECT id FROM top UNION SELECT b FROM reach JOIN both_ways ON a = id),
 least AS (SELECT min(id) AS id FROM reach), comp AS (SELECT tn.id, CASE WHEN tn.id IN (SELECT id FROM reach) THEN (SELECT id FROM least) ELSE tn.id END AS component FROM tn)"""


@query("components", f"{_WHOLE}, {_COMPONENTS} SELECT id, component FROM comp")
def components(spark, d):
    return metrics.components(tables.nodes(spark, d), tables.edges(spark, d))


# without orders every region is a tree of its own
_REGIONS = """home AS (SELECT 'N:' || n_nationkey AS hn, 'R:' || n_regionkey AS hr FROM nation),
  comp AS (SELECT id, min(id) OVER (PARTITION BY hr) AS component FROM (SELECT id, hr FROM tn JOIN home ON hn = id UNION ALL SELECT id, id FROM tn WHERE type = 'Region'
    UNION ALL SELECT tn.id, hr FROM tn JOIN te ON te.src = tn.id AND te.type = 'LOCATED_IN' JOIN home ON hn = te.dst))"""


@query("components_regions", f"{_PLACE}, {_REGIONS} SELECT id, component FROM comp")
def components_regions(spark, d):
    return metrics.components(tables.trade_nodes(spark, d), tables.trade_edges(spark, d))


@query(
    "clusters_regions",
    f"""{_PLACE}, {_REGIONS}, r AS (SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY ord) AS nth FROM comp JOIN tn USING (id))
    SELECT component, count(*) AS size, string_agg(name, ', ' ORDER BY nth) FILTER (nth <= 5) AS names FROM r GROUP BY component""",
)
def clusters_regions(spark, d):
    n = tables.trade_nodes(spark, d)
    return metrics.clusters(n, metrics.components(n, tables.trade_edges(spark, d)))


@query("components_talks", "SELECT conv_id || '/' || turn AS id, min(conv_id || '/' || turn) OVER (PARTITION BY conv_id) AS component FROM conversations")
def components_talks(spark, d):
    n, e = tables.turns(spark, d)
    return metrics.components(n, graph.known_edges(e, n))


@query(
    "clusters",
    f"""{_WHOLE}, {_COMPONENTS}, r AS (SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY ord) AS nth FROM comp JOIN tn USING (id))
    SELECT component, count(*) AS size, string_agg(name, ', ' ORDER BY nth) FILTER (nth <= 5) AS names FROM r GROUP BY component""",
)
def clusters(spark, d):
    n = tables.nodes(spark, d)
    return metrics.clusters(n, metrics.components(n, tables.edges(spark, d)))


@query(
    "density_report",
    f"""{_WHOLE}, {_COMPONENTS}, {_DEGREE.format(n='tn', e='te')} SELECT count(*) AS nodes, (SELECT count(*) FROM te) AS edges, round((SELECT count(*) FROM te) / (count(*) * (count(*) - 1))::DOUBLE, 6) AS density,
    count(*) FILTER (degree = 0) AS isolated, round(avg(degree), 4) AS mean_degree, max(degree) AS max_degree,
    (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1) AS top_node, (SELECT count(DISTINCT component) FROM comp) AS components FROM deg""",
)
def density_report(spark, d):
    return metrics.structure(tables.nodes(spark, d), tables.edges(spark, d))


def _rank_sql(k: int, n: str = "tn", e: str = "te") -> str:
    """``p0`` to ``pk``: ranks after each round."""
    steps = []
    for i in range(1, k + 1):
        p = f"p{i - 1}"
        steps.append(
            f"""p{i} AS MATERIALIZED (SELECT n.id, (1 - 0.85::DOUBLE) / (SELECT c FROM cnt) + 0.85::DOUBLE * (SELECT sum(rank) FROM {p} WHERE id NOT IN (SELECT src FROM fan)) / (SELECT c FROM cnt)
            + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM {n} n LEFT JOIN (SELECT l.dst AS id, sum({p}.rank / fan.fan) AS given FROM l JOIN {p} ON {p}.id = l.src JOIN fan ON fan.src = l.src GROUP BY l.dst) g ON g.id = n.id)"""
        )
    return (
        f"cnt AS (SELECT count(*)::DOUBLE AS c FROM {n}), l AS (SELECT DISTINCT src, dst FROM {e}), fan AS (SELECT src, count(*) AS fan FROM l GROUP BY src), "
        f"p0 AS (SELECT id, 1.0::DOUBLE / (SELECT c FROM cnt) AS rank FROM {n}), {', '.join(steps)}"
    )


@query("pagerank_k", f"{_WHOLE}, {_rank_sql(5)} SELECT id, round(rank, 9) AS rank FROM p5")
def pagerank_k(spark, d):
    return metrics.pagerank(tables.nodes(spark, d), tables.edges(spark, d), 5, None).withColumn("rank", F.round("rank", 9))


def _settled_sql(k: int) -> str:
    """The ranks of the first round that moves less than a millionth a node; ``k`` rounds are enough."""
    moves = " UNION ALL ".join(f"SELECT {i} AS step, sum(abs(b.rank - a.rank)) AS moved FROM p{i} b JOIN p{i - 1} a USING (id)" for i in range(1, k + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS step, id, rank FROM p{i}" for i in range(1, k + 1))
    return f"{_WHOLE}, {_rank_sql(k)}, stop AS (SELECT min(step) AS step FROM ({moves}) WHERE moved < 1e-6 * (SELECT c FROM cnt)) SELECT id, round(rank, 9) AS rank FROM ({every}) JOIN stop USING (step)"


@query("pagerank", _settled_sql(45))
def pagerank(spark, d):
    return metrics.pagerank(tables.nodes(spark, d), tables.edges(spark, d)).withColumn("rank", F.round("rank", 9))


# in a forest every pair of nodes of a tree has one path: a node lies between the pairs of its branches
_BETWEEN = f"""{_PLACE}, nat AS (SELECT n_nationkey AS k, n_regionkey AS r, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS s FROM nation),
  reg AS (SELECT r, sum(s + 1) AS below, sum((s + 1) * (s + 1)) AS squares FROM nat GROUP BY r), c AS (SELECT count(*)::DOUBLE AS n FROM pn),
  raw AS (SELECT 'R:' || r AS id, (below * below - squares)::DOUBLE AS b FROM reg
    UNION ALL SELECT 'N:' || k, (s * (s - 1) + 2 * s * (below - s))::DOUBLE FROM nat JOIN reg USING (r)),
  btw AS (SELECT pn.id, coalesce(b, 0) / (((SELECT n FROM c) - 1) * ((SELECT n FROM c) - 2)) AS betweenness FROM pn LEFT JOIN raw ON raw.id = pn.id)"""


@query("betweenness", f"{_BETWEEN} SELECT id, round(betweenness, 8) AS betweenness FROM btw")
def betweenness(spark, d):
    return metrics.betweenness(tables.trade_nodes(spark, d), tables.trade_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 8))


# nations in a ring and regions are the core, walked pair by pair; whoever is in a nation hangs on it
@query(
    "betweenness_rings",
    f"""{_PLACE}, l AS (SELECT src AS a, dst AS b FROM ({_RING} UNION ALL SELECT * FROM te WHERE type = 'PART_OF')), both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) WHERE a <> b),
    core AS (SELECT n.id, (SELECT count(*) FROM te WHERE dst = n.id AND type = 'LOCATED_IN')::DOUBLE AS below FROM tn n WHERE type IN ('Region', 'Nation')),
    r AS (SELECT id AS s, id, 0 AS hops FROM core UNION SELECT s, b, hops + 1 FROM r JOIN both_ways ON a = id WHERE hops < 12), d AS MATERIALIZED (SELECT s, id, min(hops) AS hops FROM r GROUP BY s, id),
    p AS (SELECT id AS s, id, 0 AS hops FROM core UNION ALL SELECT p.s, b, p.hops + 1 FROM p JOIN both_ways ON a = p.id JOIN d ON d.s = p.s AND d.id = b AND d.hops = p.hops + 1),
    g AS MATERIALIZED (SELECT p.s, p.id, any_value(p.hops) AS hops, count(*)::DOUBLE AS paths FROM p GROUP BY p.s, p.id),
    walked AS (SELECT v.id, sum((1 + cs.below) * (1 + ct.below) * sv.paths * vt.paths / st.paths) AS b FROM core v JOIN g sv ON sv.id = v.id JOIN g vt ON vt.s = v.id JOIN g st ON st.s = sv.s AND st.id = vt.id AND st.hops = sv.hops + vt.hops
      JOIN core cs ON cs.id = sv.s JOIN core ct ON ct.id = vt.id WHERE sv.s <> v.id AND vt.id <> v.id AND sv.s <> vt.id GROUP BY v.id),
    c AS (SELECT count(*)::DOUBLE AS n FROM tn)
    SELECT tn.id, round((coalesce(w.b, 0) + coalesce(below * below - below + 2 * below * ((SELECT n FROM c) - 1 - below), 0)) / (((SELECT n FROM c) - 1) * ((SELECT n FROM c) - 2)), 8) AS betweenness
    FROM tn LEFT JOIN core ON core.id = tn.id LEFT JOIN walked w ON w.id = tn.id""",
)
def betweenness_rings(spark, d):
    return metrics.betweenness(tables.trade_nodes(spark, d), _rings(spark, d)).withColumn("betweenness", F.round("betweenness", 8))


def _scaled(of: str, table: str) -> str:
    low, high = f"(SELECT min({of}) FROM {table})", f"(SELECT max({of}) FROM {table})"
    return f"({of} - {low}) / ({high} - {low})"


_IMPORTANCE = f"""{_BETWEEN}, {_rank_sql(12, "pn", "pe")}, {_DEGREE.format(n='pn', e='pe')},
  three AS (SELECT id, betweenness AS b, rank AS p, degree::DOUBLE AS d FROM btw JOIN p12 USING (id) JOIN deg USING (id)),
  imp AS (SELECT id, {_scaled('b', 'three')} AS b, {_scaled('p', 'three')} AS p, {_scaled('d', 'three')} AS d FROM three)"""


@query("importance", f"{_IMPORTANCE} SELECT id, round(b, 4) AS betweenness, round(p, 4) AS pagerank, round(d, 4) AS degree, round(0.40::DOUBLE * b + 0.35::DOUBLE * p + 0.25::DOUBLE * d, 4) AS importance FROM imp")
def importance(spark, d):
    return metrics.importance(tables.trade_nodes(spark, d), tables.trade_edges(spark, d), 12, None)


@query(
    "minmax_degree",
    f"""{_WHOLE}, {_DEGREE.format(n='tn', e='te')} SELECT id, round((degree - (SELECT min(degree) FROM deg)) / ((SELECT max(degree) FROM deg) - (SELECT min(degree) FROM deg))::DOUBLE, 6) AS degree FROM deg""",
)
def minmax_degree(spark, d):
    return metrics.min_max(metrics.degrees(tables.nodes(spark, d), tables.edges(spark, d)), "degree").withColumn("degree", F.round("degree", 6))


@query(
    "edge_weights",
    f"""{_WHOLE}, {_DEGREE.format(n='tn', e='te')} SELECT src, dst, type, (a.degree + b.degree) / 2.0::DOUBLE AS weight FROM te JOIN deg a ON a.id = src JOIN deg b ON b.id = dst""",
)
def edge_weights(spark, d):
    e = tables.edges(spark, d)
    scores = metrics.degrees(tables.nodes(spark, d), e).withColumnRenamed("degree", "importance")
    return metrics.edge_weights(e, scores)


@query(
    "graph_view",
    f"""{_IMPORTANCE} SELECT id, type, name, deg.degree, round(0.40::DOUBLE * b + 0.35::DOUBLE * p + 0.25::DOUBLE * d, 4) AS importance, round(b, 4) AS betweenness, round(p, 4) AS pagerank
    FROM pn JOIN imp USING (id) JOIN deg USING (id)""",
)
def graph_view(spark, d):
    n, e = tables.trade_nodes(spark, d), tables.trade_edges(spark, d)
    scores = metrics.importance(n, e, 12, None).select("id", "importance", "betweenness", "pagerank")
    return n.join(metrics.degrees(n, e), "id").join(scores, "id").select("id", "type", "name", "degree", "importance", "betweenness", "pagerank")


# --- reports -----------------------------------------------------------------------


@query(
    "eval_rollup",
    """WITH j AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, 3 * quality + doc_id % 4 AS total FROM labels)
    SELECT difficulty, count(*) AS n, count(*) FILTER (total >= 4) AS passed, round(avg(total), 4) AS mean_score, round(100.0::DOUBLE * count(*) FILTER (total >= 4) / count(*), 1) AS pass_rate FROM j GROUP BY ROLLUP (difficulty)""",
)
def eval_rollup(spark, d):
    c = F.col("doc_id") % 3
    j = tables.table(spark, d, "labels").select(F.when(c == 0, "easy").when(c == 1, "medium").otherwise("hard").alias("difficulty"), (3 * F.col("quality") + F.col("doc_id") % 4).alias("total"))
    return reports.evaluation(j)


@query(
    "usage_rollup",
    """SELECT role AS stage, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, count(*) AS calls FROM conversations GROUP BY ROLLUP (role)""",
)
def usage_rollup(spark, d):
    t = tables.table(spark, d, "conversations")
    return reports.usage(t.select(F.col("role").alias("stage"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")))


@query(
    "jaccard_pairs",
    """WITH t AS (SELECT DISTINCT lang AS e, n_chars // 50 AS t FROM documents), s AS (SELECT e, list(t) AS l FROM t GROUP BY e)
    SELECT a.e AS a, b.e AS b, round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))::DOUBLE, 3) AS jaccard FROM s a JOIN s b ON a.e < b.e""",
)
def jaccard_pairs(spark, d):
    t = tables.table(spark, d, "documents").select(F.col("lang").alias("experiment"), F.floor(F.col("n_chars") / 50).alias("type"))
    return reports.type_jaccard(t)


@query(
    "coverage_pct",
    """WITH r AS (SELECT DISTINCT source AS type FROM documents WHERE lang = 'en')
    SELECT lang AS experiment, count(DISTINCT source) FILTER (source IN (SELECT type FROM r)) AS matched, round(100.0::DOUBLE * count(DISTINCT source) FILTER (source IN (SELECT type FROM r)) / (SELECT count(*) FROM r), 1) AS coverage_pct
    FROM documents GROUP BY lang""",
)
def coverage_pct(spark, d):
    t = tables.table(spark, d, "documents").select(F.col("lang").alias("experiment"), F.col("source").alias("type"))
    return reports.schema_coverage(t, t.filter("experiment = 'en'"))


@query(
    "experiment_stats",
    f"""{_MENTION_EDGES}, n AS (SELECT type AS experiment, count(*) AS nodes FROM m GROUP BY type), e AS (SELECT lower(type) AS experiment, count(*) AS edges FROM me GROUP BY type)
    SELECT experiment, nodes, 2.0::DOUBLE AS mean_properties, edges, round(edges / (nodes * (nodes - 1))::DOUBLE, 4) AS density FROM n JOIN e USING (experiment)""",
)
def experiment_stats(spark, d):
    n = tables.mentions(spark, d).select(F.col("type").alias("experiment"), "attrs")
    e = tables.mention_edges(spark, d).select(F.lower("type").alias("experiment"))
    return reports.experiment_stats(n, e).select("experiment", "nodes", "mean_properties", "edges", "density")


_STEPSQL = "s AS (SELECT conv_id AS scenario, turn AS step, list_distinct(string_split(lower(text), ' ')) AS items FROM conversations)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "conversations").select(F.col("conv_id").alias("scenario"), F.col("turn").alias("step"), F.array_distinct(F.split(F.lower("text"), " ")).alias("items"))


@query(
    "progressive_reveal",
    f"""WITH {_STEPSQL} SELECT a.scenario, a.step, (SELECT count(DISTINCT i) FROM (SELECT unnest(b.items) AS i FROM s b WHERE b.scenario = a.scenario AND b.step <= a.step)) AS revealed,
    (SELECT string_agg(i, ' ' ORDER BY i) FROM (SELECT unnest(a.items) AS i) WHERE i NOT IN (SELECT unnest(b.items) FROM s b WHERE b.scenario = a.scenario AND b.step < a.step)) AS fresh FROM s a""",
)
def progressive_reveal(spark, d):
    r = reports.reveal(_steps(spark, d))
    fresh = F.when(F.size("fresh") > 0, F.array_join("fresh", " "))
    return r.select("scenario", "step", "revealed", fresh.alias("fresh"))


@query(
    "log_history",
    """SELECT conv_id AS scenario, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1)::INT AS "at", turn AS step, line
    FROM (SELECT conv_id, turn, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT conv_id, turn, string_split(text, ' ') AS p FROM conversations))""",
)
def log_history(spark, d):
    t = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("scenario"), F.col("turn").alias("step"), F.split("text", " ").alias("log"))
    return reports.history(t)


# --- text --------------------------------------------------------------------------

_SPACES = r"'[ \t\n\r\f\v]+'"


@query("normalized_text", f"SELECT item_id, trim(regexp_replace(nfc_normalize(text), {_SPACES}, ' ', 'g')) AS text FROM benchmark")
def normalized_text(spark, d):
    t = tables.table(spark, d, "benchmark")
    return txt.normalize(t, "text", "n").select("item_id", F.col("n").alias("text"))


@query("strip_markdown", "SELECT item_id, text FROM benchmark")
def strip_markdown(spark, d):
    marked = F.concat(F.lit("**"), F.regexp_replace("text", " ", " __"), F.lit("**"))
    return tables.table(spark, d, "benchmark").select("item_id", txt.strip_markdown(marked).alias("text"))


@query(
    "anchor_offsets",
    """SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS "offset", 'exact' AS kind FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
)
def anchor_offsets(spark, d):
    # texts are matched by a word of their own first, so no pair of all rows is made
    b = tables.table(spark, d, "benchmark").select("item_id", F.col("text").alias("anchor"))
    docs = tables.table(spark, d, "documents").select("doc_id", F.col("text").alias("doc"))
    own = F.split("anchor", "[ \\n]")
    key = F.array_max(F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(1))), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("doc", "[ \\n]"))).alias("w"))
    near = b.withColumn("w", key).join(words, "w").select("item_id", "anchor", "doc_id").join(docs, "doc_id")
    found = txt.locate(near, "anchor", "doc", fuzzy=False).filter("kind = 'exact'")
    return found.select("item_id", "doc_id", F.col("offset").cast("long").alias("offset"), "kind")


@query(
    "fixed_chunks",
    """SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(i * 800 AS INT) AS start, substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS chunk
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""",
)
def fixed_chunks(spark, d):
    return txt.fixed_chunks(tables.table(spark, d, "documents").select("doc_id", "text"), "text", 1000, 200)


@query(
    "split_sections",
    """WITH x AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(1)), chr(10) || chr(1)) AS p FROM documents)
    SELECT doc_id, CAST(i AS INT) AS chunk_index, chunk FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line, trim(unnest(p), ' ') AS chunk FROM x) WHERE chunk <> ''""",
)
def split_sections(spark, d):
    t = tables.table(spark, d, "documents").select("doc_id", F.concat(F.lit("## "), F.regexp_replace("text", "\\n", "\n## ")).alias("text"))
    out = txt.split_sections(t, "text")
    return out.select("doc_id", "chunk_index", F.trim(F.regexp_replace("chunk", "^##\\s*", "")).alias("chunk")).filter("chunk != ''")


@query(
    "section_numbers",
    """WITH x AS (SELECT doc_id, 'SEC-0' || (1 + doc_id % 9) || CASE WHEN doc_id % 3 > 0 THEN chr(CAST(97 + doc_id % 5 AS INT)) ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN CAST(doc_id % 4 AS VARCHAR) ELSE '' END AS section_id FROM documents)
    SELECT doc_id, section_id, (1 + doc_id % 9) || CASE WHEN doc_id % 3 > 0 THEN '.' || (1 + doc_id % 5) ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN '.' || (doc_id % 4) ELSE '' END AS section_number FROM x""",
)
def section_numbers(spark, d):
    c = F.col("doc_id")
    letter = F.when(c % 3 > 0, F.char(97 + c % 5)).otherwise("")
    sub = F.when(c % 3 == 2, (c % 4).cast("string")).otherwise("")
    rows = tables.table(spark, d, "documents").select(c, F.concat(F.lit("SEC-0"), (1 + c % 9).cast("string"), letter, sub).alias("section_id"))
    return rows.withColumn("section_number", txt.section_number(F.col("section_id")))


@query(
    "json_repair",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 4 < 3 AS parsed FROM (SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props END AS props FROM events)""",
)
def json_repair(spark, d):
    c = F.col("event_id") % 4
    broken = F.when(c == 0, F.col("props")).when(c == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(c == 2, F.concat(F.lit("\x01"), "props")).otherwise(F.concat("props", F.lit("}")))
    rows = tables.table(spark, d, "events").select("event_id", txt.repaired_json(broken).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.col("j").isNotNull().alias("parsed"))


@query("canonical_types", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2) ELSE upper(event_type) END AS canonical FROM events")
def canonical_types(spark, d):
    names = spark.createDataFrame([("Click",), ("View",)], "type string")
    rows = tables.table(spark, d, "events").select("event_id", F.upper("event_type").alias("t"))
    return txt.canonical_type(rows, "t", names).select("event_id", "canonical")


@query(
    "mojibake_census",
    """WITH c AS (SELECT unnest(regexp_extract_all(text, '[' || chr(128) || '-' || chr(255) || ']')) AS c FROM documents)
    SELECT c AS char, upper(printf('%04x', unicode(c))) AS code, count(*) AS n FROM c GROUP BY c""",
)
def mojibake_census(spark, d):
    return txt.mojibake_census(tables.table(spark, d, "documents"), "text")


@query("mojibake_fixed", "SELECT doc_id, text FROM documents")
def mojibake_fixed(spark, d):
    # read as Latin-1, then repaired
    docs = tables.table(spark, d, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("bad"))
    return txt.fix_mojibake(docs, "bad", "text").select("doc_id", "text")


@query(
    "link_graph",
    """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM x GROUP BY page_id, href""",
)
def link_graph(spark, d):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return tables.table(spark, d, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


_LASTLINE = "string_split(text, chr(10))[-1]"


@query(
    "anchoring_report",
    f"""WITH a AS (SELECT text AS doc, CASE WHEN doc_id % 3 = 0 THEN upper({_LASTLINE}) ELSE {_LASTLINE} END AS text FROM documents)
    SELECT count(*) AS total, count(*) FILTER (text <> '') AS anchored, count(*) FILTER (text <> '' AND contains(doc, text)) AS verbatim, count(*) FILTER (text <> '' AND contains(doc, text)) AS located,
    round(100.0::DOUBLE * count(*) FILTER (text <> '' AND contains(doc, text)) / count(*), 1) AS verbatim_pct FROM a""",
)
def anchoring_report(spark, d):
    # the last line of each document is its anchor; of every third it is spelled otherwise
    last = F.element_at(F.split("text", "\n"), -1)
    rows = tables.table(spark, d, "documents").select(F.col("text").alias("doc"), F.when(F.col("doc_id") % 3 == 0, F.upper(last)).otherwise(last).alias("text"))
    off = F.when(F.col("text") == "", -1).otherwise(F.position(F.col("text"), F.col("doc")) - 1)
    return reports.anchoring(rows.withColumn("offset", off))


@query(
    "section_coverage",
    """WITH s AS (SELECT doc_id, sum(length(line)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE ends_with(line, '.') GROUP BY doc_id)
    SELECT doc_id, round(coalesce(chars, 0) / greatest(length(text), 1)::DOUBLE, 4) AS coverage, coalesce(chars, 0) / greatest(length(text), 1)::DOUBLE < 0.85 AS warning FROM documents LEFT JOIN s USING (doc_id)""",
)
def section_coverage(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return reports.coverage(lines.filter(F.endswith("text", F.lit("."))), docs)


# --- files, prompts and views -------------------------------------------------------

_SECTIONS = """sections AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS section_id, CAST(doc_id % 7 AS VARCHAR) AS section_number, source AS header, text FROM documents)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id")
    return tables.table(spark, d, "documents").select(
        c.alias("ord"), c.cast("string").alias("section_id"), (c % 7).cast("string").alias("section_number"), F.col("source").alias("header"), "text"
    )


@query("section_by_number", f"WITH {_SECTIONS} SELECT section_number, arg_min(text, ord) AS text FROM sections GROUP BY section_number")
def section_by_number(spark, d):
    return graph.section_text(_sections(spark, d))


@query(
    "extractions_attached",
    f"""WITH {_SECTIONS}, x AS (SELECT label.doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'none' END AS section_id, CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE CAST(doc_id % 7 AS VARCHAR) END AS section_number FROM labels label),
    f AS (SELECT section_number, arg_min(text, ord) AS text FROM sections GROUP BY section_number)
    SELECT x.ord, x.section_id, x.section_number, CASE WHEN s.text IS NOT NULL THEN 'id' WHEN f.text IS NOT NULL THEN 'number' ELSE 'none' END AS attached_by, coalesce(s.text, f.text, '') AS text
    FROM x LEFT JOIN sections s ON s.section_id = x.section_id LEFT JOIN f ON f.section_number = x.section_number""",
)
def extractions_attached(spark, d):
    c = F.col("doc_id")
    raw = tables.table(spark, d, "labels").select(
        c.alias("ord"), F.when(c % 3 == 0, c.cast("string")).otherwise("none").alias("section_id"), F.when(c % 5 == 0, "n").otherwise((c % 7).cast("string")).alias("section_number")
    )
    return files.extractions(raw, _sections(spark, d))


@query(
    "serialized_extractions",
    f"""{_MENTIONS} SELECT section, count(*) AS entity_count, string_agg(id || ':' || type, ',' ORDER BY ord) AS entities FROM m GROUP BY section""",
)
def serialized_extractions(spark, d):
    return files.serialized(tables.mentions(spark, d))


@query(
    "section_counts",
    f"""{_MENTION_EDGES}, e AS (SELECT section, count(*) AS n FROM m WHERE type <> 'view' GROUP BY section), r AS (SELECT section, count(*) AS n FROM me WHERE type <> 'CLICK' GROUP BY section)
    SELECT section, coalesce(e.n, 0) AS entity_count, coalesce(r.n, 0) AS relationship_count FROM e FULL JOIN r USING (section)""",
)
def section_counts(spark, d):
    return files.section_counts(tables.mentions(spark, d).filter("type != 'view'"), tables.mention_edges(spark, d).filter("type != 'CLICK'"))


@query("grouped_relationships", f"{_GRAPH} SELECT type, count(*) OVER (PARTITION BY type) AS n, src || '->' || dst AS key FROM edges")
def grouped_relationships(spark, d):
    return graph.grouped(tables.edges(spark, d).withColumn("key", F.concat_ws("->", "src", "dst")), "key")


@query(
    "first_warnings",
    f"""{_WHOLE}, {_KINDS}, {_TURNED}, x AS (SELECT cand.*, a.kind AS s, b.kind AS t FROM cand LEFT JOIN kinds a ON a.id = src LEFT JOIN kinds b ON b.id = dst),
    w AS (SELECT ord, type, CASE WHEN type = 'ODD' THEN 'unknown relationship type ODD' ELSE concat_ws('; ', CASE WHEN NOT {_FROM.format(t='type', s='s')} THEN 'source type ' || s END, CASE WHEN NOT {_ONTO.format(t='type', d='t')} THEN 'target type ' || t END) END AS warnings
      FROM x WHERE type = 'ODD' OR NOT {_ALLOW.format(t='type', s='s', d='t')} AND NOT {_ALLOW.format(t='type', s='t', d='s')})
    SELECT ord, type, warnings, count(*) OVER () AS in_all FROM w WHERE warnings <> '' ORDER BY ord LIMIT 10""",
)
def first_warnings(spark, d):
    return validate.first_warnings(validate.validate_edges(_candidates(spark, d), tables.nodes(spark, d), _rules(spark)))


@query("unanchored_first", f"SELECT doc_id AS ord, source AS id FROM documents WHERE doc_id % 3 = 0 AND NOT contains(text, upper({_LASTLINE})) ORDER BY doc_id LIMIT 10")
def unanchored_first(spark, d):
    last = F.element_at(F.split("text", "\n"), -1)
    anchor = F.when(F.col("doc_id") % 3 == 0, F.upper(last)).otherwise(last)
    rows = tables.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("id"), (F.position(anchor, F.col("text")) - 1).alias("offset"))
    return reports.unanchored(rows)


@query("referenced_entities", f"{_WHOLE} SELECT id, type, name FROM tn WHERE id IN ('N:1', 'S:2', 'R:0')")
def referenced_entities(spark, d):
    return graph.referenced(tables.nodes(spark, d), _ids(spark, "N:1", "S:2", "R:0", "gone"))


_REGISTERED = """registered AS (SELECT source AS entity_name, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY source)"""


@query(
    "registered_relevant",
    f"""WITH {_REGISTERED}, x AS (SELECT entity_name, unnest([a, b]) AS s FROM registered) SELECT CAST(s AS VARCHAR) AS section_id, entity_name, entity_name AS brief_description FROM x""",
)
def registered_relevant(spark, d):
    docs = tables.table(spark, d, "documents")
    reg = docs.groupBy(F.col("source").alias("entity_name")).agg(F.array(F.min("doc_id").cast("string"), F.max("doc_id").cast("string")).alias("mentioned_in_sections"))
    return prompts.relevant(reg.withColumn("brief_description", F.col("entity_name")), _sections(spark, d)).select("section_id", "entity_name", "brief_description")


@query(
    "dependency_sections",
    f"""WITH {_SECTIONS}, dep AS (SELECT CAST(doc_id AS VARCHAR) AS p, CAST(doc_id + quality AS VARCHAR) AS q FROM labels), x AS (SELECT DISTINCT p, q, unnest([p, q]) AS section_id FROM dep)
    SELECT section_id, header, p AS primary_section_id, q AS dependent_section_id FROM x JOIN sections USING (section_id)""",
)
def dependency_sections(spark, d):
    dep = tables.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("primary_section_id"), (F.col("doc_id") + F.col("quality")).cast("string").alias("dependent_section_id"))
    return prompts.dependency_sections(dep, _sections(spark, d)).distinct()


@query(
    "foreign_graph_stats",
    f"""{_MENTION_EDGES} SELECT (SELECT count(DISTINCT id) FROM m) AS nodes, count(*) AS edges, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM m) AS node_types, string_agg(DISTINCT type, ',' ORDER BY type) AS edge_types FROM me""",
)
def foreign_graph_stats(spark, d):
    return reports.schema_stats(tables.mentions(spark, d), tables.mention_edges(spark, d))


@query(
    "json_types",
    """SELECT * FROM (VALUES ('ContactRole', 'escalation_severity_levels', 'array of integer'), ('ContactRole', 'escalation_condition', 'string'), ('ContactRole', 'roster_position', 'string'),
    ('Workflow', 'trigger_condition', 'string'), ('Workflow', 'step_count', 'integer (optional)'), ('Workflow', 'time_constraint', 'string')) AS t(type, attr, json_type)""",
)
def json_types(spark, d):
    return registry.json_types(registry.attribute_table(spark)).filter(F.col("type").isin("ContactRole", "Workflow"))


@query("first_text_blocks", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE text END AS text FROM conversations")
def first_text_blocks(spark, d):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    rows = tables.table(spark, d, "conversations")
    thought = block("thinking", F.lit("hm"))
    blocks = F.when(F.col("turn") % 3 == 2, F.array(thought)).otherwise(F.array(thought, block("text", F.col("text")), block("text", F.lit("late"))))
    return rows.select("conv_id", "turn", txt.first_text_block(blocks).alias("text"))


@query(
    "static_export",
    f"""{_WHOLE} SELECT 'r' || (row_number() OVER (ORDER BY ord, src, dst, type, description) - 1) AS edge_id, src, dst, type, substr(description, 1, 200) AS description FROM te""",
)
def static_export(spark, d):
    return files.export(tables.nodes(spark, d), tables.edges(spark, d))[1]


_ATTRS = "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":"' || {k} || '"'""" for k in ("region", "nation", "segment", "brand", "kind", "size", "status", "priority")) + ") || '}' AS attrs"


@query("static_export_nodes", f"{_GRAPH} SELECT id, type, name, substr(description, 1, 300) AS description, {_ATTRS} FROM nodes")
def static_export_nodes(spark, d):
    return files.export(tables.nodes(spark, d), tables.edges(spark, d))[0]


@query(
    "directions_split",
    f"""{_WHOLE} SELECT 'N:3' AS id, count(*) FILTER (src = 'N:3') AS outgoing, count(*) FILTER (dst = 'N:3') AS incoming FROM te WHERE src = 'N:3' OR dst = 'N:3'""",
)
def directions_split(spark, d):
    rows = graph.relations(tables.nodes(spark, d), tables.edges(spark, d), _ids(spark, "N:3"))
    return rows.groupBy("id").agg(F.count_if(F.col("direction") == "out").alias("outgoing"), F.count_if(F.col("direction") == "in").alias("incoming"))


@query("compact_entities", f"{_GRAPH} SELECT ord, id, type, name, substr(description, 1, 12) AS description, {_ATTRS} FROM nodes")
def compact_entities(spark, d):
    return prompts.compact(tables.nodes(spark, d), 12)


@query("latest_mentions", f"{_MENTIONS} SELECT id, max(ord) AS ord, arg_max(type, ord) AS type FROM m GROUP BY id")
def latest_mentions(spark, d):
    return files.latest_in_order(tables.mentions(spark, d), "id").select("id", "ord", "type")


def _load() -> None:
    from weftgraph import catalog_docs  # noqa: F401  registers its queries here


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
