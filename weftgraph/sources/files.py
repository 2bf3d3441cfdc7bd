"""Files: documents, ontologies, chunk lists, extractions, scenarios, runs and graph versions.

All go through Spark's readers and writers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANCHOR = "struct<source_text: string, source_section: string, source_offset: int>"
ENTITY = (
    f"id string, type string, name string, description string, source_anchor {ANCHOR}, source_anchors array<{ANCHOR}>, "
    "appears_in array<string>"
)
RELATION = "source_id string, target_id string, type string, description string, source_sections array<string>"
SECTION = (
    "section_id string, chunk_id string, header string, section_number string, text string, char_count int, source_offset int, "
    "section_purpose string, section_summary string"
)
SCENARIOS = (
    "scenarios array<struct<id: string, name: string, steps: array<struct<title: string, description: string, "
    "highlight_nodes: array<string>, highlight_edges: array<string>, focus_node: string, log: array<struct<type: string, text: string>>>>>>"
)
FIRST_PASS = (
    "document_map struct<document_title: string, sections: array<struct<section_id: string, section_name: string, section_order: int, "
    "section_purpose: string, section_summary: string, beginning_text: string>>>, "
    "global_entity_pre_registration array<struct<entity_name: string, candidate_types: array<string>, mentioned_in_sections: array<string>, "
    "brief_description: string>>, cross_section_dependencies array<struct<primary_section_id: string, dependent_section_id: string, "
    "dependency_type: string, dependency_description: string>>"
)
#: Columns of an entity of its own; all other fields are attributes.
_BASE = ("id", "type", "name", "description", "source_anchor", "source_anchors", "appears_in", "attributes")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``text``: each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def first_pass(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIRST_PASS).json(path, multiLine=True)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a chunk file; an older ``chunk_id`` stands in for ``section_id``."""
    rows = spark.read.schema(SECTION).json(path, multiLine=True)
    text = F.coalesce("text", F.lit(""))
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        F.coalesce("section_id", "chunk_id", F.lit("")).alias("section_id"), none("header"), none("section_number"), text.alias("text"),
        F.length(text).alias("char_count"), F.coalesce("source_offset", F.lit(-1)).alias("source_offset"), none("section_purpose"), none("section_summary"),
    )


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Each JSON file as one string, without the wrapper ``{"ontology": ...}``; broken files go."""
    rows = texts(spark, path).select(F.col("path"), F.try_parse_json("text").alias("v")).filter("v is not null")
    return rows.withColumn("v", F.coalesce(F.expr("try_variant_get(v, '$.ontology', 'variant')"), F.col("v")))


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of ontology files in file order, attributes as JSON texts.

    Attributes of a nested object ``attributes`` count unless the entity has the field itself.
    """
    rows = _raw(spark, path).select("path", F.posexplode(F.expr("try_variant_get(v, '$.entities', 'array<variant>')")).alias("ord", "e"))
    rows = rows.withColumn("j", F.to_json("e")).withColumn("fields", F.expr("try_variant_get(e, '$', 'map<string, variant>')"))
    flat = F.transform_values("fields", lambda _, v: F.to_json(v))
    nested = F.transform_values(F.expr("try_variant_get(e, '$.attributes', 'map<string, variant>')"), lambda _, v: F.to_json(v))
    own = F.map_filter(flat, lambda k, _: ~k.isin(*_BASE))
    more = F.map_filter(F.coalesce(nested, F.expr("cast(map() as map<string, string>)")), lambda k, _: ~F.map_contains_key(flat, k))
    base = F.from_json("j", ENTITY)
    return rows.withColumns({"base": base, "attrs": F.map_concat(own, more)}).select("path", "ord", "base.*", "attrs")


def relationships(spark: SparkSession, path: str) -> DataFrame:
    """Relationships of ontology files in file order."""
    rows = _raw(spark, path).select("path", F.to_json("v").alias("j"))
    parsed = F.from_json("j", f"relationships array<struct<{RELATION.replace(' string', ': string').replace(' array', ': array')}>>")
    return rows.select("path", F.posexplode(parsed["relationships"]).alias("ord", "r")).select("path", "ord", "r.*")


def graph_rows(found: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File rows as the nodes and edges that the graph operators take."""
    text = F.coalesce("source_anchor.source_text", F.lit(""))
    own = F.create_map(F.lit("source_text"), text, F.lit("source_section"), F.coalesce("source_anchor.source_section", F.lit("")), F.lit("source_offset"), F.coalesce("source_anchor.source_offset", F.lit(-1)).cast("string"))
    attrs = F.transform_values("attrs", lambda _, v: F.regexp_replace(v, '^"|"$', ""))
    n = found.select("ord", "id", "type", "name", "description", F.map_concat(attrs, own).alias("attrs"))
    e = relations.select("ord", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type", "description")
    return n, e


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Steps of a scenario file, one row each; none where there is no file or it isn't JSON."""
    rows = spark.read.schema(SCENARIOS).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], SCENARIOS)
    s = rows.select(F.explode("scenarios").alias("s")).select(F.col("s.id").alias("scenario"), F.col("s.name").alias("name"), F.posexplode("s.steps").alias("step", "t"))
    return s.select("scenario", "name", "step", "t.*")


def scripted(steps: DataFrame, numbered_edges: DataFrame) -> DataFrame:
    """Steps that name edges by number, with the edges' own keys: ``scenario``, ``step``, ``edge_id``, ``key``.

    ``steps``: scenario, step, edge_ids (array). Numbers hold for one order of edges; those that have none are dropped.
    """
    named = steps.select("scenario", "step", F.explode("edge_ids").alias("edge_id"))
    return named.join(numbered_edges.select("edge_id", F.concat_ws("->", "src", "dst").alias("key")), "edge_id").select("scenario", "step", "edge_id", "key")


def extractions(raw: DataFrame, sections: DataFrame) -> DataFrame:
    """Attach sections to extractions: by id, else by the first of their number, else empty.

    ``raw``: ord, section_id, section_number. ``sections``: ord, section_id, section_number, text.
    """
    by_id = sections.select("section_id", F.col("text").alias("id_text"))
    first = sections.groupBy("section_number").agg(F.min_by("text", "ord").alias("number_text"), F.min_by("section_id", "ord").alias("number_id"))
    out = raw.join(by_id, "section_id", "left").join(first, "section_number", "left")
    how = F.when(F.col("id_text").isNotNull(), "id").when(F.col("number_text").isNotNull(), "number").otherwise("none")
    return out.select("ord", "section_id", "section_number", how.alias("attached_by"), F.coalesce("id_text", "number_text", F.lit("")).alias("text"))


def serialized(entities: DataFrame) -> DataFrame:
    """Entities of each section in input order as one text, with their number."""
    rows = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "id", "type").alias("e"))))
    return entities.groupBy("section").agg(
        F.count("*").alias("entity_count"), F.array_join(F.transform(rows, lambda x: x["e"]), ",").alias("entities")
    )


def section_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and relationships of each section, also where there are none of one kind."""
    parts = [df.select("section", F.lit(n).alias("e"), F.lit(1 - n).alias("r")) for df, n in ((entities, 1), (edges, 0))]
    return parts[0].unionByName(parts[1]).groupBy("section").agg(F.sum("e").cast("long").alias("entity_count"), F.sum("r").cast("long").alias("relationship_count"))


# --- runs and versions ------------------------------------------------------------


def run_id(name: str, at: str) -> str:
    """``YYYY-MM-DDTHH-MM-SS_name`` with odd characters as underscores."""
    import re

    return at.replace(":", "-") + "_" + re.sub(r"[^\w\-.]", "_", name)


#: Tables of a run that are also split by type.
BY_TYPE = ("entities", "relationships")


def save_run(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Write each table of a run as Parquet below ``root/table/run_id=run``; entities and relationships by type; then the pointer to the latest."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("type") if name in BY_TYPE and "type" in df.columns else out).parquet(f"{root}/{name}/run_id={run}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run,)], "run_id string").coalesce(1).write.mode("overwrite").json(f"{root}/latest")


def latest_run(spark: SparkSession, root: str) -> str | None:
    """What the pointer names; without one, None."""
    found = spark.read.schema("run_id string").json(f"{root}/latest").first() if exists(spark, f"{root}/latest") else None
    return found["run_id"] if found else None


def load_run(spark: SparkSession, root: str, table: str, run: str | None = None) -> DataFrame:
    """A table of one run, by default the latest; only its partition is read."""
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    if run is None:
        run = latest_run(spark, root) or rows.agg(F.max("run_id")).first()[0]
    return rows.filter(F.col("run_id") == run)


def list_runs(spark: SparkSession, root: str, table: str = "run_meta") -> DataFrame:
    """Runs from the last on; a run whose table can't be read is left out."""
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{root}/{table}")
    return rows.select("run_id").distinct().orderBy(F.desc("run_id"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row, other alphabets as they are, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_markdown(docs: DataFrame, root: str) -> None:
    """``docs``: doc_id, markdown. Each document's text below ``root/doc_id=...``."""
    docs.select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(root)


def merge_relationships(existing: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Edges of a graph and of a file of relationships, the first of equal ones: ``src``, ``dst``, ``type``, ``ord``, ``description``, ``added``.

    The file is ``{"relationships": [...]}`` or a list alone.
    """
    fields = f"array<struct<{RELATION.replace(' string', ': string').replace(' array', ': array')}>>"
    rows = texts(spark, path).select(F.coalesce(F.from_json("text", f"relationships {fields}")["relationships"], F.from_json("text", fields)).alias("rs"))
    new = rows.select(F.posexplode("rs").alias("ord", "r")).select(F.col("ord").cast("long").alias("ord"), F.col("r.source_id").alias("src"), F.col("r.target_id").alias("dst"), "r.type", F.coalesce("r.description", F.lit("")).alias("description"))
    both = existing.select("ord", "src", "dst", "type", "description").withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))
    first = F.min_by(F.struct("ord", "description", "added"), F.struct("added", "ord"))
    return both.groupBy("src", "dst", "type").agg(first.alias("f")).select("src", "dst", "type", "f.*")


def lenient_graph(found: DataFrame, relations: DataFrame, sections: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities that pass one by one, their relationships, and sections: none if any entity was skipped.

    ``found``: ord, id, type, name, description, attrs, as ``entities`` reads them.
    """
    from weftgraph.operators.validate import validate_entities

    judged = validate_entities(found.select("ord", "id", "type", "name", "description", "attrs"), attributes)
    good = judged.filter(F.size("errors") == 0).select("ord")
    kept = found.join(good, "ord", "left_semi")
    whole = judged.agg(F.bool_and(F.size("errors") == 0).alias("whole"))
    ids = kept.select("id").distinct()
    edges = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, edges, sections.join(F.broadcast(whole.filter("whole")), F.lit(True), "left_semi")


def next_instance(spark: SparkSession, root: str, version: str) -> int:
    """One above the largest instance number of a version's graph folders."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 1
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    head = f"graph-{version}-"
    taken = [int(n[len(head) :].removesuffix(".json")) for n in names if n.startswith(head) and n[len(head) :].removesuffix(".json").isdigit()]
    return max(taken, default=0) + 1


def save_graph(nodes: DataFrame, edges: DataFrame, root: str, version: str) -> str:
    spark = nodes.sparkSession
    name = f"graph-{version}-{next_instance(spark, root, version)}"
    nodes.write.parquet(f"{root}/{name}/nodes")
    edges.write.parquet(f"{root}/{name}/edges")
    return name


def load_graph(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    name = name if name.startswith("graph-") else f"graph-{name}"
    return spark.read.parquet(f"{root}/{name}/nodes"), spark.read.parquet(f"{root}/{name}/edges")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Graph files with title (else the stem) and number of entities; sidecars and broken files left out."""
    rows = _raw(spark, path).filter(~F.endswith("path", F.lit(".scenarios.json")))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.json$", "")
    title = F.expr("try_variant_get(v, '$.graph_title', 'string')")
    size = F.expr("size(coalesce(try_variant_get(v, '$.entities', 'array<variant>'), try_variant_get(v, '$.nodes', 'array<variant>'), array()))")
    return rows.select(stem.alias("file"), F.coalesce(F.nullif(title, F.lit("")), stem).alias("title"), size.alias("entities")).orderBy("file")


def export(nodes: DataFrame, edges: DataFrame, node_chars: int = 300, edge_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows of a static view: short descriptions, attributes that hold something, numbered edges."""
    from weftgraph.operators.graph import numbered

    kept = F.map_filter("attrs", lambda _, v: ~F.coalesce(v, F.lit("")).isin("", "false", "False", "[]", "null"))
    n = nodes.select("id", "type", "name", F.substring("description", 1, node_chars).alias("description"), F.to_json(kept).alias("attrs"))
    e = numbered(edges).select("edge_id", "src", "dst", "type", F.substring("description", 1, edge_chars).alias("description"))
    return n, e


def latest_in_order(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key by ``ord``."""
    w = Window.partitionBy(key).orderBy(F.desc("ord"))
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
