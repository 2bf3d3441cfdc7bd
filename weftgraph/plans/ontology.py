"""From documents to ontologies: the deterministic stages around a provider.

Stages: map the document, cut it into sections, ask for entities and then relationships
of each section, merge, ask for relationships of the whole document, combine, report.
A section whose answer fails gives nothing and is listed; a document that can't be cut
ends with its error. Many documents run at once: answers carry ``doc_id``, ids have it in front, and
sections are numbered within their document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import locate, repaired_json
from weftgraph.operators import graph, resolve, validate
from weftgraph.session import materialize

ENTITIES = "entities array<struct<id: string, type: string, name: string, description: string, source_text: string, attributes: map<string, string>>>"
#: More rows than one answer holds.
ANSWER_ROWS = 1 << 31
RELATIONS = "relationships array<struct<source_id: string, target_id: string, type: string, description: string>>"


@dataclass
class Ontology:
    """Merged entities and relationships, and the counters of the stages."""

    entities: DataFrame
    relationships: DataFrame
    counters: DataFrame


def read_entities(responses: DataFrame) -> DataFrame:
    """``doc_id``, ``section``, ``ord`` and fields of the entities in each section's answer."""
    out = _answers(responses, ENTITIES, "entities")
    empty = F.expr("cast(map() as map<string, string>)")
    return out.select(
        "doc_id", "ord", "section", _scoped("x.id").alias("id"), "x.type", "x.name", F.coalesce("x.description", F.lit("")).alias("description"),
        F.coalesce("x.source_text", F.lit("")).alias("source_text"), F.coalesce("x.attributes", empty).alias("attrs"),
    )


def read_relations(responses: DataFrame) -> DataFrame:
    """``doc_id``, ``section``, ``ord`` and fields of the relationships in each section's answer."""
    out = _answers(responses, RELATIONS, "relationships")
    return out.select(
        "doc_id", "ord", "section", _scoped("x.source_id").alias("src"), _scoped("x.target_id").alias("dst"), "x.type", F.coalesce("x.description", F.lit("")).alias("description")
    )


def _answers(responses: DataFrame, schema: str, field: str) -> DataFrame:
    """``doc_id`` (null where answers name none), ``section``, ``ord`` (by section, then place) and the item ``x``.

    ``responses``: key (the section), response, and doc_id if there are several documents.
    """
    doc = F.col("doc_id") if "doc_id" in responses.columns else F.lit(None)
    rows = responses.select(doc.cast("string").alias("doc_id"), F.col("key").alias("section"), F.from_json(repaired_json(F.col("response")), schema)[field].alias("xs"))
    # sections of one document: a few hundred
    own = rows.select(F.col("doc_id").alias("_doc"), F.col("section").alias("_section")).distinct()
    sections = own.withColumn("at", F.row_number().over(Window.partitionBy("_doc").orderBy("_section")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("section").eqNullSafe(F.col("_section"))
    numbered = rows.join(sections, same).select("doc_id", "section", "at", F.posexplode("xs").alias("place", "x"))
    return numbered.select("doc_id", "section", (F.col("at").cast("long") * ANSWER_ROWS + F.col("place")).alias("ord"), "x")


def _scoped(c: str):
    """An id of a document among several has the document in front, so equal ids of two stay apart."""
    return F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(F.concat_ws("/", "doc_id", c))


def merge(entities: DataFrame, relations: DataFrame, remaps: DataFrame, known_types: DataFrame) -> Ontology:
    """Exact merge, remaps, moved ends, first of equal edges, no orphans; counters of each step."""
    raw = materialize(entities.join(F.broadcast(known_types.select("type").distinct()), "type", "left_semi"), "entities")
    exact = materialize(resolve.exact_dedup(raw), "merged")
    again = exact.select("ord", "id", "type", "name", "description", F.explode("appears_in").alias("section"), "attrs")
    final = materialize(resolve.apply_remaps(again, remaps), "remapped")
    moved = resolve.dedup_edges(resolve.remap_edges(relations, resolve.resolved_remaps(again, remaps)))
    kept = materialize(graph.known_edges(moved, final), "relations")
    counters = (
        raw.agg(F.count("*").alias("mentions"))
        .join(exact.agg(F.count("*").alias("after_exact")))
        .join(final.agg(F.count("*").alias("entities")))
        .join(relations.agg(F.count("*").alias("edges_before")))
        .join(kept.agg(F.count("*").alias("edges")))
    )
    return Ontology(final, kept, counters)


def anchored(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``offset`` and ``kind`` of each entity's source text in its document, by ``doc_id``.

    An offset that is known already stays, with the kind ``known``.
    """
    if "offset" not in entities.columns:
        entities = entities.withColumn("offset", F.lit(-1))
    known = F.coalesce("offset", F.lit(-1)) >= 0
    old = entities.filter(known).withColumn("kind", F.lit("known"))
    new = entities.filter(~known).drop("offset").join(documents.select("doc_id", F.col("text").alias("doc")), "doc_id")
    return old.unionByName(locate(new, "source_text", "doc").drop("doc"))


def combine(ontology: Ontology, found: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All relationships once the whole document was asked, and the outcome of each new one."""
    nodes = ontology.entities.select("ord", "id", "type")
    outcome = materialize(validate.stage_filter(found, ontology.relationships, nodes, rules), "outcomes")
    good = outcome.filter("outcome = 'valid'")
    turn = F.col("verdict") == "flipped"
    new = good.select(
        F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "type", "ord"
    )
    old = ontology.relationships.select("src", "dst", "type", F.col("ord"))
    # the first of equal edges stays, those of sections before new ones
    both = old.withColumn("stage", F.lit(0)).unionByName(new.withColumn("stage", F.lit(1)))
    out = both.groupBy("src", "dst", "type").agg(F.min(F.struct("stage", "ord")).alias("m")).select("src", "dst", "type", "m.*")
    return out, outcome
