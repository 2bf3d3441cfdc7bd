"""Graphs asked of a model without the pipeline: with or without the schema, whole or in chunks.

Each document is one prompt or one for each part under a heading. A guided prompt that fails is
asked again without the schema, and the part says so.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import registry
from weftgraph.functions.text import split_sections
from weftgraph.operators import reports, resolve
from weftgraph.plans import ontology, provider
from weftgraph.session import materialize
from weftgraph.sources import files

#: Names of the two by two ways to ask.
WAYS = tuple((f"{size}_{schema}", size == "chunked", schema == "guided") for size in ("whole", "chunked") for schema in ("free", "guided"))


@dataclass
class Experiment:
    """Nodes and edges as answered, what failed, and one row of figures."""

    name: str
    nodes: DataFrame
    edges: DataFrame
    problems: DataFrame
    stats: DataFrame


def parts(documents: DataFrame, chunked: bool) -> DataFrame:
    """``doc_id``, ``key`` (the part's number), ``text``."""
    if not chunked:
        return documents.select("doc_id", F.lit("0").alias("key"), "text")
    rows = split_sections(documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("chunk_index").cast("string").alias("key"), F.col("chunk").alias("text"))


def prompts_of(rows: DataFrame, schema: DataFrame | None) -> DataFrame:
    """``key``, ``prompt``. ``schema``: one row ``types``, or None."""
    ask = F.lit('List entities and relationships as JSON: {"entities": [...], "relationships": [...]}.')
    key = F.concat_ws("#", "doc_id", "key").alias("key")
    if schema is None:
        return rows.select(key, F.concat_ws("\n\n", ask, "text").alias("prompt"))
    return rows.join(F.broadcast(schema.limit(1))).select(key, F.concat_ws("\n\n", ask, F.concat(F.lit("Only these types: "), "types"), "text").alias("prompt"))


def run(documents: DataFrame, model: provider.Provider, name: str) -> Experiment:
    """One of ``WAYS``. ``documents``: doc_id, text."""
    _, chunked, guided = next(w for w in WAYS if w[0] == name)
    began = time.time()
    spark = documents.sparkSession
    rows = parts(documents, chunked)
    schema = registry.type_names(registry.attribute_table(spark)) if guided else None
    asked = materialize(provider.ask(prompts_of(rows, schema), model), "answers").withColumn("fallback", F.lit(False))
    if guided:
        failed = prompts_of(rows, None).join(asked.filter("error is not null").select("key"), "key", "left_semi")
        again = materialize(provider.ask(failed, model), "answers").withColumn("fallback", F.lit(True))
        asked = asked.filter("error is null").unionByName(again)
    cut = F.split("key", "#")
    said = asked.select(F.element_at(cut, 1).alias("doc_id"), F.element_at(cut, 2).alias("key"), "response", "error", "fallback")
    found = ontology.read_entities(said)
    nodes = materialize(resolve.foreign_dedup(found.select("ord", "id", "type", "name", "attrs")).select("ord", "id", "type", "name", "attrs"), "experiment")
    edges = materialize(resolve.dedup_edges(ontology.read_relations(said)), "experiment")
    label = F.lit(name).alias("experiment")
    stats = reports.experiment_stats(nodes.select(label, "attrs"), edges.select(label)).withColumn("seconds", F.lit(round(time.time() - began, 2)))
    return Experiment(name, nodes, edges, said.filter("error is not null or fallback").select("doc_id", "key", "error", "fallback"), stats)


def save(done: Experiment, root: str) -> None:
    """The graph and its figures as JSON below ``root/name``."""
    for part in ("nodes", "edges", "problems", "stats"):
        files.write_json(getattr(done, part), f"{root}/{done.name}/{part}")
