"""Prompts as projections of the registry, sections and entities, in wording of our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(entities: DataFrame, chars: int = 200) -> DataFrame:
    """What a prompt says of each entity: id, type, name, the start of its description, attributes that hold something."""
    kept = F.map_filter("attrs", lambda _, v: ~F.coalesce(v, F.lit("")).isin("", "[]", "null"))
    return entities.select("ord", "id", "type", "name", F.substring("description", 1, chars).alias("description"), F.to_json(kept).alias("attrs"))


def relevant(registered: DataFrame, sections: DataFrame) -> DataFrame:
    """Pre-registered entities that are said to occur in each section."""
    rows = registered.select("entity_name", "brief_description", F.explode("mentioned_in_sections").alias("section_id"))
    return sections.select("section_id").join(rows, "section_id")


def dependency_sections(dependencies: DataFrame, sections: DataFrame) -> DataFrame:
    """Dependencies that name a section on either side."""
    ends = dependencies.select("*", F.explode(F.array_distinct(F.array("primary_section_id", "dependent_section_id"))).alias("section_id"))
    return sections.select("section_id", "header").join(ends, "section_id")


def entity_prompts(sections: DataFrame, registered: DataFrame, type_lines: DataFrame) -> DataFrame:
    """``key``, ``prompt`` of each section's entity pass."""
    types = type_lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("types"))
    known = relevant(registered, sections).groupBy("section_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "entity_name", "brief_description"))), "\n").alias("known")
    )
    rows = sections.join(known, "section_id", "left").join(F.broadcast(types))  # types: one row
    prompt = F.concat_ws(
        "\n\n", F.lit("List the entities of this section as JSON."), F.concat(F.lit("Types:\n"), "types"),
        F.when(F.col("known").isNotNull(), F.concat(F.lit("Known so far:\n"), "known")), F.concat(F.lit("Section "), "header", F.lit(":\n"), "text"),
    )
    return rows.select(F.col("section_id").alias("key"), prompt.alias("prompt"))


def relationship_prompts(sections: DataFrame, entities: DataFrame, constraints: DataFrame) -> DataFrame:
    """``key``, ``prompt`` of each section's relationship pass over its own entities."""
    rules = _rules(constraints)  # one row
    own = entities.groupBy("section_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "type", "name")))).alias("own"))
    rows = sections.join(own, "section_id").join(F.broadcast(rules))
    prompt = F.concat_ws("\n\n", F.lit("List relationships between these entities as JSON."), "rules", "own", F.col("text"))
    return rows.select(F.col("section_id").alias("key"), prompt.alias("prompt"))


def parsed_entities(responses: DataFrame) -> DataFrame:
    """Entities of the responses, one row each; a response that isn't JSON has one row with an error."""
    from weftgraph.functions.text import repaired_json

    good: Column = repaired_json(F.col("response"))
    rows = responses.select("key", good.alias("j")).select("key", F.from_json("j", "entities array<struct<id: string, type: string, name: string, description: string>>").alias("p"), "j")
    found = rows.filter("p.entities is not null").select("key", F.posexplode("p.entities").alias("ord", "e")).select("key", "ord", "e.*", F.lit(None).cast("string").alias("error"))
    bad = rows.filter("p.entities is null").select(
        "key", F.lit(0).alias("ord"), *(F.lit(None).cast("string").alias(c) for c in ("id", "type", "name", "description")), F.lit("no JSON").alias("error")
    )
    return found.unionByName(bad)


def to_ask_again(sections: DataFrame, entities: DataFrame, chars: int = 100) -> DataFrame:
    """Sections of some length in which no entity was found."""
    return sections.filter(F.length("text") > chars).join(entities.filter("id is not null"), sections.section_id == entities.key, "left_anti")


# --- whole documents ------------------------------------------------------------------


def _said(title: str, body) -> Column:
    return F.concat(F.lit(f"{title}:\n"), body)


def analysis_prompts(documents: DataFrame, types: DataFrame) -> DataFrame:
    """``key``, ``prompt``: ask for a map of each document. ``types``: one row, from ``registry.type_names``."""
    ask = "Map this document as JSON: its title, its sections in order with their first words, names that recur, and which sections depend on others."
    rows = documents.join(F.broadcast(types.limit(1)))
    return rows.select(F.col("doc_id").cast("string").alias("key"), F.concat_ws("\n\n", F.lit(ask), _said("Types", F.col("types")), _said("Document", F.col("text"))).alias("prompt"))


def _rules(constraints: DataFrame) -> DataFrame:
    return constraints.select(F.concat("type", F.lit(": "), "sources", F.lit(" -> "), "targets").alias("rule")).agg(
        F.array_join(F.array_sort(F.collect_list("rule")), "\n").alias("rules")
    )


def _entities_of(entities: DataFrame, by: str) -> DataFrame:
    """The compact entities of each document, as JSON lines in order."""
    line = F.to_json(F.struct("id", "type", "name", "description"))
    return entities.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("j")))), lambda x: x["j"]), "\n").alias("known"))


def document_prompts(documents: DataFrame, entities: DataFrame, constraints: DataFrame) -> DataFrame:
    """``key``, ``prompt``: ask for relationships over each whole document. ``entities``: doc_id, ord, id, type, name, description."""
    known = _entities_of(entities, "doc_id")
    rows = documents.join(known, "doc_id").join(F.broadcast(_rules(constraints)))
    ask = "List relationships between these entities that the document states, also across sections, as JSON."
    prompt = F.concat_ws("\n\n", F.lit(ask), _said("Allowed", F.col("rules")), _said("Entities", F.col("known")), _said("Document", F.col("text")))
    return rows.select(F.col("doc_id").cast("string").alias("key"), prompt.alias("prompt"))


def cross_section_prompts(entities: DataFrame, constraints: DataFrame) -> DataFrame:
    """``key``, ``prompt``: ask for relationships between sections. ``entities``: doc_id, section, ord, id, type, name, description.

    Both forms come here: extractions name each entity's section, a merged graph its first.
    """
    shown = entities.withColumn("description", F.concat(F.lit("["), "section", F.lit("] "), F.substring("description", 1, 200)))
    rows = _entities_of(shown, "doc_id").join(F.broadcast(_rules(constraints)))
    ask = "List relationships between entities of different sections as JSON, each with the words that show it."
    return rows.select(F.col("doc_id").cast("string").alias("key"), F.concat_ws("\n\n", F.lit(ask), _said("Allowed", F.col("rules")), _said("Entities", F.col("known"))).alias("prompt"))


def dedup_prompts(entities: DataFrame) -> DataFrame:
    """``key``, ``prompt``: ask which entities of a document are the same. ``entities``: doc_id, ord, id, type, name, description, attrs."""
    short = compact(entities).withColumn("description", F.concat_ws(" ", "description", "attrs"))
    rows = _entities_of(entities.select("doc_id", "ord", "id").join(short.drop("id"), "ord"), "doc_id")
    ask = "Some of these entities may be the same thing. List remaps as JSON: old_id, new_id and the reason."
    return rows.select(F.col("doc_id").cast("string").alias("key"), F.concat_ws("\n\n", F.lit(ask), "known").alias("prompt"))


def coverage_prompts(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """``key``, ``prompt``: ask what the entities of each document miss, invent or leave incomplete."""
    rows = documents.join(_entities_of(entities, "doc_id"), "doc_id", "left")
    ask = "Compare these entities with the document. List as JSON what is missing, what the document doesn't say, and what is incomplete."
    return rows.select(F.col("doc_id").cast("string").alias("key"), F.concat_ws("\n\n", F.lit(ask), _said("Entities", F.coalesce("known", F.lit("none"))), _said("Document", F.col("text"))).alias("prompt"))


def question_prompts(sections: DataFrame, each: int = 3) -> DataFrame:
    """``key``, ``prompt``: ask for questions and answers about each section."""
    ask = f"Write {each} questions that this section answers, with answers and a difficulty of easy, medium or hard, as JSON."
    return sections.select(F.col("section_id").alias("key"), F.concat_ws("\n\n", F.lit(ask), F.concat_ws("\n", "header", "text")).alias("prompt"))


def judge_prompts(answers: DataFrame) -> DataFrame:
    """``key``, ``prompt``: ask for a score of each answer. ``answers``: key, question, answer, given."""
    ask = "Score the given answer against the true one as JSON: accuracy 0 to 3, completeness 0 to 2, no_hallucination 0 or 1, and an explanation."
    return answers.select("key", F.concat_ws("\n\n", F.lit(ask), _said("Question", F.col("question")), _said("True answer", F.col("answer")), _said("Given answer", F.col("given"))).alias("prompt"))
