"""Whole plans: from answers to an ontology, and requests over a stored graph."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import registry
from weftgraph.plans import answers, experiments, ontology, prompts, service, tools


def test_ontology_from_answers(spark):
    e1 = {"entities": [{"id": "o", "type": "Organization", "name": "Org", "description": "an org", "source_text": "Org runs"},
                       {"id": "s", "type": "Service", "name": "S", "description": "x", "attributes": {"k": "1"}}, {"id": "bad", "type": "Nope", "name": "N", "description": ""}]}
    e2 = {"entities": [{"id": "s", "type": "Service", "name": "S", "description": "longer text", "attributes": {"k": "2"}}, {"id": "s2", "type": "Service", "name": "S2", "description": "y"}]}
    answers = spark.createDataFrame([("1", json.dumps(e1)), ("2", "```json\n" + json.dumps(e2) + "\n```"), ("3", "sorry")], "key string, response string")
    r = {"relationships": [{"source_id": "o", "target_id": "s", "type": "PROVIDES"}, {"source_id": "o", "target_id": "s2", "type": "PROVIDES"}, {"source_id": "o", "target_id": "gone", "type": "PROVIDES"}]}
    rel = spark.createDataFrame([("1", json.dumps(r))], "key string, response string")
    remaps = spark.createDataFrame([(0, "s2", "s")], "ord long, old_id string, new_id string")
    found = ontology.read_entities(answers)
    done = ontology.merge(found, ontology.read_relations(rel), remaps, registry.attribute_table(spark))
    assert done.counters.first().asDict() == {"mentions": 4, "after_exact": 3, "entities": 2, "edges_before": 3, "edges": 1}
    s = done.entities.filter("id = 's'").first()
    assert s["description"] == "longer text" and s["attrs"]["k"] == "2; 1" and s["appears_in"] == ["1", "2"]
    more = spark.createDataFrame([(1, "s", "o", "PROVIDES"), (2, "s", "o", "PROVIDES"), (3, "o", "o", "ENGAGES"), (4, "x", "o", "ENGAGES"), (5, "s", "s", "ENGAGES")], "ord long, src string, dst string, type string")
    all_, outcome = ontology.combine(done, more, registry.relation_table(spark))
    assert [r["outcome"] for r in outcome.orderBy("ord").collect()] == ["valid", "duplicate", "valid", "orphan", "invalid"]
    assert all_.count() == 2  # the turned edge equals one of the sections
    doc = spark.createDataFrame([("d", "Here Org runs things.")], "doc_id string, text string")
    assert ontology.anchored(found.filter("id = 'o'").withColumn("doc_id", F.lit("d")), doc).first()["offset"] == 5


def test_service(spark, tmp_path):
    doc = {"graph_title": "G", "entities": [{"id": x, "type": "Service", "name": x.upper(), "description": ""} for x in "abc"],
           "relationships": [{"source_id": "a", "target_id": "b", "type": "FOLLOWED_BY", "description": ""}, {"source_id": "b", "target_id": "c", "type": "FOLLOWED_BY", "description": ""}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "g.scenarios.json").write_text(json.dumps({"scenarios": [{"id": "1", "name": "n", "steps": [{"title": "t", "highlight_nodes": ["a"]}]}]}))
    s = service.GraphService(spark, str(tmp_path))
    with pytest.raises(service.NotFound):
        s.load("other")
    s.load("g")
    assert s.graph().count() == 3 and s.stats().count() == 4 and s.entity("b").count() == 2 and s.search("A").count() >= 1
    assert s.paths("a", "c").count() == 2 and s.cascade("a").count() == 3 and s.scenarios("g").count() == 1
    with pytest.raises(service.NotFound):
        s.entity("zz")
    model = lambda q, t: {"answer": "x"} if t else {"calls": [("get_entity", {"entity_id": "a"})]}
    assert s.ask("?", model)["referenced_entities"] == ["a"] and len(s.walkthrough("?", model)) == 1


def test_equal_ids_of_two_documents_stay_apart(spark):
    e = json.dumps({"entities": [{"id": "s", "type": "Service", "name": "S", "description": "x"}]})
    r = json.dumps({"relationships": [{"source_id": "s", "target_id": "s", "type": "FOLLOWED_BY"}]})
    said = spark.createDataFrame([("d1", "1", e), ("d1", "2", e), ("d2", "1", e)], "doc_id string, key string, response string")
    rel = spark.createDataFrame([("d1", "1", r), ("d2", "1", r)], "doc_id string, key string, response string")
    none = spark.createDataFrame([], "ord long, old_id string, new_id string")
    done = ontology.merge(ontology.read_entities(said), ontology.read_relations(rel), none, registry.attribute_table(spark))
    assert sorted((x["id"], x["size"]) for x in done.entities.collect()) == [("d1/s", 2), ("d2/s", 1)]
    assert sorted((x["src"], x["dst"]) for x in done.relationships.collect()) == [("d1/s", "d1/s"), ("d2/s", "d2/s")]


def test_known_offsets_stay(spark):
    rows = spark.createDataFrame([("d1", "a", "Org", 7), ("d1", "b", "Org", -1), ("d2", "c", "Org", -1)], "doc_id string, id string, source_text string, offset int")
    docs = spark.createDataFrame([("d1", "The Org"), ("d2", "Org")], "doc_id string, text string")
    assert {r["id"]: (r["offset"], r["kind"]) for r in ontology.anchored(rows, docs).collect()} == {"a": (7, "known"), "b": (4, "exact"), "c": (0, "exact")}


def test_answers_into_rows(spark):
    said = lambda *xs: spark.createDataFrame([(str(i), x) for i, x in enumerate(xs)], "key string, response string")
    m = {"sections": [{"section_id": "SEC-01", "section_name": "One", "section_order": 1, "beginning_text": "Once"}]}
    assert [r["section_name"] for r in answers.sections(said(json.dumps(m), "no")).collect()] == ["One"]
    r = answers.scores(said('{"accuracy": 9, "completeness": 1, "no_hallucination": 1}', "{}")).orderBy("key").collect()
    assert [(x["total"], x["passed"]) for x in r] == [(5, True), (0, False)]
    e = spark.createDataFrame([(0, "a", "T", "A", "long", "1", {}), (1, "b", "T", "B", "x", "2", {})], "ord long, id string, type string, name string, description string, section string, attrs map<string,string>")
    merged, held = answers.semantic_dedup(e, said('{"remappings": [{"old_id": "b", "new_id": "a", "reason": "same"}]}'))
    assert [x["id"] for x in merged.collect()] == ["a"] and held.count() == 1
    assert answers.semantic_dedup(e, said("broken"))[0].count() == 2


def test_prompts_of_whole_documents(spark):
    docs = spark.createDataFrame([("d", "The text.")], "doc_id string, text string")
    e = spark.createDataFrame([("d", "1", 0, "a", "Service", "A", "what", {"k": "v"})], "doc_id string, section string, ord long, id string, type string, name string, description string, attrs map<string,string>")
    rules = registry.constraint_rollup(registry.relation_table(spark))
    for p in (prompts.document_prompts(docs, e, rules), prompts.cross_section_prompts(e, rules), prompts.dedup_prompts(e), prompts.coverage_prompts(docs, e)):
        assert [r["key"] for r in p.collect()] == ["d"] and '"id":"a"' in p.first()["prompt"]
    shown = json.loads(registry.answer_example(registry.attribute_table(spark), registry.relation_table(spark)).first()["example"])
    assert shown["entities"][0]["type"] == "Agreement" and shown["relationships"][0]["type"] == "ACTIVATED_AT"


def test_experiments(spark, tmp_path):
    class Answers:
        """Answers by what a prompt holds; fails on guided prompts of the second part."""

        def answer(self, key, prompt):
            if "Only these types" in prompt and key.endswith("#1"):
                raise ValueError("refused")
            part = key.split("#")[1]
            said = {"entities": [{"id": f"E{part}", "type": "T", "name": "n"}, {"id": f"e{part}", "type": "T", "name": "m"}], "relationships": [{"source_id": "a", "target_id": "b", "type": "R"}]}
            return json.dumps(said), 1, 1

    docs = spark.createDataFrame([("d", "## One\nx\n## Two\ny")], "doc_id string, text string")
    free = experiments.run(docs, Answers(), "whole_free")
    assert free.nodes.count() == 1 and free.problems.count() == 0  # ids equal but for case
    guided = experiments.run(docs, Answers(), "chunked_guided")
    assert guided.nodes.count() == 2 and [(r["key"], r["fallback"]) for r in guided.problems.collect()] == [("1", True)]
    experiments.save(guided, str(tmp_path))
    assert (tmp_path / "chunked_guided/stats").is_dir()


def test_titles():
    assert tools.title("get_entity", {"entity_id": "a"}) == "A look at a" and tools.title("other_tool", {}) == "other tool" and tools.title("find_paths", {}) == "find paths"
