"""Traps of the semantics, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import registry
from weftgraph.functions import text as txt
from weftgraph.operators import graph, layout, metrics, reports, resolve, traverse, validate
from weftgraph.plans import prompts, provider, segment, tools
from weftgraph.sources import files, pdf
from weftgraph.streaming import ingest

EDGES = "ord long, src string, dst string, type string, description string"
NODES = "ord long, id string, type string, name string, description string, attrs map<string,string>"


def edges(spark, *rows):
    return spark.createDataFrame([(i, s, d, t, "") for i, (s, d, t) in enumerate(rows)], EDGES)


def nodes(spark, *ids):
    return spark.createDataFrame([(i, x, "T", x.upper(), "", {}) for i, x in enumerate(ids)], NODES)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_parallel_edges_last_wins_first_place(spark):
    e = edges(spark, ("a", "b", "X"), ("b", "c", "Y"), ("a", "b", "Z"))
    got = {(r["src"], r["dst"]): (r["ord"], r["type"]) for r in graph.collapse_edges(e).collect()}
    assert got == {("a", "b"): (0, "Z"), ("b", "c"): (1, "Y")}


def test_reserved_attributes_go(spark):
    n = spark.createDataFrame([(0, "a", "T", "A", "", {"name": "x", "k": "1"})], NODES)
    assert graph.first_nodes(n).first()["attrs"] == {"k": "1"}


def test_search_is_plain_text(spark):
    n = spark.createDataFrame([(0, "a", "T", "50%_x", "", {}), (1, "b", "T", "50yx", "", {})], NODES)
    assert [r["id"] for r in graph.search(n, "50%_").collect()] == ["a"]


def members(spark, *rows):
    """id, sections and description, one mention for each section."""
    out = [(i, "T", "n", text, s, {}) for i, sections, text in rows for s in sections]
    return spark.createDataFrame([(n, *x) for n, x in enumerate(out)], "ord long, id string, type string, name string, description string, section string, attrs map<string, string>")


def remaps(spark, *pairs):
    return spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "ord long, old_id string, new_id string")


def test_remaps_one_hop_and_chains(spark):
    n, r = members(spark, ("a", "1", "x"), ("b", "2", "xx"), ("c", "3", "xxx")), remaps(spark, ("a", "b"), ("b", "c"))
    e = edges(spark, ("a", "x", "T"))
    assert resolve.remap_edges(e, resolve.resolved_remaps(n, r)).first()["src"] == "b"
    assert resolve.remap_edges(e, resolve.resolve_chains(r)).first()["src"] == "c"
    got = resolve.apply_remaps(n, r).collect()
    assert [(x["id"], x["size"], x["appears_in"]) for x in got] == [("c", 3, ["1", "2", "3"])]


def test_new_ids_that_no_entity_has(spark):
    n = members(spark, ("a", "1", "long text"), ("b", "12", "t"), ("c", "1", "z"), ("d", "1", "same"), ("e", "1", "size"))
    r = remaps(spark, ("a", "new"), ("b", "new"), ("c", "solo"), ("e", "tie"), ("d", "tie"), ("gone", "a"), ("d", "tie"))
    got = {tuple(x) for x in resolve.resolved_remaps(n, r).collect()}
    assert got == {("a", "b"), ("d", "e")}  # most sections; of equals the first remap
    assert {x["id"] for x in resolve.apply_remaps(n, r).collect()} == {"b", "c", "e"}
    e = edges(spark, ("a", "c", "T"), ("x", "d", "T"))
    assert {(x["src"], x["dst"]) for x in resolve.remap_edges(e, resolve.resolved_remaps(n, r)).collect()} == {("b", "c"), ("x", "e")}


def test_remaps_that_would_delete_entities(spark):
    n, r = members(spark, ("a", "1", "x"), ("b", "2", "y")), remaps(spark, ("a", "b"), ("b", "a"), ("nobody", "a"), ("b", "b"))
    assert resolve.resolved_remaps(n, r).count() == 0
    assert {x["problem"] for x in resolve.checked_remaps(r, n).collect()} == {"cycle", "unknown old id", "onto itself"}


def test_importance_is_scaled(spark):
    n = spark.createDataFrame([(i, x, "T", x, "", {}) for i, x in enumerate("abcde")], NODES)
    e = edges(spark, *((x, y, "T") for x, y in zip("abcd", "bcde")))
    got = {r["id"]: r for r in metrics.importance(n, e).collect()}
    for k in ("betweenness", "pagerank", "degree"):
        assert {0.0, 1.0} <= {r[k] for r in got.values()} <= {x for x in (r[k] for r in got.values()) if 0 <= x <= 1}
    assert got["a"]["degree"] == 0 and got["c"]["betweenness"] == 1
    for r in got.values():
        assert abs(r["importance"] - (0.4 * r["betweenness"] + 0.35 * r["pagerank"] + 0.25 * r["degree"])) < 2e-4


def test_cascade_parents_by_discovery(spark):
    e = edges(spark, ("r", "b", "T"), ("r", "a", "T"), ("a", "x", "T"), ("b", "x", "T"), ("x", "r", "T"))
    got = {r["id"]: (r["depth"], r["parent"]) for r in traverse.cascade(e, ids(spark, "r")).collect()}
    assert got == {"r": (0, None), "b": (1, "r"), "a": (1, "r"), "x": (2, "b")}


def test_workflow_branches_and_cycles(spark):
    e = edges(spark, ("a", "b", "FOLLOWED_BY"), ("a", "c", "FOLLOWED_BY"), ("b", "a", "FOLLOWED_BY"))
    got = [(r["step"], r["id"], r["branches"]) for r in traverse.workflow_chains(e, ids(spark, "a")).orderBy("step").collect()]
    assert got == [(0, "a", 1), (1, "b", 0)]


def test_deep_subtrees_hide_whole(spark):
    e = edges(spark, *((f"n{i}", f"n{i + 1}", "T") for i in range(52))).coalesce(1).cache()
    assert {r["id"] for r in traverse.hidden(e, ids(spark, "n0").coalesce(1)).collect()} == {f"n{i}" for i in range(1, 53)}


def test_long_chains_are_whole(spark):
    e = edges(spark, *((f"n{i}", f"n{i + 1}", "FOLLOWED_BY") for i in range(101))).coalesce(1).cache()
    got = [(r["step"], r["id"]) for r in traverse.workflow_chains(e, ids(spark, "n0").coalesce(1)).orderBy("step").collect()]
    assert got == [(i, f"n{i}") for i in range(102)]


def test_paths_of_a_square(spark):
    e = edges(spark, ("a", "b", "T"), ("b", "d", "T"), ("a", "c", "T"), ("d", "c", "U"))
    p = spark.createDataFrame([("a", "d"), ("a", "a")], "source string, target string")
    found = traverse.simple_paths(e, p)
    assert sorted(r["path"] for r in found.collect()) == [["a", "b", "d"], ["a", "c", "d"]]
    steps = traverse.path_steps(found, e).filter("a = 'c'").first()
    assert (steps["type"], steps["direction"]) == ("U", "backward")


def test_metrics_against_plain_python(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d"), ("d", "f")]
    e, n = edges(spark, *((s, d, "T") for s, d in rows)), nodes(spark, *"abcdefg")
    adj = {}
    for s, d in rows:
        adj.setdefault(s, set()).add(d)
        adj.setdefault(d, set()).add(s)
    want = {k: 0.0 for k in "abcdefg"}  # all shortest paths of all ordered pairs, listed

    def shortest(s, t):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            paths = [[*p, x] for p in paths for x in adj.get(p[-1], ()) if x not in p]
        return [p for p in paths if p[-1] == t]

    for s in "abcdefg":
        for t in "abcdefg":
            if s != t and (paths := shortest(s, t)):
                for p in paths:
                    for x in p[1:-1]:
                        want[x] += 1 / len(paths)
    got = {r["id"]: r["betweenness"] for r in metrics.betweenness(n, e, block_rows=30).collect()}
    for k in "abcdefg":
        assert got[k] == pytest.approx(want.get(k, 0.0) / 30)
    rank = dict.fromkeys("abcdefg", 1 / 7)
    for _ in range(100):
        sunk = sum(rank[k] for k in "fg")
        rank = {k: 0.15 / 7 + 0.85 * sunk / 7 + 0.85 * sum(rank[s] / sum(x[0] == s for x in rows) for s, d in rows if d == k) for k in rank}
    for r in metrics.pagerank(n, e).collect():
        assert r["rank"] == pytest.approx(rank[r["id"]], abs=1e-5)
    imp = metrics.importance(n, e).collect()
    assert all(0 <= r["importance"] <= 1 for r in imp)
    assert metrics.components(n, e).select("component").distinct().count() == 2


def test_constant_metric_is_half(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["x"] for r in metrics.min_max(df, "x").collect()] == [0.5, 0.5]


def test_reveal_is_monotone(spark):
    s = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["b", "a"]), (1, 2, ["c"])], "scenario int, step int, items array<string>")
    got = [(r["revealed"], r["fresh"]) for r in reports.reveal(s).orderBy("step").collect()]
    assert got == [(1, ["a"]), (2, ["b"]), (3, ["c"])]
    h = spark.createDataFrame([(1, 0, ["x", "y"]), (1, 1, ["z"])], "scenario int, step int, log array<string>")
    assert [(r["at"], r["step"], r["line"]) for r in reports.history(h).orderBy("at").collect()] == [(0, 0, "x"), (1, 0, "y"), (2, 1, "z")]


def test_registry_rules(spark):
    n = spark.createDataFrame([(0, "o", "Organization", "", "", {}), (1, "s", "Service", "", "", {})], NODES)
    e = edges(spark, ("o", "s", "PROVIDES"), ("s", "o", "PROVIDES"), ("s", "s", "PROVIDES"), ("o", "s", "NOPE"))
    v = validate.validate_edges(e, n, registry.relation_table(spark)).orderBy("ord").collect()
    assert [r["verdict"] for r in v] == ["valid", "flipped", "invalid", "invalid"]
    assert len(registry.ENTITY_TYPES) == 17 and len(registry.RELATION_TYPES) == 28


def test_text_functions(spark):
    df = spark.createDataFrame([("a **b** snake_case _i_ “q”", "é   x", "cafÃ© ok")], "m string, n string, j string")
    r = txt.fix_mojibake(txt.normalize(df.withColumn("m", txt.strip_markdown(F.col("m"))), "n", "nn"), "j", "jj").first()
    assert (r["m"], r["nn"], r["jj"]) == ('a b snake_case i "q"', "é x", "café ok")


def test_locator_tiers(spark):
    long = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark forest to rest for a while before it comes back home again at night"
    doc = "start. " + long.replace("lazy", "lasy") + " end. one  two\nthree"
    df = spark.createDataFrame([(1, "start.", doc), (2, "one two three", doc), (3, long, doc), (4, "missing", doc), (5, None, doc)], "k int, t string, d string")
    got = {r["k"]: r["kind"] for r in txt.locate(df, "t", "d").collect()}
    assert got == {1: "exact", 2: "normalized", 3: "fuzzy", 4: "none", 5: "none"}


def test_chunks_refuse_no_step(spark):
    with pytest.raises(ValueError):
        txt.fixed_chunks(spark.createDataFrame([("x",)], "t string"), "t", 10, 10)


def test_segments(spark):
    doc = "Intro text that is long enough to count as a preamble of the whole document.\n# One\n\nFirst **body** text here.\n\n## 2. Two\nSecond body, with words.\n"
    maps = [
        {"section_id": "SEC-02a", "section_name": "Two", "section_order": 2, "beginning_text": "Nowhere to be found"},
        {"section_id": "SEC-01", "section_name": "One", "section_order": 1, "beginning_text": "First body text"},
    ]
    got = segment.segment(doc, maps)
    assert [(s["section_id"], s["section_number"]) for s in got] == [("SEC-00", "0"), ("SEC-01", "1"), ("SEC-02a", "2.1")]
    assert got[1]["text"].startswith("# One") and got[2]["text"].startswith("## 2. Two")
    assert "".join(s["text"] for s in got) == doc
    assert segment.segment(doc, [{**maps[0], "section_name": "Three"}]) == [{"section_id": "SEC-02a", "error": "not found"}]
    df = spark.createDataFrame([("d", doc, maps)], "doc_id string, text string, sections array<struct<section_id:string,section_name:string,section_order:int,beginning_text:string>>")
    assert segment.segment_documents(df).count() == 3


def test_layout_markdown(spark):
    rows = []
    for page in range(3):
        rows.append(("d", page, 0, 0, "Company footer", 8.0, False, 50.0, 10.0, 100.0, 18.0, 800.0))
    body = [("1.INTRODUCTION", 18.0, False, 50.0), ("This is a body line of some length that", 10.0, False, 50.0), ("goes on here.", 10.0, False, 50.0), ("• first item", 10.0, False, 60.0), ("with more", 10.0, False, 70.0)]
    for i, (t, size, bold, x) in enumerate(body, 1):
        rows.append(("d", 0, i, 0, t, size, bold, x, 100.0 + 12 * i, x + 100, 110.0 + 12 * i, 800.0))
    rows.append(("d", 0, 9, 0, "Term:", 10.0, True, 50.0, 300.0, 80.0, 310.0, 800.0))
    rows.append(("d", 0, 9, 1, "its meaning in a longer explanation", 10.0, False, 84.0, 300.0, 280.0, 310.0, 800.0))
    rows.append(("d", 1, 1, 0, "7", 10.0, False, 300.0, 790.0, 305.0, 798.0, 800.0))
    spans = spark.createDataFrame(rows, "doc_id string, page int, line int, span int, text string, font_size double, is_bold boolean, x0 double, y0 double, x1 double, y1 double, page_height double")
    md = layout.markdown(spans).first()["markdown"]
    assert md == "# 1. INTRODUCTION\n\nThis is a body line of some length that goes on here.\n\n- first item with more\n**Term:** its meaning in a longer explanation\n"


def test_files_runs_and_versions(spark, tmp_path):
    doc = {"ontology": {"graph_title": "T", "entities": [
        {"id": "a", "type": "Service", "name": "A", "description": "d", "attributes": {"k": 1, "name": "no"}, "source_anchor": {"source_text": "x", "source_section": "1", "source_offset": 3}},
        {"id": "b", "type": "Service", "name": "B", "description": "", "k": [1, 2]}],
        "relationships": [{"source_id": "a", "target_id": "b", "type": "R", "description": "", "source_sections": []}]}}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/one.json").write_text(json.dumps(doc))
    (tmp_path / "g/bad.json").write_text("{nope")
    path = str(tmp_path / "g")
    e = files.entities(spark, path).orderBy("ord").collect()
    assert [r["attrs"] for r in e] == [{"k": "1"}, {"k": "[1,2]"}] and e[0]["source_anchor"]["source_offset"] == 3
    n, x = files.graph_rows(files.entities(spark, path), files.relationships(spark, path))
    own, built = graph.build(n, x)
    assert own.count() == 2 and built.count() == 1
    assert [tuple(r) for r in files.catalog(spark, path).collect()] == [("one", "T", 2)]
    root = str(tmp_path / "store")
    assert files.save_graph(n, x, root, "v1") == "graph-v1-1" and files.save_graph(n, x, root, "v1") == "graph-v1-2"
    assert files.load_graph(spark, root, "v1-2")[0].count() == 2
    for at in ("2024-01-01T00:00:00", "2024-01-02T00:00:00"):
        files.save_run({"run_meta": n.limit(1 if at.startswith("2024-01-01") else 2)}, str(tmp_path / "runs"), files.run_id("a b", at))
    assert files.load_run(spark, str(tmp_path / "runs"), "run_meta").count() == 2
    assert files.list_runs(spark, str(tmp_path / "runs")).first()["run_id"] == "2024-01-02T00-00-00_a_b"
    assert files.scenarios(spark, str(tmp_path / "none.json")).count() == 0


def test_provider_and_prompts(spark):
    sections = spark.createDataFrame([("s1", "H", "text " * 30), ("s2", "H2", "short")], "section_id string, header string, text string")
    known = spark.createDataFrame([("E", ["Service"], ["s1"], "brief")], "entity_name string, candidate_types array<string>, mentioned_in_sections array<string>, brief_description string")
    p = prompts.entity_prompts(sections, known, registry.type_prompt(registry.attribute_table(spark)))
    answers = {"s1": '```json\n{"entities": [{"id": "a", "type": "Service", "name": "A", "description": "d"}]}\n```'}
    said = provider.ask(p, provider.ReplayProvider(answers))
    assert {r["key"]: r["error"] is None for r in said.collect()} == {"s1": True, "s2": False}
    got = prompts.parsed_entities(said)
    assert got.filter("id = 'a'").count() == 1 and got.filter("error is not null").count() == 1
    calls = []
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise provider.RateLimited
        return "ok", 1, 1
    assert provider.with_retry(flaky, lambda s: None)[0] == "ok"


def test_agent_loop(spark):
    t = tools.GraphTools(nodes(spark, "a", "b", "c"), edges(spark, ("a", "b", "FOLLOWED_BY"), ("b", "c", "FOLLOWED_BY")))
    for name, args in (("list_entity_types", {}), ("find_entities", {"entity_type": "t"}), ("search_entities", {"keyword": "A"}), ("get_entity", {"entity_id": "a"}),
                       ("get_neighbors", {"entity_id": "a"}), ("find_paths", {"source_id": "a", "target_id": "c"}), ("get_graph_summary", {}),
                       ("traverse_workflow", {"start_entity_id": "a"})):
        assert t.call(name, **args).count() > 0
    assert t.call("find_by_attribute", attribute="k", value="v").count() == 0
    def model(question, trace):
        return {"answer": "done"} if len(trace) > 1 else {"calls": [("get_entity", {"entity_id": "a"}), ("nope", {})]}
    out = tools.run_agent("?", t, model)
    assert out["answer"] == "done" and out["referenced_entities"] == ["a"] and "unknown tool" in out["trace"][1]["result"]
    assert tools.scenario_steps(out["trace"])[0]["focus_node"] == "a"


def test_stream_into_graph(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.limit(50).union(rows.limit(50)).write.parquet(src)
    stream = ingest.events(spark, src, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    ingest.append_graph(stream, out, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 50


def test_relationships_of_a_file(spark, tmp_path):
    old = edges(spark, ("a", "b", "R"))
    for name, body in (("x", {"relationships": [{"source_id": "a", "target_id": "b", "type": "R"}, {"source_id": "b", "target_id": "a", "type": "R"}]}), ("y", [{"source_id": "b", "target_id": "a", "type": "R"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        got = files.merge_relationships(old, spark, str(tmp_path / f"{name}.json"))
        assert sorted((r["src"], r["dst"], r["added"]) for r in got.collect()) == [("a", "b", False), ("b", "a", True)]


def test_lenient_graph(spark):
    e = spark.createDataFrame([(0, "a", "Service", "A", "", {}), (1, "b", "Nope", "B", "", {})], NODES)
    r = spark.createDataFrame([("a", "a", "R"), ("a", "b", "R")], "source_id string, target_id string, type string")
    s = spark.createDataFrame([("1",)], "section_id string")
    kept, rel, sections = files.lenient_graph(e, r, s, registry.attribute_table(spark))
    assert ([x["id"] for x in kept.collect()], rel.count(), sections.count()) == (["a"], 1, 0)
    assert files.lenient_graph(e.filter("id = 'a'"), r, s, registry.attribute_table(spark))[2].count() == 1


def test_runs_by_type_and_latest(spark, tmp_path):
    root = str(tmp_path)
    n = nodes(spark, "a", "b")
    files.save_run({"entities": n, "run_meta": n.limit(1)}, root, "r1")
    files.save_run({"entities": n.limit(1), "run_meta": n.limit(1)}, root, "r0")
    assert files.latest_run(spark, root) == "r0" and files.load_run(spark, root, "entities").count() == 1
    assert (tmp_path / "entities/run_id=r1/type=T").is_dir()


def pdf_bytes(*pages):
    """A small file: each page a list of (font, size, x, y, text)."""
    import zlib

    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    out = ["1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", f"2 0 obj <</Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 600 800] /Resources <</Font <</F1 3 0 R /F2 4 0 R>>>>>> endobj",
           "3 0 obj <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>> endobj", "4 0 obj <</Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold>> endobj"]
    data = "%PDF-1.4\n".encode() + "\n".join(out).encode()
    for i, page in enumerate(pages):
        body = zlib.compress(b"BT " + b" ".join(f"/{f} {s} Tf 1 0 0 1 {x} {y} Tm ({t}) Tj".encode("cp1252") for f, s, x, y, t in page) + b" ET")
        data += f"\n{10 + 2 * i} 0 obj <</Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R>> endobj\n{11 + 2 * i} 0 obj <</Length {len(body)} /Filter /FlateDecode>> stream\n".encode() + body + b"\nendstream endobj"
    return data + b"\ntrailer <</Root 1 0 R>>\n%%EOF"


def test_pdf_to_markdown(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(pdf_bytes([("F2", 20, 50, 750, "Title \\(one\\)"), ("F1", 10, 50, 700, "Some body text of the page that is long, café."), ("F1", 10, 50, 688, "It goes on.")], [("F1", 10, 50, 700, "Second page.")]))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    spans = pdf.spans(files.binaries(spark, str(tmp_path)))
    bad = spans.filter("error is not null").collect()
    assert [(r["doc_id"], r["error"]) for r in bad] == [("bad", "ValueError: not a PDF file")]
    assert pdf.plain_text(spans).first()["text"].startswith("Title (one)\nSome body text")
    md = layout.markdown(spans.filter("error is null"))
    assert md.first()["markdown"].startswith("# Title (one)\n\nSome body text of the page that is long, café. It goes on.")
    files.write_markdown(md, str(tmp_path / "out"))
    assert layout.markdown_stats(md.withColumn("markdown", F.concat(F.lit("\n"), "markdown"))).first()["headings"] == 1
    assert (tmp_path / "out/doc_id=one").is_dir()


def test_beginning_is_where_all_first_words_are():
    head = " ".join(["ofonntestion"] * 8 + ["atblend", "atblend"])
    doc = "Start " + "ofonntestion " * 13 + "atblend atblend and so on"
    at = doc.index(head)
    for begin in (head + " but otherwise", "**" + head.replace(" ", "  ") + "**"):
        assert doc.index(head[:100]) < at
        assert segment.find_begin(segment.Indexed(doc), begin, 0) == at - 1
    # where the first words are nowhere, the first characters decide
    assert segment.find_begin(segment.Indexed(doc), "ofonntestion " * 8 + "other words", 0) == 5


def test_markdown_stats_count_a_first_line(spark):
    texts = ["- a\n- b\n\n### c\n", "## 1. A\n\n- b\n", "# title\n\n## b\n", "### a\n"]
    got = layout.markdown_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, markdown string")).collect()
    assert [(r["headings"], r["items"]) for r in sorted(got)] == [(1, 2), (1, 1), (1, 0), (1, 0)]
