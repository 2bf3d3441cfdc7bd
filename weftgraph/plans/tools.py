"""The query tools of an agent, each a DataFrame, and the loop and traces around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph, traverse
from weftgraph.operators.text_index import TextIndex

#: Most turns of a loop, most edges of a path, paths shown.
MAX_TURNS, MAX_HOPS, PATHS_SHOWN = 15, 5, 5


class UnknownTool(ValueError):
    """No tool has the name."""


@dataclass
class GraphTools:
    """Nine tools over one graph. Each returns rows; ``text`` renders them."""

    nodes: DataFrame
    edges: DataFrame
    index: TextIndex | None = None

    def _ids(self, *ids: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")

    def list_entity_types(self) -> DataFrame:
        return graph.type_counts(self.nodes)

    def find_entities(self, entity_type: str) -> DataFrame:
        return graph.find_entities(self.nodes, entity_type)

    def search_entities(self, keyword: str) -> DataFrame:
        return graph.search(self.nodes, keyword) if self.index is None else self.index.search(keyword)

    def get_entity(self, entity_id: str) -> DataFrame:
        return graph.entity_view(self.nodes, self.edges, entity_id)

    def get_neighbors(self, entity_id: str, depth: int = 1) -> DataFrame:
        return traverse.walk(self.edges, self._ids(entity_id), depth).join(self.nodes.select("id", "type", "name"), "id")

    def find_paths(self, source_id: str, target_id: str, max_hops: int = MAX_HOPS) -> DataFrame:
        pairs = self.nodes.sparkSession.createDataFrame([(source_id, target_id)], "source string, target string")
        return traverse.path_steps(traverse.simple_paths(self.edges, pairs, max_hops), self.edges, PATHS_SHOWN)

    def get_graph_summary(self) -> DataFrame:
        return graph.summary(self.nodes, self.edges)

    def traverse_workflow(self, start_entity_id: str) -> DataFrame:
        return traverse.workflow_chains(self.edges, self._ids(start_entity_id)).join(self.nodes.select("id", "type", "name"), "id")

    def find_by_attribute(self, attribute: str, value: str) -> DataFrame:
        return graph.find_by_attribute(self.nodes, attribute, value)

    TOOLS = (
        "list_entity_types", "find_entities", "search_entities", "get_entity", "get_neighbors", "find_paths", "get_graph_summary",
        "traverse_workflow", "find_by_attribute",
    )

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self.TOOLS:
            raise UnknownTool(f"unknown tool {name}")
        return getattr(self, name)(**arguments)


def text(rows: DataFrame) -> str:
    """All rows as lines, fetched a partition at a time: an answer leaves nothing out."""
    return "\n".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows.toLocalIterator()) or "nothing found"


def referenced(calls: list[tuple[str, dict]]) -> list[str]:
    """Ids among the arguments of calls, sorted."""
    keys = ("entity_id", "source_id", "target_id", "start_entity_id")
    return sorted({a[k] for _, a in calls for k in keys if k in a})


def run_agent(question: str, tools: GraphTools, model, max_turns: int = MAX_TURNS) -> dict:
    """Ask ``model`` for calls until it answers. ``model``: (question, trace) -> {"calls": [...]} or {"answer": ...}."""
    trace: list[dict] = []
    made: list[tuple[str, dict]] = []
    for _ in range(max_turns):
        said = model(question, trace)
        if "answer" in said:
            return {"answer": said["answer"], "referenced_entities": referenced(made), "trace": trace}
        for name, arguments in said["calls"]:
            made.append((name, arguments))
            try:
                out = text(tools.call(name, **arguments))
            except UnknownTool as e:
                out = str(e)
            trace.append({"tool": name, "arguments": arguments, "result": out})
    return {"answer": "", "referenced_entities": referenced(made), "trace": trace}


def highlights(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``calls``: step, tool, ids (array). Nodes and edges that each step lights up, from the data."""
    rows = calls.select("step", "tool", F.explode("ids").alias("id"))
    nodes = rows.select("step", F.lit("node").alias("kind"), F.col("id").alias("key"))
    near = rows.filter(F.col("tool").isin("get_entity", "get_neighbors"))
    touch = near.join(edges, (near.id == edges.src)).select("step", "src", "dst").union(near.join(edges, (near.id == edges.dst)).select("step", "src", "dst"))
    lit = touch.select("step", F.lit("edge").alias("kind"), F.concat_ws("->", "src", "dst").alias("key"))
    return nodes.union(lit).distinct()


#: What a step of a walkthrough is called, by tool.
TITLES = {
    "list_entity_types": "Kinds of entities", "find_entities": "All of kind {entity_type}", "search_entities": "Search for {keyword}",
    "get_entity": "A look at {entity_id}", "get_neighbors": "Around {entity_id}", "find_paths": "From {source_id} to {target_id}",
    "get_graph_summary": "The whole graph", "traverse_workflow": "What follows {start_entity_id}", "find_by_attribute": "Where {attribute} is {value}",
}


def title(tool: str, arguments: dict) -> str:
    """A step's title; a tool without one, or without its arguments, is named as it is."""
    try:
        return TITLES[tool].format(**arguments)
    except KeyError:
        return tool.replace("_", " ")


def scenario_steps(trace: list[dict]) -> list[dict]:
    """A trace as steps of a scenario: title, the ids it concerns, a log of two lines."""
    out = []
    for t in trace:
        ids = referenced([(t["tool"], t["arguments"])])
        args = ", ".join(f"{k}={v}" for k, v in t["arguments"].items())
        out.append(
            {
                "title": title(t["tool"], t["arguments"]), "description": args, "highlight_nodes": ids, "focus_node": ids[0] if ids else None,
                "log": [{"type": "call", "text": f"{t['tool']}({args})"}, {"type": "result", "text": t["result"][:120]}],
            }
        )
    return out
