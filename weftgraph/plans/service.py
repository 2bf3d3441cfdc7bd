"""What an HTTP layer over graphs would answer, as one DataFrame for each request.

The web layer itself is outside; an unknown graph or entity is ``NotFound``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, metrics, traverse
from weftgraph.plans.tools import GraphTools, run_agent, scenario_steps
from weftgraph.sources import files


class NotFound(LookupError):
    """No such graph or entity."""


@dataclass
class GraphService:
    """Requests over the graph that is active; ``load`` changes it at once."""

    spark: SparkSession
    root: str
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    scores: DataFrame | None = field(default=None, repr=False)

    def graphs(self) -> DataFrame:
        return files.catalog(self.spark, self.root)

    def load(self, name: str) -> None:
        if "/" in name or name.startswith(".") or self.graphs().filter(F.col("file") == name).limit(1).count() == 0:
            raise NotFound(name)
        path = f"{self.root}/{name}.json"
        n, e = files.graph_rows(files.entities(self.spark, path), files.relationships(self.spark, path))
        nodes, edges = graph.build(n, e)
        self.nodes, self.edges, self.scores = nodes, edges, metrics.importance(nodes, edges)

    def graph(self) -> DataFrame:
        """Nodes with degree and metrics."""
        d = metrics.degrees(self.nodes, self.edges).withColumnRenamed("degree", "links")
        return self.nodes.select("id", "type", "name", "description").join(d, "id").join(self.scores, "id")

    def stats(self) -> DataFrame:
        return graph.summary(self.nodes, self.edges)

    def entity(self, entity_id: str) -> DataFrame:
        return graph.relations(self.nodes, self.edges, self._known(entity_id))

    def search(self, q: str) -> DataFrame:
        if not q:
            raise ValueError("q is empty")
        return graph.search(self.nodes, q)

    def paths(self, source: str, target: str, max_hops: int = 5) -> DataFrame:
        self._known(source), self._known(target)
        pairs = self.spark.createDataFrame([(source, target)], "source string, target string")
        return traverse.path_steps(traverse.simple_paths(self.edges, pairs, max_hops), self.edges)

    def cascade(self, entity_id: str, max_depth: int = 10) -> DataFrame:
        return traverse.cascade(self.edges, self._known(entity_id), max_depth)

    def scenarios(self, name: str) -> DataFrame:
        return files.scenarios(self.spark, f"{self.root}/{name}.scenarios.json")

    def ask(self, question: str, model) -> dict:
        return run_agent(question, GraphTools(self.nodes, self.edges), model)

    def walkthrough(self, prompt: str, model) -> list[dict]:
        return scenario_steps(self.ask(prompt, model)["trace"])

    def _known(self, entity_id: str) -> DataFrame:
        found = self.nodes.filter(F.col("id") == entity_id).select("id")
        if found.limit(1).count() == 0:
            raise NotFound(entity_id)
        return found
