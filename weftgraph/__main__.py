"""Command line: ``python -m weftgraph COMMAND ...``.

query NAME TABLES       a named query over a folder of tables
pdf IN OUT              PDF files to markdown, one folder for each document
graphs ROOT             graph files with titles and sizes
runs ROOT               runs from the last on
summary GRAPH           counts by type of a graph file
entity GRAPH ID         an entity's relationships
paths GRAPH FROM TO     simple paths between two entities
cascade GRAPH ID        what an entity reaches
merge GRAPH FILE OUT    a graph's relationships with those of a file
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import catalog
from weftgraph.operators import graph, layout, traverse
from weftgraph.plans.tools import GraphTools
from weftgraph.sources import files, pdf


def _graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(*files.graph_rows(files.entities(spark, path), files.relationships(spark, path)))


def to_markdown(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Write markdown; one row for each file with its figures or its error."""
    spans = pdf.spans(files.binaries(spark, source))
    docs = layout.markdown(spans.filter("error is null"))
    files.write_markdown(docs, out)
    return layout.markdown_stats(docs).withColumn("error", F.lit(None).cast("string")).unionByName(spans.filter("error is not null").select("doc_id", "error"), allowMissingColumns=True)


def merged(spark: SparkSession, path: str, more: str, out: str) -> DataFrame:
    edges = files.graph_rows(files.entities(spark, path), files.relationships(spark, path))[1]
    both = files.merge_relationships(edges, spark, more)
    files.write_json(both, out)
    return both.groupBy("added").agg(F.count("*").alias("n"))


def cascaded(spark: SparkSession, path: str, entity_id: str) -> DataFrame:
    """What directed relationships reach, with each node's depth and parent."""
    nodes, edges = _graph(spark, path)
    return traverse.cascade(edges, nodes.filter(F.col("id") == entity_id).select("id")).drop("rank")


COMMANDS = {
    "query": lambda s, name, tables: catalog.queries()[name](s, tables),
    "pdf": to_markdown,
    "graphs": files.catalog,
    "runs": files.list_runs,
    "summary": lambda s, path: graph.summary(*_graph(s, path)),
    "entity": lambda s, path, i: GraphTools(*_graph(s, path)).get_entity(i),
    "paths": lambda s, path, a, b: GraphTools(*_graph(s, path)).find_paths(a, b),
    "cascade": cascaded,
    "merge": merged,
}


def main(arguments: list[str]) -> int:
    if arguments and arguments[0] in catalog.queries():
        arguments = ["query", *arguments]
    command = COMMANDS.get(arguments[0]) if arguments else None
    if command is None:
        print(__doc__)
        return 2
    command(SparkSession.builder.getOrCreate(), *arguments[1:]).show(50, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
