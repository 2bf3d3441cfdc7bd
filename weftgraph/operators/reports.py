"""Reports: anchoring, coverage, evaluation, experiments compared, usage, reveals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), digits)


def anchoring(anchors: DataFrame) -> DataFrame:
    """``anchors``: text, offset, doc. Anchored, verbatim in the document, and with an offset.

    The last two differ: an offset may come from a normalized or fuzzy match.
    """
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    return anchors.agg(
        F.count("*").alias("total"), F.count_if(has).alias("anchored"),
        F.count_if(has & F.contains("doc", "text")).alias("verbatim"), F.count_if(F.col("offset") >= 0).alias("located"),
    ).withColumn("verbatim_pct", share(F.col("verbatim"), F.col("total"), 1))


def unanchored(rows: DataFrame, first: int = 10) -> DataFrame:
    """The first entities in input order whose text isn't found: an offset below 0."""
    return rows.filter(F.coalesce("offset", F.lit(-1)) < 0).orderBy("ord").limit(first).select("ord", "id")


def coverage(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Share of each document's characters that its sections hold; a warning below 0.85."""
    held = sections.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    out = documents.join(held, "doc_id", "left")
    ratio = F.coalesce("chars", F.lit(0)) / F.greatest(F.length("text"), F.lit(1))
    return out.select("doc_id", F.round(ratio, 4).alias("coverage"), (ratio < 0.85).alias("warning"))


def evaluation(judged: DataFrame, pass_at: int = 4) -> DataFrame:
    """``judged``: difficulty, total. Counts, passes, rate and mean score by difficulty and overall (null)."""
    ok = F.col("total") >= pass_at
    return judged.rollup("difficulty").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.round(F.avg("total"), 4).alias("mean_score")
    ).withColumn("pass_rate", share(F.col("passed"), F.col("n"), 1))


def usage(calls: DataFrame) -> DataFrame:
    """Tokens and calls by stage and overall (null)."""
    return calls.rollup("stage").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls")
    )


def type_jaccard(types: DataFrame) -> DataFrame:
    """``types``: experiment, type. Jaccard of the type sets of each pair of experiments, 3 digits."""
    sets = types.groupBy("experiment").agg(F.collect_set("type").alias("s"))
    a, b = sets.toDF("a", "a_set"), sets.toDF("b", "b_set")
    both = a.join(b, F.col("a") < F.col("b"))
    union = F.size(F.array_union("a_set", "b_set"))
    ratio = F.when(union > 0, F.size(F.array_intersect("a_set", "b_set")) / union).otherwise(0.0)
    return both.select("a", "b", F.round(ratio, 3).alias("jaccard"))


def schema_coverage(types: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of the registry's types that each experiment uses, 1 digit."""
    size = registry.select("type").distinct().count()
    used = types.select("experiment", "type").distinct().join(registry.select("type").distinct(), "type", "left_semi")
    n = used.groupBy("experiment").agg(F.count("*").alias("matched"))
    return types.select("experiment").distinct().join(n, "experiment", "left").select(
        "experiment", F.coalesce("matched", F.lit(0)).alias("matched"),
        F.round(100.0 * F.coalesce("matched", F.lit(0)) / F.lit(max(size, 1)), 1).alias("coverage_pct"),
    )


def experiment_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean properties of each experiment's graph."""
    n = nodes.groupBy("experiment").agg(F.count("*").alias("nodes"), F.round(F.avg(F.size("attrs")), 2).alias("mean_properties"))
    e = edges.groupBy("experiment").agg(F.count("*").alias("edges"))
    out = n.join(e, "experiment", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return out.withColumn("density", F.round(density, 4))


def schema_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges, and the types of both as sorted text."""
    kinds = lambda: F.array_join(F.array_sort(F.collect_set("type")), ",")
    n = nodes.agg(F.count_distinct("id").alias("nodes"), kinds().alias("node_types"))
    return n.join(edges.agg(F.count("*").alias("edges"), kinds().alias("edge_types")))


def reveal(steps: DataFrame, key: str = "scenario") -> DataFrame:
    """``steps``: scenario, step, items (array). Adds ``fresh``: the items that no step before has, sorted, and ``revealed``: how many there are by now.

    What is shown at a step are the fresh items up to it, so no row repeats those before.
    """
    first = steps.select(key, "step", F.explode("items").alias("item")).groupBy(key, "item").agg(F.min("step").alias("step"))
    fresh = first.groupBy(key, "step").agg(F.array_sort(F.collect_list("item")).alias("fresh"))
    out = steps.join(fresh, [key, "step"], "left").withColumn("fresh", F.coalesce("fresh", F.array().cast("array<string>")))
    so_far = Window.partitionBy(key).orderBy("step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("revealed", F.sum(F.size("fresh")).over(so_far))


def history(steps: DataFrame, key: str = "scenario") -> DataFrame:
    """``steps``: scenario, step, log (array). Each line once: ``at`` (its number in the scenario), ``step`` and ``line``.

    The history of a step are the lines of steps before it.
    """
    lines = steps.select(key, "step", F.posexplode("log").alias("place", "line"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("step", "place")) - 1
    return lines.select(key, at.alias("at"), "step", "line")


def font_histogram(spans: DataFrame) -> DataFrame:
    """The commonest font size of each document by characters; ties to the first seen."""
    chars = F.length(F.trim("text"))
    sizes = spans.groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.sum(chars).alias("n"), F.min("ord").alias("first"))
    return sizes.filter("n > 0").groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body_size"))
