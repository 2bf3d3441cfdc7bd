"""The schema registry as data: entity types with typed attributes, relationship types with ends.

Fixed values of the data model; an empty list of ends means any type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entity type -> attributes, as name: type.
ENTITY_TYPES: dict[str, dict[str, str]] = {
    "Agreement": {},
    "Alert": {
        "alert_type": "string", "severity_level": "int", "channel": "string", "channel_priority_order": "int",
        "attempt_number": "int", "content": "string", "outcome": "string",
    },
    "Booking": {
        "pnr_id": "string", "segments": "array<string>", "status": "string", "destinations": "array<string>",
        "capture_method": "string",
    },
    "BookingChannel": {},
    "ContactRole": {"escalation_severity_levels": "array<int>", "escalation_condition": "string", "roster_position": "string"},
    "DataElement": {},
    "Incident": {},
    "Obligation": {
        "section_reference": "string", "obligation_type": "string", "obligated_party": "string", "conditionality": "string",
    },
    "Organization": {},
    "Platform": {},
    "Regulation": {},
    "RiskCategory": {},
    "Service": {
        "activation_severity_threshold": "int", "requires_client_authorization": "boolean", "authorization_details": "string",
    },
    "SeverityLevel": {
        "level": "int", "classification": "string", "alert_time_target": "string", "client_escalation_time_target": "string",
        "status_update_cadence": "string", "crisis_bridge_required": "boolean",
    },
    "Traveler": {},
    "TravelerResponseStatus": {
        "tmc_action": "string", "action_time_target": "string", "closes_outreach": "boolean", "triggers_escalation": "boolean",
    },
    "Workflow": {"trigger_condition": "string", "step_count": "int", "time_constraint": "string"},
}

_FLOW = ["Service", "Alert", "TravelerResponseStatus", "Obligation", "Workflow"]
#: Relationship type -> source types, target types.
RELATION_TYPES: dict[str, tuple[list[str], list[str]]] = {
    "PARTY_TO": (["Organization"], ["Agreement"]),
    "INCORPORATES": (["Agreement"], ["Agreement", "Regulation"]),
    "PROVIDES": (["Organization"], ["Service"]),
    "ENGAGES": (["Organization"], ["Organization"]),
    "OPERATES": (["Organization"], ["Platform"]),
    "CLASSIFIED_AS": (["Incident"], ["SeverityLevel"]),
    "CATEGORIZED_AS": (["Incident"], ["RiskCategory"]),
    "IMPACTS": (["Incident"], ["Traveler"]),
    "RESPONDS_WITH": (["Traveler"], ["TravelerResponseStatus"]),
    "ACTIVATED_AT": (["Service"], ["SeverityLevel"]),
    "ENABLED_BY": (["Service"], ["Platform"]),
    "COMPLIES_WITH": (["Agreement", "Service", "Organization"], ["Regulation"]),
    "DESIGNATED_BY": (["ContactRole"], ["Organization"]),
    "REQUIRES_DATA": (["Service"], ["DataElement"]),
    "TRIGGERS_ACTION": (["TravelerResponseStatus"], ["Service"]),
    "ESCALATED_TO": (["SeverityLevel"], ["ContactRole"]),
    "HAS_BOOKING": (["Traveler"], ["Booking"]),
    "BOOKED_THROUGH": (["Booking"], ["BookingChannel"]),
    "ENABLES_COVERAGE": (["BookingChannel"], ["Service"]),
    "REQUIRES_AUTHORIZATION_FROM": (["Service"], ["Organization"]),
    "ASSIGNED_TO": (["Obligation", "Service"], ["Organization"]),
    "RELATES_TO": (["Obligation", "Service", "Regulation"], ["Service", "SeverityLevel", "Organization", "Regulation"]),
    "DEFINED_IN": (["Obligation", "Service", "SeverityLevel", "Regulation"], ["Agreement", "Regulation"]),
    "TRIGGERED_BY": (["Alert"], ["Incident"]),
    "SENT_TO": (["Alert"], ["Traveler"]),
    "FOLLOWED_BY": (_FLOW, _FLOW),
    "CONDITIONAL_ON": (
        ["Service", "ContactRole", "Obligation", "Alert", "Workflow"],
        ["SeverityLevel", "TravelerResponseStatus", "Incident", "RiskCategory"],
    ),
    "STEP_OF": (["Service", "Alert", "Obligation"], ["Workflow"]),
}

#: The types of the graph that ``sources.tables`` shows.
TABLE_TYPES = ("Customer", "Nation", "Order", "Part", "Region", "Supplier")
TABLE_RELATIONS: dict[str, tuple[list[str], list[str]]] = {
    "PART_OF": (["Nation"], ["Region"]),
    "LOCATED_IN": (["Supplier", "Customer"], ["Nation"]),
    "PLACED_BY": (["Order"], ["Customer"]),
    "CONTAINS": (["Order"], ["Part"]),
    "FULFILLED_BY": (["Order"], []),
}


def attribute_table(spark: SparkSession, types: dict[str, dict[str, str]] = ENTITY_TYPES) -> DataFrame:
    """``type``, ``attr``, ``spark_type``; a type without attributes has one row with nulls."""
    rows = [(t, a, s) for t, attrs in sorted(types.items()) for a, s in (attrs.items() or [(None, None)])]
    return spark.createDataFrame(rows, "type string, attr string, spark_type string")


def relation_table(spark: SparkSession, relations: dict[str, tuple[list[str], list[str]]] = RELATION_TYPES) -> DataFrame:
    """``type``, ``src_type``, ``dst_type``: every allowed combination; null means any."""
    rows = [(t, s, d) for t, (src, dst) in sorted(relations.items()) for s in (src or [None]) for d in (dst or [None])]
    return spark.createDataFrame(rows, "type string, src_type string, dst_type string")


def allowed_triples(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Source, relationship and target types, "any" written out."""
    names = types.select("type").distinct()
    s = relations.join(names.withColumnRenamed("type", "s"), F.col("src_type").isNull() | (F.col("src_type") == F.col("s")))
    d = s.join(names.withColumnRenamed("type", "d"), F.col("dst_type").isNull() | (F.col("dst_type") == F.col("d")))
    return d.select(F.col("s").alias("src_type"), "type", F.col("d").alias("dst_type")).distinct()


def constraint_rollup(relations: DataFrame) -> DataFrame:
    """Allowed ends of each relationship type as text."""
    def ends(c: str):
        found = F.array_join(F.array_sort(F.collect_set(c)), ", ")
        return F.when(F.count(c) == 0, "any").otherwise(found)

    return relations.groupBy("type").agg(ends("src_type").alias("sources"), ends("dst_type").alias("targets"))


def json_types(attributes: DataFrame) -> DataFrame:
    """The JSON name of each attribute's type."""
    t = F.col("spark_type")
    item = F.regexp_extract(t, "array<(.*)>", 1)
    plain = lambda c: F.when(c == "int", "integer").when(c == "double", "number").otherwise(c)
    name = F.when(t.startswith("array<"), F.concat(F.lit("array of "), plain(item))).otherwise(plain(t))
    optional = F.when(t.isin("int", "boolean"), F.concat(name, F.lit(" (optional)"))).otherwise(name)
    return attributes.filter("attr is not null").select("type", "attr", optional.alias("json_type"))


def type_prompt(attributes: DataFrame) -> DataFrame:
    """One line for each entity type with its attributes, for prompts."""
    shown = F.when(F.col("attr").isNotNull(), F.concat("attr", F.lit(": "), "json_type"))
    rows = attributes.join(json_types(attributes), ["type", "attr"], "left")
    listed = F.array_join(F.array_sort(F.array_compact(F.collect_list(shown))), "; ")
    return rows.groupBy("type").agg(listed.alias("attributes")).select(
        "type", F.concat("type", F.when(F.col("attributes") != "", F.concat(F.lit(" {"), "attributes", F.lit("}"))).otherwise("")).alias("line")
    )


# --- sections of prompts, in wording of our own --------------------------------------

#: An example value for each kind of attribute.
EXAMPLES = {"string": "text", "int": "1", "boolean": "true", "double": "1.5"}


def type_names(attributes: DataFrame) -> DataFrame:
    """One row: all type names, sorted and joined."""
    return attributes.select("type").distinct().agg(F.array_join(F.array_sort(F.collect_list("type")), ", ").alias("types"))


def type_structure(attributes: DataFrame) -> DataFrame:
    """``type``, ``fields``: the fields that an entity of each type may have, base fields first."""
    base = "id: string, type: string, name: string, description: string, source_text: string"
    typed = json_types(attributes).groupBy("type").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "attr", "json_type"))), ", ").alias("own"))
    rows = attributes.select("type").distinct().join(typed, "type", "left")
    return rows.select("type", F.concat_ws(", ", F.lit(base), "own").alias("fields"))


def example_entities(attributes: DataFrame) -> DataFrame:
    """``type``, ``example``: an entity of each type as JSON."""
    kind = F.regexp_replace("spark_type", "array<(.*)>", "$1")
    value = F.element_at(F.create_map(*(F.lit(x) for kv in EXAMPLES.items() for x in kv)), kind)
    shown = F.when(kind == "string", F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    shown = F.when(F.startswith("spark_type", F.lit("array<")), F.concat(F.lit("["), shown, F.lit("]"))).otherwise(shown)
    pair = F.when(F.col("attr").isNotNull(), F.concat(F.lit('"'), "attr", F.lit('": '), shown))
    own = attributes.groupBy("type").agg(F.array_join(F.array_sort(F.array_compact(F.collect_list(pair))), ", ").alias("own"))
    low = F.lower("type")
    base = F.concat(F.lit('{"id": "'), low, F.lit('_1", "type": "'), "type", F.lit('", "name": "'), "type", F.lit(' 1", "description": "what it is", "source_text": "words of the text"'))
    return own.select("type", F.concat(base, F.when(F.col("own") != "", F.concat(F.lit(", "), "own")).otherwise(""), F.lit("}")).alias("example"))


def example_relationships(relations: DataFrame) -> DataFrame:
    """``type``, ``example``: a relationship of each type as JSON, between its first allowed ends."""
    ends = relations.groupBy("type").agg(F.min("src_type").alias("s"), F.min("dst_type").alias("d"))
    end = lambda c: F.concat(F.lower(F.coalesce(c, F.lit("any"))), F.lit("_1"))
    return ends.select(
        "type",
        F.concat(F.lit('{"source_id": "'), end("s"), F.lit('", "target_id": "'), end("d"), F.lit('", "type": "'), "type", F.lit('", "description": "how they relate"}')).alias("example"),
    )


def answer_example(attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: an answer with an entity of the first type and a relationship of the first type."""
    e = example_entities(attributes).agg(F.min_by("example", "type").alias("e"))
    r = example_relationships(relations).agg(F.min_by("example", "type").alias("r"))
    return e.join(F.broadcast(r)).select(F.concat(F.lit('{"entities": ['), "e", F.lit('], "relationships": ['), "r", F.lit("]}")).alias("example"))
