"""Labels of nodes, their nested members and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ("name", "label", "displayName", "title")
NESTED = (("attributes", "attribute"), ("operations", "operation"), ("literals", "literal"))
#: Node types that carry values and need no label (fixed values).
VALUE_TYPES = [
    "LiteralBoolean", "LiteralInteger", "LiteralReal", "LiteralString", "LiteralUnlimitedNatural", "Region", "Expression", "InstanceValue",
    "InteractionOperand", "ClassifierTemplateParameter", "CombinedFragment", "RedefinableTemplateSignature", "MessageOccurrenceSpecification",
    "ExecutionOccurrenceSpecification", "BehaviorExecutionSpecification",
]


def resolve(fields: dict[str, Column], attributes: tuple[str, ...] = ATTRIBUTES) -> Column:
    """The first configured attribute that is there."""
    found = [fields[a] for a in attributes if a in fields]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def resolve_variant(fields: Column, data: Column | None = None, attributes: tuple[str, ...] = ATTRIBUTES) -> Column:
    """The first configured attribute that holds a string, of VARIANT objects whose values have any type.

    ``fields`` are those of the element itself: a value there that is neither null nor a string ends the search without a
    label.  In ``data``, looked at for each attribute after ``fields``, such a value is passed over."""

    def text(of: Column, a: str) -> Column:
        return F.when(F.schema_of_variant(F.variant_get(of, f"$.{a}", "variant")) == "STRING", F.variant_get(of, f"$.{a}", "string"))

    steps = []
    for a in attributes:
        own = F.variant_get(fields, f"$.{a}", "variant")
        odd = own.isNotNull() & ~F.is_variant_null(own) & (F.schema_of_variant(own) != "STRING")
        steps += [(odd, F.lit(None).cast("string")), (text(fields, a).isNotNull(), text(fields, a))]
        if data is not None:
            steps.append((text(data, a).isNotNull(), text(data, a)))
    out = F.lit(None).cast("string")
    for when, value in reversed(steps):
        out = F.when(when, value).otherwise(out)
    return out


def iter_labels(
    nodes: DataFrame, edges: DataFrame | None = None, attributes: tuple[str, ...] = ATTRIBUTES, nested: bool = True,
) -> DataFrame:
    """``model_id, label_id, kind, type, label``: a row per node, per nested entry (even an empty one) and, where edges
    are given, per edge.  Nested entries are ``struct<name, label, displayName, title>``, strings in ``name``."""
    data = {a: F.col("data")[a] for a in attributes}
    own = data | {"name": F.col("name")}
    parts = [nodes.select("model_id", F.col("node_id").alias("label_id"), F.lit("node").alias("kind"), "type", resolve(own, attributes).alias("label"))]
    for field, suffix in NESTED:
        if nested and field in nodes.columns:
            entry = {a: F.col("_e")[a] for a in attributes}
            parts.append(
                nodes.select("model_id", "node_id", "type", F.posexplode(field).alias("_i", "_e")).select(
                    "model_id", F.concat_ws("::", "node_id", F.lit(suffix), F.col("_i")).alias("label_id"), F.lit(suffix).alias("kind"),
                    F.concat_ws(".", "type", F.lit(suffix)).alias("type"), resolve(entry, attributes).alias("label"),
                )
            )
    if edges is not None:
        parts.append(edges.select("model_id", F.col("edge_id").alias("label_id"), F.lit("edge").alias("kind"), "type", resolve(data, attributes).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eligible(type_col: Column) -> Column:
    """Whether an element of this type should have a label."""
    return ~F.element_at(F.split(type_col, ":"), -1).isin(VALUE_TYPES)
