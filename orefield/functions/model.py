"""Ids and JSON accessors of the node and edge model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(kind: str | Column, codebase: Column, name: Column) -> Column:
    """``kind:codebase:name``; null if any part is."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), codebase, F.lit(":"), name)


def prop(key: str, of: str = "properties") -> Column:
    """A property as text; null where the JSON is missing, broken or lacks it."""
    return F.get_json_object(of, f"$.{key}")


def prop_number(key: str, of: str = "properties") -> Column:
    return F.coalesce(prop(key, of).try_cast("double"), F.lit(0.0))


def prop_count(key: str, of: str = "properties") -> Column:
    """Length of a list property, or the number that stands there instead."""
    return F.coalesce(F.json_array_length(prop(key, of)).cast("double"), prop(key, of).try_cast("double"), F.lit(0.0))


def properties(**values: Column) -> Column:
    """JSON with sorted keys; null values are left out."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))
