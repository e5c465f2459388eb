"""Comparison of JSON values held as text, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Column) -> Column:
    """One text for equal JSON values (key order and blanks aside); null if invalid."""
    return F.to_json(F.try_parse_json(value))


def field(item: Column, name: str) -> Column:
    """The canonical text of a member of an object, null if it has none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(item), f"$['{name}']", "variant"))


def deep_equal(a: Column, b: Column) -> Column:
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))
