"""Typed values of the graph: types, shapes, JSON equality, a JSON Schema subset.

All of it runs on the driver, over configuration, before a job starts.
"""

from __future__ import annotations

import json
import re
from typing import Any

TYPES = ("string", "int", "number", "bool", "json")
_SCHEMA_TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")


def same(a: Any, b: Any) -> bool:
    """Deep JSON equality; true and 1 differ, 1 and 1.0 do not."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def is_type(kind: str, value: Any) -> bool:
    if kind == "json":
        return value is not None
    if kind == "string":
        return isinstance(value, str)
    if kind == "bool":
        return isinstance(value, bool)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "int":
        return number and float(value).is_integer() and -(2**63) <= value < 2**63
    return kind == "number" and number


def has_shape(shape: str, kind: str, value: Any) -> bool:
    """A single value of a type, or a list with elements of it."""
    if shape == "list":
        return isinstance(value, list) and all(is_type(kind, x) for x in value)
    return is_type(kind, value)


def parse(kind: str, text: str, shape: str = "single") -> Any:
    """A value from text; ValueError if it doesn't parse."""
    if shape == "list":
        value = json.loads(text)
    elif kind == "string":
        return text
    elif kind == "bool":
        if text.strip().lower() not in ("true", "false"):
            raise ValueError(f"not a bool: {text!r}")
        return text.strip().lower() == "true"
    elif kind == "int":
        value = int(text.strip())
    elif kind == "number":
        value = float(text.strip())
    else:
        value = json.loads(text)
    if not has_shape(shape, kind, value):
        raise ValueError(f"not {kind} ({shape}): {text!r}")
    return value


def schema_error(schema: Any) -> str | None:
    """Why a schema is not one of the supported subset, or None."""
    if schema is None or isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return "a schema must be an object or a boolean"
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in _SCHEMA_TYPES:
            return f"unknown type '{kind}'"
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError) as e:
            return f"bad pattern: {e}"
    if "enum" in schema and not isinstance(schema["enum"], list):
        return "enum must be a list"
    if "required" in schema and not isinstance(schema["required"], list):
        return "required must be a list"
    parts = list(schema.get("properties", {}).values()) if isinstance(schema.get("properties", {}), dict) else [0]
    parts += [schema[k] for k in ("items", "additionalProperties") if k in schema]
    return next((e for e in map(schema_error, parts) if e), None)


def _is_schema_type(kind: str, v: Any) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {
        "object": isinstance(v, dict),
        "array": isinstance(v, list),
        "string": isinstance(v, str),
        "number": number,
        "integer": number and float(v).is_integer(),
        "boolean": isinstance(v, bool),
        "null": v is None,
    }[kind]


def violation(schema: Any, value: Any, path: str = "$") -> str | None:
    """The first thing about ``value`` that its schema forbids, with its path."""
    if schema is None or schema is True:
        return None
    if schema is False:
        return f"{path}: nothing is allowed here"
    kinds = schema.get("type")
    if kinds is not None and not any(_is_schema_type(k, value) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return f"{path}: expected {kinds}"
    if "const" in schema and not same(schema["const"], value):
        return f"{path}: not the constant"
    if "enum" in schema and not any(same(x, value) for x in schema["enum"]):
        return f"{path}: not one of the listed values"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}: missing '{name}'"
        for name, member in value.items():
            rule = known[name] if name in known else schema.get("additionalProperties")
            if error := violation(rule, member, f"{path}.{name}"):
                return error
    if isinstance(value, list):
        if error := _outside(len(value), schema, "minItems", "maxItems", f"{path}: items"):
            return error
        for i, item in enumerate(value):
            if error := violation(schema.get("items"), item, f"{path}[{i}]"):
                return error
    if isinstance(value, str):
        if error := _outside(len(value), schema, "minLength", "maxLength", f"{path}: length"):
            return error
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{path}: does not match the pattern"
    if _is_schema_type("number", value):
        if error := _outside(value, schema, "minimum", "maximum", path):
            return error
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            return f"{path}: too small"
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            return f"{path}: too large"
    return None


def _outside(n: float, schema: dict, low: str, high: str, what: str) -> str | None:
    if low in schema and n < schema[low]:
        return f"{what}: too small"
    if high in schema and n > schema[high]:
        return f"{what}: too large"
    return None


def shaped_violation(shape: str, schema: Any, value: Any) -> str | None:
    """As ``violation``; the schema of a list describes its elements."""
    if shape != "list":
        return violation(schema, value)
    return next((e for i, x in enumerate(value) if (e := violation(schema, x, f"$[{i}]"))), None)
