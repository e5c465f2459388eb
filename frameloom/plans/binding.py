"""Values that a graph takes from outside, settled on the driver before a job.

A value node takes its resolved or literal value, else the store's, else what a
resolver answers, else its default. A select node takes its ``where``; one whose
criterion comes by an edge is left to run time; it has no default. Answers of
resolvers that ask to be kept go to the store, once, at the end, if nothing
failed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

from frameloom.functions.values import has_shape, parse, shaped_violation
from frameloom.plans.graph import Graph, Node, in_order

#: A resolver gives (value, keep) for (binding, type), or None if it has none.
Resolver = Callable[[str, str], "tuple[Any, bool] | None"]
PREFIX = "FRAMELOOM_BINDING_"


def from_environment(binding: str, kind: str) -> tuple[Any, bool] | None:
    """The environment's value of a binding; never kept. ValueError if it doesn't parse."""
    text = os.environ.get(PREFIX + binding.replace(".", "_").replace("-", "_").upper())
    return None if text is None else (parse(kind, text), False)


def chained(*resolvers: Resolver) -> Resolver:
    """The first resolver that has an answer, or fails."""

    def ask(binding: str, kind: str) -> tuple[Any, bool] | None:
        return next((a for r in resolvers if (a := r(binding, kind)) is not None), None)

    return ask


class Store:
    """Bindings in a JSON file with sorted keys; a missing file is empty."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        found = self.path and self.path.exists()
        self.values: dict[str, Any] = json.loads(self.path.read_text()) if found else {}

    def save(self) -> None:
        if self.path:
            self.path.write_text(json.dumps(self.values, indent=2, sort_keys=True) + "\n")


def bind(graph: Graph, store: Store | None = None, resolver: Resolver = from_environment) -> list[str]:
    """Set ``config['resolved']`` of value and select nodes, and overlay bound
    fields of modules; the list of what failed."""
    store = store or Store()
    errors, fresh = [], {}

    def answer(node: Node, binding: str, kind: str, shape: str, schema: Any, check: bool) -> Any:
        if binding in store.values:
            value = store.values[binding]
        else:
            try:
                got = resolver(binding, kind)
            except ValueError as e:
                errors.append(f"{node.id}: {e}")
                return None
            if got is None:
                return None
            value, keep = got
            if keep:
                fresh[binding] = value
        if check and (not has_shape(shape, kind, value) or shaped_violation(shape, schema, value)):
            errors.append(f"{node.id}: the value of '{binding}' doesn't fit")
            return None
        return value

    for node in in_order(graph):
        c = node.config
        if node.is_primitive("value") and "resolved" not in c:
            shape = str(c.get("shape", "single")).lower()
            value, before = c.get("literal"), len(errors)
            if value is None and c.get("binding"):
                value = answer(node, c["binding"], c.get("type", "string"), shape, c.get("schema"), True)
            value = c.get("default") if value is None else value
            if value is None and len(errors) == before:
                errors.append(f"{node.id}: no value")
            c["resolved"] = value
        elif node.is_primitive("select") and "resolved" not in c:
            value, before = c.get("where"), len(errors)
            if value is None and "criterion" in graph.inbound(node):
                continue
            if value is None and c.get("binding"):
                value = answer(node, c["binding"], c.get("type", "json"), "single", None, False)
            if value is None and len(errors) == before:
                errors.append(f"{node.id}: no criterion")
            c["resolved"] = value
        for name, rule in node.bindings.items():
            if rule.get("binding") in store.values:
                value = store.values[rule["binding"]]
                if has_shape("single", rule.get("type", "string"), value) and not shaped_violation("single", rule.get("schema"), value):
                    c[name] = value
                else:
                    errors.append(f"{node.id}: the value of '{rule['binding']}' doesn't fit")
    if fresh and not errors:
        store.values.update(fresh)
        store.save()
    return errors


class LiveValues:
    """Values that may change while a stream runs; seen from the next batch on."""

    def __init__(self):
        self._rules: dict[str, tuple[str, str, Any]] = {}
        self._values: dict[str, Any] = {}
        self.listeners: list[Callable[[str, Any], None]] = []

    def register(self, node: Node) -> None:
        c = node.config
        self._rules[node.id] = (c.get("type", "string"), str(c.get("shape", "single")).lower(), c.get("schema"))
        self._values[node.id] = c.get("resolved")

    def get(self, node_id: str) -> Any:
        return self._values.get(node_id)

    def try_set(self, node_id: str, value: Any) -> str | None:
        """None if the value was taken, else why not."""
        if node_id not in self._rules:
            return f"unknown node '{node_id}'"
        kind, shape, schema = self._rules[node_id]
        if not has_shape(shape, kind, value):
            return f"not {kind} ({shape})"
        if error := shaped_violation(shape, schema, value):
            return error
        self._values[node_id] = value
        for listener in self.listeners:
            listener(node_id, value)
        return None
