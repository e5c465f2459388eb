"""Checks of a graph before it is compiled: a list of (code, subject)."""

from __future__ import annotations

from frameloom.functions.values import TYPES, has_shape, schema_error, shaped_violation
from frameloom.plans.graph import Edge, Graph, Node

KINDS = ("integration-module", "embedded-primitive", "runtime-builtin")
Issue = tuple[str, str]


def _value_node(node: Node) -> list[str]:
    c, out = node.config, []
    kind, shape, schema = c.get("type", "string"), str(c.get("shape", "single")).lower(), c.get("schema")
    if kind not in TYPES:
        out.append("invalid-value-type")
    if shape not in ("single", "list"):
        out.append("invalid-value-shape")
    bad_schema = schema_error(schema)
    if bad_schema:
        out.append("invalid-schema")
    if "literal" in c:
        if kind in TYPES and not has_shape(shape, kind, c["literal"]):
            out.append("literal-type-mismatch")
        elif not bad_schema and shaped_violation(shape, schema, c["literal"]):
            out.append("literal-type-mismatch")
    elif c.get("binding") is None and "default" not in c:
        out.append("unresolvable-value")
    return out


def _select_node(node: Node) -> list[str]:
    out = []
    if str(node.config.get("mode", "one")).lower() not in ("one", "many"):
        out.append("select-invalid-mode")
    if node.config.get("type", "json") not in TYPES:
        out.append("invalid-value-type")
    ports = {p.name.lower(): p.data_type.partition(":")[2] for p in node.inputs}
    if {"items", "criterion"} <= ports.keys() and ports["items"] != ports["criterion"]:
        out.append("select-type-mismatch")
    return out


def _loop_node(node: Node) -> list[str]:
    mode, count = str(node.config.get("mode", "until-exhausted")).lower(), node.config.get("count")
    if mode not in ("until-exhausted", "count", "forever"):
        return ["loop-invalid-mode"]
    positive = isinstance(count, int) and not isinstance(count, bool) and count > 0
    return ["loop-missing-count"] if mode == "count" and not positive else []


def _node(node: Node) -> list[str]:
    out = [] if node.id.strip() else ["missing-id"]
    if node.activation and node.activation.lower() not in ("resident", "on-demand"):
        out.append("invalid-activation-mode")
    if node.backpressure and node.backpressure.lower() not in ("stall", "drop"):
        out.append("invalid-backpressure")
    if node.parallelism is not None and node.parallelism < 1:
        out.append("invalid-parallelism")
    kind = node.kind.lower()
    if kind not in KINDS:
        out.append("invalid-kind")
    named = {KINDS[0]: node.module, KINDS[1]: node.primitive, KINDS[2]: node.builtin}
    lacks = {KINDS[0]: "missing-module-id", KINDS[1]: "missing-primitive-type", KINDS[2]: "missing-builtin-type"}
    if kind in named and not (named[kind] or "").strip():
        out.append(lacks[kind])
    for primitive, check in (("value", _value_node), ("select", _select_node), ("loop", _loop_node)):
        if kind == KINDS[1] and node.is_primitive(primitive):
            out += check(node)
    for binding in node.bindings.values():
        if binding.get("type", "string") not in TYPES:
            out.append("invalid-binding-type")
        if schema_error(binding.get("schema")):
            out.append("invalid-binding-schema")
    return out


def _ports(node: Node) -> list[Issue]:
    out = []
    for ports in (node.inputs, node.outputs):
        seen = set()
        for p in ports:
            if not p.name.strip():
                out.append(("pipeline.port.missing-name", node.id))
            elif p.name.lower() in seen:
                out.append(("pipeline.port.duplicate-name", node.id))
            seen.add(p.name.lower())
    return out


def _edge(e: Edge, graph: Graph) -> list[str]:
    a, b = graph.node(e.from_node), graph.node(e.to_node)
    if a is None:
        return ["missing-source-node"]
    if b is None:
        return ["missing-target-node"]
    if e.kind.lower() == "loop":
        return [] if b.is_primitive("loop") else ["invalid-loop-target"]
    p = next((x for x in a.outputs if x.name.lower() == e.from_port.lower()), None)
    q = next((x for x in b.inputs if x.name.lower() == e.to_port.lower()), None)
    out = []
    if p is None:
        out.append("missing-source-port")
    if q is None:
        out.append("missing-target-port")
    if p is None or q is None:
        return out[:1]
    if p.channel.lower() != e.kind.lower():
        out.append("source-channel-mismatch")
    if q.channel.lower() != e.kind.lower():
        out.append("target-channel-mismatch")
    if p.data_type.lower() != q.data_type.lower():
        out.append("data-type-mismatch")
    return out


def issues(graph: Graph) -> list[Issue]:
    """Everything wrong with a graph; none means that it is valid."""
    out: list[Issue] = []
    nodes, edges = set(), set()
    for node in graph.nodes:
        out += [(f"pipeline.node.{code}", node.id) for code in _node(node)] + _ports(node)
        if node.id.lower() in nodes:
            out.append(("pipeline.node.duplicate-id", node.id))
        nodes.add(node.id.lower())
    for edge in graph.edges:
        if edge.id.lower() in edges:
            out.append(("pipeline.edge.duplicate-id", edge.id))
        edges.add(edge.id.lower())
        out += [(f"pipeline.edge.{code}", edge.id) for code in _edge(edge, graph)]
    return out
