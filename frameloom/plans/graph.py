"""Pipeline graphs: reading the short JSON form, and the order of nodes.

The short form names modules and primitives and joins ``node.port`` strings;
reading it derives ports and edge kinds. Names are compared without case.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

FRAME, CLASSIFICATION, GATE = "data/frame", "control/classification", "control/boolean-gate"


class GraphError(ValueError):
    """The text is not a graph."""


@dataclass
class Port:
    name: str
    channel: str
    data_type: str
    required: bool = True


@dataclass
class Node:
    id: str
    kind: str
    inputs: list[Port] = field(default_factory=list)
    outputs: list[Port] = field(default_factory=list)
    module: str | None = None
    primitive: str | None = None
    builtin: str | None = None
    category: str | None = None
    activation: str | None = None
    backpressure: str | None = None
    parallelism: int | None = None
    config: dict[str, Any] = field(default_factory=dict)
    bindings: dict[str, Any] = field(default_factory=dict)

    def is_primitive(self, name: str) -> bool:
        return (self.primitive or "").lower() == name


@dataclass
class Edge:
    id: str
    kind: str
    from_node: str
    from_port: str
    to_node: str
    to_port: str


@dataclass
class Graph:
    name: str
    nodes: list[Node]
    edges: list[Edge]

    def node(self, node_id: str) -> Node | None:
        return next((n for n in self.nodes if n.id.lower() == node_id.lower()), None)

    def inbound(self, node: Node) -> dict[str, Edge]:
        return {e.to_port.lower(): e for e in self.edges if e.to_node.lower() == node.id.lower() and e.kind != "loop"}


def _data(name: str) -> Port:
    return Port(name, "data", FRAME)


#: Ports of a module by its kind: category, inputs, outputs.
MODULE_PORTS = {
    "source": ("source", (), (_data("frame"),)),
    "processor": ("compute", (_data("frame"),), (_data("frame"),)),
    "classifier": ("classify", (_data("frame"),), (Port("class", "control", CLASSIFICATION),)),
    "gate": ("control", (), (Port("productPresent", "control", GATE),)),
    "sink": ("output", (_data("frame"),), ()),
}


def _ends(edge: Any, nth: int) -> tuple[str, str, str, str]:
    out: list[str] = []
    for side in ("from", "to"):
        ref = edge.get(side)
        if isinstance(ref, dict):
            out += [ref.get("nodeId", ""), ref.get("port", "")]
            continue
        if not isinstance(ref, str) or not ref.strip():
            raise GraphError(f"edge {nth} lacks its '{side}'")
        node, dot, port = ref.partition(".")
        if dot and not (node and port):
            raise GraphError(f"edge {nth}: '{side}' must be 'node.port', not {ref!r}")
        out += [node if dot else node.strip(), port]
    return tuple(out)


def _primitive_ports(node_id: str, kind: str, config: dict, leaving: list[str]) -> tuple[list[Port], list[Port]]:
    kind = kind.lower()
    if kind in ("fork", "switch"):
        if not leaving:
            raise GraphError(f"{kind} '{node_id}' has no outgoing edge to take its ports from")
        inputs = [_data("frame")] + ([Port("class", "control", CLASSIFICATION)] if kind == "switch" else [])
        return inputs, [_data(p) for p in leaving]
    if kind == "if":
        return [_data("frame"), Port("productPresent", "control", GATE)], [_data("acceptedFrame")]
    if kind == "value":
        shape = "list" if str(config.get("shape", "")).lower() == "list" else "value"
        return [], [Port("value", "control", f"control/{shape}:{config.get('type', 'string')}")]
    if kind == "select":
        of = config.get("type", "json")
        shape = "list" if str(config.get("mode", "")).lower() == "many" else "value"
        items = [Port("items", "control", f"control/list:{of}"), Port("criterion", "control", f"control/value:{of}", False)]
        return items, [Port("selected", "control", f"control/{shape}:{of}")]
    if kind == "loop":
        return [], []
    raise GraphError(f"node '{node_id}' has unknown primitive '{kind}'")


def _rich(spec: dict) -> Node:
    ports = lambda key: [
        Port(p.get("name", ""), p.get("channel", ""), p.get("dataType", ""), p.get("required", True))
        for p in spec.get(key, [])
    ]
    return Node(
        spec.get("id", ""), spec["kind"], ports("inputs"), ports("outputs"), spec.get("moduleId"), spec.get("primitiveType"),
        spec.get("builtinType"), spec.get("category"), spec.get("activationMode"), spec.get("backpressure"),
        spec.get("parallelism"), dict(spec.get("config") or {}), dict(spec.get("bindings") or {}),
    )


def read_graph(text: str, modules: dict[str, str]) -> Graph:
    """A graph from JSON; ``modules`` gives the kind of each known module."""
    try:
        root = json.loads(text)
    except json.JSONDecodeError as e:
        raise GraphError(f"not JSON: {e}") from e
    if not isinstance(root, dict) or not isinstance(root.get("nodes"), list):
        raise GraphError("a graph is an object with a list of 'nodes'")
    raw_edges = root.get("edges") or []
    if not all(isinstance(x, dict) for x in [*root["nodes"], *raw_edges]):
        raise GraphError("nodes and edges must be objects")
    ends = [_ends(e, n) for n, e in enumerate(raw_edges, 1)]
    nodes: list[Node] = []
    for spec in root["nodes"]:
        if spec.get("kind") is not None and spec.get("module") is None and spec.get("primitive") is None:
            nodes.append(_rich(spec))
            continue
        node_id = spec.get("id")
        if not node_id:
            raise GraphError("a node lacks its 'id'")
        common = {
            "activation": spec.get("activationMode"),
            "backpressure": spec.get("backpressure"),
            "parallelism": spec.get("parallelism"),
            "config": dict(spec.get("config") or {}),
        }
        if spec.get("module") is not None:
            kind = modules.get(spec["module"])
            if kind is None:
                raise GraphError(f"node '{node_id}' names unknown module '{spec['module']}'")
            if kind not in MODULE_PORTS:
                raise GraphError(f"node '{node_id}': modules of kind '{kind}' have no ports")
            category, inputs, outputs = MODULE_PORTS[kind]
            nodes.append(
                Node(node_id, "integration-module", list(inputs), list(outputs), module=spec["module"],
                     category=category, bindings=dict(spec.get("bindings") or {}), **common)
            )
        elif spec.get("primitive") is not None:
            leaving = list({p.lower(): p for n, p, _, _ in reversed(ends) if n.lower() == node_id.lower()}.values())[::-1]
            inputs, outputs = _primitive_ports(node_id, spec["primitive"], common["config"], leaving)
            category = "value" if spec["primitive"].lower() in ("value", "select") else "flow-control"
            nodes.append(
                Node(node_id, "embedded-primitive", inputs, outputs, primitive=spec["primitive"], category=category, **common)
            )
        else:
            raise GraphError(f"node '{node_id}' needs 'module', 'primitive' or 'kind'")
    channels = {(n.id.lower(), p.name.lower()): p.channel for n in nodes for p in n.outputs}
    loops = {n.id.lower() for n in nodes if n.is_primitive("loop")}
    edges = []
    for nth, ((a, p, b, q), spec) in enumerate(zip(ends, raw_edges), 1):
        back = b.lower() in loops
        kind = "loop" if back else spec.get("kind") or channels.get((a.lower(), p.lower()), "data")
        edges.append(Edge(spec.get("id") or f"e{nth}", kind, a, "" if back else p, b, "" if back else q))
    return Graph(root.get("name") or "pipeline", nodes, edges)


def in_order(graph: Graph) -> list[Node]:
    """Nodes so that every edge points forward; ties go by id. GraphError on a cycle."""
    by_id = {n.id.lower(): n for n in graph.nodes}
    waits = {i: set() for i in by_id}
    for e in graph.edges:
        a, b = e.from_node.lower(), e.to_node.lower()
        if a in by_id and b in by_id:
            waits[b].add(a)
    out: list[Node] = []
    while waits:
        ready = sorted(i for i, w in waits.items() if not w)
        if not ready:
            raise GraphError("the graph has a cycle: " + ", ".join(sorted(waits)))
        for i in ready:
            out.append(by_id[i])
            del waits[i]
        for w in waits.values():
            w.difference_update(ready)
    return out
