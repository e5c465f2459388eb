import json

import pytest

from frameloom.plans.checks import issues
from frameloom.plans.compile import KINDS
from frameloom.plans.graph import Edge, Graph, GraphError, Node, Port, in_order, read_graph


def graph(nodes, edges=()):
    return read_graph(json.dumps({"nodes": nodes, "edges": [{"from": a, "to": b} for a, b in edges]}), KINDS)


CAM = {"id": "cam", "module": "table-source"}
SAVE = {"id": "save", "module": "dataset-writer"}


def test_ports_come_from_module_kinds_and_leaving_edges():
    g = graph(
        [CAM, {"id": "f", "primitive": "fork"}, {"id": "c", "module": "brightness-classifier"},
         {"id": "s", "primitive": "switch"}, SAVE],
        [("cam.frame", "f.frame"), ("f.x", "c.frame"), ("f.Y", "s.frame"), ("f.y", "s.frame2"), ("c.class", "s.class"), ("s.ok", "save.frame")],
    )
    assert [p.name.lower() for p in g.node("F").outputs] == ["x", "y"]
    assert [p.name for p in g.node("s").inputs] == ["frame", "class"]
    assert [e.kind for e in g.edges] == ["data", "data", "data", "data", "control", "data"]
    assert [e.id for e in g.edges] == [f"e{i}" for i in range(1, 7)]
    assert [n.category for n in g.nodes] == ["source", "flow-control", "classify", "flow-control", "output"]


def test_ports_split_at_the_first_dot_and_loops_join_by_id():
    g = graph([CAM, SAVE, {"id": "cycle", "primitive": "loop"}], [("cam.frame", "save.frame"), ("save", "cycle")])
    assert (g.edges[1].kind, g.edges[1].from_port, g.edges[1].to_port) == ("loop", "", "")
    dotted = graph([CAM, {"id": "f", "primitive": "fork"}, SAVE], [("cam.frame", "f.frame"), ("f.a.b", "save.frame")])
    assert dotted.node("f").outputs[0].name == "a.b"


@pytest.mark.parametrize(
    "nodes, edges",
    [
        ([{"module": "table-source"}], []),
        ([{"id": "a"}], []),
        ([{"id": "a", "module": "nope"}], []),
        ([{"id": "a", "primitive": "merge"}], []),
        ([{"id": "a", "primitive": "fork"}], []),
        ([CAM], [(".x", "cam.frame")]),
        ([CAM], [("cam.", "cam.frame")]),
        ([CAM], [("", "cam.frame")]),
    ],
)
def test_what_is_no_graph(nodes, edges):
    with pytest.raises(GraphError):
        graph(nodes, edges)


def test_text_must_be_an_object_with_nodes():
    for text in ("[]", "{}", "nonsense", '{"nodes": [1]}'):
        with pytest.raises(GraphError):
            read_graph(text, KINDS)


def test_order_is_by_edges_then_ids_and_cycles_fail():
    nodes = [Node(i, "embedded-primitive") for i in ("b", "A", "c")]
    assert [n.id for n in in_order(Graph("g", nodes, []))] == ["A", "b", "c"]
    e = [Edge("1", "data", "c", "x", "A", "y"), Edge("2", "data", "ghost", "x", "b", "y")]
    assert [n.id for n in in_order(Graph("g", nodes, e))] == ["b", "c", "A"]
    with pytest.raises(GraphError):
        in_order(Graph("g", nodes, [*e, Edge("3", "data", "A", "x", "c", "y")]))


def codes(g):
    return sorted({c.split(".", 1)[1] for c, _ in issues(g)})


def node_codes(spec):
    return codes(graph([{"id": "n", **spec}]))


@pytest.mark.parametrize(
    "spec, want",
    [
        ({"primitive": "value", "config": {"type": "int", "literal": 3}}, []),
        ({"primitive": "value", "config": {"type": "float", "literal": 3}}, ["node.invalid-value-type"]),
        ({"primitive": "value", "config": {"type": "int", "literal": "x"}}, ["node.literal-type-mismatch"]),
        ({"primitive": "value", "config": {"type": "int", "literal": 3, "shape": "map"}}, ["node.invalid-value-shape"]),
        ({"primitive": "value", "config": {"type": "int"}}, ["node.unresolvable-value"]),
        ({"primitive": "value", "config": {"type": "int", "binding": "b", "schema": {"type": "nope"}}}, ["node.invalid-schema"]),
        ({"primitive": "value", "config": {"type": "int", "literal": 9, "schema": {"maximum": 5}}}, ["node.literal-type-mismatch"]),
        ({"primitive": "value", "config": {"shape": "list", "type": "int", "literal": [1, 2], "schema": {"minimum": 1}}}, []),
        ({"primitive": "select", "config": {"mode": "some"}}, ["node.select-invalid-mode"]),
        ({"primitive": "select", "config": {"type": "blob"}}, ["node.invalid-value-type"]),
        ({"primitive": "loop", "config": {"mode": "twice"}}, ["node.loop-invalid-mode"]),
        ({"primitive": "loop", "config": {"mode": "count"}}, ["node.loop-missing-count"]),
        ({"primitive": "loop", "config": {"mode": "count", "count": 4}}, []),
        ({"module": "table-source", "activationMode": "pooled"}, ["node.invalid-activation-mode"]),
        ({"module": "table-source", "backpressure": "wait"}, ["node.invalid-backpressure"]),
        ({"module": "table-source", "parallelism": 0}, ["node.invalid-parallelism"]),
        ({"module": "table-source", "bindings": {"x": {"type": "odd"}}}, ["node.invalid-binding-type"]),
        ({"module": "table-source", "bindings": {"x": {"type": "int", "schema": 3}}}, ["node.invalid-binding-schema"]),
        ({"kind": "integration-module"}, ["node.missing-module-id"]),
        ({"kind": "embedded-primitive"}, ["node.missing-primitive-type"]),
        ({"kind": "runtime-builtin"}, ["node.missing-builtin-type"]),
        ({"kind": "magic"}, ["node.invalid-kind"]),
        ({"kind": "magic", "id": " "}, ["node.invalid-kind", "node.missing-id"]),
        ({"kind": "runtime-builtin", "builtinType": "x", "inputs": [{"name": ""}]}, ["port.missing-name"]),
        ({"kind": "runtime-builtin", "builtinType": "x", "outputs": [{"name": "a"}, {"name": "A"}]}, ["port.duplicate-name"]),
        (
            {"kind": "embedded-primitive", "primitiveType": "select", "inputs": [
                {"name": "items", "dataType": "control/list:int"}, {"name": "criterion", "dataType": "control/value:json"}]},
            ["node.select-type-mismatch"],
        ),
    ],
)
def test_node_checks(spec, want):
    assert node_codes(spec) == want


def test_edge_checks():
    a = Node("a", "runtime-builtin", [], [Port("d", "data", "data/frame"), Port("c", "control", "control/value:int")], builtin="x")
    b = Node("b", "runtime-builtin", [Port("d", "data", "data/frame"), Port("c", "control", "control/value:json")], [], builtin="x")

    def check(*ends, kind="data"):
        return codes(Graph("g", [a, b], [Edge("e", kind, *ends)]))

    assert check("a", "d", "b", "D") == []
    assert check("z", "d", "b", "d") == ["edge.missing-source-node"]
    assert check("a", "d", "z", "d") == ["edge.missing-target-node"]
    assert check("a", "x", "b", "d") == ["edge.missing-source-port"]
    assert check("a", "d", "b", "x") == ["edge.missing-target-port"]
    assert check("a", "", "b", "", kind="loop") == ["edge.invalid-loop-target"]
    assert check("a", "c", "b", "d") == ["edge.data-type-mismatch", "edge.source-channel-mismatch"]
    assert check("a", "d", "b", "c") == ["edge.data-type-mismatch", "edge.target-channel-mismatch"]
    assert check("a", "c", "b", "c", kind="control") == ["edge.data-type-mismatch"]
    twice = Graph("g", [a, a, b], [Edge("e", "data", "a", "d", "b", "d"), Edge("E", "data", "a", "d", "b", "d")])
    assert codes(twice) == ["edge.duplicate-id", "node.duplicate-id"]
