import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from frameloom.functions import payloads, values
from frameloom.plans.binding import LiveValues, Store, bind, chained, from_environment
from frameloom.plans.compile import KINDS
from frameloom.plans.graph import read_graph

JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3),
    max_leaves=8,
)


@given(JSON)
def test_json_equality_survives_a_round_trip(value):
    assert values.same(value, json.loads(json.dumps(value)))
    assert not values.same(value, [value])


def test_equality_and_types():
    assert values.same(1, 1.0) and not values.same(1, True) and not values.same("1", 1)
    assert values.same({"a": [1, {"b": None}]}, {"a": [1.0, {"b": None}]})
    assert values.is_type("int", 3.0) and not values.is_type("int", 2**63) and not values.is_type("int", True)
    assert values.is_type("number", 1) and values.has_shape("list", "int", []) and not values.has_shape("list", "int", 3)
    assert values.parse("number", " 1.5 ") == 1.5 and values.parse("string", " x ") == " x "
    assert values.parse("bool", "TRUE") is True and values.parse("json", "[1, 2]", "list") == [1, 2]
    for kind, text in (("int", "1.5"), ("bool", "yes"), ("json", "{")):
        with pytest.raises(ValueError):
            values.parse(kind, text)


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": ["string", "null"]}, [None, "x"], [1]),
        ({"const": 1}, [1.0], [True]),
        ({"enum": ["a", {"b": 1}]}, [{"b": 1}], ["b"]),
        ({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False},
         [{"a": 1}], [{}, {"a": "x"}, {"a": 1, "b": 2}]),
        ({"items": {"minimum": 2}, "minItems": 1, "maxItems": 2}, [[2, 3]], [[], [1], [2, 2, 2]]),
        ({"minLength": 2, "maxLength": 3, "pattern": "b"}, ["ab"], ["a", "aaaa", "aa"]),
        ({"minimum": 0, "exclusiveMaximum": 5}, [0, 4.9], [-1, 5]),
        (True, [1, None], []),
        (False, [], [1]),
    ],
)
def test_schema_subset(schema, good, bad):
    assert values.schema_error(schema) is None
    assert all(values.violation(schema, x) is None for x in good)
    assert all(values.violation(schema, x) for x in bad)


def test_schema_paths_and_errors():
    schema = {"properties": {"a": {"items": {"type": "string"}}}}
    assert values.violation(schema, {"a": ["x", 1]}).startswith("$.a[1]")
    assert values.schema_error({"items": {"pattern": "("}}) and values.schema_error({"type": "thing"})
    assert values.shaped_violation("list", {"minimum": 3}, [3, 1]).startswith("$[1]")


def value_graph(**config):
    return read_graph(json.dumps({"nodes": [{"id": "v", "primitive": "value", "config": config}]}), KINDS)


def test_precedence_of_values(tmp_path, monkeypatch):
    def resolved(config, store=None, resolver=lambda b, k: None):
        g = value_graph(**config)
        return bind(g, store, resolver), g.nodes[0].config.get("resolved")

    store = Store()
    store.values["b"] = 5
    assert resolved({"type": "int", "literal": 1, "binding": "b"}, store) == ([], 1)
    assert resolved({"type": "int", "binding": "b", "default": 9}, store) == ([], 5)
    assert resolved({"type": "int", "binding": "c", "default": 9}, store) == ([], 9)
    assert resolved({"type": "int", "binding": "c", "default": 9}, store, lambda b, k: (7, False)) == ([], 7)
    assert len(resolved({"type": "int", "binding": "c"}, store)[0]) == 1
    store.values["b"] = "x"
    assert len(resolved({"type": "int", "binding": "b", "default": 9}, store)[0]) == 1
    monkeypatch.setenv("FRAMELOOM_BINDING_CAM_X_Y", "12")
    assert from_environment("cam.x-y", "int") == (12, False)
    assert chained(lambda b, k: None, from_environment)("cam.x-y", "int") == (12, False)
    monkeypatch.setenv("FRAMELOOM_BINDING_CAM_X_Y", "twelve")
    assert len(resolved({"type": "int", "binding": "cam.x-y", "default": 1}, Store(), from_environment)[0]) == 1
    kept = Store(str(tmp_path / "store.json"))
    assert resolved({"type": "int", "binding": "z"}, kept, lambda b, k: (3, True)) == ([], 3)
    assert json.loads((tmp_path / "store.json").read_text()) == {"z": 3}


def test_select_and_module_bindings():
    spec = {
        "nodes": [
            {"id": "list", "primitive": "value", "config": {"type": "json", "shape": "list", "literal": [1]}},
            {"id": "crit", "primitive": "value", "config": {"type": "json", "literal": 1}},
            {"id": "wired", "primitive": "select"},
            {"id": "bare", "primitive": "select"},
            {"id": "cam", "module": "table-source", "bindings": {"limit": {"type": "int", "binding": "cam.limit"}}},
        ],
        "edges": [{"from": "crit.value", "to": "wired.criterion"}, {"from": "list.value", "to": "wired.items"}],
    }
    g = read_graph(json.dumps(spec), KINDS)
    store = Store()
    store.values["cam.limit"] = 4
    assert bind(g, store) == ["bare: no criterion"]
    assert g.node("cam").config["limit"] == 4 and "resolved" not in g.node("wired").config


def test_live_values_are_checked():
    g = value_graph(type="int", literal=1, schema={"maximum": 10})
    bind(g)
    live, seen = LiveValues(), []
    live.register(g.nodes[0])
    live.listeners.append(lambda node, v: seen.append((node, v)))
    assert live.get("v") == 1 and live.try_set("v", "x") and live.try_set("v", 11) and live.try_set("w", 1)
    assert live.try_set("v", 7) is None and live.get("v") == 7 and seen == [("v", 7)]


@given(
    st.sampled_from(payloads.MEDIA_TYPES),
    st.sampled_from(payloads.ELEMENT_TYPES),
    st.lists(st.integers(0, 50), max_size=8),
    st.integers(0, 2**40),
)
def test_header_round_trip(media, element, shape, epoch):
    header = payloads.pack_header(media, element, shape, epoch)
    fields = payloads.unpack_header(header)
    assert len(header) == 192 and fields["shape"] == shape and fields["epoch"] == epoch
    assert (fields["media_type"], fields["element_type"]) == (media, element)
    for at in (0, 4, 6, 7, 8):
        assert payloads.unpack_header(header[:at] + b"\xff" + header[at + 1 :]) is None
    assert payloads.unpack_header(header[:100]) is None
