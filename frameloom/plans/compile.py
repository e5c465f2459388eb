"""A checked graph as one DataFrame: a row per cycle, a column per output port.

Nodes add columns in order, so routing, fan-in and selection are expressions
over one row; only a counter needs a window, and only further sources a join.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.images import decoded_mean
from frameloom.operators import ports as op
from frameloom.operators import sinks
from frameloom.plans.binding import LiveValues, Store, bind
from frameloom.plans.checks import issues
from frameloom.plans.graph import Graph, GraphError, Node, in_order, read_graph
from frameloom.sources.frames import max_cycles, replay

#: (frame, config) to the result port of a module node.
Module = Callable[[Column, dict[str, Any]], Column]

PROCESSORS: dict[str, Module] = {
    "brightness-gate": lambda f, c: op.bright_enough(f, c.get("minimumMeanByte", 18)),
    "dark-frame-filter": lambda f, c: op.not_dark(
        f, decoded_mean(f), c.get("minimumMean", 18), c.get("rejectOnDecodeFailure", True)
    ),
    "black-screen-check": lambda f, c: op.is_black(
        f, decoded_mean(f), c.get("maximumMean", 40), c.get("treatDecodeFailureAsBlack", True)
    ),
    "invert-transformer": lambda f, c: op.invert(f),
}
CLASSIFIERS: dict[str, Module] = {
    "brightness-classifier": lambda f, c: op.classify_brightness(f, c.get("maximumMean", 10.0)),
    "touch": lambda f, c: op.classify_length(f),
    "warmup-classifier": lambda f, c: op.classify_length(f, label="ok", source="worker:warmup", details="warmed up"),
    "mean": lambda f, c: F.when(
        f.isNotNull(),
        op.classification(F.lit("seen"), op.mean_byte(f.getField("payload")), "mean", F.lit(None).cast("string"), "worker:mean"),
    ),
}
#: Kinds of the modules that graphs may name; ``register`` adds to them.
KINDS = {
    "folder-source": "source",
    "table-source": "source",
    "product-gate": "gate",
    "dataset-writer": "sink",
    "frame-counter": "classifier",
    **dict.fromkeys(PROCESSORS, "processor"),
    **dict.fromkeys(CLASSIFIERS, "classifier"),
}


def register(name: str, kind: str, module: Module) -> None:
    """Add a module of kind processor (a transformer too) or classifier."""
    if kind not in ("processor", "classifier"):
        raise ValueError(f"modules of kind '{kind}' can't be added")
    (PROCESSORS if kind == "processor" else CLASSIFIERS)[name] = module
    KINDS[name] = kind


def column(node: str, port: str) -> str:
    return f"{node}__{port}".lower()


@dataclass
class Compiled:
    """The wide DataFrame of a graph and where its sinks and nodes are in it."""

    graph: Graph
    frame: DataFrame
    sink_ports: dict[str, str] = field(default_factory=dict)
    node_ports: dict[str, str] = field(default_factory=dict)

    def sink(self, node: str) -> DataFrame:
        """Records of one sink, numbered in cycle order."""
        return sinks.records(self.frame, self.sink_ports[node])

    def report(self) -> DataFrame:
        return sinks.run_report(self.frame, list(self.sink_ports.values()))

    def stats(self) -> DataFrame:
        return sinks.node_stats(self.frame, self.node_ports)


def _literal(value: Any, is_list: bool) -> Column:
    if is_list:
        return F.array(*[F.lit(json.dumps(x)) for x in value]).cast("array<string>")
    return F.lit(None if value is None else json.dumps(value)).cast("string")


def _select(node: Node, port: Callable[[str], Column | None], live: LiveValues | None) -> Column:
    c, items, edge = node.config, port("items"), port("criterion")
    now = live.get(node.id) if live else None
    static = c.get("resolved", c.get("where"))
    criterion = op.criterion_of(edge, None if now is None else _literal(now, False), _literal(static, False))
    known = now if now is not None else static
    how: dict[str, Any] = {"by": c.get("by")}
    if c.get("by") is None and isinstance(known, dict) and edge is None:
        how["fields"] = list(known)
    pick = op.select_many if str(c.get("mode", "one")).lower() == "many" else op.select_one
    payload = items.getField("payload") if items is not None else F.lit(None).cast("array<string>")
    return pick(payload, criterion, **how)


def _columns(node: Node, graph: Graph, live: LiveValues | None) -> dict[str, Column]:
    """The output ports of a node that is neither a source nor a counter."""
    inbound = graph.inbound(node)

    def port(name: str) -> Column | None:
        e = inbound.get(name.lower())
        return None if e is None else F.col(column(e.from_node, e.from_port))

    c, module = node.config, node.module
    frame = port("frame")
    if frame is None and any(p.name == "frame" for p in node.inputs):
        return {p.name: F.lit(None) for p in node.outputs}
    if module in PROCESSORS:
        return {"frame": PROCESSORS[module](frame, c)}
    if module in CLASSIFIERS:
        return {"class": CLASSIFIERS[module](frame, c)}
    if module == "product-gate":
        present = op.gate_signal(
            F.col("cycle_index"),
            enabled=c.get("enabled", True),
            present=c.get("productPresent", True),
            sequence=c.get("sequence", ()),
            hold_last=c.get("holdLastSequenceValue", False),
        )
        return {"productPresent": F.struct(F.lit("boolean-gate").alias("signal_type"), present.alias("value"))}
    if node.is_primitive("fork"):
        return {p.name: frame for p in node.outputs}
    if node.is_primitive("if"):
        gate = port("productPresent")
        return {"acceptedFrame": op.accept(frame, gate.getField("value")) if gate is not None else F.lit(None)}
    if node.is_primitive("switch"):
        signal = port("class")
        names = [p.name for p in node.outputs]
        return op.route(frame, signal, names) if signal is not None else {p: F.lit(None) for p in names}
    if node.is_primitive("value"):
        now = live.get(node.id) if live else None
        is_list = str(c.get("shape", "")).lower() == "list"
        return {"value": op.value_signal(_literal(c.get("resolved") if now is None else now, is_list), is_list)}
    if node.is_primitive("select"):
        return {"selected": _select(node, port, live)}
    raise GraphError(f"node '{node.id}' can't be compiled")


def _passes(graph: Graph, most: int) -> tuple[int | None, int]:
    """(passes over the sources, most cycles) by the graph's loop."""
    loop = next((n for n in graph.nodes if n.is_primitive("loop")), None)
    mode = str(loop.config.get("mode", "until-exhausted")).lower() if loop else "until-exhausted"
    if mode == "count":
        count = int(loop.config["count"])
        return 1, count if most <= 0 else min(count, most)
    if mode == "forever":
        if most <= 0:
            raise GraphError("a batch run of a loop without end needs a number of cycles")
        return None, most
    return 1, most


def compile_graph(
    graph: Graph | str,
    sources: dict[str, DataFrame],
    *,
    cycles: int = 0,
    store: Store | None = None,
    live: LiveValues | None = None,
) -> Compiled:
    """Check, bind and compile a graph over the frames of its source nodes.

    Only settings and counts are read on the driver. Sources of different
    length end with the shortest, as they are paired by cycle.
    """
    if isinstance(graph, str):
        graph = read_graph(graph, KINDS)
    found = issues(graph)
    for node in graph.nodes:
        twice = [e for e in graph.edges if e.to_node.lower() == node.id.lower() and e.kind != "loop"]
        if len({e.to_port.lower() for e in twice}) < len(twice):
            found.append(("pipeline.edge.duplicate-input", node.id))
    if found:
        raise GraphError("; ".join(f"{code}: {subject}" for code, subject in found))
    if errors := bind(graph, store):
        raise GraphError("; ".join(errors))
    order = in_order(graph)
    passes, most = _passes(graph, cycles)
    wide: DataFrame | None = None
    out = Compiled(graph, None)  # type: ignore[arg-type]
    for node in order:
        if node.category != "source":
            continue
        frames = sources[node.id]
        if passes is None:
            n = frames.count()
            frames = replay(frames, -(-most // n)) if n else frames
        frames = max_cycles(frames, most)
        name = column(node.id, "frame")
        side = frames.select("cycle_index", op.frame_port(frames).alias(name))
        wide = side if wide is None else wide.join(side, "cycle_index")
        out.node_ports[node.id] = name
    if wide is None:
        raise GraphError("the graph has no source")
    for node in order:
        if node.category == "source" or node.is_primitive("loop"):
            continue
        if node.category == "output":
            e = graph.inbound(node).get("frame")
            if e is not None:
                out.sink_ports[node.id] = column(e.from_node, e.from_port)
            continue
        if node.module == "frame-counter":
            e = graph.inbound(node)["frame"]
            wide = op.counted(wide, column(e.from_node, e.from_port), column(node.id, "class"))
            out.node_ports[node.id] = column(node.id, "class")
            continue
        made = _columns(node, graph, live)
        wide = wide.withColumns({column(node.id, p): c for p, c in made.items()})
        if made:
            out.node_ports[node.id] = column(node.id, next(iter(made)))
    out.frame = wide
    return out
