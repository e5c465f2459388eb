"""Python functions as modules: Arrow batches in, null instead of a failure out.

A module's function sees the bytes of one payload. It is called batch by batch
inside an Arrow UDF; ``on_start`` runs once in each worker before the first. A
payload on which it fails gives no output in that cycle and the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.operators.ports import accept, classification
from frameloom.plans.compile import Module

_LABEL = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("measurement", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("failed", T.BooleanType()),
    ]
)
_LABEL_ARROW = pa.struct(
    [("label", pa.string()), ("measurement", pa.float64()), ("unit", pa.string()), ("details", pa.string()), ("failed", pa.bool_())]
)


def _each(work: Callable[[bytes], Any], on_start: Callable[[], None] | None) -> Callable[[pa.Array], list]:
    started: list[bool] = []

    def run(payload: pa.Array) -> list:
        if on_start and not started:
            on_start()
            started.append(True)
        out = []
        for value in payload:
            try:
                out.append(None if not value.is_valid else (work(value.as_py()),))
            except Exception:
                out.append(None)
        return out

    return run


def classifier(
    work: Callable[[bytes], dict[str, Any]], *, source: str = "worker", on_start: Callable[[], None] | None = None
) -> Module:
    """A classifier from a function to label, measurement, unit and details."""
    each = _each(work, on_start)

    @F.arrow_udf(_LABEL)
    def labelled(payload: pa.Array) -> pa.Array:
        rows = [{"failed": True} if x is None else {**x[0], "failed": False} for x in each(payload)]
        return pa.array([{k: r.get(k) for k in ("label", "measurement", "unit", "details", "failed")} for r in rows], _LABEL_ARROW)

    def build(frame: Column, config: dict[str, Any]) -> Column:
        got = labelled(frame.getField("payload"))
        signal = classification(got.getField("label"), got.getField("measurement"), None, got.getField("details"), source)
        signal = signal.withField("unit", got.getField("unit"))
        return F.when(frame.isNotNull() & ~got.getField("failed"), signal)

    return build


def processor(work: Callable[[bytes], bool], *, on_start: Callable[[], None] | None = None) -> Module:
    """A filter from a function that accepts a payload or not."""
    each = _each(work, on_start)

    @F.arrow_udf(T.BooleanType())
    def accepted(payload: pa.Array) -> pa.Array:
        return pa.array([x is not None and bool(x[0]) for x in each(payload)], pa.bool_())

    return lambda frame, config: accept(frame, accepted(frame.getField("payload")))


def transformer(work: Callable[[bytes], bytes | None], *, on_start: Callable[[], None] | None = None) -> Module:
    """A transformer from a function to new bytes, or None to drop the frame."""
    each = _each(work, on_start)

    @F.arrow_udf(T.BinaryType())
    def changed(payload: pa.Array) -> pa.Array:
        return pa.array([x and x[0] for x in each(payload)], pa.binary())

    def build(frame: Column, config: dict[str, Any]) -> Column:
        payload = changed(frame.getField("payload"))
        made = frame.withField("payload", payload).withField("content_length", F.octet_length(payload).cast("long"))
        return F.when(frame.isNotNull() & payload.isNotNull(), made)

    return build
