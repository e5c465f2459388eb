"""Operators on port columns of a wide row.

A port is a nullable struct column: null is a cycle without a message, and a
struct with a null field is a message whose payload is null. So every operator
of one cycle is an expression over its row, and fan-in needs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.jsons import canonical, deep_equal, field
from frameloom.functions.payloads import inverted, mean_byte

FRAME_FIELDS = (
    "camera_id",
    "sequence_number",
    "file_name",
    "source_path",
    "ts",
    "content_type",
    "content_length",
    "payload",
)


def frame_port(frames: DataFrame) -> Column:
    """The frame columns of a source as one port."""
    return F.struct(*[frames[c] for c in FRAME_FIELDS])


# -- gates and filters ------------------------------------------------------


def gate_signal(
    cycle: Column,
    *,
    enabled: bool = True,
    present: bool = True,
    sequence: Sequence[bool] = (),
    hold_last: bool = False,
) -> Column:
    """The simulated gate: a value for each cycle of ``sequence``, then the last
    one or ``present``; a disabled gate is false."""
    if not enabled:
        return F.lit(False)
    if not sequence:
        return F.lit(present)
    values = F.array(*[F.lit(x) for x in sequence])
    rest = F.lit(bool(sequence[-1]) if hold_last else present)
    return F.when(cycle < len(sequence), F.get(values, cycle.cast("int"))).otherwise(rest)


def accept(frame: Column, condition: Column) -> Column:
    """A processor or ``if``: the same frame where the condition holds."""
    return F.when(frame.isNotNull() & F.coalesce(condition, F.lit(False)), frame)


def bright_enough(frame: Column, minimum: float = 18.0) -> Column:
    return accept(frame, mean_byte(frame.getField("payload")) >= minimum)


def not_dark(frame: Column, decoded_mean: Column, minimum: float = 18.0, reject_failures: bool = True) -> Column:
    """Accept by the mean of the decoded picture; null is a failed decode."""
    return accept(frame, F.coalesce(decoded_mean >= minimum, F.lit(not reject_failures)))


def is_black(frame: Column, decoded_mean: Column, maximum: float = 40.0, failures_are_black: bool = True) -> Column:
    return accept(frame, F.coalesce(decoded_mean <= maximum, F.lit(failures_are_black)))


# -- classification and transformation --------------------------------------


def classification(label: Column, measurement: Column, unit: str | None, details: Column, source: str) -> Column:
    return F.struct(
        F.lit("classification").alias("signal_type"),
        F.lit(True).alias("value"),
        F.coalesce(label, F.lit("unknown")).alias("class_label"),
        measurement.cast("double").alias("measurement"),
        F.lit(unit).cast("string").alias("unit"),
        F.lit(source).alias("source"),
        details.alias("details"),
    )


def classify_brightness(frame: Column, maximum: float = 10.0, source: str = "worker:brightness") -> Column:
    """``black`` up to ``maximum``, else ``ok``; ``unknown`` for an empty frame."""
    payload = frame.getField("payload")
    n, mean = F.octet_length(payload), mean_byte(payload)
    label = F.when(n == 0, "unknown").when(mean <= maximum, "black").otherwise("ok")
    details = F.when(n == 0, "empty frame").otherwise(F.concat(F.lit("n="), n.cast("string")))
    return F.when(
        frame.isNotNull(), classification(label, F.when(n > 0, mean), "mean-byte", details, source)
    )


def classify_length(frame: Column, label: str = "seen", source: str = "worker:touch", details: str | None = None) -> Column:
    n = F.octet_length(frame.getField("payload"))
    return F.when(frame.isNotNull(), classification(F.lit(label), n, "bytes", F.lit(details).cast("string"), source))


def invert(frame: Column) -> Column:
    """The frame with every byte of its payload inverted."""
    return F.when(frame.isNotNull(), frame.withField("payload", inverted(frame.getField("payload"))))


def counted(df: DataFrame, port: str, name: str, cycle: str = "cycle_index", block: int = 1 << 16) -> DataFrame:
    """The stateful counter: how many messages ``port`` had up to each cycle.

    Cycles are counted inside blocks, and blocks start from the counts before
    them, so no task sees the whole stream. Rows without a cycle come last, and
    rows that share a cycle have the count of the last of them.
    """
    blocks = df.withColumn("_block", F.coalesce(F.floor(F.col(cycle) / block), F.lit((1 << 63) - 1)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("_block")
        .agg(F.count(port).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    upto = Window.partitionBy("_block").orderBy(F.col(cycle).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.col("_offset") + F.count(port).over(upto)
    signal = classification(
        F.when(count % 2 == 0, "even").otherwise("odd"),
        count,
        "count",
        F.concat(F.lit("seen "), count.cast("string")),
        "worker:counter",
    )
    return blocks.join(offsets, "_block").withColumn(name, F.when(F.col(port).isNotNull(), signal)).drop("_block", "_offset")


# -- routing ----------------------------------------------------------------


def route(frame: Column, signal: Column, ports: Sequence[str]) -> dict[str, Column]:
    """``switch``: the frame on the port named by the label, case aside, else on
    ``default`` if there is such a port; nothing without frame or signal."""
    label = F.lower(F.coalesce(signal.getField("class_label"), F.lit("")))
    both = frame.isNotNull() & signal.isNotNull()
    named = [p for p in ports if p.lower() != "default"]
    known = label.isin([p.lower() for p in named]) if named else F.lit(False)
    out = {p: F.when(both & (label == p.lower()), frame) for p in named}
    for p in ports:
        if p.lower() == "default":
            out[p] = F.when(both & (~known | (label == "default")), frame)
    return out


# -- values and selection ---------------------------------------------------


def value_signal(payload: Column, is_list: bool = False) -> Column:
    """A value or list message; its flag says whether it holds anything."""
    holds = F.size(payload) > 0 if is_list else payload.isNotNull()
    return F.struct(F.lit("list" if is_list else "value").alias("signal_type"), holds.alias("value"), payload.alias("payload"))


def matches(item: Column, criterion: Column, by: str | None = None, fields: Sequence[str] | None = None) -> Column:
    """Whether a JSON item fits: by one member; else an object criterion by all
    of its ``fields``; else as a whole."""
    if by is not None:
        return F.coalesce(field(item, by) == canonical(criterion), F.lit(False))
    if fields is not None:
        fit = F.lit(True)
        for name in fields:
            fit = fit & F.coalesce(field(item, name) == field(criterion, name), F.lit(False))
        return fit
    return deep_equal(item, criterion)


def select_one(items: Column, criterion: Column, **how) -> Column:
    """The first item that fits, as a value message; no message if none does."""
    found = F.get(F.filter(items, lambda x: matches(x, criterion, **how)), F.lit(0))
    return F.when(criterion.isNotNull() & found.isNotNull(), value_signal(found))


def select_many(items: Column, criterion: Column, **how) -> Column:
    """All items that fit, in order; a list message even if it is empty."""
    found = F.filter(items, lambda x: matches(x, criterion, **how))
    return F.when(items.isNotNull() & criterion.isNotNull(), value_signal(found, is_list=True))


def criterion_of(edge: Column | None, live: Column | None, static: Column | None) -> Column:
    """An edge message decides, even one with a null payload; without one the
    live value, then the static one."""
    fallback = F.coalesce(*[x for x in (live, static) if x is not None], F.lit(None).cast("string"))
    return fallback if edge is None else F.when(edge.isNotNull(), edge.getField("payload")).otherwise(fallback)


# -- fan-in -----------------------------------------------------------------


def in_step(*sides: DataFrame, cycle: str = "cycle_index", all_needed: bool = False) -> DataFrame:
    """Pair separate inputs by cycle: a row where any has a message, or all."""
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, cycle, "inner" if all_needed else "full_outer")
    return out
