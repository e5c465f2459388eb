"""Graphs over streams, and the frame counter as streaming state.

A graph without a counter compiles to the same projections on a stream. The
counter keeps its state in Spark's state store, so a run that stops goes on
from its checkpoint; the checkpoint of a run that came to its end is removed.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNTED = "cycle_index long, camera_id string, count long, label string, unit string, details string"


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    rows = pd.concat(frames).sort_values("cycle_index")
    n = range(seen + 1, seen + len(rows) + 1)
    state.update((seen + len(rows),))
    yield pd.DataFrame(
        {
            "cycle_index": rows["cycle_index"].to_numpy(),
            "camera_id": rows["camera_id"].to_numpy(),
            "count": list(n),
            "label": ["even" if x % 2 == 0 else "odd" for x in n],
            "unit": "count",
            "details": [f"seen {x}" for x in n],
        }
    )


def counted_stream(frames: DataFrame, by: str | None = None) -> DataFrame:
    """Running count of a stream's frames, for each ``by`` or over all.

    A count over all frames is one key, as its definition asks; count by camera
    where a stream is too wide for one task.
    """
    key = F.col(by) if by else F.lit("all")
    return (
        frames.select("cycle_index", "camera_id", key.alias("_key"))
        .groupBy("_key")
        .applyInPandasWithState(_count, COUNTED, "seen long", "append", GroupStateTimeout.NoTimeout)
    )


#: Names under which ``onError`` asks for restarts.
RESTARTS = {"restart", "retry", "reconnect", "forever"}


def restart_pauses(on_error: Any) -> Iterator[float]:
    """Seconds to wait before each restart that an ``onError`` setting grants.

    The setting is a name, or an object with a mode, a limit (0: no end) and the
    first and the longest pause in milliseconds; pauses double. Any other setting
    grants none.
    """
    spec = on_error if isinstance(on_error, dict) else {"mode": on_error}
    if str(spec.get("mode")).strip().lower() not in RESTARTS:
        return
    limit = max(0, spec.get("limit", spec.get("maxRetries", 0)))
    longest = max(0, spec.get("maxBackoffMs", 5_000))
    pause = max(0, spec.get("backoffMs", 500))
    for _ in range(limit) if limit else itertools.count():
        pause = min(pause, longest)
        yield pause / 1000
        pause *= 2


def run_to_end(
    stream: DataFrame,
    batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    clear_when_done: bool = True,
    on_error: Any = None,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Run a stream over what there is, batch by batch, and tell how often it was
    restarted. A failure restarts it from its checkpoint as ``on_error`` grants; one
    more is raised and leaves the checkpoint, from which the next call goes on."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    pauses, restarts = restart_pauses(on_error), 0
    while True:
        try:
            writer.start().awaitTermination()
            break
        except StreamingQueryException:
            pause = next(pauses, None)
            if pause is None:
                raise
            restarts += 1
            sleep(pause)
    if clear_when_done:
        spark = stream.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return restarts
