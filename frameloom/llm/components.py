"""Connected components of an edge table, as Spark joins.

Every node hooks onto its least neighbour; both ends of each edge are replaced
by what they hooked onto, loops and repeats fall away, and the rest goes
around again until no edge is left. Then the hooks are followed back. Groups
of near copies, mostly stars, take two or three turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.shared import written


def components(edges: DataFrame, *, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long); the component
    is its least node. Loops and repeated edges are harmless; edges with a null
    end are left out.

    A hook stays inside its component, and the least node hooks onto itself, so
    replacing ends by hooks keeps components apart and connected. All tables
    are written before they are joined: where one node has very many edges, the
    join is one of plain tables, whose skew Spark splits.
    """
    left = edges.select("u", "v").where("u <> v")
    hooks = []
    for _ in range(most_rounds):
        ends = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(ends.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("onto")), "hooks")
        hooks.append(hook)
        u, v = hook.toDF("u", "hu"), hook.toDF("v", "hv")
        left = written(
            left.join(u, "u").join(v, "v").where("hu <> hv").select(F.greatest("hu", "hv").alias("u"), F.least("hu", "hv").alias("v")).distinct(),
            "edges",
        )
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = hooks.pop().toDF("node", "component")
    for hook in reversed(hooks):
        found = written(
            hook.join(found.toDF("onto", "component"), "onto", "left").select(
                "node", F.coalesce("component", "onto").alias("component")
            ),
            "components",
        )
    return found
