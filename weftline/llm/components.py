"""Connected components of an edge table, without collecting edges or labels.

Every round each node hooks to the neighbour (or itself) that comes first in an order drawn anew
for the round, hooks are followed once more, and the edges between different hooks remain. The
expected number of edges falls by a constant factor a round. Once at most ``small`` edges remain,
one task joins them by union-find. The rounds' hooks are then composed and every component named
by its least node.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


def _union_find(t: pa.Table) -> pa.Table:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in zip(t["u"].to_pylist(), t["v"].to_pylist(), strict=True):
        a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
        parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pa.table([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "p"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of all nodes with an edge to another node.

    Null ends, self edges and repeated edges have no effect; no edges give no rows.
    """
    s, d = F.col(src).cast("long"), F.col(dst).cast("long")
    rest = cut(edges.select(F.least(s, d).alias("u"), F.greatest(s, d).alias("v")).filter("u < v").distinct())
    hooks: list[DataFrame] = []
    for seed in range(max_rounds):
        n = rest.count()
        if n <= small:
            if n:
                hooks.append(cut(rest.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_union_find, "u long, p long")))
            break
        order = F.xxhash64("v", F.lit(seed))
        both = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.union(both.select("u", F.col("u").alias("v")))
        hook = cut(ends.groupBy("u").agg(F.min(F.struct(order.alias("k"), F.col("v").alias("v"))).alias("m")).select("u", F.col("m.v").alias("p")))
        hook = cut(hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")))
        hooks.append(hook)
        step = rest.join(hook, "u").select(F.col("p").alias("a"), F.col("v").alias("u")).join(hook, "u").select("a", F.col("p").alias("b"))
        rest = cut(step.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not hooks:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = hooks[0].select(F.col("u").alias("node"), "p")
    for hook in hooks[1:]:
        label = label.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("node", F.coalesce("q", "p").alias("p"))
    label = cut(label)
    return label.join(label.groupBy("p").agg(F.min("node").alias("component")), "p").select("node", "component")
