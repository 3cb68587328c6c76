"""Graphs as node and edge tables: construction, fusion and measures.

edges has src < dst and weight, one row an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def undirected(dep: DataFrame) -> DataFrame:
    return dep.filter("src <> dst and weight > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def fuse(static: DataFrame, evo: DataFrame, alpha: float = 0.6, threshold: float = 0.1, concept: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """Weighted mean of graphs, each scaled by its own maximum; without any evo edge the static one as it is."""
    beta = min(beta, 1 - alpha)
    top = static.agg(F.max("weight").alias("ms")).crossJoin(evo.agg(F.max("weight").alias("me")))
    s = static.select("src", "dst", F.col("weight").alias("static_weight"))
    e = evo.select("src", "dst", F.col("weight").alias("evo_weight"))
    j = s.join(e, ["src", "dst"], "full").join(F.broadcast(top))
    sw = F.coalesce(F.col("static_weight") / F.col("ms"), F.lit(0.0))
    ew = F.coalesce(F.col("evo_weight") / F.col("me"), F.lit(0.0))
    mixed = alpha * sw + (1 - alpha - beta) * ew
    if concept is not None and beta > 0:
        cm = concept.agg(F.max("weight").alias("mc"))
        c = concept.select("src", "dst", F.col("weight").alias("concept_weight"))
        j = j.join(c, ["src", "dst"], "full").join(F.broadcast(cm))
        mixed = mixed + beta * F.coalesce(F.col("concept_weight") / F.col("mc"), F.lit(0.0))
    w = F.when(F.col("me").isNull(), F.col("static_weight")).otherwise(mixed)
    return j.withColumn("weight", w).filter(F.col("weight") >= threshold).select("src", "dst", "weight")


def adaptive_alpha(edges: DataFrame, heat: DataFrame) -> DataFrame:
    """alpha of each edge: 0.8 - 0.6 * mean heat of its ends (node, score)."""
    a = heat.select(F.col("node").alias("src"), F.col("score").alias("h1"))
    b = heat.select(F.col("node").alias("dst"), F.col("score").alias("h2"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("alpha", 0.8 - 0.3 * (F.coalesce("h1", F.lit(0.0)) + F.coalesce("h2", F.lit(0.0))))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").union(edges.select("dst", "src", "weight"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(d, "node", "left").join(F.broadcast(n)).select("node", F.coalesce(F.try_divide(F.coalesce("d", F.lit(0)), F.col("n") - 1), F.lit(0.0)).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, steps: int = 20, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank after so many steps; nodes without edges give their rank to all."""
    from weftline.operators.lineage import cut

    # shares and ranks are written: every step reads them, and none computes an earlier one again
    n = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))
    out = cut(ends(edges).withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("node"))).select("node", "other", "share"))
    linked = out.select("node").distinct().withColumn("linked", F.lit(True))
    rank = cut(nodes.join(n).join(linked, "node", "left").select("node", "n", F.coalesce("linked", F.lit(False)).alias("linked"), (1 / F.col("n")).alias("r")))
    for _ in range(steps):
        loose = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("r"))), F.lit(0.0)).alias("loose")))
        given = rank.select("node", "r").join(out, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("r") * F.col("share")).alias("in"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("in", F.lit(0.0)) + F.col("loose") / F.col("n"))
        rank = cut(rank.drop("r").join(given, "node", "left").join(loose).select("node", "n", "linked", new.alias("r")))
    return rank.select("node", F.col("r").alias("score"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (least node): minimum labels passed on and jumped until none changes."""
    from weftline.operators.lineage import cut

    both = cut(ends(edges).select("node", "other"))
    label = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("low"))
        new = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = cut(new.join(jump, "c").select("node", "old", F.least("c", "cc").alias("component")))
        done = new.filter("old <> component").isEmpty()
        label = new.drop("old")
        if done:
            return label


def triangles(edges: DataFrame) -> DataFrame:
    """node, t: triangles each node is in."""
    e = edges.select("src", "dst")
    tri = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"])
    return tri.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    pairs = F.col("d") * (F.col("d") - 1)
    return nodes.join(d, "node", "left").join(triangles(edges), "node", "left").select("node", F.coalesce(F.try_divide(2 * F.coalesce("t", F.lit(0)), pairs), F.lit(0.0)).alias("clustering"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    c = clustering(nodes, edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("avg_clustering"))
    return n.crossJoin(m).crossJoin(c).select("n", "m", F.coalesce(F.try_divide(2 * F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide(2 * F.col("m"), F.col("n")), F.lit(0.0)).alias("avg_degree"), "avg_clustering")


def evolutionary(coupling: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, weight: coupled names (m1, m2, coupling) as edges of the nodes that bear them.

    names maps a name to its signatures; edges need both nodes, none joins a node with itself, and of
    several that join the same two the strongest counts.
    """
    known = names.join(nodes.select(F.col("node").alias("signature")), "signature", "left_semi").select("name", "signature").distinct()
    a, b = known.select(F.col("name").alias("m1"), F.col("signature").alias("a")), known.select(F.col("name").alias("m2"), F.col("signature").alias("b"))
    pairs = coupling.join(a, "m1").join(b, "m2").filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("coupling").alias("weight"))


def history_alpha(alpha: Column, commits: Column, evolutionary_edges: Column) -> Column:
    """alpha, but 0.95 or more where fewer than five commits gave edges."""
    return F.when((commits < 5) & (evolutionary_edges > 0), F.greatest(alpha, F.lit(0.95))).otherwise(alpha)


def with_centrality(nodes: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """nodes with a score (node, score) as column name; 0 for nodes without one."""
    return nodes.join(scores.select("node", F.col("score").alias(name)), "node", "left").fillna(0.0, [name])


def eigenvector(edges: DataFrame, most: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """graph_id, node, score: weighted eigenvector centrality by power iteration of A + I, length 1.

    One task a graph (the members of one class). A graph that does not settle in so many steps, that is
    until the scores change by less than tolerance a node, gives no rows.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        names, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        src, dst = at[: len(pdf)], at[len(pdf) :]
        weight = pdf["weight"].to_numpy(float)
        loop = src == dst
        x = np.full(len(names), 1 / len(names))
        for _ in range(most):
            more = np.bincount(src, weight * x[dst], len(names)) + np.bincount(dst[~loop], (weight * x[src])[~loop], len(names))
            new = x + more
            new /= np.sqrt((new * new).sum()) or 1.0
            if np.abs(new - x).sum() < len(names) * tolerance:
                return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": names, "score": new})
            x = new
        return pd.DataFrame({"graph_id": [], "node": [], "score": []})

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id long, node long, score double")
