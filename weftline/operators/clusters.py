"""Measures, tiers, filters and ranks of a given partition of a graph, and two detectors of one.

part has (node, cluster_id); edges src < dst with weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import ends


def placed(edges: DataFrame, part: DataFrame) -> DataFrame:
    a = part.select(F.col("node").alias("src"), F.col("cluster_id").alias("c1"))
    b = part.select(F.col("node").alias("dst"), F.col("cluster_id").alias("c2"))
    return edges.join(a, "src").join(b, "dst")


def quality(edges: DataFrame, part: DataFrame, gamma: float = 1.0) -> DataFrame:
    """The resolution quality of a partition, raw and over twice the total weight."""
    total = edges.agg((2 * F.sum("weight")).alias("m2"))
    k = ends(edges).join(part, "node").groupBy("cluster_id").agg(F.sum("weight").alias("k"))
    inside = placed(edges, part).filter("c1 = c2").groupBy(F.col("c1").alias("cluster_id")).agg((2 * F.sum("weight")).alias("w"))
    q = k.join(inside, "cluster_id", "left").join(F.broadcast(total)).select((F.coalesce("w", F.lit(0.0)) - gamma * F.col("k") * F.col("k") / F.col("m2")).alias("q"), "m2")
    return q.agg(F.sum("q").alias("raw_quality"), (F.sum("q") / F.max("m2")).alias("modularity"))


def metrics(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Cohesion, coupling, their product, conductance and size of each cluster.

    Conductance counts each internal edge twice and divides the cut by that, as published.
    """
    p = placed(edges, part)
    sides = p.select(F.col("c1").alias("cluster_id"), "weight", (F.col("c1") == F.col("c2")).alias("inner")).union(p.filter("c1 <> c2").select("c2", "weight", F.lit(False)))
    m = sides.groupBy("cluster_id").agg(F.avg(F.when(F.col("inner"), F.col("weight"))).alias("ci"), F.avg(F.when(~F.col("inner"), F.col("weight"))).alias("co"), F.sum(F.when(F.col("inner"), 2 * F.col("weight")).otherwise(0.0)).alias("internal"), F.sum(F.when(~F.col("inner"), F.col("weight")).otherwise(0.0)).alias("cutw"))
    coh, out = F.coalesce("ci", F.lit(0.0)), F.coalesce("co", F.lit(0.0))
    coup = F.least(F.lit(1.0), F.when(coh > 0, out / F.nullif(coh, F.lit(0.0))).otherwise(out))
    cond = F.when((F.col("internal") == 0) & (F.col("cutw") == 0), 0.0).when(F.col("internal") == 0, 1.0).otherwise(F.try_divide(F.col("cutw"), F.col("internal")))
    size = part.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return size.join(m, "cluster_id", "left").select("cluster_id", "size", coh.alias("cohesion"), F.coalesce(coup, F.lit(0.0)).alias("coupling"), (coh * (1 - F.coalesce(coup, F.lit(0.0)))).alias("score"), F.coalesce(cond, F.lit(0.0)).alias("conductance"))


def coverage(edges: DataFrame, part: DataFrame) -> DataFrame:
    return placed(edges, part).agg((F.sum((F.col("c1") == F.col("c2")).cast("int")) / F.count(F.lit(1))).alias("coverage"))


def size_score(n: Column, most: int = 30, ideal: int = 6) -> Column:
    inner = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(n - ideal) / (most - ideal))) if most > ideal else F.lit(1.0)
    return F.when(n <= 0, 0.0).otherwise(inner)


def rank_score(modularity: Column, cohesion: Column, coupling: Column, size: Column, silhouette: Column | None = None, stability: Column | None = None) -> Column:
    s = 0.25 * modularity + 0.35 * cohesion + 0.15 * (1 - coupling) + 0.10 * size_score(size)
    if silhouette is not None:
        s = s + F.coalesce(0.10 * F.greatest(F.lit(0.0), silhouette), F.lit(0.0))
    return s + F.coalesce(0.05 * stability, F.lit(0.0)) if stability is not None else s


def tier(evo: Column, cohesion: Column, coupling: Column, size: Column) -> tuple[Column, Column]:
    """Points of a cluster and its tier; a mean pair coupling of exactly 0 earns no points."""
    e = F.when(evo.isNull(), 5).when(evo > 0.5, 30).when(evo > 0.3, 20).when(evo > 0, 10).otherwise(0)
    c = F.when(cohesion > 0.7, 35).when(cohesion > 0.5, 25).when(cohesion > 0.3, 15).otherwise(5)
    x = F.when(coupling < 0.3, 25).when(coupling < 0.5, 15).when(coupling < 0.7, 5).otherwise(0)
    n = F.when(size.between(3, 10), 10).when(size > 10, 5).otherwise(0)
    points = e + c + x + n
    return points, F.when(points >= 70, "should").when(points >= 40, "could").otherwise("potential")


def reject_reason(size: Column, cohesion: Column, modularity: Column, least: int = 3, most: int = 30, min_cohesion: float = 0.35) -> Column:
    """The first rule a cluster fails, or null."""
    return F.when(size < least, "too small").when(size > most, "too large").when((modularity > 0) & (cohesion < min_cohesion), "low cohesion")


_EDGES = "graph_id long, node long, community long"


def louvain(edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """graph_id, node, community of each graph; one task a graph (a class has some hundred members).

    Nodes are visited in order, ties go to the least community: the same input, the same partition.
    """

    def run(pdf):
        import pandas as pd

        from weftline.operators.kernels import louvain_partition

        nodes, label = louvain_partition(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(float), gamma)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": nodes, "community": label})

    return edges.groupBy("graph_id").applyInPandas(run, _EDGES)


def leiden(edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """graph_id, node, community, quality (the graph's, not normalised) of each graph; one task a graph.

    Communities are connected, and no partition of Louvain's is better (see kernels.leiden_partition).
    Communities are named by their least nodes.
    """

    def run(pdf):
        import pandas as pd

        from weftline.operators.kernels import leiden_partition

        nodes, label, score = leiden_partition(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(float), gamma)
        found = pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": nodes, "community": label, "quality": score})
        found["community"] = found.groupby("community")["node"].transform("min")
        return found

    return edges.groupBy("graph_id").applyInPandas(run, f"{_EDGES}, quality double")


def graph_quality(edges: DataFrame, part: DataFrame, gamma: float = 1.0) -> DataFrame:
    """graph_id, raw_quality, modularity of a partition (graph_id, node, community) of each graph."""
    a = part.select("graph_id", F.col("node").alias("src"), F.col("community").alias("c1"))
    b = part.select("graph_id", F.col("node").alias("dst"), F.col("community").alias("c2"))
    x = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select("graph_id", "c1", "c2", "weight")
    ends_ = x.select("graph_id", F.explode(F.array("c1", "c2")).alias("c"), "weight", (F.col("c1") == F.col("c2")).alias("inside"))
    k = ends_.groupBy("graph_id", "c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("i"))
    g = k.groupBy("graph_id").agg(F.sum("k").alias("m2"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    raw = F.col("i") - gamma * F.try_divide("kk", "m2")
    return g.select("graph_id", F.coalesce(raw, F.lit(0.0)).alias("raw_quality"), F.coalesce(F.try_divide(raw, F.col("m2")), F.lit(0.0)).alias("modularity"))


def apart(edges: DataFrame, part: DataFrame) -> DataFrame:
    """graph_id, community, parts: into how many connected parts each community of a partition falls."""
    from weftline.operators.graph import components

    named = part.select("graph_id", "node", "community", F.concat_ws(":", "graph_id", "node").alias("name"))
    a = named.select("graph_id", F.col("node").alias("src"), F.col("community").alias("c1"), F.col("name").alias("s"))
    b = named.select("graph_id", F.col("node").alias("dst"), F.col("community").alias("c2"), F.col("name").alias("d"))
    inner = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).filter("c1 = c2").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    joined = named.join(components(named.select(F.col("name").alias("node")), inner).withColumnRenamed("node", "name"), "name")
    return joined.groupBy("graph_id", "community").agg(F.countDistinct("component").alias("parts"))


def fallback(nodes: DataFrame, most: int = 30, least: int = 3) -> DataFrame:
    """graph_id, node, community, source for graphs without edges, of nodes (graph_id, node, name): one
    community of all (single), or, of more than most nodes, the groups of names with least members
    or more (names). Communities are named by their least nodes."""
    from pyspark.sql import Window

    graph, group = Window.partitionBy("graph_id"), Window.partitionBy("graph_id", "g")
    x = nodes.withColumn("g", name_group(F.col("name"))).withColumn("n", F.count(F.lit(1)).over(graph)).withColumn("m", F.count(F.lit(1)).over(group))
    large = F.col("n") > most
    x = x.filter(~large | (F.col("m") >= least))
    return x.select("graph_id", "node", F.when(large, F.min("node").over(group)).otherwise(F.min("node").over(graph)).alias("community"), F.when(large, "names").otherwise("single").alias("source"))


def detect(nodes: DataFrame, edges: DataFrame, algorithm: str = "leiden", gamma: float = 1.0, gammas: tuple[float, ...] | None = None, stable: bool = False, most: int = 30) -> DataFrame:
    """graph_id, node, community, source of all nodes (graph_id, node, name) of all graphs.

    Graphs without edges fall back (see fallback). The others are cut by resolutions (gammas), else by
    consensus (stable), else by the algorithm at gamma; nodes without an edge are communities of their
    own. Communities are named by their least nodes. No nodes, no rows.
    """
    from pyspark.sql import Window

    if algorithm not in ("leiden", "louvain"):
        raise ValueError(f"no algorithm {algorithm}")
    found = multi_resolution(edges, gammas) if gammas else consensus(edges) if stable else leiden(edges, gamma) if algorithm == "leiden" else louvain(edges, gamma)
    own = Window.partitionBy("graph_id", "community")
    found = found.select("graph_id", "node", F.min("node").over(own).alias("community"))
    linked = edges.select("graph_id").distinct()
    placed = nodes.join(linked, "graph_id", "left_semi").select("graph_id", "node").join(found, ["graph_id", "node"], "left")
    placed = placed.select("graph_id", "node", F.coalesce("community", "node").alias("community"), F.lit("communities").alias("source"))
    return placed.unionByName(fallback(nodes.join(linked, "graph_id", "left_anti"), most))


def records(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """graph_id, community, members (names, sorted), methods, fields of what detect finds; nodes have a
    kind, by default method."""
    kind = F.coalesce("kind", F.lit("method"))
    x = nodes.select("graph_id", "node", "name", kind.alias("kind")).join(found, ["graph_id", "node"])
    return x.groupBy("graph_id", "community").agg(F.array_sort(F.collect_list("name")).alias("members"), F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") != "method").alias("fields"))


def betweenness(edges: DataFrame) -> DataFrame:
    """graph_id, node, score: weights are distances; one task a graph."""

    def run(pdf):
        import pandas as pd

        from weftline.operators.kernels import brandes

        nodes, score = brandes(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(float))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": nodes, "score": score})

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id long, node long, score double")


#: Verbs that begin method names.
VERBS = (
    "is|has|get|set|contains?|starts?|ends?|split|join|strip|trim|pad|remove|replace|substring|index|count|check|validate|find|search|"
    "parse|format|convert|to|from|create|build|add|append|prepend|insert|delete|truncate|wrap|unwrap|escape|unescape|encode|decode|normalize|"
    "compare|equals?|matches?|empty|blank|null|default|abbreviate|capitalize|center|chop|reverse|rotate|swap|overlay|repeat|difference"
)


def name_group(name: Column) -> Column:
    """The verb a method's name begins with, else its first capitalised word in lower case, else 'other'."""
    plain = F.substring_index(name, "(", 1)
    verb = F.regexp_extract(plain, f"^({VERBS})[A-Z]", 1)
    word = F.lower(F.regexp_extract(plain, "[A-Z][a-z]*", 0))
    return F.when(verb != "", verb).when(word != "", word).otherwise("other")


def name_groups(methods: DataFrame, least: int = 3) -> DataFrame:
    """class_id, name_group, members of groups of least methods or more."""
    return methods.groupBy("class_id", name_group(F.col("method")).alias("name_group")).agg(F.array_sort(F.collect_set("method")).alias("members")).filter(F.size("members") >= least)


def connected_parts(edges: DataFrame, part: DataFrame) -> DataFrame:
    """node, cluster_id: clusters that fall apart become id * 1000 + i, in the order of their least nodes."""
    from pyspark.sql import Window

    from weftline.operators.graph import components

    inner = placed(edges, part).filter("c1 = c2").select("src", "dst", "weight")
    c = part.join(components(part.select("node"), inner), "node")
    w = Window.partitionBy("cluster_id")
    k = c.select("cluster_id", "component").distinct().withColumn("i", F.row_number().over(w.orderBy("component")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    return c.join(k, ["cluster_id", "component"]).select("node", F.when(F.col("m") == 1, F.col("cluster_id")).otherwise(F.col("cluster_id") * 1000 + F.col("i")).cast("long").alias("cluster_id"))


def field_groups(accesses: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """class_id, component, n_methods, n_fields: methods joined by fields they share; sizes count both."""
    from weftline.operators.graph import components

    a = accesses.select("class_id", F.concat_ws(":", F.lit("m"), "class_id", "method").alias("src"), F.concat_ws(":", F.lit("f"), "class_id", "field").alias("dst"), F.lit(1.0).alias("weight")).distinct()
    nodes = a.select("class_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    c = nodes.join(components(nodes.select("node"), a.select("src", "dst", "weight")), "node")
    g = c.groupBy("class_id", "component").agg(F.count_if(F.col("node").startswith("m:")).alias("n_methods"), F.count_if(F.col("node").startswith("f:")).alias("n_fields"))
    return g.filter((F.col("n_methods") + F.col("n_fields")).between(least, most))


def random_groups(methods: DataFrame, seed: int = 42, least: int = 3, most: int = 8) -> DataFrame:
    """class_id, method, cluster_id: methods in a seeded order, cut into groups of most; a short tail joins the group before."""
    from pyspark.sql import Window

    w = Window.partitionBy("class_id")
    x = methods.withColumn("k", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "method"), "method")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    tail = F.col("n") % most
    full = F.floor(F.col("n") / most)
    last = F.when((tail > 0) & (tail < least) & (full > 0), full - 1).otherwise(full)
    return x.select("class_id", "method", F.least(F.floor(F.col("k") / most), last).cast("long").alias("cluster_id"))


def multi_resolution(edges: DataFrame, gammas: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5)) -> DataFrame:
    """graph_id, gamma, node, community of the resolution with the greatest modularity; ties: the first named.

    Every (graph, resolution) is a task of its own.
    """
    from pyspark.sql import Window

    kind = "graph_id long, gamma double, k int, score double, node long, community long"

    def run(pdf):
        import pandas as pd

        from weftline.operators.kernels import louvain_partition, modularity_of

        gamma = float(pdf["gamma"].iloc[0])
        src, dst, weight = pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(float)
        nodes, label = louvain_partition(src, dst, weight, gamma)
        score = modularity_of(src, dst, weight, dict(zip(nodes, label, strict=True)))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "gamma": gamma, "k": pdf["k"].iloc[0], "score": score, "node": nodes, "community": label})

    each = edges.select("*", F.posexplode(F.array(*(F.lit(float(g)) for g in gammas))).alias("k", "gamma"))
    found = each.groupBy("graph_id", "k").applyInPandas(run, kind)
    best = Window.partitionBy("graph_id").orderBy(F.desc(F.round("score", 12)), "k")
    return found.withColumn("r", F.dense_rank().over(best)).filter("r = 1").select("graph_id", "gamma", "node", "community")


def consensus(edges: DataFrame, rounds: int = 10, noise: float = 0.1, least: float = 0.7, seed: int = 42) -> DataFrame:
    """graph_id, node, community, stability: groups found in most of several runs on disturbed weights.

    Nodes that share a group in least of the runs or more are joined and grouped once more; stability
    is the mean share of a community's pairs. Noise is seeded: the same input, the same groups.
    """
    def run(pdf):
        import numpy as np
        import pandas as pd

        from weftline.operators.kernels import louvain_partition

        pdf = pdf.sort_values(["src", "dst"])
        src, dst, weight = pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(float)
        rng = np.random.default_rng(seed)
        nodes = np.array(sorted({*src.tolist(), *dst.tolist()}))
        same = np.zeros((len(nodes), len(nodes)))
        for _ in range(rounds):
            label = np.array(louvain_partition(src, dst, np.maximum(0.01, weight + rng.normal(0, noise * np.abs(weight))))[1])
            same += label[:, None] == label[None, :]
        same /= rounds
        i, j = np.nonzero(np.triu(same >= least, 1))
        own = np.arange(len(nodes))
        if len(i):
            names, label = louvain_partition(i, j, same[i, j])
            own[names] = len(nodes) + np.array(label)
        own = np.unique(own, return_inverse=True)[1]
        stable = np.array([same[np.ix_(own == c, own == c)][np.triu_indices((own == c).sum(), 1)].mean() if (own == c).sum() > 1 else 1.0 for c in range(own.max() + 1)])
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": nodes, "community": own, "stability": stable[own]})

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id long, node long, community long, stability double")


def average_linkage(vectors: DataFrame, farthest: float, most: int = 4096) -> DataFrame:
    """class_id, member, community: members (with x array<double>) merged while mean distances are below farthest.

    A class of up to most members is a task (distances of 64 MB); larger ones are merged in rounds.
    """
    from weftline.operators.lineage import cut
    from weftline.operators.linkage import linked

    kind = dict(vectors.dtypes)

    def run(pdf):
        import numpy as np
        import pandas as pd

        from weftline.operators.kernels import linkage_groups

        pdf = pdf.sort_values("member")
        label = linkage_groups(np.stack(pdf["x"].to_list()).astype(float), farthest)
        return pd.DataFrame({"class_id": pdf["class_id"], "member": pdf["member"], "community": label})

    def small(x):
        return x.groupBy("class_id").applyInPandas(run, f"class_id {kind['class_id']}, member {kind['member']}, community long")

    large = cut(vectors.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("class_id").alias("large")))
    if large.isEmpty():
        return small(vectors)
    same = F.col("class_id").eqNullSafe(F.col("large"))
    return small(vectors.join(large, same, "left_anti")).unionByName(linked(vectors.join(large, same, "left_semi"), farthest, most))
