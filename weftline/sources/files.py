"""Readers and writers of the file formats around the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refactorings(spark: SparkSession, path: str, kind: str = "Extract Class") -> DataFrame:
    """commit, type, description, members of mined refactorings (one JSON document a file)."""
    x = spark.read.schema("commits array<struct<sha1:string,refactorings:array<struct<type:string,description:string,extractedMembers:array<struct<name:string>>>>>>").json(path, multiLine=True)
    r = x.select(F.explode("commits").alias("c")).select("c.sha1", F.explode("c.refactorings").alias("r")).filter(F.col("r.type") == kind)
    return r.select(F.col("sha1").alias("commit_sha"), "r.type", "r.description", F.transform("r.extractedMembers", lambda m: m["name"]).alias("members"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("commit_sha string, source_class string, extracted_class string, extracted_members array<string>").json(path)


def oracle_members(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV id,name,start,end,label; malformed rows are dropped; instance = folder."""
    x = spark.read.schema("id int, name string, start_line int, end_line int, label int").csv(path, mode="DROPMALFORMED")
    return x.withColumn("instance", F.element_at(F.split(F.input_file_name(), "/"), -2)).filter("label is not null")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """class, covered share of lines of a coverage report in XML."""
    x = spark.read.format("xml").option("rowTag", "class").schema("_name string, counter array<struct<_type:string,_missed:long,_covered:long>>").load(path)
    c = x.select(F.col("_name").alias("class"), F.explode("counter").alias("c")).filter("c._type = 'LINE'")
    return c.select("class", F.coalesce(F.try_divide(F.col("c._covered"), F.col("c._covered") + F.col("c._missed")), F.lit(0.0)).alias("covered"))


def complete_instances(listing: DataFrame, names: list[str]) -> DataFrame:
    """Folders of a listing (path) that hold all the files named."""
    parts = F.split("path", "/")
    x = listing.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("file"))
    return x.filter(F.col("file").isin(names)).groupBy("folder").agg(F.countDistinct("file").alias("n")).filter(F.col("n") == len(names)).select("folder")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str) -> None:
    """csv, json, graphml, gml, dot or adjlist; another form is an error."""
    if form == "csv":
        edges.write.csv(path, header=True)
    elif form == "json":
        edges.write.json(path)
    elif form in ("graphml", "gml", "dot", "adjlist"):
        graph_text(nodes, edges, form).write.text(path)
    else:
        raise ValueError(f"unknown graph format {form!r}")


def graph_text(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """The lines of a graph file: header, nodes, edges, footer, in order."""
    n, s, d, w = (F.col(c).cast("string") for c in ("node", "src", "dst", "weight"))
    if form == "adjlist":
        out = edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.col("dst").cast("string"))), " ").alias("x"))
        body = nodes.join(out, nodes.node == out.src, "left").select(F.lit(1).alias("k"), n.alias("a"), F.rtrim(F.concat_ws(" ", n, "x")).alias("value"))
        return body.orderBy("k", "a").select("value")
    head, foot = {"graphml": ('<graphml><graph edgedefault="undirected">', "</graph></graphml>"), "gml": ("graph [", "]"), "dot": ("graph {", "}")}[form]
    node = {"graphml": F.concat(F.lit('<node id="'), n, F.lit('"/>')), "gml": F.concat(F.lit('node [ id "'), n, F.lit('" ]')), "dot": F.concat(F.lit('"'), n, F.lit('";'))}[form]
    edge = {"graphml": F.concat(F.lit('<edge source="'), s, F.lit('" target="'), d, F.lit('"><data key="weight">'), w, F.lit("</data></edge>")), "gml": F.concat(F.lit('edge [ source "'), s, F.lit('" target "'), d, F.lit('" weight '), w, F.lit(" ]")), "dot": F.concat(F.lit('"'), s, F.lit('" -- "'), d, F.lit('" [weight='), w, F.lit("];"))}[form]
    rows = nodes.select(F.lit(1).alias("k"), n.alias("a"), node.alias("value")).union(edges.select(F.lit(2), F.concat(s, F.lit(" "), d), edge))
    ends = nodes.sparkSession.createDataFrame([(0, "", head), (3, "", foot)], "k int, a string, value string")
    return rows.union(ends).orderBy("k", "a").select("value")


def wide_centrality(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """node and a column for each metric (metric, node, score); missing: 0."""
    return rows.groupBy("node").pivot("metric", metrics).agg(F.first("score")).na.fill(0.0).orderBy("node")


def cache_key(*columns):
    return F.md5(F.concat_ws(":", *columns).cast("binary"))


def evicted(entries: DataFrame, now: str, days: int, most_bytes: int) -> DataFrame:
    """Entries (key, mtime, bytes) too old, or, oldest first, beyond the room there is."""
    from weftline.operators.prefix import running_sums

    old = F.col("mtime") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    newer = running_sums(entries.filter(~old), [F.desc("mtime"), F.col("key")], ["bytes"])
    fresh = newer.filter(F.col("before_bytes") + F.col("bytes") > most_bytes).select("key")
    return entries.filter(old).select("key").union(fresh)
