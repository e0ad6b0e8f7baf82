"""Graphs in files: Parquet for work, JSON for exchange. The schema is fixed and versioned; another version is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
NODE = "id string, label string, kind string, file string, line int, service string, modifiers array<string>, alias string"
EDGE = "source string, target string, relation string, confidence string, lines string, via string"
DOCUMENT = f"version int, nodes array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in NODE.split(', ')))}>>, edges array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in EDGE.split(', ')))}>>"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables below path; the manifest comes last, so a graph without one is not whole."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    nodes.sparkSession.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    _refuse_others(spark.read.schema("version int").json(f"{path}/manifest"))
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of graphs that are JSON documents, one in a file."""
    documents = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    _refuse_others(documents.select("version"))
    nodes = documents.select(F.explode("nodes").alias("x")).select("x.*")
    edges = documents.select(F.explode("edges").alias("x")).select("x.*")
    lines = F.filter(F.transform(F.split("lines", ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return nodes, edges.withColumn("lines", F.coalesce(lines, F.array().cast("array<int>")))


def _refuse_others(versions: DataFrame) -> None:
    if (other := versions.where(F.coalesce(F.col("version"), F.lit(0)) != VERSION).first()) is not None:
        raise ValueError(f"a graph of version {other.version}, not {VERSION}")


def as_json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a line of JSON for each node and edge, to be written by Spark; empty fields are left out."""
    edges = edges.withColumn("lines", F.when(F.size("lines") > 0, F.array_join("lines", ",")))
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))
