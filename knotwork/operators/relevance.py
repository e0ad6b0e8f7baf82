"""Relevance of nodes to the words of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.words import stems

#: Weights of a word in a node's own name, in its owner's name, and in its namespace.
NAME, OWNER, NAMESPACE = 3.0, 2.0, 1.0


def word_weights(named: DataFrame) -> DataFrame:
    """(id, stem, weight) from named(id, name, owner, namespace): the highest weight of each stem."""
    parts = [named.select("id", F.explode(stems(F.coalesce(F.col(c), F.lit("")))).alias("stem"), F.lit(w).alias("weight")) for c, w in (("name", NAME), ("owner", OWNER), ("namespace", NAMESPACE))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id", "stem").agg(F.max("weight").alias("weight"))


def frequencies(weights: DataFrame) -> DataFrame:
    """(stem, df): nodes that have a stem in their name or owner."""
    return weights.groupBy("stem").agg(F.count_if(F.col("weight") >= OWNER).alias("df"))


def common_stems(weights: DataFrame, total: int, part: int = 2) -> DataFrame:
    """Stems that more than one in part of all nodes has; half of them unless told otherwise."""
    return weights.groupBy("stem").agg(F.count(F.lit(1)).alias("nodes")).where(part * F.col("nodes") > total)


def relevance(weights: DataFrame, df: DataFrame, total: int, terms: list[str]) -> DataFrame:
    """(id, score, matched): rare stems count more, and the covered share of the terms counts squared."""
    asked = weights.where(F.col("stem").isin(*terms)).join(df.where(F.col("stem").isin(*terms)), "stem")
    gain = F.col("weight") * F.log(1 + F.lit(float(total)) / (1 + F.col("df")))
    found = asked.groupBy("id").agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("matched"))
    score = F.col("gain") * F.pow(F.col("matched") / F.lit(float(len(terms))), F.lit(2.0))
    return found.select("id", F.round(score, 6).alias("score"), "matched")


def seeds(scores: DataFrame, owner: str = "owner", limit: int = 6, cut: float = 0.4) -> DataFrame:
    """The best nodes, one for each owner, that reach cut times the best score; ties by id."""
    best = scores.agg(F.max("score").alias("best"))
    near = scores.crossJoin(F.broadcast(best)).where(F.col("score") >= cut * F.col("best"))  # best is one row
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("score"), "id"))).where("rank = 1")
    return ranked.orderBy(F.desc("score"), "id").limit(limit).select("id", owner, "score")
