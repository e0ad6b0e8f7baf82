"""The property multigraph as two DataFrames, and its merge rules.

nodes: id, label, kind, file, line, service, seq. edges: source, target, relation, confidence, line, via, seq. Every
fact carries seq, so that "the first one wins" is an aggregate and never depends on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of nodes, the relations, and the confidences from strongest to weakest.
KINDS = ("file", "class", "interface", "trait", "enum", "method", "function", "external", "channel", "route", "operation")
CLASS_LIKE = ("class", "interface", "trait", "enum")
RELATIONS = (
    "defines", "imports", "extends", "implements", "uses_trait", "has_method", "overrides", "instantiates", "calls", "references",
    "dispatches", "handled_by", "contract", "requests", "receives", "autowires", "reads_state_of", "implemented_by",
)
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
#: How much an edge of a relation weighs where several join the same two nodes.
PATH_WEIGHTS = {"dispatches": 3, "handled_by": 3, "calls": 3, "extends": 2, "implements": 2, "uses_trait": 2, "overrides": 2, "has_method": 2, "receives": 2, "instantiates": 1}


def confidence_rank(confidence: Column) -> Column:
    """1 for the strongest."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(CONFIDENCES, 1):
        rank = F.when(confidence == name, i).otherwise(rank)
    return rank


def confidence_of(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in CONFIDENCES)), rank.cast("int"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: its first declaration."""
    others = [c for c in nodes.columns if c not in ("id", "seq")]
    first = F.min_by(F.struct(*others), F.col("seq"))
    return nodes.groupBy("id").agg(first.alias("first"), F.min("seq").alias("seq")).select("id", *(F.col(f"first.{c}") for c in others), "seq")


def duplicate_declarations(nodes: DataFrame) -> DataFrame:
    """(id, declarations) of ids declared more than once."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("declarations")).where("declarations > 1")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, relation, target): the first confidence, all lines sorted, and via as its prefix asks.

    Loops are dropped and a line of 0 is none. `named: ` lists are joined as ordered sets; a plain call beats one from a
    closure; else the first via stays. Adding an edge again changes nothing. The shuffle carries partial aggregates.
    """
    lines = F.array_sort(F.collect_set(F.when(F.col("line") != 0, F.col("line"))))
    first_via = F.min_by("via", "seq")
    names = F.array_sort(F.collect_set(F.when(F.col("via").startswith("named: "), F.struct("seq", "via"))))
    plain = F.max(F.coalesce(~F.col("via").startswith("closure of "), F.lit(True)))
    closures = F.array_sort(F.collect_set(F.when(F.col("via").startswith("closure of "), F.col("via"))))
    joined = F.array_join(F.array_distinct(F.flatten(F.transform("_names", lambda x: F.split(F.substr(x["via"], F.lit(8)), ", ")))), ", ")
    via = F.when(F.size("_names") > 0, F.concat(F.lit("named: "), joined)).when(F.size("_closures") > 0, F.when(F.col("_plain"), F.lit(None)).otherwise(F.array_join("_closures", ", "))).otherwise(F.col("_via"))
    merged = edges.where("source <> target").groupBy("source", "relation", "target")
    merged = merged.agg(F.min_by("confidence", "seq").alias("confidence"), lines.alias("lines"), first_via.alias("_via"), names.alias("_names"), plain.alias("_plain"), closures.alias("_closures"), F.min("seq").alias("seq"))
    return merged.select("source", "relation", "target", "confidence", "lines", via.alias("via"), "seq")


def incidence(edges: DataFrame) -> DataFrame:
    """Each edge once at each end: node, other, forward, relation, confidence."""
    ahead = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("forward"), "relation", "confidence")
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("forward"), "relation", "confidence")
    return ahead.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): entries at a node, all relations and both directions."""
    return incidence(edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def with_externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges point to and no node declares, as external nodes."""
    return edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("kind", F.lit("external"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 15, without: tuple[str, ...] = ("file", "external")) -> DataFrame:
    """The nodes of the highest degrees: a top-k report."""
    kept = nodes.where(~F.col("kind").isin(*without)).select("id", "label", "kind")
    return degrees(edges).join(kept, "id").orderBy(F.desc("degree"), "id").limit(limit)


def candidates(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """The nodes that a name may mean, best first: exact id, exact label, last part of the id, part of the label, part of the id.

    Within a tier externals come last, then higher degrees first. `service@name` looks in one service alone.
    """
    needle = name.strip().lstrip("\\").lower()
    service = None
    if "@" in needle and "\\@" not in needle:
        service, needle = needle.split("@", 1)
        needle = needle.lstrip("\\")
    label, ident = F.lower("label"), F.lower("id")
    found = nodes
    if service is not None:
        own = F.lower(F.coalesce("service", F.lit("")))
        found = found.where((own == service) | own.endswith("/" + service))
        ident = F.regexp_replace(ident, "^[^@]*@", "")
    tier = (
        F.when(F.col("id") == name.strip().lstrip("\\"), 0)
        .when((label == needle) | (F.rtrim(label, F.lit("()")) == needle), 1)
        .when((ident == needle) | ident.endswith("\\" + needle), 2)
        .when(label.contains(needle), 3)
        .when(ident.contains(needle), 4)
    )
    tiered = found.select("id", "label", "kind", tier.alias("tier")).where("tier is not null").join(degrees(edges), "id", "left")
    tiered = tiered.withColumn("degree", F.coalesce("degree", F.lit(0)))
    return tiered.orderBy("tier", (F.col("kind") == "external").cast("int"), F.desc("degree"), "id").limit(limit)


def connections(edges: DataFrame, node: str) -> DataFrame:
    """The edges at a node: outgoing first, by relation and other end."""
    return incidence(edges).where(F.col("node") == node).select("forward", "relation", "other", "confidence").orderBy(F.desc("forward"), "relation", "other")


def compare_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(source, target, side): pairs in both graphs, in the first or in the second alone; disagree if both have them with other confidences."""
    one = a.groupBy("source", "target").agg(F.min("confidence").alias("x"))
    two = b.groupBy("source", "target").agg(F.min("confidence").alias("y"))
    side = F.when(F.col("y").isNull(), "first").when(F.col("x").isNull(), "second").when(F.col("x") != F.col("y"), "disagree").otherwise("both")
    return one.join(two, ["source", "target"], "full").select("source", "target", side.alias("side"))
