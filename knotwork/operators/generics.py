"""Template parameters of classes bound through their parents: substitutions composed along the lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.session import materialize

#: What an argument that nobody gives is.
UNKNOWN = "?"
_TOKENS = r"([A-Za-z_][\w\\]*|[^A-Za-z_]+)"


def substitute(term: Column, bindings: Column) -> Column:
    """term with every name that bindings (a map) has replaced, all at once: what is put in is not looked at again."""
    return F.array_join(F.transform(F.regexp_extract_all(term, F.lit(_TOKENS), 1), lambda t: F.coalesce(F.try_element_at(bindings, t), t)), "")


def template_bindings(templates: DataFrame, parents: DataFrame, arguments: DataFrame, relations: tuple[str, ...] = ("extends", "implements", "uses_trait")) -> DataFrame:
    """(class, ancestor, depth, template, argument): what each template of an ancestor stands for in a class, in the class's own terms.

    templates: (class, position, template). parents: (source, relation, target). arguments: (class, parent, position, argument),
    what a class passes to a parent, in its own templates; what it doesn't pass is unknown. A fixpoint by levels: a level's terms are those of
    the parent with the names of the level before put in. An ancestor that is reached in several ways takes the nearest, and of equally near
    ones the first by the order of relations and then names along the way.
    """
    rank = F.array_position(F.array(*(F.lit(r) for r in relations)), F.col("relation")).cast("int")
    own = templates.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("position", "template"))).alias("_own"))
    passed = arguments.groupBy(F.col("class").alias("source"), F.col("parent").alias("target")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("position", "argument")))).alias("_passed"))
    steps = parents.where(F.col("relation").isin(*relations)).groupBy("source", "target").agg(F.min(rank).alias("rank"))
    steps = steps.join(passed, ["source", "target"], "left").join(own.withColumnsRenamed({"class": "target", "_own": "_formal"}), "target", "left")
    steps = materialize(steps.select(F.col("source").alias("_at"), F.col("target").alias("_to"), "rank", "_passed", "_formal").repartition("_at"), "generic-steps")
    starts = parents.select(F.col("source").alias("class")).union(templates.select("class")).distinct()
    # a class's templates stand for themselves in the class; bound: template to term
    itself = F.map_from_entries(F.transform(F.col("_own"), lambda x: F.struct(x["template"], x["template"])))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    path = F.array().cast("array<struct<rank:int,to:string>>")
    level = starts.join(own, "class", "left").select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth"), path.alias("path"), F.coalesce(itself, empty).alias("bound"))
    level = materialize(level, "generics")
    found = [level]
    seen = level.select("class", "ancestor")
    depth = 0
    while level.limit(1).count():
        depth += 1
        ahead = level.join(steps, level["ancestor"] == steps["_at"]).select("class", "_to", F.concat("path", F.array(F.struct("rank", F.col("_to").alias("to")))).alias("path"), "bound", "_passed", "_formal")
        ahead = ahead.join(seen.withColumnRenamed("ancestor", "_to"), ["class", "_to"], "left_anti")
        term = F.transform(F.coalesce("_formal", F.array().cast("array<struct<position:int,template:string>>")), lambda x: F.struct(x["template"].alias("template"), F.coalesce(substitute(F.try_element_at(F.col("_passed"), x["position"]), F.col("bound")), F.lit(UNKNOWN)).alias("term")))
        best = ahead.withColumn("_terms", term).groupBy("class", F.col("_to").alias("ancestor")).agg(F.min(F.struct("path", "_terms")).alias("best"))
        level = materialize(best.select("class", "ancestor", F.lit(depth).alias("depth"), F.col("best.path").alias("path"), F.map_from_entries("best._terms").alias("bound")), "generics")
        found.append(level)
        seen = seen.union(level.select("class", "ancestor"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.where("depth > 0").select("class", "ancestor", "depth", F.explode("bound").alias("template", "argument"))
