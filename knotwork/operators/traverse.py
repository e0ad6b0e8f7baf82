"""Fixpoints over the graph: reachability with confidences, closures, shortest paths, cones.

Each level is one join of the frontier with the edges, and a left-anti join with what was reached; its rows are written to
the shared folder, so lineage stays short. The steps are written once, dealt out by where they start. The driver holds only
whether a level had rows. Loops go on until a level is empty; a bound on depth holds only where the caller gives one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.graph import PATH_WEIGHTS, confidence_rank
from knotwork.session import materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _depths(most: int | None) -> Iterator[int]:
    return takewhile(lambda d: most is None or d <= most, count(1))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, backward: bool = True) -> DataFrame:
    """(start, id, depth, rank) of what is reached from each row (start) of starts: the least depth, and at that depth the
    strongest of the paths' weakest confidences (1 is strongest). backward: along edges to their sources, as impact goes."""
    near, far = ("target", "source") if backward else ("source", "target")
    steps = edges.select(F.col(near).alias("_at"), F.col(far).alias("_to"), confidence_rank(F.col("confidence")).alias("_rank"))
    steps = materialize(steps.groupBy("_at", "_to").agg(F.min("_rank").alias("_rank")).repartition("_at"), "steps")
    level = materialize(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth"), F.lit(1).alias("rank")).distinct(), "reach")
    levels = [level]
    for depth in _depths(max_depth):
        ahead = level.join(steps, level["id"] == steps["_at"]).groupBy("start", F.col("_to").alias("id")).agg(F.min(F.greatest("rank", "_rank")).alias("rank"))
        seen = _union(levels).select("start", "id")
        level = materialize(ahead.join(seen, ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth"), "rank"), "reach")
        if not level.limit(1).count():
            break
        levels.append(level)
    return _union(levels)


def closure(edges: DataFrame, relations: tuple[str, ...], upward: bool = True) -> DataFrame:
    """(start, id, depth): ancestors (or descendants) of every node over the relations, itself at depth 0."""
    kept = edges.where(F.col("relation").isin(*relations)).withColumn("confidence", F.lit("EXTRACTED"))
    starts = kept.select(F.col("source").alias("start")).union(kept.select("target")).distinct()
    return reach(kept, starts, backward=not upward).select("start", "id", "depth")


def ranked_lineage(edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(start, id, path): every ancestor with the least of its paths, itself with the empty one.

    A path is an array of steps (rank of the relation, where it leads); earlier relations come first, then lesser ids.
    Where no class is its own ancestor, sorting by path gives the order in which a depth-first search first meets the
    ancestors. Least paths may be longer than others, so a level holds all that it improved, until it improves none.
    """
    rank = F.array_position(F.array(*(F.lit(r) for r in relations)), F.col("relation")).cast("int")
    steps = edges.where(F.col("relation").isin(*relations)).select(F.col("source").alias("_at"), F.struct(rank.alias("rank"), F.col("target").alias("to")).alias("_step"))
    steps = materialize(steps.distinct().repartition("_at"), "steps")
    starts = steps.select(F.col("_at").alias("start")).union(steps.select("_step.to")).distinct()
    empty = F.array().cast("array<struct<rank:int,to:string>>")
    best = level = materialize(starts.select("start", F.col("start").alias("id"), empty.alias("path")), "lineage")
    while level.limit(1).count():
        ahead = level.join(steps, level["id"] == steps["_at"]).select("start", F.col("_step.to").alias("id"), F.concat("path", F.array("_step")).alias("path"))
        ahead = ahead.groupBy("start", "id").agg(F.min("path").alias("path"))
        known = best.select("start", "id", F.col("path").alias("_old"))
        level = materialize(ahead.join(known, ["start", "id"], "left").where("_old is null or path < _old").select("start", "id", "path"), "lineage")
        best = materialize(best.unionByName(level).groupBy("start", "id").agg(F.min("path").alias("path")), "lineage")
    return best


def family_heads(edges: DataFrame, relations: tuple[str, ...], members: DataFrame, least: int = 2) -> DataFrame:
    """(id, head, depth): for each row (id) of members its nearest proper ancestor that has at least so many members below it."""
    above = closure(edges, relations).where("depth > 0").select(F.col("start").alias("id"), F.col("id").alias("head"), "depth")
    own = above.join(members.select("id"), "id", "left_semi")
    large = own.groupBy("head").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)
    near = own.join(large, "head").groupBy("id").agg(F.min(F.struct("depth", "head")).alias("best"))
    return near.select("id", "best.head", "best.depth")


def shortest_paths(edges: DataFrame, start: str, mode: str = "dependency", reversible: tuple[str, ...] = ("implements", "extends", "overrides", "has_method"), blocked: DataFrame | None = None, max_depth: int | None = None, until: str | None = None) -> DataFrame:
    """(id, hops, previous, relation, forward): one shortest path from start to each node, as its last hop.

    dependency goes along edges, and against those of reversible relations; undirected goes both ways. Nodes in blocked
    (id) may end a path and never lie on one. Of parallel edges the heaviest is taken, then the least by name; of equally
    short paths the one through the least id. until: a node at which the search ends.
    """
    weight: Column = F.lit(0)
    for relation, value in PATH_WEIGHTS.items():
        weight = F.when(F.col("relation") == relation, value).otherwise(weight)
    ahead = edges.select(F.col("source").alias("_at"), F.col("target").alias("_to"), "relation", F.lit(True).alias("forward"))
    back = edges.select(F.col("target").alias("_at"), F.col("source").alias("_to"), "relation", F.lit(False).alias("forward"))
    if mode == "dependency":
        back = back.where(F.col("relation").isin(*reversible))
    steps = materialize(ahead.unionByName(back).withColumn("weight", weight).distinct(), "steps")
    spark = edges.sparkSession
    level = spark.createDataFrame([(start, 0, None, None, None)], "id string, hops int, previous string, relation string, forward boolean")
    levels = [level]
    for depth in _depths(max_depth):
        origin = level.select(F.col("id").alias("_at"))
        if blocked is not None and depth > 1:
            origin = origin.join(blocked.select(F.col("id").alias("_at")), "_at", "left_anti")
        best = F.min(F.struct("_at", (-F.col("weight")).alias("light"), "relation", (~F.col("forward")).alias("backward"))).alias("best")
        found = origin.join(steps, "_at").groupBy(F.col("_to").alias("id")).agg(best)
        found = found.join(_union(levels).select("id"), "id", "left_anti")
        level = materialize(found.select("id", F.lit(depth).alias("hops"), F.col("best._at").alias("previous"), "best.relation", (~F.col("best.backward")).alias("forward")), "paths")
        if not level.limit(1).count():
            break
        levels.append(level)
        if until is not None and level.where(F.col("id") == until).limit(1).count():
            break
    return _union(levels)


def path_ladder(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(position, source, target, relation, forward, mode, reversed): a shortest path of the most telling kind that there is.

    First along dependencies, then along those the other way round (reversed), then whatever the direction, and last through any
    node: but for the last, files and externals lie on no path. No rows where nothing leads from one to the other.
    """
    externals = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    blocked = materialize(nodes.where(F.col("kind").isin("file", "external")).select("id").union(externals), "blocked")
    spark = edges.sparkSession
    hops: list[tuple] = []
    for mode, turned in (("dependency", False), ("dependency", True), ("undirected", False), ("any", False)):
        one, other = (end, start) if turned else (start, end)
        found = shortest_paths(edges, one, "dependency" if mode == "dependency" else "undirected", blocked=None if mode == "any" else blocked, until=other)
        at = other
        while (hop := found.where((F.col("id") == at) & F.col("previous").isNotNull()).first()) is not None:  # a row for each hop of one path
            hops.append((hop.hops, hop.previous, hop.id, hop.relation, hop.forward, mode, turned))
            at = hop.previous
        if hops or start == end:
            break
    return spark.createDataFrame(hops[::-1], "position int, source string, target string, relation string, forward boolean, mode string, reversed boolean")


def caller_counts(edges: DataFrame, relations: tuple[str, ...] = ("calls", "instantiates")) -> DataFrame:
    """(id, callers): distinct sources that call a node."""
    return edges.where(F.col("relation").isin(*relations)).groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("callers"))


def method_cone(edges: DataFrame, start: str, depth: int = 3, hub: int = 20, relations: tuple[str, ...] = ("calls", "receives")) -> DataFrame:
    """(id, depth, is_hub): what a node calls, so deep; nodes of hub callers or more are listed and not followed."""
    kept = edges.where(F.col("relation").isin(*relations)).select("source", "target").distinct()
    busy = materialize(caller_counts(edges, relations).where(F.col("callers") >= hub).select("id"), "hubs")
    level = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    levels = [level]
    for d in range(1, depth + 1):
        origin = level.join(busy, "id", "left_anti") if d > 1 else level
        found = origin.select(F.col("id").alias("source")).join(kept, "source").select(F.col("target").alias("id")).distinct()
        level = materialize(found.join(_union(levels).select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "cone")
        levels.append(level)
    cone = _union(levels)
    return cone.join(busy.withColumn("is_hub", F.lit(True)), "id", "left").select("id", "depth", F.coalesce("is_hub", F.lit(False)).alias("is_hub"))


def up_then_down(edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(id, hops): what is reached by going to sources for some steps and then to targets for some, never up again."""
    steps_up = edges.select(F.col("target").alias("_at"), F.col("source").alias("_to"), F.lit("up").alias("way")).distinct()
    steps_down = edges.select(F.col("source").alias("_at"), F.col("target").alias("_to"), F.lit("down").alias("way")).distinct()
    steps = materialize(steps_up.unionByName(steps_down), "steps")
    level = edges.sparkSession.createDataFrame([(start, "up", 0)], "id string, state string, hops int")
    levels = [level]
    for d in _depths(max_depth):
        found = level.join(steps, level["id"] == steps["_at"]).where("not (state = 'down' and way = 'up')").select(F.col("_to").alias("id"), F.col("way").alias("state")).distinct()
        level = materialize(found.join(_union(levels).select("id", "state"), ["id", "state"], "left_anti").withColumn("hops", F.lit(d)), "ways")
        if not level.limit(1).count():
            break
        levels.append(level)
    return _union(levels).groupBy("id").agg(F.min("hops").alias("hops"))
