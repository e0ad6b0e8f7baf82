"""How parts of a code base are wired: routes, requests, schemas, messages, families, names. Joins over fact tables."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.words import namespace_of, path_segments
from knotwork.operators.rollup import context, layer
from knotwork.operators.traverse import ranked_lineage, reach
from knotwork.session import discard, materialize

#: Directories of tests, and kinds of tests that a module keeps.
TEST_FOLDERS = ("tests", "test", "spec", "specs", "__tests__", "behat")
TEST_KINDS = ("unit", "integration", "functional", "feature", "e2e", "acceptance")


def normal_path(path: Column) -> Column:
    """One slash before the path, single ones within, none at the end."""
    return F.concat(F.lit("/"), F.trim(F.regexp_replace(path, "/+", "/"), F.lit("/")))


def singular(name: Column) -> Column:
    """The last part of a name in the singular, with underscores for dashes."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), "-", "_")

    def without(n: int) -> Column:
        return F.substr(base, F.lit(1), F.length(base) - n)

    return F.when(base.endswith("ies"), F.concat(without(3), F.lit("y"))).when(base.rlike("(ss|x|ch|sh)es$"), without(2)).when(base.endswith("s") & ~base.endswith("ss"), without(1)).otherwise(base)


def test_module(path: Column) -> Column:
    """The part of a code base that a test file belongs to: what stands before its folder of tests, else the first folders."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(F.transform(folders, lambda s: F.when(F.lower(s).isin(*TEST_FOLDERS), "t").otherwise("")), "t")
    kept = F.when(F.lower(F.coalesce(F.get(folders, F.lit(1)), F.lit(""))).isin(*TEST_KINDS), 3).otherwise(2)
    own = F.when(at > 1, F.slice(folders, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).when(at == 1, F.slice(folders, 1, kept)).otherwise(folders)
    return F.when(F.size(folders) == 0, ".").otherwise(F.array_join(own, "/"))


def tests_by_module(files: DataFrame) -> DataFrame:
    """(module, files): distinct test files, path, of each module."""
    return files.groupBy(test_module(F.col("path")).alias("module")).agg(F.count_distinct("path").alias("files"))


def is_application(kind: Column, file: Column, in_tests: Column) -> Column:
    """Whether a node is code of the project: not external, in a file, and not in tests."""
    return (kind != "external") & file.isNotNull() & ~in_tests


def is_layer_first(classes: DataFrame) -> DataFrame:
    """One row (before, after, layer_first) of classes(id): whether one namespace leads to all domain layers, and several follow."""
    parts = classes.select(namespace_of(F.col("id")).alias("parts"))
    placed = parts.withColumn("layer", layer(F.col("parts"))).where("layer.explicit and layer.role = 'domain'")
    before = F.array_join(F.slice("parts", F.lit(1), F.col("layer.position")), "\\")
    counted = placed.agg(F.count_distinct(before).alias("before"), F.count_distinct(context(F.col("parts"), F.col("layer"), True)).alias("after"))
    return counted.select("before", "after", ((F.col("before") == 1) & (F.col("after") >= 2)).alias("layer_first"))


def request_targets(requests: DataFrame) -> DataFrame:
    """requests(request, path, host, literal, absolute, base) with the path, host and certainty that the call really has.

    A call without base, or of an absolute url, stays as it is. A base that is a url gives its host and leads the path; one that is
    worked out at run time (a star) leaves both unknown; any other only leads the path.
    """
    url = r"(?i)^[a-z][a-z0-9+.-]*://([^/:?#]*)[^/?#]*([^?#]*)"
    own, of_url, open_base = F.col("absolute") | F.col("base").isNull(), F.col("base").rlike(url), F.col("base").startswith("*")
    lead = F.regexp_extract("base", url, 2)
    path = F.when(own | (~of_url & open_base), F.col("path")).when(of_url, normal_path(F.concat(lead, F.lit("/"), "path"))).otherwise(normal_path(F.concat("base", F.lit("/"), "path")))
    host = F.when(own, F.col("host")).when(of_url, F.lower(F.regexp_extract("base", url, 1)))
    sure = F.when(own, F.col("literal")).when(of_url, F.col("literal") & ~lead.contains("*")).when(open_base, F.lit(False)).otherwise(F.col("literal"))
    return requests.select("request", path.alias("path"), host.alias("host"), sure.alias("literal"))


def with_loader_prefixes(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """routes(route, service, loader, path), one row for each prefix that its loader has in its service, or else in shared code
    (service null); a route without any stays as it is. prefixes(service, loader, prefix)."""
    known = prefixes.select(F.col("service").alias("_s"), F.col("loader").alias("_l"), "prefix").distinct()
    own = routes.join(known.where("_s is not null"), (F.col("service") == F.col("_s")) & (F.col("loader") == F.col("_l")), "left").drop("_s", "_l")
    root = known.where("_s is null").select("_l", F.col("prefix").alias("_root"))
    both = own.join(root, F.col("prefix").isNull() & (F.col("loader") == F.col("_l")), "left")
    prefix = F.coalesce("prefix", "_root")
    return both.select("route", F.when(prefix.isNull(), F.col("path")).otherwise(normal_path(F.concat(prefix, F.lit("/"), "path"))).alias("path"))


def undocumented(routes: DataFrame, documented: DataFrame) -> DataFrame:
    """(service, routes): routes(route, service) of services that describe some of their routes, without a description."""
    covered = routes.join(routes.join(documented.select("route"), "route", "left_semi").select("service").distinct(), "service", "left_semi")
    return covered.join(documented.select("route"), "route", "left_anti").groupBy("service").agg(F.count_distinct("route").alias("routes"))


def match_described(operations: DataFrame, requests: DataFrame, matched: DataFrame, most: int = 5) -> DataFrame:
    """(request, operation, confidence): operations(operation, method, path) that requests(request, method, path, literal) reach
    which reach no route of the project, matched(request). Inferred if the call is literal and fits one alone.

    Calls and operations meet on their literal segments: each operation gives one shape of its placeholders, the shapes of a
    length are few, and a call is joined under each of these. At most `most` are linked, the first by name, as a report."""
    hole = r"^\{.*\}$"
    o = operations.select("operation", F.col("method").alias("_m"), path_segments(F.col("path")).alias("_p"))
    o = o.withColumns({"holes": F.transform("_p", lambda s: s.rlike(hole)), "key": F.array_join(F.transform("_p", lambda s: F.when(s.rlike(hole), "{}").otherwise(s)), "/")})
    shapes = o.select("holes").distinct().withColumn("n", F.size("holes"))
    q = requests.join(matched.select("request"), "request", "left_anti").select("request", "method", "literal", path_segments(F.col("path")).alias("_q"))
    q = q.withColumn("n", F.size("_q")).join(shapes, "n")
    q = q.withColumn("key", F.array_join(F.zip_with("_q", "holes", lambda s, h: F.when(h, "{}").otherwise(s)), "/"))
    found = q.join(o.select("operation", "_m", "key", F.col("holes")), ["key", "holes"]).where("method is null or method = _m").select("request", "literal", "operation").distinct()
    listed = found.groupBy("request", "literal").agg(F.sort_array(F.collect_set("operation")).alias("all"))
    sure = F.col("literal") & (F.size("all") == 1)
    return listed.select("request", F.explode(F.slice("all", 1, most)).alias("operation"), F.when(sure, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"))


def channel_edges(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """(source, target, relation): messages that are both sent and handled, as nodes between senders and handlers: so edges are
    as many as the facts, not as the pairs of both."""
    both = sends.select("message").distinct().join(handlers.select("message").distinct(), "message")
    ahead = sends.join(both, "message", "left_semi").select(F.col("sender").alias("source"), F.col("message").alias("target"), F.lit("dispatches").alias("relation"))
    return ahead.union(handlers.join(both, "message", "left_semi").select("message", "handler", F.lit("handled_by"))).distinct()


def forwarded(sends: DataFrame, forwarders: DataFrame, calls: DataFrame) -> DataFrame:
    """(message, sender): sends, and those of callers one step away: calls(source, target, message) of methods that pass what they
    are given on as a message, forwarders(method)."""
    through = calls.where("message is not null").join(forwarders.select(F.col("method").alias("target")), "target", "left_semi")
    return sends.select("message", "sender").union(through.select("message", F.col("source"))).distinct()


def bus_statistics(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """One row: handled and sent messages, sends without a type, messages never handled, never sent, and that cross services."""
    typed = sends.where("message is not null")
    sent = typed.groupBy("message").agg(F.count(F.lit(1)).alias("sends"), F.collect_set("service").alias("from"))
    handled = handlers.groupBy("message").agg(F.count(F.lit(1)).alias("handlers"), F.collect_set("service").alias("to"))
    crosses = (F.size("from") > 0) & (F.size("to") > 0) & (F.size(F.array_union("from", "to")) > 1)
    both = sent.join(handled, "message", "full")
    counted = both.agg(
        F.count("handlers").alias("handled"), F.count("sends").alias("sent"), F.count_if(F.col("handlers").isNull()).alias("unhandled"), F.count_if(F.col("sends").isNull()).alias("never_sent"),
        F.count_if(crosses & F.col("handlers").isNotNull() & F.col("sends").isNotNull()).alias("contracts"),
    )
    return counted.join(F.broadcast(sends.agg(F.count_if(F.col("message").isNull()).alias("untyped"))), F.lit(True))  # one row each


def largest_families(edges: DataFrame, relations: tuple[str, ...], most: int = 8, least: int = 2) -> DataFrame:
    """(head, members): the heads with most descendants over the relations. A top-k report."""
    kept = edges.where(F.col("relation").isin(*relations)).withColumn("confidence", F.lit("EXTRACTED"))
    below = reach(kept, kept.select(F.col("source").alias("start")).distinct(), backward=False).where("depth > 0")
    return below.groupBy(F.col("id").alias("head")).agg(F.count_distinct("start").alias("members")).where(F.col("members") >= least).orderBy(F.desc("members"), "head").limit(most)


def callers_through_parents(edges: DataFrame, start: str, override: str = "overrides", call: tuple[str, ...] = ("calls",)) -> DataFrame:
    """(caller, method, depth): who calls a method or one that it overrides, however far up; depth is how far."""
    up = edges.where(F.col("relation") == override).withColumn("confidence", F.lit("EXTRACTED"))
    starts = edges.sparkSession.createDataFrame([(start,)], "start string")
    above = reach(up, starts, backward=False).select(F.col("id").alias("method"), "depth")
    calls = edges.where(F.col("relation").isin(*call)).select(F.col("source").alias("caller"), F.col("target").alias("method")).distinct()
    return calls.join(above, "method").select("caller", "method", "depth")


def instantiations(edges: DataFrame, declares: DataFrame, start: str) -> DataFrame:
    """(source, class): who instantiates a class, or a subclass that inherits its constructor, as no class between declares one.
    declares(class): classes with a constructor of their own."""
    down = edges.where("relation = 'extends'").join(declares.select(F.col("class").alias("source")), "source", "left_anti").withColumn("confidence", F.lit("EXTRACTED"))
    below = reach(down, edges.sparkSession.createDataFrame([(start,)], "start string")).select(F.col("id").alias("class"))
    return edges.where("relation = 'instantiates'").select("source", F.col("target").alias("class")).distinct().join(below, "class").select("source", "class")


def common_endings(classes: DataFrame, terms: DataFrame, least: int = 20) -> DataFrame:
    """(term, classes): terms(term) that so many labels of classes(label) end with. Every ending of a label is joined: no pairs."""
    label = F.lower("label")
    endings = classes.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("label")), lambda k: F.substr(label, k, F.length("label")))).alias("term"))
    return endings.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") >= least)


def distinct_suffixes(classes: DataFrame) -> DataFrame:
    """(id, shown): the shortest end of two segments or more that no other class(id) has, else the whole name."""
    parts = F.split("id", r"\\")
    every = classes.select("id").distinct().select("id", F.explode(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)))).alias("n")).select("id", "n", F.array_join(F.slice(parts, -F.least("n", F.size(parts)), F.least("n", F.size(parts))), "\\").alias("shown"))
    shared = every.groupBy("shown").agg(F.count(F.lit(1)).alias("classes"), F.min("id").alias("id"), F.min("n").alias("n")).where("classes = 1")
    best = shared.groupBy("id").agg(F.min_by("shown", "n").alias("shown"))
    return classes.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("shown", "id").alias("shown"))


def _heights(steps: DataFrame) -> DataFrame:
    """(class, height): how many steps(_at, to) lead up from each class at most; classes on a ring or below one are left out.
    Classes are settled in rounds, once all that they lead to are."""
    classes = materialize(steps.select(F.col("_at").alias("class")).union(steps.select("to")).distinct(), "classes")
    open_steps, levels = steps.select("_at", "to"), []
    for height in count():
        level = materialize(classes.join(open_steps.select(F.col("_at").alias("class")), "class", "left_anti").select("class", F.lit(height).alias("height")), "heights")
        if not level.limit(1).count():
            break
        levels.append(level)
        rest = materialize(classes.join(level, "class", "left_anti"), "classes")
        ahead = materialize(open_steps.join(level.select(F.col("class").alias("to")), "to", "left_anti").select("_at", "to"), "steps")
        discard(classes)
        if height:
            discard(open_steps)
        classes, open_steps = rest, ahead
    return reduce(DataFrame.unionByName, levels) if levels else classes.select("class", F.lit(0).alias("height")).limit(0)


def found_members(members: DataFrame, edges: DataFrame, relations: tuple[str, ...] = ("extends", "uses_trait")) -> DataFrame:
    """(class, name, type, depth): the type of each property members(class, name, type) that a class has: its own, else that which a
    depth-first search over its ancestors, earlier relations first, meets first.

    That is what the first of its parents has that has the property at all, so members are handed down, from classes without
    parents, and no lineage is made. Where classes are their own ancestors, these and what is below have lineages.
    """
    rank = F.array_position(F.array(*(F.lit(r) for r in relations)), F.col("relation")).cast("int")
    steps = edges.where(F.col("relation").isin(*relations)).select(F.col("source").alias("_at"), rank.alias("rank"), F.col("target").alias("to"))
    steps = materialize(steps.distinct(), "steps")
    heights = materialize(_heights(steps), "heights")
    own = materialize(members.where("class is not null").groupBy("class", "name").agg(F.min(F.struct("type")).alias("least")).select("class", "name", "least.type"), "own")
    lone = own.join(steps.select(F.col("_at").alias("class")), "class", "left_anti")
    down = materialize(steps.join(heights.withColumnsRenamed({"class": "_at", "height": "_height"}), "_at"), "downward")
    first = F.min(F.struct("rank", "to", "type", "depth")).alias("best")
    mine = own.select("class", "name", F.lit(0).alias("rank"), F.lit("").alias("to"), "type", F.lit(0).alias("depth"))
    level = materialize(lone.select("class", "name", "type", F.lit(0).alias("depth")), "found")
    levels, waiting = [level], []
    last = heights.agg(F.max("height")).first()[0] or 0
    for height in range(1, last + 1):
        # what a level hands down to classes that are not next waits for the other parents of these
        given = level.join(down, level["class"] == down["to"]).select(F.col("_at").alias("class"), "name", "rank", "to", "type", (F.col("depth") + 1).alias("depth"), "_height")
        late = materialize(given.where(F.col("_height") > height), "waiting")
        ready = [given, *waiting]
        if late.limit(1).count():
            waiting = [*waiting, late]
        here = mine.join(heights.where(F.col("height") == height), "class", "left_semi")
        ready = reduce(DataFrame.union, [here, *(x.where(F.col("_height") == height).drop("_height") for x in ready)])
        level = materialize(ready.groupBy("class", "name").agg(first).select("class", "name", "best.type", "best.depth"), "found")
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)
    rings = materialize(steps.join(heights.select(F.col("class").alias("_at")), "_at", "left_anti"), "rings")
    if not rings.limit(1).count():
        return found
    ringed = rings.select(F.col("_at").alias("class")).distinct()
    inner = rings.join(ringed.withColumnRenamed("class", "to"), "to", "left_semi").select(F.col("_at").alias("source"), F.element_at(F.array(*(F.lit(r) for r in relations)), F.col("rank")).alias("relation"), F.col("to").alias("target"))
    lineage = ranked_lineage(inner, relations)
    outer = rings.join(found.withColumnRenamed("class", "to"), "to").select(F.col("_at").alias("id"), "name", "type", "depth", F.array(F.struct("rank", "to")).alias("_step"))
    given = own.select(F.col("class").alias("id"), "name", "type", F.lit(0).alias("depth"), F.array().cast(outer.schema["_step"].dataType).alias("_step")).union(outer.select("id", "name", "type", (F.col("depth") + 1).alias("depth"), "_step"))
    best = lineage.join(given, "id").groupBy(F.col("start").alias("class"), "name").agg(F.min(F.struct(F.concat("path", "_step").alias("path"), "type", (F.size("path") + F.col("depth")).alias("depth"))).alias("best"))
    return found.unionByName(best.select("class", "name", "best.type", "best.depth"))
