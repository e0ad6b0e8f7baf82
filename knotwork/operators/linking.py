"""Links that need facts of several kinds: unions of receivers, closures, rpcs, decorators, imports, families, dispatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.words import is_test_path
from knotwork.operators.traverse import closure, reach
from knotwork.session import materialize


def union_calls(calls: DataFrame, found: DataFrame, methods: DataFrame) -> DataFrame:
    """(seq, source, name, target, confidence, outcome) of calls(seq, source, name, receivers, complete).

    Each class that a receiver may be gives a row for its method, one for each method: inferred if all branches are typed
    (complete), else ambiguous. A call without such a method is outside if complete, else goes to the only method of that
    name, if there is one.
    """
    asked = calls.select("seq", "source", "name", "complete", F.explode("receivers").alias("class"))
    sure = F.when(F.col("complete"), "INFERRED").otherwise("AMBIGUOUS")
    hits = asked.join(found.select("class", "name", "method"), ["class", "name"]).select("seq", "source", "name", F.col("method").alias("target"), sure.alias("confidence")).distinct()
    hits = hits.withColumn("outcome", F.lower("confidence"))
    unique = methods.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("method").alias("only")).where("n = 1").select("name", "only")
    missed = calls.join(hits.select("seq").distinct(), "seq", "left_anti").join(unique, "name", "left")
    outside = F.col("complete") & (F.size("receivers") > 0)
    outcome = F.when(outside, "outside").when(F.col("only").isNotNull(), "ambiguous").otherwise("unknown")
    missed = missed.withColumn("outcome", outcome).withColumn("target", F.when(F.col("outcome") == "ambiguous", F.col("only")))
    return hits.unionByName(missed.select("seq", "source", "name", "target", F.when(F.col("target").isNotNull(), "AMBIGUOUS").alias("confidence"), "outcome"))


def closure_calls(resolved: DataFrame, invoked: DataFrame) -> DataFrame:
    """(source, target, confidence, via): what a closure calls is called by the method that it is passed to, if that runs it.

    resolved(seq, source, target, confidence, outer, parameter): outer is the call that the closure is an argument of.
    invoked(method, parameter): the parameters that a method calls.
    """
    inner = resolved.where("outer is not null and target is not null").select(F.col("source").alias("_by"), F.col("target"), "confidence", "outer", "parameter")
    outer = resolved.where("target is not null").select(F.col("seq").alias("outer"), F.col("target").alias("source"))
    runs = invoked.select(F.col("method").alias("source"), "parameter").distinct()
    return inner.join(outer, "outer").join(runs, ["source", "parameter"]).select("source", "target", "confidence", F.concat(F.lit("closure of "), "_by").alias("via")).distinct()


def link_rpcs(rpcs: DataFrame, interfaces: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(operation, target, relation) of rpcs(operation, package, namespace, service, rpc): the methods behind a remote call.

    A service has a generated interface, <namespace>\\<service>Interface, where the namespace follows from the package if none
    is given. Implementing classes, but for those named *Client, implement the operation; the interface's own method is
    referenced. Names are compared without regard to case, interfaces without the service before @.
    """
    words = F.transform(F.filter(F.split("package", r"\."), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    space = F.coalesce("namespace", F.array_join(words, "\\"))
    asked = rpcs.select("operation", F.lower("rpc").alias("_name"), F.lower(F.concat(space, F.lit("\\"), "service", F.lit("Interface"))).alias("_key"))
    declared = interfaces.select(F.col("id").alias("interface"), F.lower(F.regexp_replace("id", "^[^@]*@", "")).alias("_key"))
    met = asked.join(declared, "_key").select("operation", "_name", "interface")
    owned = methods.select("class", F.lower("name").alias("_name"), F.col("method").alias("target"))
    behind = implements.where(~F.col("source").endswith("Client")).select(F.col("source").alias("class"), F.col("target").alias("interface"))
    done = met.join(behind, "interface").join(owned, ["class", "_name"]).select("operation", "target", F.lit("implemented_by").alias("relation"))
    own = met.withColumnRenamed("interface", "class").join(owned, ["class", "_name"]).select("operation", "target", F.lit("references").alias("relation"))
    return done.union(own).distinct()


def decorator_order(decorations: DataFrame) -> DataFrame:
    """(id, decorator, position): the decorators around each service, outermost (1) first, each after those around itself.

    decorations(id, decorator, priority, seq): lower priorities lie outside, of equal ones the later. A ring adds nothing.
    """
    step = F.struct("priority", (-F.col("seq")).alias("late"))
    steps = materialize(decorations.select(F.col("id").alias("_at"), "decorator", step.alias("_step")).distinct().repartition("_at"), "steps")
    level = materialize(steps.select(F.col("_at").alias("id"), "decorator", F.array("_step").alias("path"), F.array("_at", "decorator").alias("_seen")).where("id <> decorator"), "decorators")
    found = level
    while level.limit(1).count():
        ahead = level.select("id", F.col("decorator").alias("_at"), "path", "_seen").join(steps, "_at").where(~F.array_contains("_seen", F.col("decorator")))
        level = materialize(ahead.select("id", "decorator", F.concat("path", F.array("_step")).alias("path"), F.concat("_seen", F.array("decorator")).alias("_seen")), "decorators")
        found = found.unionByName(level)
    # its own end is greater than any step below it
    last = F.array(F.struct(F.lit(2**31 - 1).cast(steps.schema["_step"].dataType["priority"].dataType).alias("priority"), F.lit(0).cast("long").alias("late")))
    order = F.concat("path", last.cast(found.schema["path"].dataType))
    return found.select("id", "decorator", F.row_number().over(Window.partitionBy("id").orderBy(order)).alias("position"))


def enum_references(reads: DataFrame, types: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target): methods that read a property (reader, property) whose type (property, type) is an enum (id, kind)."""
    enums = nodes.where("kind = 'enum'").select(F.col("id").alias("type"))
    return reads.join(types, "property").join(enums, "type").select(F.col("reader").alias("source"), F.col("type").alias("target")).distinct()


def with_constants(routes: DataFrame, constants: DataFrame) -> DataFrame:
    """(route, path): routes(route, path) with each {const:NAME} replaced by its value of constants(name, value), or by {NAME}."""
    name = F.regexp_extract("_part", r"^\{const:([^}]+)\}$", 1)
    parts = routes.select("route", F.posexplode(F.split("path", r"(?=\{const:)|(?<=\})")).alias("_n", "_part")).withColumn("name", name)
    known = constants.groupBy("name").agg(F.min("value").alias("value"))
    filled = parts.join(known, "name", "left").withColumn("_part", F.when(F.col("name") == "", F.col("_part")).otherwise(F.coalesce("value", F.concat(F.lit("{"), "name", F.lit("}")))))
    return filled.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda p: p["_part"]), "").alias("path"))


def implementations_by_directory(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, directory, classes): where the classes below each interface (id) of starts lie, whatever lies between; no tests."""
    below = closure(edges, ("implements", "extends"), upward=False).where("depth > 0").join(starts.select(F.col("id").alias("start")), "start", "left_semi")
    placed = nodes.where((F.col("kind") == "class") & F.col("file").isNotNull()).where(~is_test_path(F.col("file")))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    return below.select(F.col("start"), "id").join(placed.select("id", folder.alias("directory")), "id").groupBy(F.col("start").alias("id"), "directory").agg(F.count(F.lit(1)).alias("classes"))


def foreign_dispatches(dispatches: DataFrame, handlers: DataFrame, contexts: DataFrame, shared: tuple[str, ...] = ()) -> DataFrame:
    """(handler, message, context, other): handlers (class) that dispatch a message of another bounded context, unless that is shared.

    dispatches(class, message), contexts(id, context). Contexts are compared without regard to case; a shared one is named
    whole or by its last segment.
    """
    of = contexts.where("context is not null").select("id", "context")
    sent = dispatches.select("class", "message").distinct().join(handlers.select("class").distinct(), "class", "left_semi")
    placed = sent.join(of.withColumnRenamed("id", "class"), "class").join(of.select(F.col("id").alias("message"), F.col("context").alias("other")), "message")
    low: Column = F.lower("other")
    free = low.isin(*(s.lower() for s in shared)) | F.substring_index(low, "\\", -1).isin(*(s.lower() for s in shared)) if shared else F.lit(False)
    return placed.where((F.lower("context") != low) & ~free).select(F.col("class").alias("handler"), "message", "context", "other")


def transitive_holders(arguments: DataFrame, starts: DataFrame, depth: int = 6) -> DataFrame:
    """(service, id, holder, depth): who injects each of starts(service, id), or injects what does, within one service.

    arguments(service, id, target): id is given target. A holder is found over at most depth steps, as the caller asks.
    """
    def key(name: str) -> Column:
        return F.concat_ws("\u0000", "service", name)

    edges = arguments.select(key("id").alias("source"), key("target").alias("target"), F.lit("EXTRACTED").alias("confidence"))
    found = reach(edges, starts.select(key("id").alias("start")), max_depth=depth).where("depth > 0")
    part = lambda c, n: F.split_part(c, F.lit("\u0000"), F.lit(n))
    return found.select(part("start", 1).alias("service"), part("start", 2).alias("id"), part("id", 2).alias("holder"), "depth")


def import_prefixes(files: DataFrame, imports: DataFrame, depth: int = 10) -> DataFrame:
    """(file, prefix): the prefixes under which files (file) are reached through imports(file, parent, prefix), each once.

    A file that none imports has the empty prefix. After depth imports a way stands for itself, as rings never end.
    """
    steps = materialize(imports.select(F.col("file").alias("at"), "parent", F.trim("prefix", F.lit("/")).alias("_more")).distinct().repartition("at"), "imports")
    level = files.select("file", F.col("file").alias("at"), F.array().cast("array<string>").alias("parts")).distinct()
    ends = []
    for _ in range(depth + 1):
        ends.append(level.join(steps, "at", "left_anti").select("file", "parts"))
        level = materialize(level.join(steps, "at").select("file", F.col("parent").alias("at"), F.concat(F.array("_more"), "parts").alias("parts")).distinct(), "imports")
        if not level.limit(1).count():
            break
    else:
        ends.append(level.select("file", "parts"))
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    whole = F.aggregate("parts", F.lit(""), lambda sofar, p: F.concat(F.rtrim(sofar, F.lit("/")), F.lit("/"), p))
    return found.select("file", whole.alias("prefix")).distinct()
