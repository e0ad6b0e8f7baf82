"""Resolution of facts across files: calls, overrides, messages, routes, services. Joins over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.words import path_segments
from knotwork.operators.traverse import closure, ranked_lineage
from knotwork.session import materialize

#: Rows of one side of a key that a task holds at once where all pairs of the key are made.
PART = 2048


def canonical(names: DataFrame, declared: DataFrame) -> DataFrame:
    """(service, name, id): the declared spelling of a name whatever its case, in its own service or else in shared code (null)."""
    keyed = declared.select(F.col("service").alias("_service"), F.lower("id").alias("_key"), F.col("id").alias("_id"))
    keyed = keyed.groupBy("_service", "_key").agg(F.min("_id").alias("_id"))
    asked = names.withColumn("_key", F.lower(F.ltrim("name", F.lit("\\"))))
    own = keyed.where("_service is not null").select(F.col("_service").alias("service"), "_key", F.col("_id").alias("_own"))
    root = keyed.where("_service is null").select("_key", F.col("_id").alias("_root"))
    return asked.join(own, ["service", "_key"], "left").join(root, "_key", "left").select("service", "name", F.coalesce("_own", "_root").alias("id"))


def service_of(files: DataFrame, services: DataFrame) -> DataFrame:
    """(path, service): the longest service directory that holds a path, by joining every directory of the path."""
    parts = F.split("path", "/")
    folders = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("service"))
    best = folders.join(services.select("service"), "service").groupBy("path").agg(F.max_by("service", F.length("service")).alias("service"))
    return files.select("path").join(best, "path", "left")


def find_methods(methods: DataFrame, edges: DataFrame, mixins: DataFrame | None = None) -> DataFrame:
    """(class, name, method, depth): the declaration of each method that a class has, from methods(class, name, method[, project]).

    A depth-first search over parents, then interfaces, then traits finds it; what the project declares comes before what
    its dependencies do (project: false). Where the lineage has none, the mixins(class, mixin) of the class, then those of
    its ancestors in that order, are asked in the same way. depth: steps within the lineage of the class or of the last mixin.
    """
    project = F.col("project") if "project" in methods.columns else F.lit(True)
    above = ranked_lineage(edges, ("extends", "implements", "uses_trait"))
    alone = methods.select("class") if mixins is None else methods.select("class").union(mixins.select("class")).union(mixins.select("mixin"))
    missing = alone.distinct().withColumnsRenamed({"class": "start"}).join(above, "start", "left_anti")
    lineage = above.unionByName(missing.select("start", F.col("start").alias("id"), F.array().cast(above.schema["path"].dataType).alias("path")))
    owned = methods.select(F.col("class").alias("id"), "name", "method", F.when(project, 0).otherwise(1).alias("turn"))
    block = F.array(F.struct("turn", "path", F.col("start").alias("via")))
    keyed = lineage.join(owned, "id").select(F.col("start").alias("class"), "name", "method", block.alias("key"), F.size("path").alias("depth"))
    first = F.min(F.struct("key", "method", "depth")).alias("best")
    found = keyed.groupBy("class", "name").agg(first).select("class", "name", "best.*")
    if mixins is not None:
        found = _through_mixins(found, lineage, mixins)
    return found.select("class", "name", "method", "depth")


def _through_mixins(found: DataFrame, lineage: DataFrame, mixins: DataFrame) -> DataFrame:
    """found(class, name, key, method, depth) with what mixins add. Every round adds one mixin to the front of a way; a way
    that comes back to its own class is none."""
    ways = lineage.join(mixins.select(F.col("class").alias("id"), "mixin"), "id").select("start", "mixin", F.struct(F.lit(2).alias("turn"), "path", F.col("mixin").alias("via")).alias("front"))
    ways = materialize(ways.distinct().repartition("mixin"), "mixins")
    first = F.min(F.struct("key", "method", "depth")).alias("best")
    found = level = materialize(found, "found")
    while level.limit(1).count():
        ahead = level.withColumnRenamed("class", "mixin").join(ways, "mixin").where(~F.exists("key", lambda k: k["via"] == F.col("start")))
        ahead = ahead.select(F.col("start").alias("class"), "name", F.concat(F.array("front"), "key").alias("key"), "method", "depth")
        ahead = ahead.groupBy("class", "name").agg(first).select("class", "name", "best.*")
        known = found.select("class", "name", F.col("key").alias("_old"))
        level = materialize(ahead.join(known, ["class", "name"], "left").where("_old is null or key < _old").drop("_old"), "found")
        found = materialize(found.unionByName(level).groupBy("class", "name").agg(first).select("class", "name", "best.*"), "found")
    return found


def overrides(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): each method and the method of the nearest ancestor that declares it too."""
    above = closure(edges, ("extends", "implements")).where("depth > 0")
    pairs = methods.alias("m").join(above.alias("a"), F.col("m.class") == F.col("a.start")).join(methods.alias("p"), (F.col("p.class") == F.col("a.id")) & (F.col("p.name") == F.col("m.name")))
    best = pairs.groupBy(F.col("m.method").alias("source")).agg(F.min(F.struct("a.depth", F.col("p.method").alias("method"))).alias("best"))
    return best.select("source", F.col("best.method").alias("target"))


def resolve_calls(calls: DataFrame, found: DataFrame, methods: DataFrame) -> DataFrame:
    """calls(source, receiver, name, seq) with target, confidence and outcome.

    A receiver's type that has the method makes the call inferred. Without a type, a name that one method alone has makes it
    ambiguous, any other unknown. A type that is not ours, or has no such method, is outside.
    """
    unique = methods.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("method").alias("only")).where("n = 1").select("name", "only")
    typed = calls.join(found.select(F.col("class").alias("receiver"), "name", "method"), ["receiver", "name"], "left").join(unique, "name", "left")
    outcome = F.when(F.col("method").isNotNull(), "inferred").when(F.col("receiver").isNotNull(), "outside").when(F.col("only").isNotNull(), "ambiguous").otherwise("unknown")
    typed = typed.withColumn("outcome", outcome)
    target = F.when(F.col("outcome") == "inferred", F.col("method")).when(F.col("outcome") == "ambiguous", F.col("only"))
    confidence = F.when(F.col("outcome") == "inferred", "INFERRED").when(F.col("outcome") == "ambiguous", "AMBIGUOUS")
    return typed.select("source", "receiver", "name", "seq", target.alias("target"), confidence.alias("confidence"), "outcome")


def call_outcomes(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count(F.lit(1)).alias("calls"))


def unresolved_names(resolved: DataFrame, limit: int = 15) -> DataFrame:
    """The names that calls fail on most: in any case, shown as first spelled. A top-k report."""
    missed = resolved.where("outcome = 'unknown'")
    return missed.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "seq").alias("name"), F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "key").limit(limit).select("name", "calls")


def _pairs(streamed: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join by keys, where a key may have very many pairs. Its held rows are dealt into parts of about PART rows, and its
    streamed rows are brought to each: no task makes all pairs of a key, or holds more than a part."""
    parts = held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = held.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(*held.columns), F.col("_parts")).cast("int")).drop("_parts")
    brought = streamed.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return brought.join(dealt, [*keys, "_part"]).drop("_part")


def state_readers(access: DataFrame) -> DataFrame:
    """(writer, reader, property, confidence) from access(method, class, property, kind, constants): who reads what another writes.

    Both sides' constants decide: a common one makes the link inferred, constants without a common one refute it, and where
    a side has none it is ambiguous. Pairs are as many as writers times readers, so they are not shuffled: only methods that
    access a property in several ways give a pair more than once.
    """
    ways = access.groupBy("kind", "method", "property").agg(F.collect_set(F.struct("class", "constants")).alias("ways"))
    ways = ways.select("kind", "method", "property", (F.size("ways") > 1).alias("many"), F.inline("ways"))

    def links(writes: Column | str, reads: Column | str) -> DataFrame:
        keys, sides = ["class", "property"], []
        for kind, own, name in (("read", reads, "reader"), ("write", writes, "writer")):
            sides.append(ways.where(F.col("kind") == kind).where(own).select(*keys, F.col("method").alias(name), F.col("constants").alias(f"{name}_constants")))
        none = (F.size("writer_constants") == 0) | (F.size("reader_constants") == 0)
        confidence = F.when(none, "AMBIGUOUS").when(F.arrays_overlap("writer_constants", "reader_constants"), "INFERRED")
        return _pairs(*sides, keys).where("writer <> reader").select("writer", "reader", "property", confidence.alias("confidence")).where("confidence is not null")

    return links("not many", "not many").union(links("many", F.lit(True)).union(links("not many", "many")).distinct())


def link_messages(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """(message, sender, handler): sends(message, sender) and handlers(message, handler) that meet, each pair of ends once."""
    return _pairs(sends.select("message", "sender").distinct(), handlers.select("message", "handler").distinct(), ["message"])


def message_balance(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """(message, state): sent and never handled, or handled and never sent."""
    sent, handled = sends.select("message").distinct(), handlers.select("message").distinct()
    unhandled = sent.join(handled, "message", "left_anti").withColumn("state", F.lit("unhandled"))
    return unhandled.unionByName(handled.join(sent, "message", "left_anti").withColumn("state", F.lit("never sent")))


def contracts(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """(message, source, target): a message that one service sends and another handles."""
    a = sends.select("message", F.col("service").alias("source")).distinct()
    b = handlers.select("message", F.col("service").alias("target")).distinct()
    return a.join(b, "message").where("source <> target")


def _literal(segment: Column) -> Column:
    return ~segment.rlike(r"\{[^}]*\}|\*")


def _as_pattern(segment: Column, hole: str, filling: str) -> Column:
    """A segment as a regular expression: its holes take the filling, all else stands for itself."""
    marked = F.regexp_replace(segment, hole, "\u0001")
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(marked, "([^A-Za-z0-9_\u0001])", r"\\$1"), F.lit("\u0001"), F.lit(filling)), F.lit("$"))


def _meets(asked: Column, offered: Column) -> Column:
    """Whether a segment asked for may be the one offered: * and braces stand for any, or for a part."""
    whole = (asked == offered) | (asked == "*") | offered.rlike(r"^\{[^}]*\}$")
    part_asked = asked.contains("*") & F.rlike(offered, _as_pattern(asked, r"\*", ".*"))
    part_offered = offered.contains("{") & F.rlike(asked, _as_pattern(offered, r"\{[^}]*\}", "[^/]+"))
    return whole | part_asked | part_offered


def _all_meet(asked: Column, offered: Column) -> Column:
    return F.forall(F.zip_with(asked, offered, _meets), lambda x: x)


def match_routes(requests: DataFrame, routes: DataFrame, most: int = 5) -> DataFrame:
    """(request, route, holes, rank): routes(route, method, path[, host]) that a request(request, method, path[, host]) may
    mean, most specific first.

    Paths meet on the number of segments, and on the first segment where it is a literal on both sides: an equi-join; the
    rest is compared on what is left. Braces in a route and * in a request stand for any segment or part of one. A route
    without method takes all; a route or a request without host (null or *) meets any, others must agree label by label.
    """
    def host(df: DataFrame) -> Column:
        return F.split(F.nullif(F.col("host"), F.lit("*")), r"\.") if "host" in df.columns else F.lit(None).cast("array<string>")

    r = routes.select("route", F.col("method").alias("_m"), path_segments(F.col("path")).alias("_r"), host(routes).alias("_to"))
    r = r.withColumns({"n": F.size("_r"), "holes": F.size(F.filter("_r", lambda s: s.contains("{") | (s == "*"))), "_first": F.get("_r", F.lit(0))})
    q = requests.select("request", F.col("method").alias("_q"), path_segments(F.col("path")).alias("_p"), host(requests).alias("_of"))
    q = q.withColumns({"n": F.size("_p"), "_first": F.get("_p", F.lit(0))})
    open_first = F.coalesce(~_literal(F.col("_first")), F.lit(True))
    by_first = q.where(~open_first).join(r.where(~open_first), ["n", "_first"]).drop("_first")
    any_route = q.drop("_first").join(r.where(open_first).drop("_first"), "n")
    any_request = q.where(open_first).drop("_first").join(r.where(~open_first).drop("_first"), "n")
    both = by_first.unionByName(any_route).unionByName(any_request)
    hosts = F.col("_to").isNull() | F.col("_of").isNull() | ((F.size("_to") == F.size("_of")) & _all_meet(F.col("_of"), F.col("_to")))
    found = both.where(_all_meet(F.col("_p"), F.col("_r")) & hosts & (F.col("_m").isNull() | F.col("_q").isNull() | (F.col("_m") == F.col("_q"))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("holes", "route"))).where(F.col("rank") <= most)
    return ranked.select("request", "route", "holes", "rank")


def follow_aliases(aliases: DataFrame) -> DataFrame:
    """(id, class): the end of each chain of alias(id, target), however long; a chain that runs into a ring has none.

    Every round follows each pointer's pointer, so chains halve; after as many rounds as double one to the number of aliases,
    only rings are left."""
    state = materialize(aliases.select("id", F.col("target").alias("class")), "aliases")
    most = state.count()
    open_ended = state.select(F.col("id").alias("class")).distinct()
    for _ in range(most.bit_length()):
        ahead = state.select(F.col("id").alias("class"), F.col("class").alias("next"))
        state = materialize(state.join(ahead, "class", "left").select("id", F.coalesce("next", "class").alias("class")), "aliases")
        if not state.join(open_ended, "class", "left_semi").limit(1).count():
            break
    return state.join(open_ended, "class", "left_anti").select("id", "class")


def untested(nodes: DataFrame, edges: DataFrame, is_test: Column) -> DataFrame:
    """(id, tested, used): whether tests, and whether other code, have edges to a node. is_test is over the column source."""
    uses = edges.select("target", is_test.alias("test")).groupBy(F.col("target").alias("id")).agg(F.max("test").alias("tested"), F.max(~F.col("test")).alias("used"))
    return nodes.select("id").join(uses, "id", "left").select("id", F.coalesce("tested", F.lit(False)).alias("tested"), F.coalesce("used", F.lit(False)).alias("used"))


def tagged_classes(tags: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tag, class): tags(tag, kind, value) name a class (id), a namespace (prefix) or what classes must be (instanceof).

    Namespaces are joined with every prefix of a class's namespace, ancestors with the closure: no comparison of all pairs.
    """
    by_id = tags.where("kind = 'id'").join(classes.select(F.col("id").alias("value"), F.col("id").alias("class")), "value")
    parts = F.split("id", r"\\")
    prefixes = classes.select(F.col("id").alias("class"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "\\"))).alias("value")).where("class <> value")
    by_prefix = tags.where("kind = 'prefix'").withColumn("value", F.rtrim("value", F.lit("\\"))).join(prefixes, "value")
    above = closure(edges, ("extends", "implements", "uses_trait")).select(F.col("start").alias("class"), F.col("id").alias("value"))
    by_kind = tags.where("kind = 'instanceof'").join(above, "value").join(classes.select(F.col("id").alias("class")), "class", "left_semi")
    return by_id.select("tag", "class").union(by_prefix.select("tag", "class")).union(by_kind.select("tag", "class")).distinct()


def match_operations(operations: DataFrame, routes: DataFrame) -> DataFrame:
    """(operation, route): paths of one shape, whatever their placeholders are called, methods that agree, and one service.

    A route without method takes all; an operation without service fits routes of any.
    """
    def shape(c: str) -> Column:
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(path_segments(F.col(c)), "/")), r"\{[^}]*\}", "{}")

    o = operations.select("operation", F.col("method").alias("_m"), F.col("service").alias("_s"), shape("path").alias("shape"))
    r = routes.select("route", "method", "service", shape("path").alias("shape"))
    fits = (F.col("method").isNull() | (F.col("method") == F.col("_m"))) & (F.col("_s").isNull() | F.col("service").eqNullSafe(F.col("_s")))
    return o.join(r, "shape").where(fits).select("operation", "route")
