"""Answers that grow from seeds: the module around some classes, and a subgraph about a topic, with room for so much.

Both go on in rounds, in which candidates compete for the places that are left. What is chosen stays small, because room is a
parameter, so it is broadcast to the edges; the candidates of a round are not, and are ranked by Spark. Ties end by name.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.graph import CLASS_LIKE, degrees
from knotwork.operators.impact import class_of
from knotwork.operators.traverse import closure
from knotwork.session import materialize

#: Relations by which a class works with another; how telling a relation is; methods that run a class; callers of a
#: hub; neighbours beyond which a node that is not about the question is a hub; classes beyond which a namespace is a layer.
STRONG = ("calls", "instantiates", "references", "receives", "extends", "implements", "dispatches", "handled_by", "reads_state_of")
TELLING = {"handled_by": 3, "calls": 3, "dispatches": 3, "receives": 3, "requests": 3, "reads_state_of": 2, "implements": 2, "extends": 2, "overrides": 2, "has_method": 2, "instantiates": 1, "references": 1}
ENTRY_POINTS = ("__invoke", "handle", "execute", "process", "provide", "run", "apply", "resolve", "validate", "supports")
HUB, NEIGHBOURS, MODULE = 20, 150, 60


def _namespace(ident: Column | str) -> Column:
    return F.regexp_replace(ident, r"(^|\\)[^\\]*$", "")


def class_links(classes: DataFrame, edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(class, other, uses, used_by): application classes(id) that work with each other, themselves or by their methods.

    Closures belong to who writes them; calls of methods that many classes call, or of accessors to an instance, link nothing, nor
    do members of a list, and exceptions.
    """
    own = edges.select("source", "target", "relation", "confidence", F.coalesce("via", F.lit("")).alias("via"), class_of("source").alias("a"), class_of("target").alias("b"))
    app = classes.select(F.col("id").alias("a")).distinct()
    callers = own.where("relation = 'calls'").join(app, "a", "left_semi").groupBy("target").agg(F.count_distinct("a").alias("n")).where(F.col("n") >= hub).select("target", F.lit(True).alias("_hub"))
    kept = own.where(F.col("relation").isin(*STRONG) & ~F.col("via").startswith("closure of ") & (F.col("a") != F.col("b")))
    kept = kept.where((F.col("relation") != "receives") | ((F.col("confidence") == "EXTRACTED") & ~F.col("via").startswith("tagged_")))
    kept = kept.join(callers, "target", "left").where((F.col("relation") != "calls") | (F.col("_hub").isNull() & ~F.lower("target").rlike("::(get)?instance$")))
    pairs = kept.select("a", "b").distinct()
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), F.lit(True).alias("uses"), F.lit(False).alias("used_by")).union(pairs.select("b", "a", F.lit(False), F.lit(True)))
    both = both.groupBy("class", "other").agg(F.max("uses").alias("uses"), F.max("used_by").alias("used_by")).where(~F.col("other").rlike("(Exception|Error)$"))
    return both.join(app.withColumnRenamed("a", "other"), "other", "left_semi").select("class", "other", "uses", "used_by")


def families(classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((head, member, members), (class, head)): the classes and enums below each of classes(id, kind), through classes alone; and
    the nearest head with two members or more above each class."""
    app = classes.select("id").distinct()
    inner = edges.where(F.col("relation").isin("extends", "implements")).select("source", "relation", "target").join(app.withColumnRenamed("id", "source"), "source", "left_semi")
    lines = materialize(closure(inner, ("extends", "implements")).where("depth > 0"), "families")
    leaves = classes.where(F.col("kind").isin("class", "enum")).select(F.col("id").alias("member"))
    below = lines.select(F.col("id").alias("head"), F.col("start").alias("member")).join(leaves, "member", "left_semi").distinct()
    counted = below.groupBy("head").agg(F.count(F.lit(1)).alias("members"))
    members = materialize(below.join(counted, "head"), "members")
    # a head is looked for through application classes only
    ways = closure(inner.join(app.withColumnRenamed("id", "target"), "target", "left_semi"), ("extends", "implements")).where("depth > 0")
    large = counted.where("members >= 2").select(F.col("head").alias("id"))
    heads = ways.join(large, "id").groupBy(F.col("start").alias("class")).agg(F.min(F.struct("depth", "id")).alias("best")).select("class", F.col("best.id").alias("head"))
    return members, materialize(heads, "heads")


def _connected(among: DataFrame, seeds: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): of the classes among those linked with the seeds: up what uses them, then down what these use, never up again."""
    inside = links.join(F.broadcast(among.select(F.col("id").alias("class"))), "class", "left_semi").join(F.broadcast(among.select(F.col("id").alias("other"))), "other", "left_semi")
    down = inside.where("uses").select("class", "other", F.lit("down").alias("_to"))
    up = inside.where("used_by").select("class", "other", F.lit("up").alias("_to"))
    lines = edges.where(F.col("relation").isin("extends", "implements")).select("source", "target")
    same = lines.select(F.col("source").alias("class"), F.col("target").alias("other")).union(lines.select("target", "source")).join(F.broadcast(among.select(F.col("id").alias("other"))), "other", "left_semi").select("class", "other", F.lit("same").alias("_to"))
    steps = materialize(down.unionByName(up).unionByName(same).distinct(), "inside")
    level = seen = materialize(seeds.select("id", F.lit("both").alias("way")), "connected")
    while level.limit(1).count():
        ahead = level.join(steps, level["id"] == steps["class"]).where("not (_to = 'up' and way = 'down')")
        ahead = ahead.select(F.col("other").alias("id"), F.when(F.col("_to") == "same", F.col("way")).otherwise(F.col("_to")).alias("way")).distinct()
        ahead = ahead.join(seen, ["id", "way"], "left_anti").join(seen.where("way = 'both'").select("id"), "id", "left_anti")
        level = materialize(ahead, "connected")
        seen = materialize(seen.unionByName(level), "connected")
    return seen.select("id").distinct()


def modules(classes: DataFrame, seeds: DataFrame, most: int = MODULE) -> DataFrame:
    """(seed, id): the classes of a seed's namespace and of those below it, unless they are more than a module has."""
    spaces = seeds.select(F.col("id").alias("seed"), _namespace("id").alias("space")).where("space <> ''")
    parts = F.split("id", r"\\")
    every = classes.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "\\"))).alias("space"), F.size(parts).alias("n")).where("n > 1")
    found = every.join(F.broadcast(spaces), "space").select("seed", "id").distinct()  # seeds: what a question names
    large = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("seed")
    return found.join(large, "seed", "left_anti")


def grow_module(classes: DataFrame, edges: DataFrame, seeds: DataFrame, about: DataFrame, most: int = 45, rounds: int = 4, hub: int = HUB, asked: DataFrame | None = None) -> DataFrame:
    """(id, round, place, state): the classes of a feature, in the order in which they joined; round 0 are the seeds' own.

    classes: (id, kind) of the application. about: (id, score, topic, half, words), what a class has to do with the question: its
    relevance, whether it is on the topic, whether its own name has half of the question's words, and the words its name has.
    Each round those join that classes of the core, but for hubs, are linked with: on the topic by any use, others by a use both
    ways, or as a family that is used; off the topic only through a class about the question. A family that is linked by half of
    its members joins by its head instead. The best take the places that are left: by links, relevance, fewer words, name.
    state: core; hub (in the core, not followed); member (in the core, but shown by its family, unless asked(id) for); left (no place).
    """
    links = materialize(class_links(classes, edges, hub), "links")
    members, heads = families(classes, edges)
    about = materialize(classes.select("id", "kind").join(about, "id", "left").na.fill({"score": 0.0, "topic": False, "half": False, "words": 0}), "about")
    users = links.where("used_by").groupBy(F.col("class").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hub).select("id", F.lit(True).alias("_busy"))
    seeds = seeds.select("id").distinct()
    begin = _connected(seeds.union(modules(classes, seeds).select("id")).distinct(), seeds, links, edges)
    core = begin.select("id", F.lit(0).alias("round"), F.row_number().over(_by("id")).alias("place"), F.lit(True).alias("anchor"), F.lit(True).alias("followed"))
    core = materialize(core, "core")
    left: list[DataFrame] = []
    for number in range(1, rounds + 1):
        size = core.count()
        if size >= most:
            break
        inside = core.select("id")
        stand_in = members.where("members >= 2").join(F.broadcast(inside.withColumnRenamed("id", "head")), "head", "left_semi").select(F.col("member").alias("other"))
        met = F.broadcast(core.where("followed").select(F.col("id").alias("class"), "anchor")).join(links, "class")
        met = met.join(F.broadcast(inside.withColumnRenamed("id", "other")), "other", "left_anti").join(stand_in, "other", "left_anti")
        met = materialize(met, "met")
        tally = met.groupBy(F.col("other").alias("id")).agg(F.sum(F.col("uses").cast("int")).alias("into"), F.sum(F.col("used_by").cast("int")).alias("out"), F.max("anchor").alias("anchored"))
        through = met.where("used_by").select(F.col("other").alias("class")).distinct().join(heads, "class").join(F.broadcast(inside.withColumnRenamed("id", "head")), "head", "left_anti")
        through = through.groupBy("head").agg(F.count(F.lit(1)).alias("linked")).join(members.select("head", "members").distinct(), "head").where((F.col("linked") >= 2) & (2 * F.col("linked") >= F.col("members")))
        working = links.join(F.broadcast(inside.withColumnRenamed("id", "other")), "other", "left_semi").select(F.col("class").alias("head")).distinct()
        near = working.union(about.where("topic").select("id")).distinct()
        joining = materialize(through.join(near, "head", "left_semi").select("head", (2 * F.col("linked")).alias("weight")), "joining")
        one_of = joining.join(members, "head").select(F.col("member").alias("id")).distinct()
        several = members.where("members >= 2").select(F.col("head").alias("id"), F.lit(True).alias("_several")).distinct()
        rows = tally.join(about, "id").join(one_of, "id", "left_anti").join(several, "id", "left").withColumn("_several", F.coalesce("_several", F.lit(False)))
        fits = ((F.col("into") >= 1) & (F.col("topic") | (F.col("out") >= 1))) | ((F.col("out") >= 1) & (F.col("topic") | F.col("_several")))
        rows = rows.where((F.col("topic") | F.col("anchored")) & fits).select("id", (F.col("into") * 2 + F.col("out") + F.when(F.col("topic"), 2).otherwise(0)).alias("weight"), F.lit(1).alias("first"))
        accepted = rows.unionByName(joining.select(F.col("head").alias("id"), "weight", F.lit(2).alias("first"))).groupBy("id").agg(F.min_by("weight", "first").alias("weight"))
        accepted = accepted.join(about, "id").join(users, "id", "left")
        ranked = accepted.withColumn("place", F.row_number().over(_by(F.desc("weight"), F.desc("score"), "words", "id")))
        ranked = materialize(ranked.select("id", F.lit(number).alias("round"), (F.col("place") + size).alias("place"), F.col("topic").alias("anchor"), (F.col("_busy").isNull() | F.col("half")).alias("followed")), "accepted")
        if not ranked.limit(1).count():
            break
        left.append(ranked.where(F.col("place") > most))
        core = materialize(core.unionByName(ranked.where(F.col("place") <= most)), "core")
    standing = core.join(about.select("id", "kind"), "id").where("kind <> 'class' or followed").select(F.col("id").alias("head"))
    shown = members.where("members >= 2").join(F.broadcast(standing), "head", "left_semi").select(F.col("member").alias("id")).distinct()
    if asked is not None:
        shown = shown.join(asked.select("id"), "id", "left_anti")
    found = core.join(shown.withColumn("_member", F.lit(True)), "id", "left")
    state = F.when(F.col("_member"), "member").when(~F.col("followed"), "hub").otherwise("core")
    out = found.select("id", "round", "place", state.alias("state"))
    for rows in left:
        out = out.unionByName(rows.join(shown, "id", "left_anti").select("id", "round", "place", F.lit("left").alias("state")))
    # a class that found no place in one round may be in the core, or left, by another: its first row counts
    return out.groupBy("id").agg(F.min(F.struct((F.col("state") == "left").alias("late"), "round", "place", "state")).alias("x")).select("id", "x.round", "x.place", "x.state")


def _by(*order: Column | str):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def expand_topic(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, scores: DataFrame, depth: int = 2, budget: int = 60, shown: DataFrame | None = None, with_tests: bool = True, neighbours: int = NEIGHBOURS, module: int = MODULE) -> DataFrame:
    """(id, level, score): the nodes of a topic around seeds(id); level is null for methods that only carry a message between classes.

    nodes: (id, kind, test). scores: (id, score, own), the relevance of a node, and that of its own name. Each level considers the neighbours of
    the last one that are about the question, then those by a telling relation that are no hub, and deals out the room that is
    left: two thirds of it on all levels but the last. Only what is about the question leads on. A method stands for its class,
    unless its class is in shown(id), or a seed's; a member of a family that is there is left to its head; classes of a seed's namespace count
    as neighbours of the seed.
    """
    classes = nodes.where(F.col("kind").isin(*CLASS_LIKE)).select("id", "kind", "test")
    _, heads = families(classes.where("not test"), edges)
    own_classes = materialize(seeds.select(class_of("id").alias("id")).distinct(), "seeds")
    shown = own_classes if shown is None else shown.select("id").distinct()
    weight = F.lit(0)
    for relation, value in TELLING.items():
        weight = F.when(F.col("relation") == relation, value).otherwise(weight)
    listed = (F.col("relation") == "receives") & (F.coalesce("via", F.lit("")).startswith("tagged_") | F.coalesce("via", F.lit("")).startswith("through "))
    kept = edges.where(~F.col("relation").isin("imports", "defines") & ~listed).select("source", "relation", "target", weight.alias("weight"))
    both = kept.select(F.col("source").alias("at"), F.col("target").alias("to"), "relation", "weight", F.lit(True).alias("ahead")).union(kept.select("target", "source", "relation", "weight", F.lit(False)))
    scored = nodes.select(F.col("id").alias("to"), "kind", "test").join(scores.select(F.col("id").alias("to"), "score", "own"), "to", "left").na.fill({"score": 0.0, "own": 0.0})
    busy = degrees(edges).where(F.col("degree") > neighbours).select(F.col("id").alias("to"), F.lit(True).alias("_busy"))
    scored = materialize(scored.join(busy, "to", "left").join(heads.withColumnsRenamed({"class": "to", "head": "_head"}), "to", "left"), "scored")
    space = nodes.where(F.col("kind").isin(*CLASS_LIKE)).select("id", _namespace("id").alias("space"))
    spaces = space.join(F.broadcast(seeds.select(F.col("id").alias("seed"), _namespace("id").alias("space"))), "space")
    small = spaces.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= module).select("seed")
    siblings = spaces.join(small, "seed", "left_semi").where("id <> seed").join(own_classes.withColumnRenamed("id", "seed"), "seed", "left_semi").select(F.col("id").alias("to"))
    selected = materialize(seeds.select("id", F.lit(0).alias("level"), F.lit(0.0).alias("score")).distinct(), "selected")
    frontier = selected.select("id")
    for level in range(1, depth + 1):
        room = budget - selected.count()
        if room <= 0 or not frontier.limit(1).count():
            break
        near = F.broadcast(frontier.withColumnRenamed("id", "at")).join(both, "at")  # the frontier has at most budget rows
        of_class = (F.col("relation") == "has_method")
        name = F.lower(F.substring_index("to", "::", -1))
        methods = near.where(of_class)
        methods = methods.join(own_classes.withColumnRenamed("id", "at"), "at", "left_anti").unionByName(methods.join(own_classes.withColumnRenamed("id", "at"), "at", "left_semi").join(shown.withColumnRenamed("id", "at"), "at", "left_semi"))
        methods = methods.join(scored, "to").where((F.col("own") > 0) | name.isin(*ENTRY_POINTS)).select("to", F.lit(2).alias("weight"), F.lit(True).alias("by_name"))
        others = near.where(~of_class).join(nodes.select(F.col("id").alias("to"), F.col("kind").alias("_kind")), "to").withColumn("_class", class_of("to"))
        others = others.join(shown.select(F.col("id").alias("_class"), F.lit(True).alias("_shown")), "_class", "left").join(nodes.select(F.col("id").alias("_class"), F.lit(True).alias("_known")), "_class", "left")
        stands = (F.col("_kind") == "method") & F.col("_shown").isNull() & F.col("_known")
        others = others.select(F.when(stands, F.col("_class")).otherwise(F.col("to")).alias("to"), "weight", F.lit(False).alias("by_name"))
        rows = methods.unionByName(others)
        if level == 1:
            rows = rows.unionByName(siblings.select("to", F.lit(2).alias("weight"), F.lit(False).alias("by_name")))
        here = F.broadcast(selected.select(F.col("id").alias("to")))
        rows = rows.join(here, "to", "left_anti").join(scored, "to").where(~F.col("kind").isin("file", "external"))
        if not with_tests:
            rows = rows.where(~F.col("test"))
        rows = rows.join(F.broadcast(selected.select(F.col("id").alias("_head"), F.lit(True).alias("_there"))), "_head", "left").where(F.col("_there").isNull() | (F.col("own") > 0))
        rows = rows.withColumn("score", F.when(F.col("by_name"), F.col("own")).otherwise(F.col("score"))).where((F.col("score") > 0) | ((F.col("weight") >= 2) & F.col("_busy").isNull()))
        best = rows.groupBy(F.col("to").alias("id")).agg(F.max(F.struct((F.col("score") * 10 + F.col("weight")).alias("priority"), "score")).alias("best"))
        share = room if level == depth else ceil(room * 2 / 3)
        chosen = materialize(best.orderBy(F.desc("best.priority"), "id").limit(share).select("id", F.lit(level).alias("level"), F.col("best.score").alias("score")), "chosen")
        selected = materialize(selected.unionByName(chosen), "selected")
        frontier = chosen.where("score > 0").select("id")
    carried = edges.where(F.col("relation").isin("handled_by", "dispatches"))
    here = selected.select("id")
    ends = carried.select(F.col("source").alias("at"), F.col("target").alias("id")).union(carried.select("target", "source"))
    bridges = ends.join(F.broadcast(here.withColumnRenamed("id", "at")), "at", "left_semi").select("id").distinct().where(F.col("id").contains("::"))
    bridges = bridges.join(F.broadcast(here), "id", "left_anti").join(F.broadcast(here.withColumnRenamed("id", "_class")), class_of(F.col("id")) == F.col("_class"), "left_semi")
    return selected.unionByName(bridges.select("id", F.lit(None).cast("int").alias("level"), F.lit(0.0).alias("score")))


def topic_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges among the nodes of a topic; at those that only carry a message, the message's alone."""
    ends = [F.broadcast(found.select(F.col("id").alias(c), F.col("level").isNull().alias(f"_{c}"))) for c in ("source", "target")]  # a topic has at most its budget's nodes
    rows = edges.join(ends[0], "source").join(ends[1], "target")
    return rows.where(~(F.col("_source") | F.col("_target")) | F.col("relation").isin("handled_by", "dispatches")).drop("_source", "_target")
