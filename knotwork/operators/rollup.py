"""Namespaces, layers and rules: what classes depend on each other, and what they must not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.words import bound, namespace_of
from knotwork.operators.graph import confidence_rank
from knotwork.session import materialize

#: Segments that name a layer outright, segments that hint at one, and which roles may not depend on which.
EXPLICIT = {
    "domain": ("domain",),
    "application": ("application", "usecase", "usecases"),
    "infrastructure": ("infrastructure", "infra", "adapter", "adapters"),
    "interface": ("ui", "presentation", "userinterface"),
    "port": ("port", "ports"),
}
GENERIC = {
    "domain": ("model", "entity", "entities", "valueobject", "valueobjects"),
    "infrastructure": ("persistence",),
    "interface": ("controller", "controllers", "http", "api", "cli"),
}
NOT_IN_RULES = ("api",)
FORBIDDEN = (
    ("domain", "application"), ("domain", "infrastructure"), ("domain", "interface"), ("application", "infrastructure"),
    ("application", "interface"), ("port", "infrastructure"), ("port", "interface"),
)


def _role(segment: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for role, values in names.items():
        out = F.when(F.lower(segment).isin(*values), role).otherwise(out)
    return out


def layer(segments: Column) -> Column:
    """struct(role, position, explicit) of the first explicit layer, else of the last hint, else null."""
    marked = F.transform(segments, lambda s, i: F.struct(_role(s, EXPLICIT).alias("sure"), _role(s, GENERIC).alias("hint"), i.alias("at")))
    return bound(marked, lambda m: bound(F.struct(F.get(F.filter(m, lambda x: x["sure"].isNotNull()), F.lit(0)).alias("sure"), F.try_element_at(F.filter(m, lambda x: x["hint"].isNotNull()), F.lit(-1)).alias("hint")), _found_layer))


def _found_layer(x: Column) -> Column:
    sure, hint = x["sure"], x["hint"]
    found = F.when(sure["sure"].isNotNull(), F.struct(sure["sure"].alias("role"), sure["at"].alias("position"), F.lit(True).alias("explicit")))
    return found.when(hint["hint"].isNotNull(), F.struct(hint["hint"].alias("role"), hint["at"].alias("position"), F.lit(False).alias("explicit")))


def context(segments: Column, found: Column, layer_first: bool = False) -> Column:
    """The bounded context of a class with an explicit layer: what stands before the layer, or after it where projects put it first."""
    if layer_first:
        return F.when(found["explicit"], F.get(segments, found["position"] + 1))
    return F.when(found["explicit"] & (found["position"] > 0), F.array_join(F.slice(segments, 1, found["position"]), "\\"))


def namespace_tree(ids: DataFrame, levels: int = 3) -> DataFrame:
    """(namespace, depth, classes) of every prefix of up to so many segments."""
    parts = ids.select(namespace_of(F.col("id")).alias("parts"))
    prefixes = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(levels))), lambda k: F.struct(F.array_join(F.slice("parts", 1, k), "\\").alias("namespace"), k.alias("depth")))).alias("x")).where("size(parts) > 0")
    return prefixes.groupBy("x.namespace", "x.depth").agg(F.count(F.lit(1)).alias("classes"))


def collapsed_tree(tree: DataFrame) -> DataFrame:
    """Namespaces of a tree without those whose classes all lie in one namespace below."""
    parent = F.regexp_replace("namespace", r"\\[^\\]*$", "")
    below = tree.where("depth > 1").groupBy(parent.alias("namespace")).agg(F.count(F.lit(1)).alias("children"), F.max("classes").alias("largest"))
    joined = tree.join(below, "namespace", "left")
    return joined.where(~((F.coalesce("children", F.lit(0)) == 1) & (F.col("largest") == F.col("classes")))).select("namespace", "depth", "classes")


def boundaries(edges: DataFrame, depth: int) -> DataFrame:
    """(from, to, n): edges between namespaces cut at depth."""
    def cut(c: str) -> Column:
        return F.array_join(F.slice(namespace_of(F.col(c)), 1, depth), "\\")

    pairs = edges.select(cut("source").alias("from"), cut("target").alias("to")).where(F.col("from") != F.col("to"))
    return pairs.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def _of_ends(pairs: DataFrame, **columns: Callable[[Column], Column]) -> DataFrame:
    """pairs(source, target) with columns of both ends, from_ and to_, worked out once for each class and then joined."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("source").alias("_id")).union(pairs.select("target")).distinct().withColumns({name: of(F.col("_id")) for name, of in columns.items()})
    ends = materialize(ends, "ends")
    for side, end in (("from", "source"), ("to", "target")):
        pairs = pairs.join(ends.select(F.col("_id").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in columns)), end)
    return pairs


def layered(edges: DataFrame) -> DataFrame:
    """Edges with the layer and the context of both ends."""
    return _of_ends(edges, layer=lambda c: layer(namespace_of(c)), context=lambda c: bound(namespace_of(c), lambda parts: bound(layer(parts), lambda found: context(parts, found))))


def rule_role(ident: Column) -> Column:
    """The layer that rules on dependencies see: that of the class, unless its segment is too vague for rules."""
    def role(parts: Column) -> Column:
        return bound(layer(parts), lambda found: F.when(~F.lower(F.get(parts, found["position"])).isin(*NOT_IN_RULES), found["role"]))

    return bound(namespace_of(ident), role)


def layer_violations(edges: DataFrame) -> DataFrame:
    """(source, target, from_role, to_role, n, confidence): class pairs against the layers' rules, with the strongest confidence.

    Guesses (ambiguous edges) break no rule. Edges are counted by pairs first, so that layers are found for pairs and not for
    every edge."""
    best = F.min_by("confidence", confidence_rank(F.col("confidence")))
    pairs = edges.where("confidence <> 'AMBIGUOUS'").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), best.alias("confidence"))
    placed = _of_ends(pairs, role=rule_role)
    forbidden = F.struct("from_role", "to_role").isin(*(F.struct(F.lit(a), F.lit(b)) for a, b in FORBIDDEN))
    return placed.where(forbidden).select("source", "target", "from_role", "to_role", "n", "confidence")


def context_pairs(edges: DataFrame) -> DataFrame:
    """(from_context, to_context, n): edges that cross bounded contexts."""
    pairs = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    crossing = layered(pairs).where(F.col("from_context") != F.col("to_context"))
    return crossing.groupBy("from_context", "to_context").agg(F.sum("n").alias("n"))


def glob(pattern: str) -> str:
    """A pattern of class names as a regular expression: * within a segment, ** across, ? one character, a final \\ all below."""
    out, i = "(?i)^", 0
    pattern = pattern + "**" if pattern.endswith("\\") else pattern
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += r"[^\\]*"
        elif c == "?":
            out += r"[^\\]"
        else:
            out += c if c.isalnum() else "\\" + c
        i += 1
    return out + "$"


@dataclass(frozen=True)
class StructureRule:
    """What classes that match must be: classes, but not those of beside, and of one kind where that is given. They have the
    modifier and lack another, have a name of the given form, implement, extend and use what is named (they or an
    ancestor), and have no public methods but those of public."""

    name: str
    classes: str
    modifier: str | None = None
    named: str | None = None
    without: str | None = None
    implements: tuple[str, ...] = ()
    extends: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()
    public: tuple[str, ...] | None = None
    beside: str | None = None
    kind: str | None = None


@dataclass(frozen=True)
class DependencyRule:
    """Classes that match source must not depend on what matches deny; with allow, on nothing but what matches it. deny wins."""

    name: str
    source: str
    deny: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()


def structure_breaches(classes: DataFrame, rules: list[StructureRule], lineage: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """(rule, id, reason) from classes(id, modifiers[, kind]), in one pass over them for all rules.

    lineage(id, ancestor) is asked by rules on ancestors, whatever their case; methods(id, method, modifiers) by those on
    public methods.
    """
    plain, needed, limited = [], [], []
    for rule in rules:
        bound = F.col("id").rlike(glob(rule.classes))
        if rule.beside:
            bound = bound & ~F.col("id").rlike(glob(rule.beside))
        if rule.kind:
            bound = bound & (F.col("kind") == rule.kind)
        name = F.lit(rule.name).alias("rule")
        broken = []
        if rule.modifier:
            broken.append((~F.array_contains("modifiers", rule.modifier), f"not {rule.modifier}"))
        if rule.without:
            broken.append((F.array_contains("modifiers", rule.without), f"is {rule.without}"))
        if rule.named:
            broken.append((~F.col("id").rlike(glob(rule.named)), f"not named {rule.named}"))
        plain += [F.when(bound & case, F.struct(name, F.lit(reason).alias("reason"))) for case, reason in broken]
        for verb, names in (("implement", rule.implements), ("extend", rule.extends), ("use", rule.uses)):
            for other in (n.lstrip("\\") for n in names):
                needed.append(F.when(bound, F.struct(name, F.lit(f"does not {verb} {other}").alias("reason"), F.lit(other.lower()).alias("ancestor"))))
        if rule.public is not None:
            allowed = F.array(*(F.lit(m.lower()) for m in rule.public)).cast("array<string>").alias("allowed")
            limited.append(F.when(bound, F.struct(name, allowed)))

    def cases(columns: list[Column]) -> DataFrame:
        return classes.select("id", F.inline(F.array_compact(F.array(*columns))))

    found = []
    if plain:
        found.append(cases(plain).select("rule", "id", "reason"))
    if needed:
        has = lineage.select("id", F.lower(F.ltrim("ancestor", F.lit("\\"))).alias("ancestor"))
        found.append(cases(needed).join(has, ["id", "ancestor"], "left_anti").select("rule", "id", "reason"))
    if limited:
        public = methods.where(~F.arrays_overlap("modifiers", F.array(F.lit("private"), F.lit("protected")))).select("id", "method").distinct()
        extra = cases(limited).join(public, "id").where(~F.array_contains("allowed", F.lower("method")))
        found.append(extra.select("rule", "id", F.concat(F.lit("has the public method "), "method", F.lit("()")).alias("reason")))
    return reduce(DataFrame.unionByName, found)


def dependency_breaches(edges: DataFrame, rules: list[DependencyRule]) -> DataFrame:
    """(rule, source, target, n): the rules are part of one pass over the edges."""
    cases = []
    for rule in rules:
        target = F.col("target")
        denied = F.lit(False)
        for pattern in rule.deny:
            denied = denied | target.rlike(glob(pattern))
        allowed = F.lit(not rule.allow)
        for pattern in rule.allow:
            allowed = allowed | target.rlike(glob(pattern))
        cases.append(F.when(F.col("source").rlike(glob(rule.source)) & (denied | ~allowed), rule.name))
    broken = edges.select("source", "target", F.explode(F.array_compact(F.array(*cases))).alias("rule"))
    return broken.groupBy("rule", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def new_violations(found: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Violations that the baseline does not hold."""
    return found.join(baseline.select(*keys), keys, "left_anti")


def suffix_counts(names: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(suffix, classes) of names(name): the first suffix that a name ends with and is not itself."""
    found = F.lit(None).cast("string")
    for suffix in reversed(suffixes):
        found = F.when(F.col("name").endswith(suffix) & (F.col("name") != suffix), suffix).otherwise(found)
    return names.select(found.alias("suffix")).where("suffix is not null").groupBy("suffix").agg(F.count(F.lit(1)).alias("classes"))


def common_roots(ids: DataFrame, *by: str) -> DataFrame:
    """(by, root): the namespace that all ids of a group share. What the least and the greatest have in common, all have."""
    parts = ids.select(*by, namespace_of(F.col("id")).alias("parts")).groupBy(*by).agg(F.min("parts").alias("low"), F.max("parts").alias("high"))
    same = F.transform(F.sequence(F.lit(0), F.least(F.size("low"), F.size("high"))), lambda k: F.when(F.slice("low", 1, k) == F.slice("high", 1, k), k))
    return parts.select(*by, F.array_join(F.slice("low", 1, F.array_max(same)), "\\").alias("root"))


def route_groups(paths: DataFrame, most: int = 60) -> DataFrame:
    """(prefix, routes) of paths(path): by first segment, and by the first two where a group is larger than most."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    cut = paths.select(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("one"), F.array_join(F.slice(parts, 1, 2), "/").alias("two"))
    sizes = cut.groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    prefix = F.when(F.col("n") > most, F.col("two")).otherwise(F.col("one"))
    return cut.join(sizes, "one").groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("routes"))


def fingerprints(rows: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(by, fingerprint, rows): a digest of a group's values that no order changes, added up in each task before the shuffle."""
    part = F.conv(F.substring(F.md5(F.col(value).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.sum(part).alias("fingerprint"), F.count(F.lit(1)).alias("rows"))
