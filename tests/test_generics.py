"""Templates through parents: known cases, and a plain search over random lineages."""

import random
import re

from knotwork.operators import generics


def plain(templates, parents, arguments):
    order = {"extends": 1, "implements": 2, "uses_trait": 3}
    formal, passed, up = {}, {}, {}
    for c, p, t in templates:
        formal.setdefault(c, {})[p] = t
    for c, parent, p, a in arguments:
        passed[c, parent, p] = a
    for s, r, t in parents:
        up.setdefault(s, {})[t] = min(order[r], up.get(s, {}).get(t, 9))
    out = set()
    for c in {p[0] for p in parents} | set(formal):
        level = {c: ((), {t: t for t in formal.get(c, {}).values()})}
        seen, depth = {c}, 0
        while level:
            depth += 1
            ahead = {}
            for at, (path, bound) in level.items():
                for parent, rank in up.get(at, {}).items():
                    if parent not in seen:
                        terms = {t: re.sub(r"[A-Za-z_][\w\\]*", lambda m: bound.get(m[0], m[0]), passed[at, parent, p]) if (at, parent, p) in passed else "?" for p, t in formal.get(parent, {}).items()}  # noqa: B023
                        way = (*path, (rank, parent))
                        if parent not in ahead or (way, sorted(terms.items())) < (ahead[parent][0], sorted(ahead[parent][1].items())):
                            ahead[parent] = way, terms
            seen |= set(ahead)
            out |= {(c, a, depth, t, x) for a, (_, terms) in ahead.items() for t, x in terms.items()}
            level = ahead
    return out


def test_bindings(spark):
    rng = random.Random(9)
    templates = [("Node", 0, "TParent"), ("Variable", 0, "P"), ("Scalar", 0, "Q"), ("Pair", 0, "A"), ("Pair", 1, "B"), ("Swap", 0, "A"), ("Swap", 1, "B"), ("Ring", 0, "T")]
    parents = [("Variable", "extends", "Node"), ("Scalar", "extends", "Variable"), ("Leaf", "extends", "Scalar"), ("Swap", "extends", "Pair"), ("Twice", "extends", "Swap"), ("Ring", "implements", "Ring"), ("Raw", "extends", "Pair")]
    arguments = [("Variable", "Node", 0, "P"), ("Scalar", "Variable", 0, "list<Q>"), ("Leaf", "Scalar", 0, "App\\Int"), ("Swap", "Pair", 0, "B"), ("Swap", "Pair", 1, "array<A, B>"), ("Twice", "Swap", 0, "B"), ("Twice", "Swap", 1, "A"), ("Raw", "Pair", 1, "int")]
    for i in range(40):
        templates += [(f"R{i}", p, f"T{(i + p) % 3}") for p in range(i % 3)]
        for j in rng.sample(range(i), min(i, rng.randint(0, 2))):
            parents.append((f"R{i}", rng.choice(["extends", "implements", "uses_trait"]), f"R{j}"))
            arguments += [(f"R{i}", f"R{j}", p, rng.choice(["T0", "T1", "map<T1,T2>", "T2|null", "X"])) for p in range(2) if rng.random() < 0.8]
    t = spark.createDataFrame(templates, "class string, position int, template string")
    p = spark.createDataFrame(parents, "source string, relation string, target string").repartition(3)
    a = spark.createDataFrame(arguments, "class string, parent string, position int, argument string")
    got = {tuple(r) for r in generics.template_bindings(t, p, a).collect()}
    assert got == plain(templates, parents, arguments)
    assert {("Leaf", "Node", 3, "TParent", "list<App\\Int>"), ("Scalar", "Node", 2, "TParent", "list<Q>"), ("Twice", "Pair", 2, "A", "A"), ("Twice", "Pair", 2, "B", "array<B, A>"), ("Raw", "Pair", 1, "A", "?")} <= got
    assert generics.template_bindings(t.limit(0), p.limit(0), a.limit(0)).count() == 0
