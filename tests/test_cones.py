"""Cones against a plain walk on random graphs."""

import random
from collections import defaultdict

import pytest
from knotwork.operators import cones


def cls(n):
    return n.split("::")[0]


def plain(nodes, edges, start, depth, hub, most, most_classes, implementations):
    kind, file = {n[0]: n[1] for n in nodes}, {n[0]: n[2] for n in nodes}
    app = {n for n in kind if kind[n] in ("class", "interface") and file[n] and not file[n].startswith("tests/")}
    steps, callers = defaultdict(dict), defaultdict(set)
    over = defaultdict(set)
    for s, r, t, c, via in edges:
        if r == "calls" and not (via or "").startswith("closure of "):
            steps[s][t] = steps[s].get(t, True) and c == "AMBIGUOUS"
        if r == "instantiates" and f"{t}::__construct" in kind:
            steps[s][f"{t}::__construct"] = False
        if r == "overrides":
            over[t].add(s)
        if r == "calls" and cls(s) in app:
            callers[t].add(cls(s))
        if r == "instantiates" and cls(s) in app and f"{t}::__construct" in kind:
            callers[f"{t}::__construct"].add(cls(s))
    for t, own in over.items():
        if len(own) <= implementations and (kind.get(cls(t)) == "interface" or not any(e[0] == t and e[1] in ("calls", "instantiates") for e in edges)):
            for s in own:
                steps[t][s] = False
    run = lambda m: {t: g for t, g in steps[m].items() if t in kind and cls(t) in app and t != m}
    cone, hubs, frontier = {start: 0}, {}, [start]
    for d in range(1, depth + 1):
        ahead = {t for m in frontier for t in run(m)}
        busy = {t for t in ahead if len(callers[t]) >= hub or t.lower().endswith(("::instance", "::getinstance"))}
        for t in busy:
            hubs.setdefault(t, d)
        new, known = sorted(ahead - busy - set(cone)), {cls(m) for m in cone}
        fresh = list(dict.fromkeys(cls(t) for t in new if cls(t) not in known))[: max(0, most_classes - len(known))]
        frontier = [t for t in new if cls(t) in known or cls(t) in fresh][: max(0, most - len(cone))]
        cone |= dict.fromkeys(frontier, d)
    sure, queue = {start}, [start]
    while queue:
        for t, g in run(queue.pop()).items():
            if t in cone and not g and t not in sure:
                sure.add(t)
                queue.append(t)
    return {(m, d, "sure" if m in sure else "guessed", len(callers[m])) for m, d in cone.items()} | {(m, d, "hub", len(callers[m])) for m, d in hubs.items() if m not in cone}


@pytest.mark.parametrize(("seed", "limits"), [(1, (3, 3, 120, 45, 4)), (2, (4, 4, 12, 5, 1)), (3, (3, 99, 9, 45, 4))])
def test_cone(spark, seed, limits):
    rng = random.Random(seed)
    nodes = [(f"C{i}", rng.choice(["class", "class", "interface"]), rng.choice(["src/a.php"] * 5 + ["tests/a.php", None])) for i in range(14)]
    methods = [f"C{i}::{m}" for i in range(14) for m in rng.sample(["__construct", "run", "getInstance", "a", "b"], 3)]
    nodes += [(m, "method", None) for m in methods]
    edges = {(cls(m), "has_method", m, "EXTRACTED", None) for m in methods}
    edges |= {(rng.choice(methods), "calls", rng.choice([*methods, "gone::m"]), rng.choice(["EXTRACTED", "AMBIGUOUS", "AMBIGUOUS"]), rng.choice([None, None, None, "closure of x"])) for _ in range(90)}
    edges |= {(rng.choice(methods), "instantiates", f"C{rng.randrange(14)}", "EXTRACTED", None) for _ in range(12)} | {(rng.choice(methods), "overrides", rng.choice(methods), "EXTRACTED", None) for _ in range(14)}
    edges = sorted((e for e in edges if e[0] != e[2]), key=repr)
    n = spark.createDataFrame(nodes, "id string, kind string, file string")
    e = spark.createDataFrame(edges, "source string, relation string, target string, confidence string, via string").repartition(3)
    start = max(methods, key=lambda m: sum(x[0] == m for x in edges))
    got = {tuple(r) for r in cones.run_cone(n, e, start, *limits).collect()}
    want = plain(nodes, edges, start, *limits)
    assert got == want and len({s for _, _, s, _ in want}) > 1
