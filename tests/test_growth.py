"""Growing answers against plain versions over dictionaries, on random graphs."""

import math
import random
from collections import defaultdict

import pytest
from knotwork.operators import growth


def cls(n):
    return n.split("::")[0]


def space(n):
    return n.rpartition("\\")[0]


def graph(seed):
    rng = random.Random(seed)
    names = [f"App\\{rng.choice('PQ')}\\{'K' if i % 9 else 'Bad'}{i}{'Exception' if i % 11 == 5 else ''}" for i in range(34)]
    kinds = {n: rng.choice(["class"] * 4 + ["interface", "enum", "trait"]) for n in names}
    nodes = [(n, kinds[n], i % 8 == 7) for i, n in enumerate(names)] + [("file:a", "file", False), ("ext", "external", False)]
    edges = set()
    methods = []
    for n in names:
        for m in rng.sample(["handle", "load", "getInstance", "x"], rng.randint(0, 2)):
            methods.append(f"{n}::{m}")
            edges.add((n, "has_method", f"{n}::{m}", "EXTRACTED", None))
    nodes += [(m, "method", False) for m in methods]
    for _ in range(70):
        relation = rng.choice(["calls", "calls", "references", "instantiates", "receives", "dispatches", "handled_by", "reads_state_of", "imports"])
        via = rng.choice([None, None, None, "closure of x", "tagged_iterator t", "through y"])
        edges.add((rng.choice(names + methods), relation, rng.choice(names + methods + ["file:a", "ext"]), rng.choice(["EXTRACTED", "EXTRACTED", "AMBIGUOUS"]), via))
    for i in range(6, 34):
        if rng.random() < 0.5:
            edges.add((names[i], rng.choice(["extends", "implements"]), names[rng.randrange(6)], "EXTRACTED", None))
    edges = {e for e in edges if e[0] != e[2]}
    scores = {n[0]: (round(rng.random() * 3, 3), rng.choice([0.0, 0.0, 1.5])) for n in nodes if rng.random() < 0.4}
    return nodes, sorted(edges, key=repr), scores, rng


class Plain:
    def __init__(self, nodes, edges, hub):
        self.kind = {n: k for n, k, t in nodes if k in ("class", "interface", "trait", "enum") and not t}
        self.nodes, self.edges, self.hub = nodes, edges, hub
        callers = defaultdict(set)
        for s, r, t, _, _ in edges:
            if r == "calls" and cls(s) in self.kind:
                callers[t].add(cls(s))
        self.links = defaultdict(dict)
        for s, r, t, c, via in edges:
            a, b, via = cls(s), cls(t), via or ""
            if r not in growth.STRONG or via.startswith("closure of ") or a == b or r == "receives" and (c != "EXTRACTED" or via.startswith("tagged_")):
                continue
            if r == "calls" and (len(callers[t]) >= hub or t.lower().endswith(("::instance", "::getinstance"))):
                continue
            for x, y, k in ((a, b, 0), (b, a, 1)):
                if y in self.kind and not y.endswith(("Exception", "Error")):
                    self.links[x].setdefault(y, [False, False])[k] = True

    def members(self, c):
        found, queue = set(), [c]
        while queue:
            at = queue.pop()
            for s, r, t, _, _ in self.edges:
                if t == at and r in ("extends", "implements") and s in self.kind and s not in found:
                    found.add(s)
                    queue.append(s)
        return {f for f in found - {c} if self.kind[f] in ("class", "enum")}

    def head(self, c):
        seen, level = {c}, [c]
        while level:
            level = sorted({t for s, r, t, _, _ in self.edges if s in level and r in ("extends", "implements") and t in self.kind and t not in seen})
            seen |= set(level)
            for t in level:
                if len(self.members(t)) >= 2:
                    return t
        return None

    def grow(self, seeds, about, most, rounds, asked):
        zero = dict(score=0.0, topic=False, half=False, words=0)
        about = {c: {**zero, **about.get(c, {})} for c in self.kind}
        among = set(seeds)
        for s in seeds:
            found = {c for c in self.kind if space(s) and c.startswith(space(s) + "\\")}
            among |= found if len(found) <= growth.MODULE else set()
        ways, queue = set(), [(s, "both") for s in seeds]
        while queue:
            c, way = queue.pop(0)
            if (c, way) in ways or (c, "both") in ways:
                continue
            ways.add((c, way))
            for o, (uses, used) in self.links[c].items():
                if o in among:
                    queue += [(o, "down")] * uses + [(o, "up")] * (used and way != "down")
            for s, r, t, _, _ in self.edges:
                if r in ("extends", "implements") and c in (s, t) and (t if c == s else s) in among:
                    queue.append((t if c == s else s, way))
        busy = {c for c in self.kind if sum(u for _, u in self.links[c].values()) >= self.hub}
        core = {c: (0, i + 1) for i, c in enumerate(sorted({c for c, _ in ways}))}
        anchors, followed, left = set(core), set(core), {}
        for number in range(1, rounds + 1):
            if len(core) >= most:
                break
            stand = set().union(*(m for h in core if len(m := self.members(h)) >= 2))
            tally, through = {}, defaultdict(set)
            for c in core:
                for o, (uses, used) in self.links[c].items() if c in followed else ():
                    if o in core or o in stand:
                        continue
                    t = tally.setdefault(o, [0, 0, False])
                    t[0] += uses
                    t[1] += used
                    t[2] |= c in anchors
                    h = self.head(o)
                    if used and h and h not in core:
                        through[h].add(o)
            accepted, joining = {}, set()
            for h, linked in through.items():
                if len(linked) >= 2 and 2 * len(linked) >= len(self.members(h)) and (about[h]["topic"] or any(o in core for o in self.links[h])):
                    accepted[h] = 2 * len(linked)
                    joining |= self.members(h)
            for o, (into, out, anchored) in tally.items():
                topic, several = about[o]["topic"], len(self.members(o)) >= 2
                if o not in joining and (topic or anchored) and (into and (topic or out) or out and (topic or several)):
                    accepted[o] = 2 * into + out + 2 * topic
            if not accepted:
                break
            order = sorted(accepted, key=lambda o: (-accepted[o], -about[o]["score"], about[o]["words"], o))
            size = len(core)
            for place, o in enumerate(order, size + 1):
                if place > most:
                    left.setdefault(o, (number, place))
                    continue
                core[o] = (number, place)
                if about[o]["topic"]:
                    anchors.add(o)
                if o not in busy or about[o]["half"]:
                    followed.add(o)
        shown = set().union(*(m for h in core if (self.kind[h] != "class" or h in followed) and len(m := self.members(h)) >= 2)) - set(asked)
        out = {c: (*at, "member" if c in shown else "core" if c in followed else "hub") for c, at in core.items()}
        return out | {c: (*at, "left") for c, at in left.items() if c not in core and c not in shown}

    def expand(self, seeds, scores, depth, budget, shown, with_tests, neighbours, module):
        known = {n: (k, t) for n, k, t in self.nodes}
        degree = defaultdict(int)
        for s, _, t, _, _ in self.edges:
            degree[s] += 1
            degree[t] += 1
        own = {cls(s) for s in seeds}
        shown = own if shown is None else shown
        heads = {n: self.head(n) for n in self.kind}
        selected, frontier = {s: (0, 0.0) for s in seeds}, list(seeds)
        for level in range(1, depth + 1):
            room = budget - len(selected)
            if room <= 0 or not frontier:
                break
            best = {}

            def consider(o, weight, by_name):
                if o not in known or o in selected or known[o][0] in ("file", "external") or not with_tests and known[o][1]:  # noqa: B023
                    return
                score, name = scores.get(o, (0.0, 0.0))
                if heads.get(o) in selected and heads.get(o) is not None and name <= 0:  # noqa: B023
                    return
                score = name if by_name else score
                if score > 0 or weight >= 2 and degree[o] <= neighbours:
                    best[o] = max(best.get(o, (-1, 0)), (score * 10 + weight, score))  # noqa: B023

            for at in frontier:
                for s, r, t, _, via in self.edges:
                    if at not in (s, t) or r in ("imports", "defines") or r == "receives" and (via or "").startswith(("tagged_", "through ")):
                        continue
                    o = t if at == s else s
                    if o not in known:
                        continue
                    if r == "has_method":
                        if (at not in own or at in shown) and (scores.get(o, (0, 0))[1] > 0 or o.split("::")[-1].lower() in growth.ENTRY_POINTS):
                            consider(o, 2, True)
                    else:
                        stands = known[o][0] == "method" and cls(o) not in shown and cls(o) in known
                        consider(cls(o) if stands else o, growth.TELLING.get(r, 0), False)
                if level == 1 and at in own:
                    near = [n for n, (k, _) in known.items() if k in ("class", "interface", "trait", "enum") and space(n) == space(at)]
                    for n in near if len(near) <= module else ():
                        if n != at:
                            consider(n, 2, False)
            share = room if level == depth else math.ceil(room * 2 / 3)
            chosen = sorted(best, key=lambda o: (-best[o][0], o))[:share]
            for o in chosen:
                selected[o] = (level, best[o][1])
            frontier = [o for o in chosen if best[o][1] > 0]
        out = dict(selected)
        for s, r, t, _, _ in self.edges:
            for o, at in ((s, t), (t, s)):
                if r in ("handled_by", "dispatches") and at in selected and o not in selected and "::" in o and cls(o) in selected:
                    out[o] = (None, 0.0)
        return out


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id string, kind string, test boolean"), spark.createDataFrame(edges, "source string, relation string, target string, confidence string, via string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_growth(spark, seed):
    nodes, edges, scores, rng = graph(seed)
    n, e = frames(spark, nodes, edges)
    classes = n.where("kind in ('class', 'interface', 'trait', 'enum') and not test").select("id", "kind")
    for hub, most, rounds in ((3, 14, 4), (20, 45, 3)):
        plain = Plain(nodes, edges, hub)
        app = sorted(plain.kind)
        about = {c: dict(score=float(rng.randint(0, 3)), topic=rng.random() < 0.3, half=rng.random() < 0.2, words=rng.randint(1, 3)) for c in app if rng.random() < 0.7}
        seeds, asked = rng.sample(app, 2), rng.sample(app, 3)
        a = spark.createDataFrame([(c, *x.values()) for c, x in about.items()], "id string, score double, topic boolean, half boolean, words int")
        one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
        got = {r.id: (r["round"], r.place, r.state) for r in growth.grow_module(classes, e, one(seeds), a, most, rounds, hub, one(asked)).collect()}
        assert got == plain.grow(seeds, about, most, rounds, asked)


@pytest.mark.parametrize("seed", [3, 4])
def test_topic(spark, seed):
    nodes, edges, scores, rng = graph(seed)
    n, e = frames(spark, nodes, edges)
    plain = Plain(nodes, edges, 20)
    s = spark.createDataFrame([(i, *x) for i, x in scores.items()], "id string, score double, own double")
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    classes, methods = sorted(plain.kind), [x for x, k, _ in nodes if k == "method"]
    for depth, budget, shown, with_tests, neighbours, module in ((2, 12, None, True, 150, 60), (3, 30, set(rng.sample(classes, 4)), False, 8, 5)):
        seeds = [rng.choice(classes), rng.choice(methods)]
        found = growth.expand_topic(n, e, one(seeds), s, depth, budget, None if shown is None else one(shown), with_tests, neighbours, module)
        want = plain.expand(seeds, scores, depth, budget, shown, with_tests, neighbours, module)
        assert {r.id: (r.level, r.score) for r in found.collect()} == want
        among = {(x[0], x[1], x[2]) for x in edges if x[0] in want and x[2] in want and (x[1] in ("handled_by", "dispatches") or want[x[0]][0] is not None and want[x[2]][0] is not None)}
        assert {(r.source, r.relation, r.target) for r in growth.topic_edges(found, e).collect()} == among
