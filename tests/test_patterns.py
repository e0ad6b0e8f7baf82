"""Patterns of names against the definition by lists."""

import os
import random

from knotwork.operators import patterns


def plain(names, by="."):
    names = sorted(set(names))
    if len(names) == 1:
        return names[0]
    parts = [n.split(by) for n in names]
    first = len(os.path.commonprefix(parts))
    last = min(len(os.path.commonprefix([p[::-1] for p in parts])), min(map(len, parts)) - first)
    middles = list(dict.fromkeys(by.join(p[first : len(p) - last]) for p in parts))
    return by.join([*parts[0][:first], "{" + ",".join(middles) + "}", *parts[0][len(parts[0]) - last :]])


def plain_signatures(signatures):
    groups = {}
    for s in sorted(set(signatures)):
        at = s.find("(") if "(" in s else len(s)
        groups.setdefault(s[at:], []).append(s[:at])
    out = []
    for rest, names in groups.items():
        if len(names) == 1:
            out.append(names[0] + rest)
            continue
        prefix = os.path.commonprefix(names)
        while prefix and any(not (n[len(prefix) : len(prefix) + 1] or "A").isupper() for n in names):
            prefix = prefix[:-1]
        tails = [n[len(prefix) :] for n in names]
        suffix = os.path.commonprefix([t[::-1] for t in tails])[::-1]
        while suffix and not suffix[0].isupper():
            suffix = suffix[1:]
        middles = list(dict.fromkeys(t[: len(t) - len(suffix)] for t in tails))
        out.append(prefix + "{" + ",".join(middles) + "}" + suffix + rest)
    return sorted(out)


def test_patterns(spark):
    rng = random.Random(6)
    groups = {g: [".".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))] for g in range(80)}
    groups |= {100: ["sales.order.rule", "sales.quote.rule"], 101: ["a", "a.a", "a.a.a"], 102: ["", "x"], 103: ["x.y", "x.y"]}
    df = spark.createDataFrame([(g, n) for g, own in groups.items() for n in own] + [(1, None), (None, "n.o"), (None, "n.p")], "group long, name string").repartition(4)
    got = {r.group: r.pattern for r in patterns.common_patterns(df).collect()}
    assert got == {g: plain(own) for g, own in groups.items()} | {None: "n.{o,p}"}
    assert patterns.common_patterns(df.limit(0)).count() == 0


def test_signatures(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["Add", "Get", "Context", "Policy", "Violation", "Code"])
    groups = {g: [rng.choice(["add", "get", "is"]) + "".join(word() for _ in range(rng.randint(0, 3))) + rng.choice(["()", "(int $x)", ""]) for _ in range(rng.randint(1, 6))] for g in range(60)}
    groups |= {100: ["addContextViolation(int $x)", "addPolicyViolation(int $x)"], 101: ["code()", "message()"], 102: ["mode()", "made()"]}
    df = spark.createDataFrame([(g, s) for g, own in groups.items() for s in own] + [(None, "aX()"), (None, "aY()")], "group long, signature string").repartition(4)
    got = {}
    for r in patterns.grouped_signatures(df).collect():
        got.setdefault(r.group, []).append(r.pattern)
    assert {g: sorted(p) for g, p in got.items()} == {g: plain_signatures(own) for g, own in groups.items()} | {None: ["a{X,Y}()"]}
    assert "add{Context,Policy}Violation(int $x)" in got[100]
