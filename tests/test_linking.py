"""Linking operators on small facts with known answers, rings and missing facts included."""

import random

from knotwork import session
from knotwork.operators import linking, resolve, traverse, wiring


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_union_calls(spark):
    methods = spark.createDataFrame([("A", "go", "A::go"), ("B", "go", "B::go"), ("C", "solo", "C::solo")], "class string, name string, method string")
    calls = spark.createDataFrame([(1, "s", "go", ["A", "B"], True), (2, "s", "go", ["A", "X"], False), (3, "s", "no", ["A"], True), (4, "s", "solo", [], False), (5, "s", "solo", ["X"], True), (6, "s", "none", [], False)], "seq long, source string, name string, receivers array<string>, complete boolean")
    got = {(r.seq, r.target, r.confidence, r.outcome) for r in linking.union_calls(calls, methods, methods).collect()}
    assert got == {(1, "A::go", "INFERRED", "inferred"), (1, "B::go", "INFERRED", "inferred"), (2, "A::go", "AMBIGUOUS", "ambiguous"), (3, None, None, "outside"), (4, "C::solo", "AMBIGUOUS", "ambiguous"), (5, None, None, "outside"), (6, None, None, "unknown")}


def test_closure_calls(spark):
    resolved = spark.createDataFrame([(1, "a", "map", "INFERRED", None, None), (2, "a", "x", "AMBIGUOUS", 1, "0"), (3, "a", "y", "INFERRED", 1, "1"), (4, "a", None, None, 1, "0"), (5, "a", "z", "INFERRED", 4, "0")], "seq long, source string, target string, confidence string, outer long, parameter string")
    invoked = spark.createDataFrame([("map", "0"), ("map", "0")], "method string, parameter string")
    assert rows(linking.closure_calls(resolved, invoked)) == {("map", "x", "AMBIGUOUS", "closure of a")}


def test_rpcs(spark):
    rpcs = spark.createDataFrame([("op", "shop.cart", None, "Cart", "Add"), ("given", "p", "My\\Space", "S", "do"), ("none", "q", None, "S", "do")], "operation string, package string, namespace string, service string, rpc string")
    interfaces = spark.createDataFrame([("app@Shop\\Cart\\CartInterface",), ("my\\space\\sInterface",)], "id string")
    implements = spark.createDataFrame([("Impl", "app@Shop\\Cart\\CartInterface"), ("CartClient", "app@Shop\\Cart\\CartInterface")], "source string, target string")
    methods = spark.createDataFrame([("Impl", "add", "Impl::add"), ("CartClient", "add", "CartClient::add"), ("my\\space\\sInterface", "do", "s::do")], "class string, name string, method string")
    assert rows(linking.link_rpcs(rpcs, interfaces, implements, methods)) == {("op", "Impl::add", "implemented_by"), ("given", "s::do", "references")}


def test_decorators(spark):
    df = spark.createDataFrame([("a", "low", 0, 1), ("a", "late", 0, 2), ("a", "high", 5, 3), ("late", "around", 1, 4), ("r", "q", 0, 5), ("q", "r", 0, 6)], "id string, decorator string, priority int, seq long")
    got = linking.decorator_order(df).orderBy("id", "position").collect()
    assert [r.decorator for r in got if r.id == "a"] == ["around", "late", "low", "high"]
    assert {(r.id, r.decorator) for r in got if r.id in "rq"} == {("r", "q"), ("q", "r")}
    assert linking.decorator_order(df.limit(0)).count() == 0


def test_constants_in_paths(spark):
    routes = spark.createDataFrame([("a", "/{const:X}/{id}/{const:No}"), ("b", "/plain"), ("c", "{const:X}{const:X}")], "route string, path string")
    constants = spark.createDataFrame([("X", "shop")], "name string, value string")
    assert rows(linking.with_constants(routes, constants)) == {("a", "/shop/{id}/{No}"), ("b", "/plain"), ("c", "shopshop")}


def test_implementations_by_directory(spark):
    nodes = spark.createDataFrame([("A", "class", "src/x/A.php"), ("B", "class", "B.php"), ("T", "class", "tests/T.php"), ("Mid", "interface", "src/Mid.php"), ("E", "class", None)], "id string, kind string, file string")
    edges = spark.createDataFrame([("Mid", "extends", "I"), ("A", "implements", "Mid"), ("B", "extends", "A"), ("T", "implements", "I"), ("E", "implements", "I")], "source string, relation string, target string")
    assert rows(linking.implementations_by_directory(nodes, edges, spark.createDataFrame([("I",)], "id string"))) == {("I", "src/x", 1), ("I", ".", 1)}


def test_foreign_dispatches(spark):
    sent = spark.createDataFrame([("H", "M"), ("H", "M"), ("H", "Own"), ("H", "Common"), ("Idle", "M")], "class string, message string")
    contexts = spark.createDataFrame([("H", "App\\Sales"), ("Idle", "App\\Sales"), ("M", "App\\Stock"), ("Own", "app\\SALES"), ("Common", "App\\Shared")], "id string, context string")
    handlers = spark.createDataFrame([("H",)], "class string")
    assert rows(linking.foreign_dispatches(sent, handlers, contexts, ("shared",))) == {("H", "M", "App\\Sales", "App\\Stock")}
    assert len(rows(linking.foreign_dispatches(sent, handlers, contexts))) == 2


def test_holders_stay_in_their_service(spark):
    given = spark.createDataFrame([("s", "b", "a"), ("s", "c", "b"), ("t", "d", "c"), ("s", "a", "c")], "service string, id string, target string")
    starts = spark.createDataFrame([("s", "a")], "service string, id string")
    assert rows(linking.transitive_holders(given, starts)) == {("s", "a", "b", 1), ("s", "a", "c", 2)}


def test_import_prefixes(spark):
    imports = spark.createDataFrame([("leaf", "mid", "/x/"), ("mid", "root", "api/"), ("leaf", "root", ""), ("r1", "r2", "q"), ("r2", "r1", "q")], "file string, parent string, prefix string")
    files = spark.createDataFrame([("leaf",), ("root",), ("r1",)], "file string")
    got = rows(linking.import_prefixes(files, imports, depth=3))
    assert got == {("leaf", "/api/x"), ("leaf", "/"), ("root", ""), ("r1", "/q/q/q/q")}


def test_properties_are_found_depth_first(spark):
    """A parent's ancestors come before a trait, however far, and relations of other classes play no part."""
    edges = [("A", "extends", "B"), ("B", "extends", "C"), ("A", "uses_trait", "T"), ("X", "extends", "Z"), ("X", "uses_trait", "Y"), ("W", "extends", "Y"), ("V", "uses_trait", "Z")]
    members = [("C", "p", "of C"), ("T", "p", "of T"), ("T", "q", "of T"), ("Z", "r", "of Z"), ("Y", "r", "of Y"), ("Lone", "s", "own")]
    got = wiring.found_members(spark.createDataFrame(members, "class string, name string, type string"), spark.createDataFrame(edges, "source string, relation string, target string"))
    found = {(r["class"], r.name): (r.type, r.depth) for r in got.collect()}
    assert found["A", "p"] == ("of C", 2) and found["A", "q"] == ("of T", 1) and found["X", "r"] == ("of Z", 1) and found["V", "r"] == ("of Z", 1) and found["Lone", "s"] == ("own", 0)


def test_a_shared_folder_is_made_once_where_none_is_set(spark, monkeypatch):
    kept = session._made[:]
    monkeypatch.setattr(spark.conf.__class__, "get", lambda self, key, default=None: None)
    try:
        assert session.shared_dir(spark) == session.shared_dir(spark) and session.shared_dir(spark).startswith("file:/")
    finally:
        session._made[:] = kept


def test_pairs_of_large_keys_are_made_in_parts(spark, monkeypatch):
    """All pairs of a key, whose held rows lie in several parts; a key that one side alone has gives none."""
    monkeypatch.setattr(resolve, "PART", 3)
    streamed = spark.createDataFrame([("k", i) for i in range(5)] + [("x", 1), (None, 1)], "key string, a int")
    held = spark.createDataFrame([("k", i) for i in range(20)] + [("y", 1), (None, 1)], "key string, b int")
    found = resolve._pairs(streamed, held, ["key"])
    assert sorted(tuple(r) for r in found.collect()) == [("k", a, b) for a in range(5) for b in range(20)]


def test_state_readers_of_methods_with_several_ways(spark):
    """Methods that access a property by several classes or constants give each link once; pairs of all others are not aggregated."""
    rng = random.Random(3)
    kinds, constants = ("read", "write"), ([], ["a"], ["b"], ["a", "c"], None)
    rows = [(f"m{rng.randrange(12)}", f"C{rng.randrange(2)}", f"p{rng.randrange(3)}", rng.choice(kinds), rng.choice(constants)) for _ in range(90)] + [(None, "C0", "p0", "read", []), ("m1", None, "p0", "write", [])]
    want = set()
    for m, c, p, k, own in rows:
        for m2, c2, p2, k2, other in rows:
            if (k, k2) == ("write", "read") and c == c2 and p == p2 and None not in (m, m2, c) and m != m2:
                if own == [] or other == []:
                    want.add((m, m2, p, "AMBIGUOUS"))
                elif own and other and set(own) & set(other):
                    want.add((m, m2, p, "INFERRED"))
    found = resolve.state_readers(spark.createDataFrame(rows, "method string, class string, property string, kind string, constants array<string>"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_found_members_without_lineages(spark, monkeypatch):
    """Members handed down equal those of the least paths, with several parents at different heights, rings and what is below them;
    only classes on or below rings have lineages."""
    rng = random.Random(8)
    relation = lambda: rng.choice(("extends", "uses_trait"))
    edges = sorted({(f"c{i:02}", relation(), f"c{rng.randrange(i):02}") for i in range(1, 40) for _ in range(rng.randint(0, 3))})
    edges += [("r1", "extends", "r2"), ("r2", "uses_trait", "r1"), ("r1", "uses_trait", "c30"), ("r2", "extends", "c35"), ("s1", "extends", "r1"), ("s1", "uses_trait", "c20")]
    members = [(rng.choice([f"c{i:02}" for i in range(40)] + ["r1", "r2", "s1", "alone"]), f"n{rng.randrange(6)}", rng.choice(("t", "u", None))) for _ in range(60)]
    edges = spark.createDataFrame(edges, "source string, relation string, target string")
    above = traverse.ranked_lineage(edges, ("extends", "uses_trait"))
    paths = {(r.start, r.id): [(s.rank, s.to) for s in r.path] for r in above.collect()} | {(m[0], m[0]): [] for m in members}
    want = {}
    for (start, at), path in paths.items():
        for owner, name, kind in members:
            if owner == at:
                want[start, name] = min(want.get((start, name), ([(9, "")], (True, ""))), (path, (kind is not None, kind or "")))
    asked = []
    monkeypatch.setattr(wiring, "ranked_lineage", lambda e, r: asked.extend(x.source for x in e.collect()) or traverse.ranked_lineage(e, r))
    got = wiring.found_members(spark.createDataFrame(members, "class string, name string, type string"), edges)
    found = {(r["class"], r.name): (r.depth, r.type or "") for r in got.collect()}
    assert found == {key: (len(path), kind) for key, (path, (_, kind)) in want.items()} and got.count() == len(found)
    assert set(asked) == {"r1", "r2", "s1"}
