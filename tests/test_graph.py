"""Graph operators on hand-built graphs with known answers."""

import random

import pytest
from knotwork.operators import graph, relevance, resolve, rollup, traverse, wiring
from pyspark.sql import functions as F


def edges(spark, rows):
    """rows: (source, relation, target[, confidence[, line[, via[, seq]]]])"""
    full = [(*r, *("EXTRACTED", None, None, i)[len(r) - 3 :]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "source string, relation string, target string, confidence string, line int, via string, seq long")


def test_first_confidence_wins_and_lines_join(spark):
    df = edges(spark, [("a", "calls", "b", "INFERRED", 9, None, 2), ("a", "calls", "b", "AMBIGUOUS", 3, None, 1), ("a", "calls", "b", "EXTRACTED", 0, None, 3), ("a", "calls", "a"), ("a", "calls", "b", "INFERRED", 9, None, 2)])
    rows = graph.merge_edges(df).collect()
    assert [(r.source, r.target, r.confidence, r.lines) for r in rows] == [("a", "b", "AMBIGUOUS", [3, 9])]


def test_via_rules(spark):
    df = edges(spark, [
        ("a", "calls", "b", "INFERRED", 1, "named: x, y", 1), ("a", "calls", "b", "INFERRED", 2, "named: y, z", 2), ("a", "calls", "c", "INFERRED", 1, "closure of f", 1),
        ("a", "calls", "c", "INFERRED", 2, None, 2), ("a", "calls", "d", "INFERRED", 1, "closure of g", 1), ("a", "calls", "d", "INFERRED", 1, "closure of f", 2), ("a", "calls", "e", "INFERRED", 1, "service s", 1),
    ])
    assert {r.target: r.via for r in graph.merge_edges(df).collect()} == {"b": "named: x, y, z", "c": None, "d": "closure of f, closure of g", "e": "service s"}


def test_nodes_first_declaration(spark):
    df = spark.createDataFrame([("A", "second", 5), ("A", "first", 1), ("B", "only", 2)], "id string, label string, seq long")
    assert {r.id: r.label for r in graph.merge_nodes(df).collect()} == {"A": "first", "B": "only"}
    assert [tuple(r) for r in graph.duplicate_declarations(df).collect()] == [("A", 2)]


def test_candidates_tiers(spark):
    names = ["App\\Order", "App\\OrderLine", "Other\\Order", "order", "billing@Pay\\Order"]
    nodes = spark.createDataFrame([(n, n.split("\\")[-1], "external" if n == "order" else "class", n.split("@")[0] if "@" in n else None) for n in names], "id string, label string, kind string, service string")
    es = edges(spark, [("App\\Order", "calls", "x"), ("Other\\Order", "calls", "x"), ("Other\\Order", "calls", "y")])
    assert [r.id for r in graph.candidates(nodes, es, "App\\Order").collect()][0] == "App\\Order"
    assert [r.id for r in graph.candidates(nodes, es, "Order").collect()][:2] == ["Other\\Order", "App\\Order"]
    assert [r.id for r in graph.candidates(nodes, es, "order").collect()][0] == "order"
    assert [r.id for r in graph.candidates(nodes, es, "billing@order").collect()] == ["billing@Pay\\Order"]


def test_reach_keeps_the_strongest_weakest(spark):
    df = edges(spark, [("b", "calls", "a", "AMBIGUOUS"), ("c", "calls", "a", "INFERRED"), ("d", "calls", "b", "EXTRACTED"), ("d", "calls", "c", "EXTRACTED"), ("a", "calls", "d", "EXTRACTED")])
    starts = spark.createDataFrame([("a",)], "start string")
    got = {r.id: (r.depth, r["rank"]) for r in traverse.reach(df, starts).collect()}
    assert got == {"a": (0, 1), "b": (1, 3), "c": (1, 2), "d": (2, 2)}
    assert {r.id for r in traverse.reach(df, starts, max_depth=1).collect()} == {"a", "b", "c"}


def test_paths(spark):
    df = edges(spark, [("H", "references", "P"), ("A", "implements", "P"), ("B", "calls", "A"), ("C", "calls", "A")])
    hops = {r.id: (r.hops, r.previous, r.forward) for r in traverse.shortest_paths(df, "H").collect()}
    assert hops["A"] == (2, "P", False) and "B" not in hops
    both = {r.id: r.hops for r in traverse.shortest_paths(df, "B", mode="undirected").collect()}
    assert both == {"B": 0, "A": 1, "C": 2, "P": 2, "H": 3}
    hub = edges(spark, [("A", "references", "X"), ("D", "references", "X"), ("A", "calls", "B"), ("B", "calls", "C"), ("C", "calls", "D")])
    blocked = spark.createDataFrame([("X",)], "id string")
    assert {r.id: r.hops for r in traverse.shortest_paths(hub, "A", mode="undirected", blocked=blocked).collect()}["D"] == 3


def test_parallel_edges_take_the_heavier(spark):
    df = edges(spark, [("a", "references", "b"), ("a", "calls", "b")])
    assert {r.id: r.relation for r in traverse.shortest_paths(df, "a").collect()}["b"] == "calls"


def test_closure_matches_a_plain_walk(spark):
    rng = random.Random(1)
    pairs = sorted({(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(25)})
    pairs = [p for p in pairs if p[0] != p[1]]
    want = set()
    for start in {x for p in pairs for x in p}:
        seen, todo = {start: 0}, [start]
        for at in todo:
            for a, b in pairs:
                if a == at and b not in seen:
                    seen[b] = seen[at] + 1
                    todo.append(b)
        want |= {(start, k, d) for k, d in seen.items()}
    df = edges(spark, [(a, "extends", b) for a, b in pairs])
    assert {tuple(r) for r in traverse.closure(df, ("extends",)).collect()} == want


def test_cone_stops_at_hubs(spark):
    rows = [("s", "calls", "h"), ("h", "calls", "deep"), ("s", "calls", "m"), ("m", "calls", "n")] + [(f"x{i}", "calls", "h") for i in range(5)]
    got = {r.id: (r.depth, r.is_hub) for r in traverse.method_cone(edges(spark, rows), "s", hub=5).collect()}
    assert got == {"s": (0, False), "h": (1, True), "m": (1, False), "n": (2, False)}


def test_up_then_down(spark):
    df = edges(spark, [("p", "calls", "a"), ("p", "calls", "b"), ("q", "calls", "b")])
    assert {r.id: r.hops for r in traverse.up_then_down(df, "a").collect()} == {"a": 0, "p": 1, "b": 2}


def test_layers_and_contexts(spark):
    df = spark.createDataFrame([
        ("Shop\\Cart\\Domain\\Cart", "Shop\\Cart\\Infrastructure\\Db", "INFERRED"), ("Shop\\Cart\\Domain\\Cart", "Shop\\Cart\\Infrastructure\\Db", "EXTRACTED"),
        ("billing@Domain\\X", "Pay\\UI\\Page", "EXTRACTED"), ("Shop\\Cart\\Application\\A", "Shop\\Pay\\Domain\\P", "EXTRACTED"),
    ], "source string, target string, confidence string")
    got = {(r.source, r.from_role, r.to_role, r.n, r.confidence) for r in rollup.layer_violations(df).collect()}
    assert got == {("Shop\\Cart\\Domain\\Cart", "domain", "infrastructure", 2, "EXTRACTED"), ("billing@Domain\\X", "domain", "interface", 1, "EXTRACTED")}
    assert {tuple(r) for r in rollup.context_pairs(df).collect()} == {("Shop\\Cart", "Shop\\Pay", 1)}


def test_tree_collapses(spark):
    ids = spark.createDataFrame([("A\\B\\C\\X",), ("A\\B\\C\\Y",), ("A\\B\\D\\Z",)], "id string")
    tree = rollup.namespace_tree(ids)
    assert {tuple(r) for r in tree.collect()} == {("A", 1, 3), ("A\\B", 2, 3), ("A\\B\\C", 3, 2), ("A\\B\\D", 3, 1)}
    assert {r.namespace for r in rollup.collapsed_tree(tree).collect()} == {"A\\B", "A\\B\\C", "A\\B\\D"}


@pytest.mark.parametrize(("pattern", "name", "fits"), [("App\\*", "App\\X", True), ("App\\*", "App\\X\\Y", False), ("App\\**", "App\\X\\Y", True), ("app\\", "App\\X\\Y", True), ("A?p\\X", "App\\X", True), ("*Handler", "FooHandler", True), ("*Handler", "A\\FooHandler", False)])
def test_globs(spark, pattern, name, fits):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(name,)], "x string").select(F.col("x").rlike(rollup.glob(pattern))).first()[0] is fits


def test_stems(spark):
    from knotwork.functions.words import stems
    from pyspark.sql import functions as F

    words = {"validated": "validat", "validation": "validat", "validator": "validat", "prices": "pric", "policies": "policy", "classes": "class", "creating": "creat", "the": "the", "a1": None, "HTTPServer": None}
    rows = {r.w: list(r.s) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stems(F.col("w")).alias("s")).collect()}
    assert {w: rows[w][0] for w in words if words[w]} == {w: s for w, s in words.items() if s}
    assert rows["a1"] == [] and rows["HTTPServer"] == ["http", "serv"]


def test_relevance_covers_terms(spark):
    named = spark.createDataFrame([(1, "PriceRule", "", "Shop"), (2, "Price", "Rule", ""), (3, "Other", "", "")], "id long, name string, owner string, namespace string")
    weights = relevance.word_weights(named)
    scores = {r.id: r.score for r in relevance.relevance(weights, relevance.frequencies(weights), 3, ["pric", "rule"]).collect()}
    assert scores[1] > scores[2] and 3 not in scores


def test_calls_and_overrides(spark):
    lines = edges(spark, [("Kid", "extends", "Mum"), ("Mum", "extends", "Gran")])
    methods = spark.createDataFrame([("Gran", "go", "Gran::go"), ("Mum", "go", "Mum::go"), ("Gran", "old", "Gran::old"), ("Lone", "solo", "Lone::solo")], "class string, name string, method string")
    calls = spark.createDataFrame([("a", "Kid", "go", 1), ("b", "Kid", "old", 2), ("c", None, "solo", 3), ("d", None, "go", 4), ("e", "Alien", "go", 5)], "source string, receiver string, name string, seq long")
    got = {r.source: (r.outcome, r.target) for r in resolve.resolve_calls(calls, resolve.find_methods(methods, lines), methods).collect()}
    assert got == {"a": ("inferred", "Mum::go"), "b": ("inferred", "Gran::old"), "c": ("ambiguous", "Lone::solo"), "d": ("unknown", None), "e": ("outside", None)}
    assert [tuple(r) for r in resolve.overrides(methods, lines).collect()] == [("Mum::go", "Gran::go")]


def test_method_lookup_order(spark):
    lines = edges(spark, [("Kid", "extends", "Mum"), ("Mum", "extends", "Gran"), ("Kid", "implements", "Can"), ("Kid", "uses_trait", "Also"), ("Also", "extends", "Gran"), ("Other", "extends", "Lib")])
    rows = [("Gran", "go", True), ("Can", "go", True), ("Also", "go", True), ("Can", "be", True), ("Also", "be", True), ("Lib", "do", False), ("Mix", "do", True), ("Mix", "it", True), ("Far", "it", True), ("Far", "too", True)]
    methods = spark.createDataFrame([(c, n, f"{c}::{n}", p) for c, n, p in rows], "class string, name string, method string, project boolean")
    mixins = spark.createDataFrame([("Gran", "Mix"), ("Other", "Mix"), ("Mix", "Far"), ("Far", "Kid"), ("Lone", "Far")], "class string, mixin string")
    got = {tuple(r)[:2]: r.method for r in resolve.find_methods(methods, lines, mixins).collect()}
    # the parent's parent comes before an interface that is nearer, an interface before a trait
    assert got["Kid", "go"] == "Gran::go" and got["Kid", "be"] == "Can::be"
    assert got["Other", "do"] == "Lib::do" and got["Kid", "do"] == "Mix::do"
    # mixins of ancestors and of mixins, rings included
    assert got["Kid", "it"] == "Mix::it" and got["Kid", "too"] == "Far::too" and got["Lone", "it"] == "Far::it" and got["Far", "go"] == "Gran::go" and got["Lone", "do"] == "Mix::do"


def test_lineage_takes_the_first_way(spark):
    lines = edges(spark, [("a", "extends", "b"), ("b", "extends", "c"), ("a", "implements", "c"), ("c", "extends", "d"), ("a", "implements", "d"), ("x", "extends", "y"), ("y", "extends", "x")])
    rows = traverse.ranked_lineage(lines, ("extends", "implements")).collect()
    assert {r.id: [(s.rank, s.to) for s in r.path] for r in rows if r.start == "a"} == {"a": [], "b": [(1, "b")], "c": [(1, "b"), (1, "c")], "d": [(1, "b"), (1, "c"), (1, "d")]}
    assert {(r.start, r.id) for r in rows if r.start in "xy"} == {("x", "x"), ("x", "y"), ("y", "y"), ("y", "x")}


def test_hosts_and_parts_of_segments(spark):
    routes = spark.createDataFrame([("any", None, "/a/{id}.json", None), ("mine", None, "/a/{id}.json", "{x}.example.com"), ("lit", None, "/a/order-7", "*")], "route string, method string, path string, host string")
    asked = spark.createDataFrame([("r1", None, "/a/5.json", "eu.example.com"), ("r2", None, "/a/5.json", "example.org"), ("r3", None, "/a/order-*", None), ("r4", None, "/*/order-7", "q"), ("r5", None, "/a/.json", None)], "request string, method string, path string, host string")
    got = {}
    for r in resolve.match_routes(asked, routes).orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append(r.route)
    assert got == {"r1": ["any", "mine"], "r2": ["any"], "r3": ["lit"], "r4": ["lit"]}


def test_routes(spark):
    routes = spark.createDataFrame([("any", None, "/{a}/{b}"), ("shop", "GET", "/shop/{id}"), ("item", "GET", "/shop/7"), ("post", "POST", "/shop/{id}"), ("long", None, "/shop/7/x")], "route string, method string, path string")
    asked = spark.createDataFrame([("r1", "GET", "/shop/7"), ("r2", None, "/other/7"), ("r3", "GET", "/nothing")], "request string, method string, path string")
    got = {}
    for r in resolve.match_routes(asked, routes).orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append(r.route)
    assert got == {"r1": ["item", "shop", "any"], "r2": ["any"]}


def test_aliases(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "Klass"), ("x", "y"), ("y", "x")], "id string, target string")
    assert {tuple(r) for r in resolve.follow_aliases(df).collect()} == {("a", "Klass"), ("b", "Klass"), ("c", "Klass")}


def test_canonical_names(spark):
    declared = spark.createDataFrame([("App\\Order", None), ("App\\Order", "billing"), ("Shared\\Money", None)], "id string, service string")
    asked = spark.createDataFrame([("billing", "\\app\\order"), ("billing", "SHARED\\money"), (None, "app\\ORDER"), ("x", "No")], "service string, name string")
    assert {(r.service, r.name): r.id for r in resolve.canonical(asked, declared).collect()} == {("billing", "\\app\\order"): "App\\Order", ("billing", "SHARED\\money"): "Shared\\Money", (None, "app\\ORDER"): "App\\Order", ("x", "No"): None}


def test_application_nodes_and_rings(spark):
    df = spark.createDataFrame([("class", "a.php", False), ("external", "a.php", False), ("class", None, False), ("class", "t.php", True)], "kind string, file string, in_tests boolean")
    assert [r[0] for r in df.select(wiring.is_application(F.col("kind"), F.col("file"), F.col("in_tests"))).collect()] == [True, False, False, False]
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s", "r1")]
    ends = {tuple(r) for r in resolve.follow_aliases(spark.createDataFrame(chain, "id string, target string")).collect()}
    assert ends == {(f"n{i}", "n40") for i in range(40)}


def test_path_ladder(spark):
    nodes = spark.createDataFrame([(n, "file" if n == "f" else "class") for n in ("a", "b", "c", "d", "e", "f", "x", "y", "lone")], "id string, kind string")
    edges = [("a", "calls", "b"), ("b", "calls", "c"), ("d", "calls", "c"), ("a", "references", "b"), ("f", "defines", "x"), ("f", "defines", "y"), ("x", "imports", "log"), ("e", "calls", "log"), ("e", "extends", "d")]
    graph = spark.createDataFrame(edges, "source string, relation string, target string")

    def ladder(start, end):
        return [tuple(r) for r in traverse.path_ladder(nodes, graph, start, end).orderBy("position").collect()]

    assert ladder("a", "c") == [(1, "a", "b", "calls", True, "dependency", False), (2, "b", "c", "calls", True, "dependency", False)]
    assert ladder("c", "a") == [(1, "a", "b", "calls", True, "dependency", True), (2, "b", "c", "calls", True, "dependency", True)]
    assert ladder("b", "e") == [(1, "b", "c", "calls", True, "undirected", False), (2, "c", "d", "calls", False, "undirected", False), (3, "d", "e", "extends", False, "undirected", False)]
    assert [(h[1], h[2], h[5]) for h in ladder("x", "y")] == [("x", "f", "any"), ("f", "y", "any")]
    assert [(h[1], h[2], h[5]) for h in ladder("x", "e")] == [("x", "log", "any"), ("log", "e", "any")]
    assert ladder("a", "lone") == [] and ladder("a", "a") == []
