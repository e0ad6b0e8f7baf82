"""Source trees, graph files and the incremental stream."""

from knotwork.operators.graph import merge_edges
from knotwork.sources import files, graph_json
from knotwork.streaming import incremental


def test_tree(spark, tmp_path):
    for name, text in {
        "src/A.php": "<?php", "vendor/x/B.php": "<?php", "views/v.blade.php": "", "config/routes.yaml": "a: b", "routes/web.yaml": "x: y", "api/openapi.yaml": "openapi: 3.0.0\n", "composer.json": "{}",
        "p/s.proto": "syntax = 'proto3';\npackage shop.v1;\nservice Cart {\n  rpc Add (A) returns (B);\n}\nservice Pay {\n rpc Do (A) returns (B);\n}\n", "tmp/skip.php": "<?php", "tmp/keep.php": "<?php", "readme.md": "",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    scanned = files.scan_tree(spark, str(tmp_path))
    kept = files.without_ignored(scanned, files.ignore_rules(".gitignore", "# none\ntmp/*\n!tmp/keep.php\n"))
    kinds = {r.path: r.kind for r in files.classified(kept).collect()}
    assert kinds == {"src/A.php": "code", "config/routes.yaml": "routing", "routes/web.yaml": "routing", "api/openapi.yaml": "openapi", "composer.json": "composer", "p/s.proto": "proto", "tmp/keep.php": "code"}
    rpcs = files.proto_rpcs(files.classified(kept).where("kind = 'proto'")).collect()
    assert sorted((r.line, r.package, r.service, r.rpc) for r in rpcs) == [(4, "shop.v1", "Cart", "Add"), (7, "shop.v1", "Pay", "Do")]
    known = scanned.select("path", "hash")
    (tmp_path / "src/A.php").write_text("<?php 1;")
    assert [r.path for r in files.changed_files(files.scan_tree(spark, str(tmp_path)), known.where("path <> 'none'")).collect()] in ([], ["src/A.php"])


def test_ignore_rules(spark):
    rules = files.ignore_rules(".gitignore", "build/\n!build/keep.php\n*.tmp.php\n/top.php\nlogs\ndocs/**/x.php\n\\!odd.php\n[ab].php\n")
    rules += files.ignore_rules("sub/.gitignore", "!y.tmp.php\nonly/\n")
    left = {
        "build/keep.php": False, "a/build": True, "a/build/z.php": False, "x.tmp.php": False, "sub/y.tmp.php": True, "top.php": False, "a/top.php": True, "logs": False, "a/logs/b.php": False,
        "docs/x.php": False, "docs/p/q/x.php": False, "docs/p/y.php": True, "!odd.php": False, "odd.php": True, "a.php": False, "c.php": True, "sub/only": True, "sub/only/c.php": False, "only/c.php": True,
    }
    df = spark.createDataFrame([(p,) for p in left], "path string")
    assert {r.path for r in files.without_ignored(df, rules).collect()} == {p for p, stays in left.items() if stays}
    assert files.without_ignored(df, []).count() == len(left)


def test_schema_files_by_their_key(spark):
    texts = {"a.yaml": b"# one\nopenapi: 3.0.0\n", "b.json": b'{"swagger": "2.0"}', "c.yaml": b"note: about openapi: a text", "d.json": b'{\n  "openapi" : "3"}'}
    df = spark.createDataFrame([(p, bytearray(t)) for p, t in texts.items()], "path string, content binary")
    assert {r.path for r in files.classified(df).where("kind = 'openapi'").collect()} == {"a.yaml", "b.json", "d.json"}


def test_other_languages(spark):
    df = spark.createDataFrame([("a.py",), ("b.py",), ("c.go",), ("d.php",)], "path string")
    assert [tuple(r) for r in files.other_languages(df).collect()] == [("Python", 2), ("Go", 1)]


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"version": 2,\n "nodes": [{"id": "A", "label": "A", "kind": "class"}],\n "edges": [{"source": "A", "target": "B", "relation": "calls", "confidence": "INFERRED", "lines": "4,12"}]}')
    nodes, edges = graph_json.read_documents(spark, str(tmp_path / "g.json"))
    assert edges.first().lines == [4, 12]
    graph_json.write_graph(nodes, edges, str(tmp_path / "out"))
    again = graph_json.read_graph(spark, str(tmp_path / "out"))
    assert [r.json for r in graph_json.as_json_rows(*again).where("kind = 'edge'").collect()] == ['{"source":"A","target":"B","relation":"calls","confidence":"INFERRED","lines":"4,12"}']
    (tmp_path / "old.json").write_text('{"version": 1, "nodes": [], "edges": []}')
    try:
        graph_json.read_documents(spark, str(tmp_path / "old.json"))
        raise AssertionError("an old version was read")
    except ValueError:
        pass


def test_stream_equals_full_build(spark, tmp_path):
    rows = [(f"s{i % 5}", "calls", f"t{i % 7}", ("EXTRACTED", "INFERRED", "AMBIGUOUS")[i % 3], i % 11, None, i) for i in range(120)]
    facts = spark.createDataFrame(rows, incremental.FACT)
    for part in range(2):
        facts.where(f"seq % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.fold_in(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "marks"))
    got = {tuple(map(str, r)) for r in incremental.current_edges(spark, str(tmp_path / "state")).collect()}
    assert got == {tuple(map(str, r)) for r in merge_edges(facts).collect()}
