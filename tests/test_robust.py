"""No file may end a job, however it is built; and state survives what happens to files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from thicket import api
from thicket.operators.analyze import analyze_text
from thicket.operators.js_parser import JsSyntaxError, parse
from thicket.operators.scan import ast_nodes, find_pattern, rule_matches
from thicket.sources import containers
from thicket.sources.files import read_files
from thicket.storage import shared_folder
from thicket.streaming.ingest import IncrementalGraph

DEEP = {
    "sum": "x = " + " + ".join(['"a"'] * 10_000) + ";",
    "chain": "a" + ".b(1)" * 10_000 + ";",
    "calls": "f" + "(1)" * 3_000 + ";",
    "members": "x = a" + ".b" * 9_000 + "();",
    "conditions": "x = " + "a ? b : " * 900 + "c;",
    "branches": "if (a) {}" + " else if (b) {}" * 900,
    "brackets": "[" * 20_000 + "]" * 20_000,
    "parentheses": "(" * 3_000,
}


@pytest.fixture
def deep(spark):
    return spark.createDataFrame(sorted(DEEP.items()), "path string, code string")


def test_deep_files_are_analysed_or_have_an_issue(spark, deep):
    got = {r.path: r.analysis for r in api.analyze(deep).collect()}
    assert len(got["chain"].call_edges) == 10_000 and got["chain"].call_edges[0].callee == "<expr>.b"
    assert [e.callee for e in got["calls"].call_edges] == ["f"]
    assert len(got["members"].call_edges) == 1
    for name in ("sum", "chain", "calls", "members", "conditions", "branches"):
        assert not got[name].issues
    for name in ("brackets", "parentheses"):
        assert [(i.category, i.message) for i in got[name].issues] == [("parse", "Nested too deeply")]


def test_deep_files_elsewhere(spark, deep, tmp_path):
    for code in DEEP.values():
        assert json.loads(api.analyze_json(code))["file_structure"]["language"] == "tsx"
    nodes = {r.path: r.n for r in ast_nodes(deep, "ts").groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert nodes["calls"] > 6_000 and "brackets" not in nodes
    assert {r.path for r in find_pattern(deep, "f(1)").select("path").collect()} <= set(DEEP)
    rows = rule_matches(deep, "id: k\nlanguage: ts\nrule: {kind: CallExpression}").select("path", "error").collect()
    assert {r.path for r in rows if r.error} == {"brackets", "parentheses"}
    graph = IncrementalGraph(spark, str(tmp_path / "g"), buckets=4)
    graph.upsert(deep.withColumn("version", F.lit(1)), 0)
    assert graph.files().count() == len(DEEP)


@pytest.mark.parametrize("code", ["a = b ? (c) : d => e;", "a = b ? (c, d) : (e) => f;", "a = b ? (c): d => e : f;", "f(a ? (b ? (c) : d => e) : g)", "a = b ? (x) => y : z;", "a = b ? (c) : d;"])
def test_conditionals_with_arrows(code):
    assert parse(code)[0].body[0].type == "ExpressionStatement"


def test_comments_are_found_once_however_often_they_are_read_over():
    code = "a ? (b /* 1 */) /* 2 */ : c => d // 3\n;/* 4 */"
    assert [code[a:b] for a, b in parse(code)[1]] == ["/* 1 */", "/* 2 */", "// 3", "/* 4 */"]


def test_a_fault_of_the_parser_is_the_files_fault(monkeypatch):
    monkeypatch.setattr("thicket.operators.js_parser.Parser.program", lambda self: 1 / 0)
    with pytest.raises(JsSyntaxError, match="ZeroDivisionError"):
        parse("a")
    assert analyze_text("a")["issues"][0]["category"] == "parse"


@pytest.mark.parametrize(
    ("code", "names"),
    [
        ("let a; let a;", ["a"]),
        ("var a; let a;", ["a"]),
        ("let a; { var a; }", ["a"]),
        ("let a; { let a; }", []),
        ("function f(a) { let a; }", ["a"]),
        ("function f(a) { var a; var a; }", []),
        ("try {} catch (e) { let e; }", ["e"]),
        ("try {} catch (e) { var e; }", []),
        ("import a from 'x'; const a = 1;", ["a"]),
        ("import type { T } from 'x'; const T = 1;", []),
        ("function f(): void; function f(a) {}", []),
        ("class A {} let { b: [A, ...c], c: { d = A } } = 1;", ["A"]),
        ("for (let i;;) { let i; }", []),
        ("switch (1) { case 1: let a; case 2: let a; }", ["a"]),
        ("let f; function f() {}", ["f"]),
        ("{ function f() {} var f; }", ["f"]),
        ("namespace N { let a; } let a; class C { static { var a; } }", []),
        ("x => { let x; }", ["x"]),
    ],
)
def test_names_declared_twice(code, names):
    found = [i["message"] for i in analyze_text(code)["issues"] if i["category"] == "semantic"]
    assert found == [f"Identifier `{n}` has already been declared" for n in names]


def test_only_the_wanted_parts_are_collected(spark):
    df = spark.createDataFrame([("a.ts", "var a; f(); // c")], "path string, code string")
    row = api.analyze(df, parts=["issues", "comments"]).first().analysis
    assert row.asDict().keys() == {"language", "issues", "comments"} and row.comments == ["// c"] and len(row.issues) == 1


def test_nul_in_a_container(spark):
    html = "<p>\0</p><script setup>a\0b</script>\0<script>c</script>"
    df = spark.createDataFrame([(html,)], "code string")
    got = [(r.content, r.start, html.encode()[r.start : r.end].decode()) for r in containers.script_blocks(df).collect()]
    assert [g[0] for g in got] == ["a\0b", "c"] and all(content == cut for content, _, cut in got)
    assert containers.block_presence(df).select("has_script", "has_script_setup").first()[:] == (True, True)


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.ts").write_text("f(é);", "utf-8")
    (tmp_path / "bad.ts").write_bytes(b"f(\xff);")
    with pytest.raises(Exception, match="(?i)utf-?8"):
        read_files(spark, str(tmp_path)).collect()
    assert [r.code for r in read_files(spark, str(tmp_path), permissive=True).collect()] == ["f(é);"]


def test_upsert_rewrites_only_what_changed(spark, tmp_path):
    graph = IncrementalGraph(spark, str(tmp_path / "g"), buckets=8)
    batch = lambda rows: spark.createDataFrame(rows, "path string, code string, version int")
    graph.upsert(batch([(f"f{k}.ts", f"a{k}();", 1) for k in range(40)]), 0)
    graph.upsert(batch([("f0.ts", "b();", 2), ("f1.ts", "a1();", 2)]), 1)
    first = graph._manifest(1)
    assert sorted(set(first.values())) == [0, 1] and sum(g == 1 for g in first.values()) == 1
    graph.upsert(batch([("f0.ts", "b();", 3), ("f2.ts", "old();", 0)]), 2)  # equal content; an older version
    assert graph._manifest(2) == first
    graph.upsert(batch([(f"f{k}.ts", f"c{k}();", 4) for k in range(40)]), 3)
    graph.upsert(batch([("./x/../f0.ts", "d();", 5)]), 4)
    graph.upsert(batch([("./x/../f0.ts", "d();", 5)]), 4)  # a repeated batch
    assert {int(p.name) for p in (tmp_path / "g" / "data").iterdir()} == {3, 4}
    assert sorted(int(p.name) for p in (tmp_path / "g" / "manifest").iterdir()) == [3, 4]
    got = {r.path: (r.code, r.version, [e.callee for e in r.analysis.call_edges]) for r in graph.analyzed().collect()}
    assert len(got) == 40 and got["f0.ts"] == ("d();", 5, ["d"]) and got["f1.ts"] == ("c1();", 4, ["c1"])
    graph.clear()
    assert graph.files().count() == 0


def test_scan_directory_writes_after_all_is_known(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.ts").write_text(f"log({k});\n")
    rule = "id: r\nlanguage: ts\nrule: {pattern: 'log($A)'}\nfix: out($A)\n"
    done = api.scan_directory(spark, str(tmp_path), rule, dry_run=False)
    assert [(p.read_text()) for p in sorted(tmp_path.iterdir())] == [f"out({k})\n" for k in range(3)]
    assert sorted((r.path[-4:], r.matches, r.modifications) for r in done.collect()) == [(f"{k}.ts", 1, 1) for k in range(3)]


def test_graph_of_many_single_files(spark):
    graph = api.initialize_graph(spark)
    for k in range(200):
        graph.add_file(f"src/{k % 150}.ts", f"export const a{k} = 1;")
    graph.add_files(spark.createDataFrame([("src/0.ts", "export const z = 1;")], "path string, code string"))
    graph.add_file("src/./1.ts", "export const y = 1;")
    assert graph.list_files().count() == 150
    assert [r.path for r in graph.get_symbol_details("z").collect()] == ["src/0.ts"] and [r.path for r in graph.get_symbol_details("y").collect()] == ["src/1.ts"]
    assert graph.get_symbol_details("a0").count() == 0 and [r.path for r in graph.get_symbol_details("a199").collect()] == ["src/49.ts"]


def test_issue_log(spark):
    df = spark.createDataFrame([("a.ts", "var a;"), ("b.css", "var a;"), ("c.ts", "let a;")], "path string, code string")
    got = {r.path: (r.annotated, r.log) for r in api.annotate_issues(df, inject=False, log=True).collect()}
    assert got["a.ts"] == ("var a;", ["Found 1 issues in a.ts", "  - Avoid using 'var'. Use 'const' or 'let' instead."])
    assert got["b.css"] == ("var a;", []) and got["c.ts"] == ("let a;", [])


def test_shared_folder_is_the_sessions(spark, tmp_path_factory):
    assert spark.conf.get("spark.checkpoint.dir") in shared_folder(spark)


def test_the_package_can_be_sent_to_executors(tmp_path):
    """A session in a process whose workers don't find the package by themselves."""
    script = tmp_path / "job.py"
    root = __import__("pathlib").Path(api.__file__).resolve().parent.parent
    script.write_text(
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from thicket import api\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "api.ship(spark)\n"
        "print('rows', api.find_pattern(spark.createDataFrame([('f(1);',)], 'code string'), 'f($A);').count())\n"
    )
    environment = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = __import__("subprocess").run([__import__("sys").executable, str(script)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=120)
    assert "rows 1" in done.stdout, done.stderr[-2000:]
