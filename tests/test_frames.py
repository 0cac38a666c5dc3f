import json

import pytest
from pyspark.sql import functions as F

from thicket import api
from thicket.functions import text_ops as X
from thicket.operators import analyze as A
from thicket.operators import rewrite as R
from thicket.operators import scan as S
from thicket.operators.graph import ProjectGraph, initialize_graph
from thicket.operators.overlap import resolve_spans
from thicket.sources import containers as C
from thicket.sources.files import in_memory, parse_extensions, read_files, summary_json, summary_text, write_in_place
from thicket.streaming.ingest import IncrementalGraph, read_file_stream

LOG = "id: log\nlanguage: ts\nrule:\n  pattern: console.log($A)\nfix: logger.info($A)\n"


def edited(spark, source, edits):
    rows = [(source, [(a, b, r, absorb) for a, b, r, absorb in edits])]
    df = spark.createDataFrame(rows, f"s string, e array<{R.EDIT}>")
    return df.select(R.apply_edits(F.col("s"), F.col("e")).alias("r")).select("r.*").first()


@pytest.mark.parametrize(
    "source, edits, expected",
    [
        ("const x = 1;", [(10, 11, "2", False)], "const x = 2;"),
        ("const a = 1; const b = 2;", [(10, 11, "10", False), (23, 24, "20", False)], "const a = 10; const b = 20;"),
        ("abcdef", [(4, 6, "Y", False), (1, 3, "X", False)], "aXdY"),
        ("", [(0, 0, "init", False)], "init"),
        ("let a = 1;\nlet b = 2;\n", [(0, 10, "", True)], "let b = 2;\n"),
        ("if (x) {    foo();}", [(12, 18, "", True)], "if (x) {}"),
        ("{\n    foo();    \n}\n", [(6, 12, "", True)], "{\n}\n"),
        ("let value = 1;\n", [(12, 13, "10", True)], "let value = 10;\n"),
        ("first(); \nsecond();\n", [(0, 8, "", True), (10, 19, "", True)], ""),
        ("let a = 1;\n", [(0, 10, "", False)], "\n"),
        ("aéb", [(1, 3, "x", False)], "axb"),
        ("abc", [], "abc"),
    ],
)
def test_edits(spark, source, edits, expected):
    r = edited(spark, source, edits)
    assert r.error is None and r.updated == expected


@pytest.mark.parametrize(
    "source, edits, message",
    [
        ("abcdef", [(1, 4, "", False), (3, 5, "", False)], "Overlapping spans detected: [1, 4) and [3, 5)"),
        ("abc", [(0, 4, "", False)], "Span [0, 4) is out of bounds for source length 3"),
        ("abc", [(2, 1, "", False)], "Invalid span range: start (2) > end (1)"),
        ("é", [(1, 2, "", False)], "Span [1, 2) does not align to UTF-8 char boundary"),
    ],
)
def test_edit_errors(spark, source, edits, message):
    r = edited(spark, source, edits)
    assert r.updated is None and r.error == message


def test_diffs(spark):
    df = spark.createDataFrame([("hello",)], "s string")
    diff = lambda original: F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("end"), F.lit(original).alias("original"), F.lit("bye").alias("replacement")))
    assert df.select(R.apply_diffs(F.col("s"), diff("world"))["error"]).first()[0] == "Source text does not match expected original content at span [0, 5)"
    assert df.select(R.apply_diffs(F.col("s"), diff("hello"))["updated"]).first()[0] == "bye"
    edits = F.array(R.edit(F.lit(1), F.lit(3), F.lit("X")))
    assert df.select(R.edit_diffs(F.col("s"), edits)).first()[0][0].original == "el"


@pytest.mark.parametrize(
    "template, single, multi, expected",
    [
        ("console.log('hello')", {}, {}, "console.log('hello')"),
        ("console.log($MSG)", {"MSG": "world"}, {}, "console.log(world)"),
        ("return $$$ARGS;", {}, {"ARGS": ["a", "b", "c"]}, "return abc;"),
        ("$FUNC($ARGS)", {"FUNC": "console.log"}, {"ARGS": ["'hello'", "'world'"]}, "console.log('hello''world')"),
        ("console.log($UNKNOWN)", {"KNOWN": "value"}, {}, "console.log($UNKNOWN)"),
    ],
)
def test_templates(spark, template, single, multi, expected):
    df = spark.createDataFrame([(single, multi)], "s map<string,string>, m map<string,array<string>>")
    assert df.select(R.render(template, F.col("s"), F.col("m"))).first()[0] == expected


def test_rewrites(spark):
    files = in_memory(spark, {"a.ts": "console.log(foo);", "b.ts": "const value = fn(answer, foo, bar);", "bad.ts": "let = ;"})
    rules = [LOG, "id: wrap\nlanguage: ts\nrule: {pattern: 'const value = fn($A, $$$B);'}\nfix: const value = wrapped($A, $$$B);", "id: twice\nlanguage: ts\nrule: {kind: CallExpression}\nfix: x", "id: plain\nlanguage: ts\nrule: {kind: CallExpression}"]
    got = {(r.path, r.rule_id): r for r in S.rewrites(files, rules).collect()}
    assert got["a.ts", "log"].updated == "logger.info(foo)" and got["a.ts", "log"].modifications == 1
    assert got["b.ts", "wrap"].updated == "const value = wrapped(answer, foobar);"
    assert got["b.ts", "log"].updated == "const value = fn(answer, foo, bar);" and got["b.ts", "log"].modifications == 0
    assert "Overlapping spans" in got["a.ts", "twice"].error and got["a.ts", "twice"].updated is None
    assert (got["a.ts", "plain"].matches, got["a.ts", "plain"].modifications) == (2, 0)
    assert got["bad.ts", "log"].error.startswith("Rule evaluation failed")
    with pytest.raises(api.RuleError):
        S.apply_rule(files, rules[3])
    with pytest.raises(Exception, match="Rule evaluation failed"):
        S.scan(files, LOG, mode="failfast").collect()


def test_replacing_a_match_by_itself_changes_nothing(spark):
    files = in_memory(spark, {"a.ts": "let é = 1;\nfoo(bar);\n"})
    same = S.apply_rule(files, "id: i\nlanguage: ts\nrule: {pattern: 'foo($A);'}\nfix: foo($A);").first()
    assert same.updated == "let é = 1;\nfoo(bar);\n" and same.matches == 1


def test_null_and_empty_code(spark):
    files = spark.createDataFrame([("a", None), ("b", "")], "path string, code string")
    assert S.find_pattern(files, "f($A);").count() == 0
    assert {r.path: r.matches for r in S.scan(files, LOG).collect()} == {"a": 0, "b": 0}
    assert [r.kind for r in S.ast_nodes(files).collect()] == ["Program"]


def test_nodes_encode_ancestry_and_spans(spark):
    code = "class A { m() {} }\nconst é = f(g(1), h);"
    nodes = S.ast_nodes(in_memory(spark, {"p": code})).collect()
    by_id = {n.node_id: n for n in nodes}
    for n in nodes:
        assert code.encode()[n.start : n.end].decode() == n.text
        above, k = set(), n.parent_id
        while k is not None:
            above.add(k)
            k = by_id[k].parent_id
        assert above == {a.node_id for a in nodes if a.node_id < n.node_id and a.post > n.post}


def test_relations_as_joins_equal_the_evaluator(spark):
    files = in_memory(spark, {f"{k}.ts": c for k, c in enumerate(["let a = f(g(1));", "f(g(1));", "class A { m() { f(1); } }", "export const b = f(1), c = 2;"])})
    nodes = S.ast_nodes(files, "ts")
    joined = S.related(nodes, F.col("kind") == "VariableDeclaration", "inside").where("kind = 'CallExpression'").groupBy("path").count()
    rule = "id: r\nlanguage: ts\nrule: {all: [{kind: CallExpression}, {inside: {kind: VariableDeclaration}}]}"
    assert {r.path: r["count"] for r in joined.collect()} == {r.path: r.matches for r in S.scan(files, rule).collect() if r.matches}
    nearest = S.nearest_ancestor(nodes, F.col("kind") == "CallExpression").where("text = '1'").collect()
    assert {(r.path, r.anc_text) for r in nearest} == {("0.ts", "g(1)"), ("1.ts", "g(1)"), ("3.ts", "f(1)")}


def test_overlap_columns(spark):
    df = spark.createDataFrame([([(0, 10), (2, 4), (3, 6), (12, 13), (12, 13)],)], "s array<struct<start:bigint,end:bigint>>")
    assert [tuple(x) for x in df.select(resolve_spans(F.col("s"), "outer")).first()[0]] == [(0, 10), (12, 13)]
    assert [tuple(x) for x in df.select(resolve_spans(F.col("s"), "inner")).first()[0]] == [(2, 4), (12, 13)]


def test_containers(spark):
    setup = '<template>é</template>\n<script setup lang="ts">\nconst a = track(1);\n</script>\n<style></style>'
    files = in_memory(spark, {"setup": setup, "plain": '<script lang="ts">let x</script>', "none": "<template></template><style></style>", "odd": "<script data-setup='setup'>1</script><SCRIPT>2</SCRIPT><script", "quoted": '<script title="a setup b">1</script>'})
    flags = {r.path: (r.has_script, r.has_script_setup, r.has_template, r.has_style) for r in C.block_presence(files).collect()}
    assert flags == {"setup": (False, True, True, True), "plain": (True, False, False, False), "none": (False, False, True, True), "odd": (True, False, False, False), "quoted": (True, False, False, False)}
    blocks = [(r.path, r.block, r.content, r.start, r.end) for r in C.script_blocks(files).orderBy("path", "block").collect()]
    assert [b[:3] for b in blocks] == [("odd", 0, "1"), ("odd", 1, "2"), ("plain", 0, "let x"), ("quoted", 0, "1"), ("setup", 0, "\nconst a = track(1);\n")]
    assert setup.encode()[blocks[-1][3] : blocks[-1][4]].decode() == blocks[-1][2]
    found = {r.path: r for r in S.find_pattern_in_sfc(files, "const a = track($A);").collect()}
    assert found["setup"].script.kind == "scriptSetup" and found["setup"].start == found["setup"].script.start + found["setup"].relative_start
    assert (found["setup"].line, found["setup"].column, found["setup"].metavariables) == (3, 0, {"A": "1"}) and found["none"].script is None


@pytest.mark.parametrize(
    "tag, found",
    [
        ("<script setup>", True),
        ("<script SETUP lang='ts'>", True),
        ("<script lang=ts setup>", True),
        ("<script lang = 'a setup b'>", False),
        ("<script data-setup>", False),
        ("<script / setup>", False),
        ("<script lang=ts/ setup>", True),
        ("<script =x setup>", True),
        ("<script 'x' setup>", True),
        ("<script x='unclosed setup>", False),
        ("<script setup=''>", True),
        ("<script>", False),
    ],
)
def test_setup_attribute(tag, found):
    assert C.has_attribute(tag, "setup") == found


def test_analysis(spark):
    code = """import a, { b as c } from './utils'; import * as ns from 'n';
export interface User<K> { name: string }
type Alias = { a: 1 };
export class Foo extends Bar { greet(name: string): string { return helper(name); } }
export function buildName(user, n = 1): string { var x = 1; console.log(user); return a.b[k].d(); }
const arrow = () => inner(); // note
"""
    df = A.analyze(in_memory(spark, {"p": code, "empty": "", "bad": "let = ;", "twice": "let a = 1; let a = 2;"})).persist()
    rows = lambda part: [r for r in A.unnest(df, part).orderBy("path", "seq").collect() if r.path == "p"]
    assert [(r.name, r.kind) for r in rows("symbols")] == [("User", "interface"), ("Alias", "type"), ("Foo", "class"), ("Foo.greet", "method"), ("<anonymous@4>", "function"), ("buildName", "function")]
    assert [(r.name, r.kind) for r in rows("exports")] == [("User", "interface"), ("Foo", "class"), ("buildName", "function")]
    assert [(r.caller, r.callee) for r in rows("call_edges")] == [("<anonymous@4>", "helper"), ("buildName", "console.log"), ("buildName", "a.b.<computed>.d"), ("<module>", "inner")]
    assert [(r.category, r.line) for r in rows("issues")] == [("best-practices", 5), ("dev-code", 5)]
    assert [r.specifiers for r in rows("imports")] == [["a", "c"], ["* as ns"]]
    assert [r.text for r in rows("comments")] == ["// note"]
    assert rows("symbols")[-1].params == ["user", "n"] and rows("symbols")[-1].return_type == ": string"
    issues = {r.path: r.category for r in A.unnest(df, "issues").collect() if r.path != "p"}
    assert issues == {"bad": "parse", "twice": "semantic"}
    assert json.loads(A.analyze_json("f();"))["file_structure"]["call_graph"]["edges"] == [{"caller": "<module>", "callee": "f", "location": [1, 0]}]


def test_project_graph(spark):
    g = initialize_graph(spark, "on-demand").add_file("./src/utils.ts", "export const userName = 1;").add_file("src/app.ts", "import { userName } from './utils';\nexport const userName2 = 1;\ninterface User { a: 1 }")
    assert [r.path for r in g.list_files().collect()] == ["src/app.ts", "src/utils.ts"]
    deps = g.analyze_dependencies(["src/app.ts", "nope.ts"]).collect()
    assert [d.resolved_path for d in deps[0].dependencies] == ["src/utils.ts"] and deps[1].dependencies == []
    assert [r.kind for r in g.get_symbol_details("User").collect()] == ["interface"]
    g.add_file("src/x.ts", "import './y'")
    assert g.analyze_dependencies(["src/x.ts"]).first().dependencies == []
    g.add_file("src/y/index.ts", "").add_file("src/y.tsx", "")
    assert [d.resolved_path for d in g.analyze_dependencies(["src/x.ts"]).first().dependencies] == ["src/y.tsx"]
    g.add_file("src/utils.ts", "export const userName = 1;")
    assert g.get_symbol_details("userName").count() == 1 and g.get_file_structure("src/./utils.ts").count() == 1
    assert g.clear().list_files().count() == 0
    assert ProjectGraph(spark, mode="on-demand").on_transform("a.ts", "f()").list_files().count() == 0


def test_files_scan_and_cli(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.js").write_text("console.log(foo);")
    (tmp_path / "sub/b.ts").write_text("const x = 1;")
    (tmp_path / "c.txt").write_text("no")
    assert parse_extensions(" .js, ts,,") == ["js", "ts"] and parse_extensions(None) == ["js", "ts", "jsx", "tsx"]
    assert read_files(spark, str(tmp_path)).count() == 2
    dry = api.scan_directory(spark, str(tmp_path), LOG, dry_run=True)
    assert json.loads(summary_json(dry)) == [{"path": str(tmp_path / "a.js"), "matches": 1}, {"path": str(tmp_path / "sub/b.ts"), "matches": 0}]
    assert "Matches: 1" in summary_text(dry) and (tmp_path / "a.js").read_text() == "console.log(foo);"
    assert [r.path for r in api.scan_directory(spark, str(tmp_path), LOG, True, "js").collect()] == [str(tmp_path / "a.js")]
    with pytest.raises(api.RuleError):
        api.scan_directory(spark, str(tmp_path), "id: n\nlanguage: ts\nrule: {kind: a}", dry_run=False)
    done = {r.path: r.modifications for r in api.scan_directory(spark, str(tmp_path), LOG, dry_run=False).collect()}
    assert done[str(tmp_path / "a.js")] == 1 and (tmp_path / "a.js").read_text() == "logger.info(foo)"
    from thicket import cli

    (tmp_path / "r.yml").write_text("id: v\nlanguage: ts\nrule: {pattern: 'const x = $A;'}\nfix: 'let x = $A;'")
    assert cli.main(["run", str(tmp_path / "sub/b.ts"), str(tmp_path / "r.yml")]) == 0 and "let x = 1;" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path), str(tmp_path / "r.yml"), "--dry-run", "-e", "ts"]) == 0 and '"matches":1' in capsys.readouterr().out
    assert cli.main(["run", str(tmp_path / "sub/b.ts"), "id: x"]) == 1
    write_in_place(S.rewrites(read_files(spark, str(tmp_path)), LOG), dry_run=True)


def test_tools_and_sql(spark):
    tools = api.tools(spark, ProjectGraph(spark).add_file("a.ts", "export function f() {}"))
    assert len(tools) == 7
    assert json.loads(tools["find_pattern"](source="foo(1);", pattern="foo($A);"))[0]["metavariables"] == {"A": "1"}
    assert json.loads(tools["get_symbol_details"](symbol="f"))[0]["kind"] == "function"
    with pytest.raises(TypeError):
        tools["find_pattern"](source="x")
    with pytest.raises(TypeError):
        tools["analyze_ast"](source=3)
    api.register(spark)
    assert spark.sql("SELECT n.kind FROM (SELECT 'f(1);' AS code) t, LATERAL ast_nodes(t.code, 'ts') n").count() == 6
    assert spark.sql("SELECT m.text FROM (SELECT 'f(1);' AS code) t, LATERAL pattern_matches(t.code, 'f($A);') m").first()[0] == "f(1);"
    assert "file_structure" in spark.sql("SELECT analyze_json('f();') AS j").first().j


def test_incremental_ingest(spark, tmp_path):
    graph = IncrementalGraph(spark, str(tmp_path / "graph"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, code string, version bigint")
    graph.upsert(batch(("a.ts", "let a", 1), ("./b.ts", "let b", 1), ("b.ts", "let b2", 2)), 0)
    graph.upsert(batch(("a.ts", "let a", 5), ("b.ts", "old", 1), ("c.ts", "f()", 1)), 1)
    graph.upsert(batch(("a.ts", "let a", 5), ("b.ts", "old", 1), ("c.ts", "f()", 1)), 1)  # a repeated batch
    assert {r.path: (r.code, r.version) for r in graph.files().collect()} == {"a.ts": ("let a", 1), "b.ts": ("let b2", 2), "c.ts": ("f()", 1)}
    assert graph.analyzed().where("path = 'c.ts'").first().analysis.call_edges[0].callee == "f"
    graph.clear()
    assert graph.files().count() == 0
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.ts").write_text("g();")
    query = graph.start(read_file_stream(spark, str(tmp_path / "src")), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    assert [r.code for r in graph.files().collect()] == ["g();"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a/é\nbé/c", "x/../../y/./z")], "s string, p string")
    assert df.select(X.line_starts(F.col("s"))).first()[0] == [0, 5]
    assert df.select(X.normalize_path(F.col("p"))).first()[0] == "y/z"
    assert df.select(X.byte_slice(F.col("s"), F.lit(2), F.lit(4))).first()[0] == "é" and df.select(X.byte_slice(F.col("s"), F.lit(3), F.lit(4))).first()[0] is None
    assert df.select(X.import_candidates(F.lit("src/a.ts"), F.lit("../lib/b"))).first()[0][:3] == ["lib/b", "lib/b.ts", "lib/b.tsx"]
    assert df.select(X.import_candidates(F.lit("a.ts"), F.lit("react"))).first()[0] == []
    assert df.select(X.to_absolute(F.lit(3), F.lit(10), F.lit(12))).first()[0] is None
    assert df.select(X.should_analyze(F.lit("a/b.tsx")), X.should_analyze(F.lit("a.vue"))).first()[:] == (True, False)
