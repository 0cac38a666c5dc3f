"""More named queries: files and directories, the project graph, incremental ingest, matchers, analysis of every kind, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import text_ops as X
from .operators import analyze as A
from .operators import graph as G
from .operators import matching as M
from .operators import rewrite as R
from .operators import scan as S
from .plans.rules import compile_pattern, load_rule
from .queries import customer_files, nation_modules, query, spread, t, text
from .sources.files import read_files, summary_json, summary_text
from .storage import shared_folder
from .streaming.ingest import IncrementalGraph

_NATION_PATHS = "SELECT 'src/nation/' || n_nationkey || '.ts' AS path FROM nation UNION ALL SELECT CASE WHEN r_regionkey % 2 = 1 THEN 'src/region/' || r_regionkey || '/index.ts' ELSE 'src/region/' || r_regionkey || '.ts' END FROM region"


def _local(path: str) -> str:
    return path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def nation_tree(spark: SparkSession, d: str) -> str:
    """A folder with a file for each nation, two folders deep; every other nation's file has an extension that isn't asked for."""
    root, k = _folder(spark, "tree"), F.col("n_nationkey")
    code = F.concat(text("log(", k, ");\nconst n", k, " = '", F.col("n_name"), "';"))
    nations = t(spark, d, "nation").select(F.col("n_regionkey").alias("r"), k.alias("k"), code.alias("value"))
    nations.write.partitionBy("r", "k").text(root)
    return root


# -- files and directories --------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, 'log(' || n_nationkey || ');' || chr(10) || 'const n' || n_nationkey || ' = ''' || n_name || ''';' || chr(10) AS code FROM nation")
def read_tree(spark: SparkSession, d: str) -> DataFrame:
    """All files below a folder, at any depth, with an extension of the list; blanks and dots in the list don't count."""
    files = read_files(spark, nation_tree(spark, d), " .txt, ts ,,")
    return files.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("n_nationkey"), "code")


@query("SELECT n_nationkey, CAST(1 AS BIGINT) AS matches FROM nation")
def directory_scan(spark: SparkSession, d: str) -> DataFrame:
    found = api.scan_directory(spark, nation_tree(spark, d), "id: l\nlanguage: ts\nrule: {pattern: 'log($A);'}", extensions="txt")
    return found.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("n_nationkey"), "matches")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'out(' ELSE 'log(' END || n_nationkey || ')' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ';' END || chr(10) AS first_line, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS modifications FROM nation")
def directory_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Files are written back in place, those with matches only; then read again."""
    root = nation_tree(spark, d)
    rule = "id: l\nlanguage: ts\nrule: {all: [{pattern: 'log($A)'}, {regex: '[02468]\\)'}]}\nfix: out($A)"
    done = api.scan_directory(spark, root, rule, dry_run=False, extensions="txt").select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("n_nationkey"), "modifications")
    after = read_files(spark, root, "txt").select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("k"), F.concat(F.substring_index("code", "\n", 1), F.lit("\n")).alias("first_line"))
    return done.join(after, F.col("n_nationkey") == F.col("k")).select("n_nationkey", "first_line", "modifications")


@query("SELECT '[' || string_agg('{\"path\":\"n/' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.ts\",\"matches\":' || n_regionkey || '}', ',' ORDER BY n_nationkey) || ']' AS report, CAST(sum(n_regionkey) AS BIGINT) AS total FROM nation")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """The command line's report, and the sum that scripts make of it."""
    found = S.scan(_region_calls(spark, d), "id: c\nlanguage: ts\nrule: {pattern: 'go($A);'}")
    report = summary_json(found)
    return spark.createDataFrame([(report, sum(r["matches"] for r in json.loads(report)))], "report string, total bigint")


@query("SELECT string_agg('File: n/' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.ts' || chr(10) || 'Matches: ' || n_regionkey || chr(10) || 'Modifications: ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS report FROM nation")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    found = S.scan(_region_calls(spark, d), "id: c\nlanguage: ts\nrule: {pattern: 'go($A);'}\nfix: run($A);", dry_run=False)
    return spark.createDataFrame([(summary_text(found),)], "report string")


def _region_calls(spark: SparkSession, d: str) -> DataFrame:
    """As many calls in a nation's file as its region's key says."""
    n = t(spark, d, "nation")
    return n.select(F.concat(F.lit("n/"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".ts")).alias("path"), F.repeat(text("go(", F.col("n_nationkey"), ");\n"), F.col("n_regionkey")).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'logger.info(c' || c_custkey || ')' END AS updated FROM customer WHERE c_acctbal < 0")
def apply_rule(spark: SparkSession, d: str) -> DataFrame:
    """A rule given as JSON instead of YAML; it must have a fix."""
    rule = json.dumps({"id": "log", "language": "ts", "rule": {"pattern": "console.log($A)"}, "fix": "logger.info($A)"})
    found = S.apply_rule(customer_files(spark, d), rule).where("modifications > 0")
    return found.select("c_custkey", F.substring_index("updated", "\n", 1).alias("updated"))


@query("SELECT CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS matches, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS modifications, CAST(count(*) AS BIGINT) AS files FROM customer")
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    found = S.scan(customer_files(spark, d), "id: log\nlanguage: ts\nrule: {pattern: console.log($A)}\nfix: logger.info($A)", dry_run=False)
    return found.agg(F.sum("matches").alias("matches"), F.sum("modifications").alias("modifications"), F.count("*").alias("files"))


# -- graph and ingest -------------------------------------------------------------------------------------------------------------


@query(_NATION_PATHS)
def graph_list(spark: SparkSession, d: str) -> DataFrame:
    graph = api.initialize_graph(spark, "on-demand").add_files(nation_modules(spark, d))
    return graph.add_files(nation_modules(spark, d)).list_files()  # the same files again: nothing new


@query("SELECT 'N3' AS name, 'class' AS kind, CAST(4 AS BIGINT) AS line UNION ALL SELECT 'N3.go', 'method', 4 UNION ALL SELECT '<anonymous@4>', 'function', 4 UNION ALL SELECT 'I3', 'interface', 5")
def graph_structure(spark: SparkSession, d: str) -> DataFrame:
    """One file's symbols, looked up by a path that isn't normalized."""
    graph = api.initialize_graph(spark).add_files(nation_modules(spark, d))
    return A.unnest(graph.get_file_structure("src/./region/../nation/3.ts"), "symbols").select("name", "kind", "line")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'fresh' ELSE 'N' || n_nationkey END AS name FROM nation")
def graph_replace(spark: SparkSession, d: str) -> DataFrame:
    """Files added later replace those of the same path; in on-demand mode the build hook adds nothing."""
    graph = api.initialize_graph(spark).add_files(nation_modules(spark, d))
    k = F.col("n_nationkey")
    graph.add_files(t(spark, d, "nation").where(k % 2 == 0).select(text("./src/nation/", k, ".ts").alias("path"), F.lit("class fresh {}").alias("code")))
    graph.mode = "on-demand"
    graph.on_transform("src/nation/1.ts", "class lost {}")
    found = graph.analyzed(["classes"]).where(F.col("path").startswith("src/nation/"))
    return found.select(F.regexp_extract("path", r"(\d+)\.ts$", 1).cast("int").alias("n_nationkey"), F.col("analysis.classes")[0]["name"].alias("name"))


@query("""
SELECT p AS requested, CAST(CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n, CASE WHEN n_nationkey IS NULL THEN NULL WHEN n_regionkey % 2 = 1 THEN 'src/region/' || n_regionkey || '/index.ts' ELSE 'src/region/' || n_regionkey || '.ts' END AS first
FROM (VALUES ('src/nation/0.ts'), ('src/nation/7.ts'), ('nowhere.ts'), ('src/region/1/index.ts'), ('src/nation/24.ts')) AS v(p) LEFT JOIN nation ON p = 'src/nation/' || n_nationkey || '.ts'""")
def graph_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Only imports that a file of the project answers are dependencies; unknown paths have none."""
    graph = api.initialize_graph(spark).add_files(nation_modules(spark, d))
    found = graph.analyze_dependencies(["src/nation/0.ts", "src/nation/7.ts", "nowhere.ts", "src/region/1/index.ts", "src/nation/24.ts"])
    return found.select("requested", F.size("dependencies").cast("long").alias("n"), F.get("dependencies", F.lit(0))["resolved_path"].alias("first"))


@query("SELECT text_md5, CAST(n AS BIGINT) AS n, first_id FROM (SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text))")
def content_classes(spark: SparkSession, d: str) -> DataFrame:
    """Files of equal content, found by the hash that incremental ingest skips by."""
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), X.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.min("text_md5").alias("text_md5"), F.count("*").alias("n"), F.min("doc_id").alias("first_id")).drop("hash")


@query("SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as files whose versions are their turns, ingested in three batches, of which the second comes twice: the latest version of a path wins."""
    rows = t(spark, d, "conversations").select(text("c/./", F.col("conv_id"), ".ts").alias("path"), F.col("text").alias("code"), F.col("turn").cast("long").alias("version"))
    graph = IncrementalGraph(spark, _folder(spark, "ingest"), buckets=8)
    for k, part in enumerate((rows.where("version % 3 = 1"), rows.where("version % 3 = 2"), rows.where("version % 3 = 2"), rows.where("version % 3 = 0"))):
        graph.upsert(part, min(k, 2) if k < 3 else 3)
    return graph.files().select(F.regexp_extract("path", r"c/(\d+)", 1).cast("long").alias("conv_id"), F.col("code").alias("text"))


@query("SELECT path, content_md5 FROM (SELECT 'f/' || (doc_id % 50) || '.ts' AS path, md5(text) AS content_md5, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC, text DESC) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").where("text IS NOT NULL").select(text("f/../f/", F.col("doc_id") % 50, ".ts").alias("path"), F.col("text").alias("code"), "doc_id")
    return G.latest_files(docs, "doc_id").select("path", F.md5("code").alias("content_md5"))


# -- matchers --------------------------------------------------------------------------------------------------------------------------


class _CallOf(M.Matcher):
    """A user's own matcher: calls of one function."""

    def __init__(self, name: str):
        self.name = name

    def match(self, node, env):
        return env if node.variant == "CallExpression" and node.text.startswith(self.name + "(") else None


def _matcher_counts(spark: SparkSession, d: str, matcher: M.Matcher) -> DataFrame:
    found = S.find_matches(customer_files(spark, d), matcher, language="ts")
    return found.groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS n FROM customer WHERE c_acctbal >= 0")
def user_matcher(spark: SparkSession, d: str) -> DataFrame:
    return _matcher_counts(spark, d, _CallOf("send"))


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 0")
def all_matcher(spark: SparkSession, d: str) -> DataFrame:
    pattern = M.PatternMatcher(compile_pattern("console.log($A);"))
    return _matcher_counts(spark, d, M.All(pattern, M.Where(lambda n: n.text[-3] in "02468")))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM customer")
def any_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Log calls, variables with a call, and classes."""
    return _matcher_counts(spark, d, M.AnyOf(M.PatternMatcher(compile_pattern("console.log($A);")), M.Where(lambda n: n.kind in ("VariableDeclaration", "ClassDeclaration"))))


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 3 <> 0")
def not_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Statements that are neither calls nor variables nor classes: composed of the others."""
    plain = M.Composite(M.Where(lambda n: n.kind == "ExpressionStatement"), M.Not(M.Where(lambda n: "(" in n.text)))
    return _matcher_counts(spark, d, plain)


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || '7' AS a FROM lineitem WHERE l_partkey = l_suppkey")
def multi_rebinding(spark: SparkSession, d: str) -> DataFrame:
    """Two lists that must agree element by element."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    lines = spread(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").where((p % 10 == s % 10) & (F.col("l_linenumber") < 3) | (p == s)))
    files = lines.select("l_orderkey", "l_linenumber", text("call(", p, ", 7, 0, ", s, ", 7);").alias("code"))
    return S.find_pattern(files, "call($$$A, 0, $$$A);").select("l_orderkey", "l_linenumber", F.col("metavariables")["A"].alias("a"))


@query("SELECT c_custkey, CAST(0 AS BIGINT) AS n FROM customer")
def bare_placeholder(spark: SparkSession, d: str) -> DataFrame:
    """A pattern that is nothing but $$$A matches no node."""
    found = S.rule_matches(customer_files(spark, d), "id: b\nlanguage: ts\nrule: {pattern: '$$$A'}")
    return found.select("c_custkey", F.size("matches").cast("long").alias("n"))


@query("SELECT c_custkey, mode, c_custkey % 2 = 0 OR mode <> 'cst' AS found FROM customer, (VALUES ('ast'), ('relaxed'), ('template'), ('cst'), ('signature')) AS m(mode)")
def strictness_modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 2 == 0, F.lit("f(a, b);")).otherwise(F.lit("f(a,  /* b */ b);"))
    files = spread(t(spark, d, "customer").select("c_custkey")).select("c_custkey", code.alias("code"))
    out = None
    for mode in M.STRICTNESS:
        one = S.find_matches(files, M.PatternMatcher(compile_pattern("f(a, b);"), mode)).select("c_custkey").distinct().withColumn("found", F.lit(True))
        one = files.select("c_custkey").join(one, "c_custkey", "left").select("c_custkey", F.lit(mode).alias("mode"), F.coalesce("found", F.lit(False)).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size % 4 END AS BIGINT) AS inside FROM part")
def nearest_call(spark: SparkSession, d: str) -> DataFrame:
    """How many nested calls have a call around them, by the nearest ancestor that satisfies a predicate."""
    depth = F.col("p_size") % 4 + 1
    parts = spread(t(spark, d, "part").select("p_partkey", "p_size"))
    files = parts.select("p_partkey", F.col("p_partkey").cast("string").alias("path"), text(F.repeat(F.lit("fn("), depth), F.col("p_partkey"), F.repeat(F.lit(")"), depth), ";").alias("code"))
    nodes = S.ast_nodes(files, "ts")
    call = F.col("variant") == "CallExpression"
    inner = S.nearest_ancestor(nodes, call).where(call).groupBy("p_partkey").agg(F.count("*").alias("n")).withColumnRenamed("p_partkey", "k")
    return parts.join(inner, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("inside"))


# -- analysis --------------------------------------------------------------------------------------------------------------------


def part_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each part: a type alias, comments, a name declared twice, lint, and a syntax error in some."""
    parts, k = spread(t(spark, d, "part").select("p_partkey", "p_size")), F.col("p_partkey")
    code = F.concat(
        text("type P", k, "<T> = T | ", F.col("p_size"), ";\n"),
        F.repeat(F.lit("// note\n"), F.col("p_size") % 4),
        F.when(k % 3 == 0, text("/** d */ let a", k, "; { let a", k, "; }\n")).otherwise(""),
        F.when(k % 5 == 0, text("const b", k, " = 1; class b", k, " {}\n")).otherwise(""),
        F.when(k % 2 == 0, F.lit("var c; console.log(c);\n")).otherwise(""),
        F.when(k % 11 == 0, F.lit("f(;")).otherwise(""),
    )
    return parts.select("p_partkey", text("p/", k, F.element_at(F.array(*map(F.lit, (".ts", ".tsx", ".css", ".js"))), (F.col("p_size") % 4 + 1).cast("int"))).alias("path"), code.alias("code"))


@query("SELECT p_partkey, 'P' || p_partkey AS name, 'T' AS type_params, 'T | ' || p_size AS type_text, CAST(1 AS BIGINT) AS line FROM part WHERE p_partkey % 11 <> 0")
def type_aliases(spark: SparkSession, d: str) -> DataFrame:
    found = A.unnest(A.analyze(part_files(spark, d), parts=["type_aliases"]), "type_aliases", "p_partkey")
    return found.select("p_partkey", "name", F.array_join("type_params", ",").alias("type_params"), F.col("return_type").alias("type_text"), "line")


@query("SELECT p_partkey, CAST(p_size % 4 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS comments, CASE WHEN p_partkey % 3 = 0 THEN '/** d */' WHEN p_size % 4 > 0 THEN '// note' END AS last, CAST(0 AS BIGINT) AS jsdoc, 'tsx' AS language FROM part WHERE p_partkey % 11 <> 0")
def comments(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("analysis")
    found = A.analyze(part_files(spark, d), parts=["comments", "jsdoc", "issues"]).where(~F.exists(a["issues"], lambda i: i["category"] == "parse"))
    return found.select("p_partkey", F.size(a["comments"]).cast("long").alias("comments"), F.try_element_at(a["comments"], F.lit(-1)).alias("last"), F.size(a["jsdoc"]).cast("long").alias("jsdoc"), a["language"].alias("language"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'parse' ELSE concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'semantic' END, CASE WHEN p_partkey % 2 = 0 THEN 'best-practices,dev-code' END) END AS categories,
  CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 = 0 THEN 'Identifier `b' || p_partkey || '` has already been declared' END AS redeclared FROM part""")
def issue_order(spark: SparkSession, d: str) -> DataFrame:
    """Syntax errors alone, else declarations, then lint; a name in an inner block is another one."""
    issues = F.col("analysis.issues")
    found = A.analyze(part_files(spark, d), parts=["issues"])
    semantic = F.get(F.filter(issues, lambda i: i["category"] == "semantic"), F.lit(0))
    return found.select("p_partkey", F.array_join(F.transform(issues, lambda i: i["category"]), ",").alias("categories"), semantic["message"].alias("redeclared"))


@query("SELECT p_partkey, 'tsx' AS language, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS BIGINT) AS aliases, CASE WHEN p_partkey % 11 <> 0 THEN 'P' || p_partkey END AS first, CASE WHEN p_partkey % 11 <> 0 THEN '[1,0]' END AS location FROM part")
def analysis_json(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis as JSON, by the SQL function."""
    api.register(spark)
    found = part_files(spark, d).select("p_partkey", F.call_function("analyze_json", "code").alias("j"))
    one = lambda path: F.get_json_object("j", path)
    kind = "array<struct<name:string>>"
    aliases = F.from_json(one("$.file_structure.type_aliases"), kind)
    return found.select("p_partkey", one("$.file_structure.language").alias("language"), F.size(aliases).cast("long").alias("aliases"), one("$.file_structure.type_aliases[0].name").alias("first"), one("$.file_structure.type_aliases[0].location").alias("location"))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 2 OR n = 0 THEN 0 ELSE n + 1 END AS BIGINT) AS lines, CASE WHEN p_size % 4 <> 2 AND n > 0 THEN 'Found ' || n || ' issues in p/' || p_partkey || ext END AS head
FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.css' ELSE '.js' END AS ext, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END END AS n FROM part)""")
def issue_log(spark: SparkSession, d: str) -> DataFrame:
    """What a build prints; files that aren't scripts by their name are left alone."""
    found = A.annotate_issues(part_files(spark, d), inject=False, log=True).where(F.col("annotated") == F.col("code"))
    return found.select("p_partkey", F.size("log").cast("long").alias("lines"), F.get("log", F.lit(0)).alias("head"))


@query("SELECT p_partkey, p_size % 4 <> 2 AS wanted FROM part")
def script_names(spark: SparkSession, d: str) -> DataFrame:
    return part_files(spark, d).select("p_partkey", X.should_analyze(F.col("path")).alias("wanted"))


@query("SELECT doc_id, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines, CAST(strlen(text) - strlen(regexp_extract(text, '[^\\n]*$')) AS BIGINT) AS last_start FROM documents WHERE text IS NOT NULL".replace("\\\\n", "\\n"))
def line_starts(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.line_starts(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("lines"), F.element_at("s", -1).alias("last_start"))


@query("SELECT o_orderkey, 'cust=' || o_custkey || '>X;key=' || o_orderkey || '>Y' AS diffs FROM orders")
def edit_diffs(spark: SparkSession, d: str) -> DataFrame:
    """What edits change, in the order in which they were given."""
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    rows = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("key="), o, F.lit(" cust="), c).alias("code"), F.length(o).alias("n"), F.length(c).alias("m"))
    first, second = R.edit(F.col("n") + 5, F.col("n") + F.col("m") + 10, F.lit("X")), R.edit(F.lit(0), F.col("n") + 4, F.lit("Y"))
    shown = F.array_join(F.transform(R.edit_diffs(F.col("code"), F.array(first, second)), lambda x: F.concat(x["original"], F.lit(">"), x["replacement"])), ";")
    return rows.select("o_orderkey", shown.alias("diffs"))


@query("SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a FROM nation")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The agent tools' answers, which are JSON: a call for each nation."""
    find = api.tools(spark)["find_pattern"]
    sources = [(r.n_nationkey, f"visit({r.n_nationkey});") for r in t(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").limit(25).collect()]
    return spark.createDataFrame([(k, json.loads(find(source=code, pattern="visit($A);"))[0]["metavariables"]["A"]) for k, code in sources], "n_nationkey int, a string")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS matches FROM customer")
def rule_file(spark: SparkSession, d: str) -> DataFrame:
    """A rule read from a file: an argument that is the path of one."""
    path = _local(_folder(spark, "rule")) + ".yml"
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("id: log\nlanguage: ts\nrule: {pattern: console.log($A)}\n")
    return S.scan(customer_files(spark, d), load_rule(path)).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("c_custkey"), "matches")
