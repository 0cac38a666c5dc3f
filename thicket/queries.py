"""Named queries over the given tables, one or more for each operator, with the same in DuckDB's SQL.

Code to search is made from the relational rows, so the expected answers are plain algebra on those rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text_ops as X
from .operators import analyze as A
from .operators import graph as G
from .operators import rewrite as R
from .operators import scan as S
from .operators.overlap import outermost, resolve_spans
from .sources import containers as C

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    """Strings and Columns put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def spread(rows: DataFrame) -> DataFrame:
    """A scan's rows over all cores, if it has fewer splits than there are cores, which only a small one has. A larger scan is parsed where it is read."""
    wanted = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else rows.repartition(wanted)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by the key that they are grouped and joined by next, in a number of parts that adaptive execution doesn't lower: parsing follows, which costs
    far more than moving keys. No further shuffle is needed."""
    spark = rows.sparkSession
    return rows.repartition(max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


# -- containers and text -------------------------------------------------------------------------------------------------

_TAG = r"<script(?:[ \t\r\n/][^>]*)?>"


@query(rf"""
WITH b AS (SELECT page_id, regexp_extract(html, '(?is){_TAG}(.*?)</script>', 1) AS content, strlen(regexp_extract(html, '(?is)^(.*?{_TAG})', 1)) AS a FROM pages)
SELECT page_id, content AS script, CAST(a AS BIGINT) AS span_start, CAST(a + strlen(content) AS BIGINT) AS span_end,
  CAST(CASE WHEN regexp_matches(content, '(^|;)var ') THEN 1 ELSE 0 END AS BIGINT) AS var_hits, regexp_extract(content, 'track\(([^)]*)\)', 1) AS track_arg FROM b""")
def page_script_scan(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: each page's script block with its byte span, its var declarations, and the argument of track()."""
    pages = C.first_script(spread(t(spark, d, "pages").select("page_id", F.col("html").alias("code"))))
    rows = pages.select("page_id", F.col("script.content").alias("code"), F.col("script.start").alias("span_start"), F.col("script.end").alias("span_end"))
    rows = rows.withColumn("analysis", A.analysis_of(F.col("code"), ["issues"]))
    found = S.find_pattern(rows, "track($A);")
    hits = F.size(F.filter("analysis.issues", lambda i: i["category"] == "best-practices")).cast("long")
    return found.select("page_id", F.col("code").alias("script"), "span_start", "span_end", hits.alias("var_hits"), F.col("metavariables")["A"].alias("track_arg"))


@query(rf"""
SELECT page_id, 0 AS block, regexp_extract(html, '(?is){_TAG}(.*?)</script>', 1) AS content, CAST(strlen(regexp_extract(html, '(?is)^(.*?{_TAG})', 1)) AS BIGINT) AS span_start,
  CAST(strlen(regexp_extract(html, '(?is)^(.*?{_TAG}.*?)</script>', 1)) AS BIGINT) AS span_end FROM pages""")
def sfc_script_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = C.script_blocks(t(spark, d, "pages").select("page_id", F.col("html").alias("code")))
    return blocks.select("page_id", "block", "content", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(rf"""
SELECT page_id, regexp_matches(html, '(?is){_TAG}.*?</script>') AS has_script, regexp_matches(html, '(?i)<script[^>]*\ssetup') AS has_script_setup,
  regexp_matches(html, '(?is)<template(?:[ \t\r\n/][^>]*)?>.*?</template>') AS has_template, regexp_matches(html, '(?is)<style(?:[ \t\r\n/][^>]*)?>.*?</style>') AS has_style FROM pages""")
def sfc_block_presence(spark: SparkSession, d: str) -> DataFrame:
    found = C.block_presence(t(spark, d, "pages").select("page_id", F.col("html").alias("code")))
    return found.select("page_id", "has_script", "has_script_setup", "has_template", "has_style")


@query(r"""
WITH p AS (SELECT doc_id, left(text, CAST(length(text) // 2 AS INT)) AS p FROM documents)
SELECT doc_id, CAST(strlen(p) AS BIGINT) AS byte_offset, CAST(1 + length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line, CAST(strlen(regexp_extract(p, '[^\n]*$')) AS BIGINT) AS col FROM p""")
def match_line_col(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "text")
    at = F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).cast("long")
    rows = docs.withColumn("byte_offset", at)
    return rows.select("doc_id", "byte_offset", X.line_of(F.col("text"), F.col("byte_offset")).alias("line"), X.column_of(F.col("text"), F.col("byte_offset")).alias("col"))


_NORM = r"regexp_replace(text, '(?s)//[^\n]*\n?|/\*.*?(?:\*/|\z)|[\t\n\x0b\f\r \x{85}\p{Z}]', '', 'g')"


@query(f"SELECT doc_id, md5({_NORM}) AS norm_md5, md5(split_part({_NORM}, '{{', 1)) AS signature_md5, {_NORM} = '' AS ignorable FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "text")
    norm = F.col("norm")
    return docs.select("doc_id", X.normalize_text(F.col("text")).alias("norm")).select("doc_id", F.md5(norm).alias("norm_md5"), F.md5(F.substring_index(norm, "{", 1)).alias("signature_md5"), (norm == "").alias("ignorable"))


@query(r"SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '[Tt]h[a-z]+ing[.,]')")
def regex_rule(spark: SparkSession, d: str) -> DataFrame:
    from .plans.rules import Rule, check_regex

    nodes = t(spark, d, "documents").select("doc_id", "text")
    return nodes.where(S.node_predicate(Rule("regex", check_regex("[Tt]h[a-z]+ing[.,]")))).select("doc_id", F.length("text").cast("long").alias("n"))


@query(r"""
SELECT page_id, decode(encode(html)[CAST(strlen(regexp_extract(html, '(?s)^(.*?<title>)', 1)) AS INT) + 1 : CAST(strlen(regexp_extract(html, '(?s)^(.*?)</title>', 1)) AS INT)]) AS title FROM pages""")
def byte_slice(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    a, b = (F.octet_length(F.regexp_extract(html, p, 1)).cast("long") for p in (r"(?s)^(.*?<title>)", r"(?s)^(.*?)</title>"))
    return t(spark, d, "pages").select("page_id", X.byte_slice(html, a, b).alias("title"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a/c/p' || p_partkey || '.ts' WHEN 1 THEN '/lib/p' || p_partkey WHEN 2 THEN 'p' || p_partkey || '/x' ELSE 'p' || p_partkey END AS path,
  p_size % 4 <> 1 AS relative FROM part""")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("p_partkey"), F.col("p_size") % 4
    raw = F.when(kind == 0, text("a/./b/../c//p", k, ".ts")).when(kind == 1, text("/../lib/./p", k)).when(kind == 2, text("../../p", k, "/x/")).otherwise(text("./q/../p", k))
    path = X.normalize_path(F.col("raw"))
    return t(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", path.alias("path"), (~F.col("raw").startswith("/")).alias("relative"))


# -- rules ------------------------------------------------------------------------------------------------------------------


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each customer: a debt is logged, other balances are sent; every third customer has a class."""
    c = spread(t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"))
    k = F.col("c_custkey")
    first = F.when(F.col("c_acctbal") < 0, text("console.log(c", k, ");\n")).otherwise(text("const v", k, " = send(c", k, ", ", F.col("c_nationkey"), ");\n"))
    second = F.when(k % 3 == 0, text("class C", k, " { m() { return call(1); } }\n")).otherwise(F.lit("x = 1;\n"))
    return c.select("c_custkey", text("c/", k, ".ts").alias("path"), F.concat(first, second).alias("code"))


def _rule_counts(spark: SparkSession, d: str, rule: str) -> DataFrame:
    found = S.rule_matches(customer_files(spark, d), f"id: r\nlanguage: ts\nrule: {rule}")
    return found.select("c_custkey", F.size("matches").cast("long").alias("matches"))


@query("SELECT c_custkey, CAST(2 AS BIGINT) AS matches FROM customer")
def kind_rule(spark: SparkSession, d: str) -> DataFrame:
    """Statement and inner node share a span, so each call counts twice."""
    return _rule_counts(spark, d, "{kind: CallExpression}")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS BIGINT) AS matches FROM customer")
def all_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_counts(spark, d, "{all: [{kind: CallExpression}, {regex: '^console'}]}")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS matches FROM customer")
def any_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_counts(spark, d, "{any: [{pattern: 'console.log($A);'}, {kind: MethodDefinition}]}")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE 2 END AS BIGINT) AS matches FROM customer")
def not_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_counts(spark, d, "{all: [{kind: CallExpression}, {not: {regex: console}}]}")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE 2 END AS BIGINT) AS matches FROM customer")
def inside_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_counts(spark, d, "{all: [{kind: CallExpression}, {inside: {kind: VariableDeclaration}}]}")


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS matches FROM customer")
def has_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_counts(spark, d, "{all: [{regex: '^class'}, {has: {kind: Function}}]}")


@query("SELECT c_custkey, CAST(2 AS BIGINT) AS n FROM customer WHERE c_acctbal >= 0")
def inside_join(spark: SparkSession, d: str) -> DataFrame:
    """The same as an interval semi-join over a node table."""
    nodes = S.ast_nodes(customer_files(spark, d), "ts")
    found = S.related(nodes, F.col("kind") == "VariableDeclaration", "inside").where("kind = 'CallExpression'")
    return found.groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 3 <> 0")
def not_has_join(spark: SparkSession, d: str) -> DataFrame:
    """Top-level statements without a call or method below: the plain assignments."""
    nodes = S.ast_nodes(customer_files(spark, d), "ts")
    bare = S.related(nodes, F.col("kind").isin("CallExpression", "MethodDefinition"), "has", negate=True).where("depth = 1")
    return bare.groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS callee, '\"' || o_orderpriority || '\"' AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders")
def pattern_capture(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = spread(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"))
    files = orders.select("o_orderkey", text("const o_", k, ' = place("', F.col("o_orderpriority"), '", ', F.col("o_custkey"), ");").alias("code"))
    found = S.find_pattern(files, "const $X = place($A, $B);")
    m = F.col("metavariables")
    return found.select("o_orderkey", F.regexp_extract("text", r"o_(\d+)", 1).alias("callee"), m["A"].alias("a"), m["B"].alias("b"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS a FROM lineitem WHERE l_partkey = l_suppkey")
def pattern_repeat_binding(spark: SparkSession, d: str) -> DataFrame:
    lines = spread(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    files = lines.select("l_orderkey", "l_linenumber", text("pair(", F.col("l_partkey"), ", ", F.col("l_suppkey"), ");").alias("code"))
    return S.find_pattern(files, "pair($A, $A);").select("l_orderkey", "l_linenumber", F.col("metavariables")["A"].alias("a"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, l_partkey) AS args, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey")
def multi_capture(spark: SparkSession, d: str) -> DataFrame:
    lines = dealt(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    args = F.array_join(F.transform("ls", lambda x: x["l_partkey"].cast("string")), ", ")
    found = S.find_pattern(lists.select("l_orderkey", text("call(", args, ");").alias("code")), "call($$$A);")
    return found.select("l_orderkey", F.col("metavariables")["A"].alias("args"), F.size(F.col("multi")["A"]).cast("long").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS cst, true AS ast, true AS signature FROM customer")
def strictness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 2 == 0, F.lit("function sum(a, b) { return a + b; }")).otherwise(F.lit("function sum(a, /* b */ b) { return a + b; }"))
    files = spread(t(spark, d, "customer").select("c_custkey")).select("c_custkey", code.alias("code"))
    out = files
    for mode in ("cst", "ast", "signature"):
        one = S.find_pattern(files, "function sum(a, b) { return a + b; }", mode).select(F.col("c_custkey").alias("k"), F.lit(True).alias(mode)).distinct()
        out = out.join(one, out["c_custkey"] == one["k"], "left").drop("k")
    return out.select("c_custkey", *(F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("cst", "ast", "signature")))


# -- overlap and rewriting ---------------------------------------------------------------------------------------------------


def _nested_spans(spark: SparkSession, d: str) -> DataFrame:
    """A file for each part: calls nested 1 to 4 deep; the spans of its call nodes."""
    depth = F.col("p_size") % 4 + 1
    code = text(F.repeat(F.lit("fn("), depth), F.col("p_partkey"), F.repeat(F.lit(")"), depth), ";")
    parts = spread(t(spark, d, "part").select("p_partkey", "p_size"))
    files = parts.select("p_partkey", F.col("p_partkey").cast("string").alias("path"), code.alias("code"))
    return S.ast_nodes(files, "ts").where("variant = 'CallExpression'").select("p_partkey", "start", "end")


@query("SELECT p_partkey, CAST(0 AS BIGINT) AS a, CAST(4 * (p_size % 4 + 1) + length(CAST(p_partkey AS VARCHAR)) AS BIGINT) AS b FROM part")
def overlap_outer(spark: SparkSession, d: str) -> DataFrame:
    spans = _nested_spans(spark, d).groupBy("p_partkey").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return spans.select("p_partkey", F.inline(resolve_spans(F.col("s"), "outer"))).select("p_partkey", F.col("start").alias("a"), F.col("end").alias("b"))


@query("SELECT p_partkey, CAST(3 * (p_size % 4) AS BIGINT) AS a, CAST(3 * (p_size % 4) + 4 + length(CAST(p_partkey AS VARCHAR)) AS BIGINT) AS b FROM part")
def overlap_inner(spark: SparkSession, d: str) -> DataFrame:
    spans = _nested_spans(spark, d).groupBy("p_partkey").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return spans.select("p_partkey", F.inline(resolve_spans(F.col("s"), "inner"))).select("p_partkey", F.col("start").alias("a"), F.col("end").alias("b"))


@query("SELECT p_partkey, CAST(0 AS BIGINT) AS a, CAST(4 * (p_size % 4 + 1) + length(CAST(p_partkey AS VARCHAR)) AS BIGINT) AS b FROM part")
def overlap_outermost_window(spark: SparkSession, d: str) -> DataFrame:
    return outermost(_nested_spans(spark, d), "p_partkey").select("p_partkey", F.col("start").alias("a"), F.col("end").alias("b"))


_FIX = "id: log\nlanguage: ts\nrule:\n  pattern: console.log($A)\nfix: logger.info($A)\n"


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'logger.info(c' || c_custkey || ')' ELSE 'const v' || c_custkey || ' = send(c' || c_custkey || ', ' || c_nationkey || ');' END
  || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'class C' || c_custkey || ' { m() { return call(1); } }' ELSE 'x = 1;' END || chr(10) AS updated,
  CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS modifications FROM customer""")
def rewrite_rule(spark: SparkSession, d: str) -> DataFrame:
    """The pattern has no semicolon but the statement's span does, so the rewrite loses it."""
    return S.rewrites(customer_files(spark, d), _FIX).select("c_custkey", "updated", "modifications")


@query("""
SELECT c_custkey, 'const t = wrap(' || c_custkey || ', a' || c_nationkey || 'b);' || '  // $C' AS updated FROM customer""")
def template_fix(spark: SparkSession, d: str) -> DataFrame:
    """Several captured nodes are put in without separator; unbound placeholders stay."""
    rule = "id: t\nlanguage: ts\nrule: {pattern: 'const t = f($A, $$$B);'}\nfix: 'const t = wrap($A, $$$B);  // $C'\n"
    customers = spread(t(spark, d, "customer").select("c_custkey", "c_nationkey"))
    files = customers.select("c_custkey", text("const t = f(", F.col("c_custkey"), ", a", F.col("c_nationkey"), ", b);").alias("code"))
    return S.rewrites(files, rule).select("c_custkey", "updated")


@query("SELECT o_orderkey, 'keep' || o_orderkey || '();' || chr(10) AS updated FROM orders")
def delete_absorb_trivia(spark: SparkSession, d: str) -> DataFrame:
    """An absorbing deletion takes the blanks around and one line end with it."""
    gone = text("gone", F.col("o_custkey"), "();")
    code = text("  ", gone, " \t\r\n", "keep", F.col("o_orderkey"), "();\n")
    rows = t(spark, d, "orders").select("o_orderkey", code.alias("code"), F.octet_length(gone).cast("long").alias("n"))
    edits = F.array(R.edit(F.lit(2), F.col("n") + 2, F.lit(""), True))
    return rows.select("o_orderkey", R.apply_edits(F.col("code"), edits)["updated"].alias("updated"))


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS a, CAST(l_linenumber + l_quantity % 7 - 1 AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a > b THEN 'Invalid span range: start (' || a || ') > end (' || b || ')'
  WHEN b > 10 THEN 'Span [' || a || ', ' || b || ') is out of bounds for source length 10'
  WHEN a < 8 AND 5 < b THEN 'Overlapping spans detected: [' || least(a, 5) || ', ' || CASE WHEN a < 5 OR a = 5 AND b < 8 THEN b ELSE 8 END || ') and [' || greatest(a, 5) || ', ' || CASE WHEN a < 5 OR a = 5 AND b < 8 THEN 8 ELSE b END || ')' END AS error FROM e""")
def rewrite_errors(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_linenumber").cast("long"), (F.col("l_linenumber") + F.col("l_quantity") % 7 - 1).cast("long")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    edits = F.array(R.edit(F.col("a"), F.col("b"), F.lit("x")), R.edit(F.lit(5), F.lit(8), F.lit("y")))
    return rows.select("l_orderkey", "l_linenumber", R.edit_error(F.lit("0123456789"), edits).alias("error"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b' || o_custkey || ';' END AS updated, CASE WHEN o_orderkey % 2 = 1 THEN 'Source text does not match expected original content at span [0, 1)' END AS error FROM orders")
def apply_diffs(spark: SparkSession, d: str) -> DataFrame:
    original = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("z")
    diffs = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"), original.alias("original"), F.lit("b").alias("replacement")))
    return t(spark, d, "orders").select("o_orderkey", R.apply_diffs(text("a", F.col("o_custkey"), ";"), diffs).alias("r")).select("o_orderkey", "r.updated", "r.error")


@query("""
SELECT 'c/' || c_custkey || '.ts' AS path, r AS rule_id, CAST(CASE r WHEN 'log' THEN CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END WHEN 'class' THEN CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS matches
FROM customer, (VALUES ('log'), ('class'), ('none')) AS rules(r)""")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    """Three rules in one pass; files without matches have a row with 0."""
    rules = [_FIX, "id: class\nlanguage: ts\nrule: {kind: ClassDeclaration}", "id: none\nlanguage: ts\nrule: {pattern: nothing($A)}"]
    return S.scan(customer_files(spark, d), rules).select("path", "rule_id", "matches")


# -- analysis -----------------------------------------------------------------------------------------------------------------


def order_modules(spark: SparkSession, d: str) -> DataFrame:
    """A module for each order: a function that calls ship() once for each line, a var and a console call in some."""
    lines = dealt(t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = dealt(t(spark, d, "orders").select("o_orderkey"), "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    body = F.concat(F.repeat(text("  ship.item(", k, ");\n"), F.coalesce(F.col("n"), F.lit(0)).cast("int")), F.when(k % 5 == 0, "  console.log(1);\n").otherwise(""))
    code = F.concat(text("export function order", k, "(a: string, b): void {\n"), body, F.lit("}\n"), F.when(k % 7 == 0, text("var v", k, " = 1;\n")).otherwise(""))
    return o.select("o_orderkey", text("o/", k, ".ts").alias("path"), code.alias("code"))


@query("""
SELECT 'order' || o_orderkey AS caller, callee, CAST(n AS BIGINT) AS n FROM (
  SELECT o_orderkey, 'ship.item' AS callee, count(l_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
  UNION ALL SELECT o_orderkey, 'console.log', 1 FROM orders WHERE o_orderkey % 5 = 0)""")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = A.unnest(A.analyze(order_modules(spark, d), parts=["call_edges"]), "call_edges")
    return edges.groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("SELECT 'o/' || o_orderkey || '.ts' AS path, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + 3 AS BIGINT) AS line, CAST(0 AS BIGINT) AS col FROM orders WHERE o_orderkey % 7 = 0")
def lint_var(spark: SparkSession, d: str) -> DataFrame:
    issues = A.unnest(A.analyze(order_modules(spark, d), parts=["issues"]), "issues").where("category = 'best-practices'")
    return issues.select("path", "line", F.col("column").alias("col"))


@query("SELECT 'o/' || o_orderkey || '.ts' AS path, 'warning' AS severity, CAST(2 AS BIGINT) AS col FROM orders WHERE o_orderkey % 5 = 0")
def lint_console(spark: SparkSession, d: str) -> DataFrame:
    issues = A.unnest(A.analyze(order_modules(spark, d), parts=["issues"]), "issues").where("category = 'dev-code'")
    return issues.select("path", "severity", F.col("column").alias("col"))


@query("SELECT 'order' || o_orderkey AS name, 'function' AS kind, 'a,b' AS params, ': void' AS return_type, CAST(1 AS BIGINT) AS line, CAST(7 AS BIGINT) AS col FROM orders")
def symbols(spark: SparkSession, d: str) -> DataFrame:
    found = A.unnest(A.analyze(order_modules(spark, d), parts=["symbols"]), "symbols")
    return found.select("name", "kind", F.array_join("params", ",").alias("params"), "return_type", "line", F.col("column").alias("col"))


def nation_modules(spark: SparkSession, d: str) -> DataFrame:
    """Nations import their regions; regions lie in R.ts, or in R/index.ts if their key is odd."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    k = F.col("n_nationkey")
    code = text("import R, { name as n", k, " } from '../region/", F.col("n_regionkey"), "';\nimport type { T } from 'lib';\nexport const nation", k, " = R, other = 1;\nexport default class N", k, " { go() { return R(); } }\nexport interface I", k, "<A> { a: A }\nexport type { T };\nexport * from './all';\n")
    nations = n.select(text("src/nation/", k, ".ts").alias("path"), code.alias("code"))
    rk = F.col("r_regionkey")
    regions = r.select(F.when(rk % 2 == 1, text("src/region/", rk, "/index.ts")).otherwise(text("src/region/", rk, ".ts")).alias("path"), text("export const name = '", F.col("r_name"), "';\nexport default function () {}\n").alias("code"))
    return nations.unionByName(regions)


@query("""
SELECT 'src/nation/' || n_nationkey || '.ts' AS path, name, kind, CAST(line AS BIGINT) AS line FROM nation, LATERAL (VALUES ('nation' || n_nationkey, 'variable', 3), ('other', 'variable', 3), ('N' || n_nationkey, 'class', 4), ('I' || n_nationkey, 'interface', 5), ('T', 'value', 6), ('*', 'value', 7)) AS v(name, kind, line)
UNION ALL SELECT CASE WHEN r_regionkey % 2 = 1 THEN 'src/region/' || r_regionkey || '/index.ts' ELSE 'src/region/' || r_regionkey || '.ts' END, name, kind, line FROM region, (VALUES ('name', 'variable', 1), ('default', 'function', 2)) AS v(name, kind, line)""")
def exports(spark: SparkSession, d: str) -> DataFrame:
    return A.unnest(A.analyze(nation_modules(spark, d), parts=["exports"]), "exports").select("path", "name", "kind", "line")


@query("""
SELECT 'src/nation/' || n_nationkey || '.ts' AS path, '../region/' || n_regionkey AS source, 'R,n' || n_nationkey AS names, false AS is_type_only FROM nation
UNION ALL SELECT 'src/nation/' || n_nationkey || '.ts', 'lib', 'T', true FROM nation""")
def imports(spark: SparkSession, d: str) -> DataFrame:
    found = A.unnest(A.analyze(nation_modules(spark, d), parts=["imports"]), "imports")
    return found.select("path", "source", F.array_join("specifiers", ",").alias("names"), "is_type_only")


@query("SELECT 'src/nation/' || n_nationkey || '.ts' AS path, '../region/' || n_regionkey AS source, CASE WHEN n_regionkey % 2 = 1 THEN 'src/region/' || n_regionkey || '/index.ts' ELSE 'src/region/' || n_regionkey || '.ts' END AS resolved_path FROM nation")
def resolve_dependencies(spark: SparkSession, d: str) -> DataFrame:
    files = G.latest_files(nation_modules(spark, d))
    found = G.resolve_dependencies(A.unnest(A.analyze(files, parts=["imports"]), "imports"), files)
    return found.select("path", "source", "resolved_path")


@query("""
SELECT 'src/nation/' || n_nationkey || '.ts' AS path, name, kind FROM nation, LATERAL (VALUES ('N' || n_nationkey, 'class'), ('N' || n_nationkey || '.go', 'method'), ('<anonymous@4>', 'function'), ('I' || n_nationkey, 'interface'), ('nation' || n_nationkey, 'variable'), ('other', 'variable'), ('T', 'value'), ('*', 're-export')) AS v(name, kind)
UNION ALL SELECT CASE WHEN r_regionkey % 2 = 1 THEN 'src/region/' || r_regionkey || '/index.ts' ELSE 'src/region/' || r_regionkey || '.ts' END, name, kind FROM region, (VALUES ('<anonymous@2>', 'function'), ('name', 'variable'), ('default', 'function')) AS v(name, kind)""")
def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    """All symbols with the exports that add to them. A method's function value is a symbol of its own."""
    return G.find_symbols(A.analyze(G.latest_files(nation_modules(spark, d)), parts=["symbols", "export_signatures"])).select("path", "name", "kind")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'var x = ' || o_orderkey || ';' || chr(10) || '/* Issues:' || chr(10) || ' * - Avoid using ''var''. Use ''const'' or ''let'' instead.' || chr(10) || ' */' ELSE 'let x = ' || o_orderkey || ';' END AS annotated FROM orders""")
def annotate_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = spread(t(spark, d, "orders").select("o_orderkey")).select("o_orderkey", F.concat(F.when(k % 3 == 0, "var").otherwise("let"), text(" x = ", k, ";")).alias("code"))
    return A.annotate_issues(files).select("o_orderkey", "annotated")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'error' ELSE 'ok' END AS status FROM customer")
def permissive_errors(spark: SparkSession, d: str) -> DataFrame:
    """A file that can't be parsed has an error of its own and stops nothing."""
    code = F.when(F.col("c_custkey") % 4 == 0, "let = (;").otherwise("f(1);")
    files = spread(t(spark, d, "customer").select("c_custkey")).select("c_custkey", F.col("c_custkey").cast("string").alias("path"), code.alias("code"))
    found = S.scan(files, "id: k\nlanguage: ts\nrule: {kind: CallExpression}", mode="permissive").join(files.select("c_custkey", "path"), "path")
    return found.select("c_custkey", F.when(F.col("error").isNotNull(), "error").otherwise("ok").alias("status"))


@query("""
SELECT page_id, CAST(0 AS BIGINT) AS relative_offset, CAST(strlen(regexp_extract(html, '(?is)^(.*?<script>)', 1)) AS BIGINT) AS absolute_offset, CAST(1 + length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line, CAST(strlen(regexp_extract(p, '[^\\n]*$')) AS BIGINT) AS col
FROM (SELECT *, regexp_extract(html, '(?is)^(.*?<script>.*?;)track', 1) AS p FROM pages)""".replace("\\\\n", "\\n"))
def sfc_pattern_search(spark: SparkSession, d: str) -> DataFrame:
    """A match in the page's script, with its place in the whole page."""
    pages = spread(t(spark, d, "pages").select("page_id", F.col("html").alias("code")))
    found = S.find_pattern_in_sfc(pages, "track($A);")
    rel = X.to_relative(F.col("script.start"), F.col("script.start"), F.col("script.end"))
    return found.select("page_id", rel.cast("long").alias("relative_offset"), X.to_absolute(rel, F.col("script.start"), F.col("script.end")).alias("absolute_offset"), "line", F.col("column").alias("col"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


from . import queries_more  # noqa: E402, F401 - adds its own queries
