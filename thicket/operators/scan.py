"""DataFrame operators over files: syntax-tree nodes, pattern search, rule scans and rewrites.

Parsing is the only Python step: an Arrow UDF on the code column, which returns an array for each file, so scans are one narrow stage. A scan with several
rules parses each file once a language; rules whose required word a file lacks aren't evaluated on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_ops import column_of, line_of
from ..plans.rules import Rule, RuleDocument, RuleError, compile_pattern, load_rule, parse_rule, required_word
from ..sources.containers import first_script
from .js_parser import JsSyntaxError
from .matching import Captured, Env, Match, PatternMatcher, RuleEvaluator
from .rewrite import apply_edits, edit, render
from .tree import TreeNode, shallow_tree

CAPTURED = "struct<kind:string,text:string,start:bigint,end:bigint>"
MATCH = f"struct<start:bigint,end:bigint,kind:string,text:string,single:map<string,{CAPTURED}>,multi:map<string,array<{CAPTURED}>>>"
NODE = "struct<node_id:int,parent_id:int,post:int,depth:int,ordinal:int,variant:string,kind:string,text:string,start:bigint,end:bigint,n_children:int>"

_CAPTURED = pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("single", pa.map_(pa.string(), _CAPTURED)), ("multi", pa.map_(pa.string(), pa.list_(_CAPTURED)))])
_NODE = pa.struct([(n, pa.int32() if t == "int" else pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split(":") for x in NODE[7:-1].split(","))])


class SourceError(ValueError):
    """A file that can't be parsed, in failfast mode."""


def _captures(env: Env) -> tuple[list, list]:
    as_row = lambda c: {"kind": c.kind, "text": c.text, "start": c.start, "end": c.end}
    single = [(k, as_row(v)) for k, v in sorted(env.items()) if isinstance(v, Captured)]
    return single, [(k, [as_row(c) for c in v]) for k, v in sorted(env.items()) if not isinstance(v, Captured)]


def _match_row(m: Match) -> dict:
    single, multi = _captures(m.env)
    start, end = m.span
    return {"start": start, "end": end, "kind": m.node.kind, "text": m.node.text, "single": single, "multi": multi}


def _node_rows(root: TreeNode) -> list[dict]:
    rows: list[dict] = []
    post = 0
    todo: list = [(root, None, 0, 0)]
    while todo:
        item = todo.pop()
        if type(item) is int:  # all below that row is done
            rows[item]["post"] = post
            post += 1
            continue
        node, parent, depth, ordinal = item
        k = len(rows)
        rows.append({"node_id": k, "parent_id": parent, "depth": depth, "ordinal": ordinal, "variant": node.variant, "kind": node.kind, "text": node.text, "start": node.start, "end": node.end, "n_children": len(node.children)})
        todo.append(k)
        todo += [(child, k, depth + 1, i) for i, child in reversed(list(enumerate(node.children)))]
    return rows


def _per_text(make: Callable[[str], object], item: pa.DataType, returned: str, failfast: bool, field: str):
    """An Arrow UDF code -> struct<field, error>; a syntax error is that row's error, or ends the job."""
    kind = pa.struct([(field, item), ("error", pa.string())])

    def run(codes: pa.Array) -> pa.Array:
        rows = []
        for code in codes.to_pylist():
            try:
                rows.append({field: None if code is None else make(code), "error": None})
            except (JsSyntaxError, RecursionError) as e:
                if failfast:
                    raise SourceError(f"Rule evaluation failed: {e}") from None
                rows.append({field: None, "error": str(e)})
        return pa.array(rows, kind)

    return F.arrow_udf(run, f"struct<{field}:{returned},error:string>")


def ast_nodes(df: DataFrame, language: str = "tsx", code: str = "code", mode: str = "permissive") -> DataFrame:
    """A row for each node, in preorder: df's columns but the code, and NODE's. a is an ancestor of d iff a.node_id < d.node_id and a.post > d.post."""
    nodes = _per_text(lambda text: _node_rows(shallow_tree(text, language)), pa.list_(_NODE), f"array<{NODE}>", mode == "failfast", "nodes")
    rest = [c for c in df.columns if c != code]
    return df.select(*rest, F.inline(nodes(F.col(code))["nodes"]))


def _matches(find: Callable[[TreeNode], list[Match]], language: str, failfast: bool, skip: Callable[[str], bool] = lambda text: False):
    return _per_text(lambda text: [] if skip(text) else list(map(_match_row, find(shallow_tree(text, language)))), pa.list_(_MATCH), f"array<{MATCH}>", failfast, "matches")


def flat_metavariables(single: Column, multi: Column) -> Column:
    """map name -> text; several captured nodes joined without separator; a single capture wins."""
    texts = F.transform_values(single, lambda k, v: v["text"])
    joined = F.transform_values(multi, lambda k, v: F.array_join(F.transform(v, lambda c: c["text"]), ""))
    return F.map_concat(F.map_filter(joined, lambda k, v: ~F.map_contains_key(texts, k)), texts)


def find_pattern(df: DataFrame, pattern: str, strictness: str = "ast", prefer: str = "outer", code: str = "code", mode: str = "permissive") -> DataFrame:
    """A row for each match that survives overlap resolution: df's columns, start, end, text, kind, single, multi, metavariables."""
    matcher = PatternMatcher(compile_pattern(pattern), strictness)
    found = _matches(lambda root: matcher.find_all(root, prefer), "tsx", mode == "failfast")
    rows = df.select("*", F.inline(found(F.col(code))["matches"]))
    return rows.withColumn("metavariables", flat_metavariables(F.col("single"), F.col("multi")))


def find_matches(df: DataFrame, matcher, prefer: str = "outer", language: str = "tsx", code: str = "code") -> DataFrame:
    """The same for any Matcher, user-defined ones included."""
    found = _matches(lambda root: matcher.find_all(root, prefer), language, False)
    return df.select("*", F.inline(found(F.col(code))["matches"]))


def find_pattern_in_sfc(df: DataFrame, pattern: str, code: str = "code") -> DataFrame:
    """Search in the first script block of each container. script is null without one. Spans relative to the block and absolute, line and column in the container."""
    matcher = PatternMatcher(compile_pattern(pattern))
    found = _matches(matcher.find_all, "tsx", False)
    rows = first_script(df, code).withColumn("__found", found(F.col("script.content")))
    rows = rows.select("*", F.inline_outer("__found.matches")).drop("__found")
    at = F.col("script.start")
    rows = rows.withColumnsRenamed({"start": "relative_start", "end": "relative_end"}).withColumns({"start": F.col("relative_start") + at, "end": F.col("relative_end") + at})
    return rows.withColumns({"metavariables": flat_metavariables(F.col("single"), F.col("multi")), "line": line_of(F.col(code), F.col("start")), "column": column_of(F.col(code), F.col("start"))})


def _documents(rules: str | RuleDocument | Iterable) -> list[RuleDocument]:
    if isinstance(rules, (str, RuleDocument)):
        rules = [rules]
    return [r if isinstance(r, RuleDocument) else load_rule(r) for r in rules]


def rule_matches(df: DataFrame, rules, code: str = "code", mode: str = "permissive") -> DataFrame:
    """A row for each file and rule: df's columns, rule_id, matches (array of MATCH in preorder, null if the file can't be parsed), error. One parse a language."""
    documents = _documents(rules)
    failfast = mode == "failfast"
    evaluators = [(d.id, d.language, RuleEvaluator(d.rule), required_word(d.rule)) for d in documents]
    kind = pa.list_(pa.struct([("rule_id", pa.string()), ("matches", pa.list_(_MATCH)), ("error", pa.string())]))

    def run(codes: pa.Array) -> pa.Array:
        rows = []
        for text in codes.to_pylist():
            trees: dict[str, object] = {}
            row = []
            for rule_id, language, evaluator, word in evaluators:
                if text is None:
                    row.append({"rule_id": rule_id, "matches": [], "error": None})
                    continue
                if language not in trees:
                    try:
                        trees[language] = shallow_tree(text, language)
                    except JsSyntaxError as e:
                        if failfast:
                            raise SourceError(f"Rule evaluation failed: {e}") from None
                        trees[language] = e
                tree = trees[language]
                if isinstance(tree, JsSyntaxError):
                    row.append({"rule_id": rule_id, "matches": None, "error": f"Rule evaluation failed: {tree}"})
                else:
                    row.append({"rule_id": rule_id, "matches": [] if word and word not in text else list(map(_match_row, evaluator.matches(tree))), "error": None})
            rows.append(row)
        return pa.array(rows, kind)

    udf = F.arrow_udf(run, f"array<struct<rule_id:string,matches:array<{MATCH}>,error:string>>")
    return df.select("*", F.inline(udf(F.col(code))))


def rewrites(df: DataFrame, rules, code: str = "code", mode: str = "permissive") -> DataFrame:
    """A row for each file and rule: df's columns, rule_id, updated, matches, modifications, error. Without a fix, or without matches, the code stays as it is."""
    documents = _documents(rules)
    found = rule_matches(df, documents, code, mode)
    edits = F.array().cast("array<struct<start:bigint,end:bigint,replacement:string,absorb:boolean>>")
    for d in documents:
        if d.fix is not None:
            text = lambda m, fix=d.fix: render(fix, F.transform_values(m["single"], lambda k, v: v["text"]), F.transform_values(m["multi"], lambda k, v: F.transform(v, lambda c: c["text"])))
            own = F.transform(F.col("matches"), _edit_maker(text))
            edits = F.when(F.col("rule_id") == d.id, own).otherwise(edits)
    found = found.withColumn("__edits", F.coalesce(edits, F.array().cast("array<struct<start:bigint,end:bigint,replacement:string,absorb:boolean>>")))
    found = found.withColumn("__done", apply_edits(F.col(code), F.col("__edits")))
    error = F.coalesce(F.col("error"), F.concat(F.lit("Failed to apply replacements: "), F.col("__done.error")))
    return found.withColumns(
        {
            "updated": F.when(error.isNull(), F.col("__done.updated")),
            "modifications": F.when(error.isNull(), F.size("__edits").cast("long")),
            "error": error,
            "matches": F.size("matches").cast("long"),
        }
    ).drop("__edits", "__done")


def _edit_maker(text: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: edit(m["start"], m["end"], text(m))


def apply_rule(df: DataFrame, rule: str, code: str = "code", mode: str = "permissive") -> DataFrame:
    """rewrites() with one rule, which must have a fix."""
    document = parse_rule(rule)
    if document.fix is None:
        raise RuleError("Rule has no fix")
    return rewrites(df, document, code, mode)


def scan(df: DataFrame, rules, dry_run: bool = True, mode: str = "failfast") -> DataFrame:
    """path, rule_id, matches, modifications (null in dry runs), error for each file and rule, files without matches included."""
    documents = _documents(rules)
    if dry_run:
        found = rule_matches(df, documents, mode=mode)
        return found.select("path", "rule_id", F.size("matches").cast("long").alias("matches"), F.lit(None).cast("long").alias("modifications"), "error")
    return rewrites(df, documents, mode=mode).select("path", "rule_id", "matches", "modifications", "error")


# -- rules over node tables -------------------------------------------------------------------------------------


def node_predicate(rule: Rule) -> Column:
    """A rule of kind, regex, all, any and not as a Column over a node table; nothing leaves the JVM."""
    if rule.op == "kind":
        return F.col("kind") == rule.value
    if rule.op == "regex":
        return F.col("text").rlike("(?U)" + rule.value)
    if rule.op == "not":
        return ~node_predicate(rule.rules[0])
    if rule.op in ("all", "any"):
        out = F.lit(rule.op == "all")
        for r in rule.rules:
            out = out & node_predicate(r) if rule.op == "all" else out | node_predicate(r)
        return out
    raise RuleError(f"`{rule.op}` is no plain predicate")


def related(nodes: DataFrame, predicate: Column, relation: str, key: str = "path", negate: bool = False) -> DataFrame:
    """The nodes with (or without) a proper ancestor (inside) or descendant (has) that satisfies the predicate: an interval semi-join within a file."""
    other = nodes.where(predicate).select(F.col(key).alias("__key"), F.col("node_id").alias("__id"), F.col("post").alias("__post"))
    above = (F.col("__id") < F.col("node_id")) & (F.col("__post") > F.col("post")) if relation == "inside" else (F.col("__id") > F.col("node_id")) & (F.col("__post") < F.col("post"))
    return nodes.join(other, nodes[key].eqNullSafe(F.col("__key")) & above, "left_anti" if negate else "left_semi")


def nearest_ancestor(nodes: DataFrame, predicate: Column, key: str = "path") -> DataFrame:
    """nodes with anc_id, anc_text: the nearest proper ancestor that satisfies the predicate; nodes without one are dropped."""
    other = nodes.where(predicate).select(F.col(key).alias("__key"), F.col("node_id").alias("__id"), F.col("post").alias("__post"), F.col("text").alias("__text"))
    joined = nodes.join(other, nodes[key].eqNullSafe(F.col("__key")) & (F.col("__id") < F.col("node_id")) & (F.col("__post") > F.col("post")))
    best = joined.groupBy(key, "node_id").agg(F.max_by(F.struct("__id", "__text"), "__id").alias("anc"), *(F.first(c).alias(c) for c in nodes.columns if c not in (key, "node_id")))
    return best.select(*nodes.columns, F.col("anc.__id").alias("anc_id"), F.col("anc.__text").alias("anc_text"))
