"""The public surface: functions over DataFrames, SQL functions, and named tools with checked arguments."""

from __future__ import annotations

import json
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.analyze import analyze, analyze_json, annotate_issues
from .operators.graph import ProjectGraph, initialize_graph
from .operators.matching import PatternMatcher
from .operators.scan import _match_row, _node_rows, apply_rule, ast_nodes, find_matches, find_pattern, find_pattern_in_sfc, rewrites, scan
from .operators.tree import shallow_tree
from .plans.rules import RuleError, compile_pattern, load_rule, parse_rule
from .sources.files import in_memory, read_files, summary_json, write_in_place
from .storage import stash

__all__ = ["ProjectGraph", "RuleError", "analyze", "analyze_json", "annotate_issues", "apply_rule", "ast_nodes", "find_matches", "find_pattern", "find_pattern_in_sfc", "initialize_graph", "load_rule", "parse_rule", "read_files", "register", "rewrites", "scan", "scan_directory", "ship", "tools", "write_in_place"]


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors, for clusters on which it isn't installed: a zip in the driver's temporary folder, handed to them by Spark."""
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    return str(target)


def scan_directory(spark: SparkSession, root: str, rule: str, dry_run: bool = True, extensions: str | None = None) -> DataFrame:
    """Scans files below root; unless dry, a fix is needed and changed files are written back."""
    document = load_rule(rule)
    files = read_files(spark, root, extensions)
    if dry_run:
        return scan(files, document)
    if document.fix is None:
        raise RuleError("Rule has no fix")
    done = stash(rewrites(files, document, mode="failfast"))  # whole and safe before any file is changed: what is lost later isn't read from changed files
    write_in_place(done.where(F.col("error").isNull()))
    return done.select("path", "rule_id", "matches", "modifications", "error")


def register(spark: SparkSession) -> None:
    """SQL functions: analyze_json(code); table functions ast_nodes(code, language) and pattern_matches(code, pattern), for LATERAL."""

    def analyze_column(codes: pa.Array) -> pa.Array:
        return pa.array([None if c is None else analyze_json(c) for c in codes.to_pylist()], pa.string())

    spark.udf.register("analyze_json", F.arrow_udf(analyze_column, T.StringType()))

    class AstNodes:
        def eval(self, code: str, language: str):
            for r in _node_rows(shallow_tree(code, language)):
                yield r["node_id"], r["parent_id"], r["post"], r["depth"], r["kind"], r["text"], r["start"], r["end"]

    class PatternMatches:
        def eval(self, code: str, pattern: str):
            for m in PatternMatcher(compile_pattern(pattern)).find_all(shallow_tree(code)):
                r = _match_row(m)
                yield r["start"], r["end"], r["text"], {k: v["text"] for k, v in r["single"]}

    spark.udtf.register("ast_nodes", F.udtf(AstNodes, returnType="node_id int, parent_id int, post int, depth int, kind string, text string, start bigint, end bigint"))
    spark.udtf.register("pattern_matches", F.udtf(PatternMatches, returnType="start bigint, end bigint, text string, single map<string,string>"))


def tools(spark: SparkSession, graph: ProjectGraph | None = None) -> dict[str, Callable[..., str]]:
    """Agent tools by name; each takes keyword arguments, checks them and returns JSON."""
    graph = graph or initialize_graph(spark)
    rows = lambda df: json.dumps([json.loads(x) for x in df.toJSON().toLocalIterator()], ensure_ascii=False)

    def checked(call: Callable[..., str], **kinds: type):
        def run(**arguments) -> str:
            unknown = arguments.keys() - kinds.keys()
            if unknown:
                raise TypeError(f"unknown argument {min(unknown)}")
            for name, kind in kinds.items():
                if name.rstrip("_") == name and name not in arguments and name not in optional:
                    raise TypeError(f"missing argument {name}")
                if name in arguments and not isinstance(arguments[name], kind):
                    raise TypeError(f"{name} must be {kind.__name__}")
            return call(**arguments)

        optional = {"dry_run"}
        run.arguments = kinds
        return run

    one = lambda source: in_memory(spark, {"<source>": source})
    return {
        "analyze_ast": checked(lambda source: analyze_json(source), source=str),
        "get_file_structure": checked(lambda path: rows(graph.get_file_structure(path)), path=str),
        "get_symbol_details": checked(lambda symbol: rows(graph.get_symbol_details(symbol)), symbol=str),
        "analyze_dependencies": checked(lambda paths: rows(graph.analyze_dependencies(paths)), paths=list),
        "find_pattern": checked(lambda source, pattern: rows(find_pattern(one(source), pattern, mode="failfast").select("start", "end", "text", "metavariables")), source=str, pattern=str),
        "apply_rule": checked(lambda source, rule: rows(apply_rule(one(source), rule, mode="failfast").select("updated", "matches", "modifications", "error")), source=str, rule=str),
        "scan_directory": checked(lambda root, rule, dry_run=True: summary_json(scan_directory(spark, root, rule, dry_run)), root=str, rule=str, dry_run=bool),
    }
