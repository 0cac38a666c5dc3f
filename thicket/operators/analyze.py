"""Per-file analysis: symbols, imports, exports, issues, call edges, comments, as one nested struct a file.

Unlike rules, analysis looks into function bodies and all expressions. Files with syntax errors have a parse issue and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .js_parser import JsSyntaxError, Node, Source, parse
from .scopes import redeclarations

_LOCATION = "line:bigint,column:bigint"
SYMBOL = f"struct<name:string,kind:string,params:array<string>,return_type:string,type_params:array<string>,exported:boolean,{_LOCATION}>"
EXPORT = f"struct<name:string,kind:string,{_LOCATION}>"
ISSUE = f"struct<category:string,severity:string,message:string,{_LOCATION}>"
IMPORT = f"struct<source:string,kind:string,specifiers:array<string>,is_type_only:boolean,{_LOCATION}>"
EDGE = f"struct<caller:string,callee:string,{_LOCATION}>"
#: The lists of an analysis by name.
PARTS = {
    "exports": EXPORT,
    "issues": ISSUE,
    "imports": IMPORT,
    "export_signatures": SYMBOL,
    "symbols": SYMBOL,
    "classes": SYMBOL,
    "interfaces": SYMBOL,
    "type_aliases": SYMBOL,
    "comments": "string",
    "jsdoc": "string",
    "call_edges": EDGE,
}


def analysis_type(parts: Iterable[str] = PARTS) -> str:
    return "struct<language:string," + ",".join(f"{p}:array<{PARTS[p]}>" for p in parts) + ">"


ANALYSIS = analysis_type()
# Fixed wording of the lint rules.
VAR_MESSAGE = "Avoid using 'var'. Use 'const' or 'let' instead."
CONSOLE_MESSAGE = "Console statement detected. Remove in production code."


def _arrow(ddl: str) -> pa.DataType:
    """The Arrow type of a DDL string of structs, arrays and the scalars used here."""
    at = 0

    def read() -> pa.DataType:
        nonlocal at
        for name, kind in (("string", pa.string()), ("bigint", pa.int64()), ("boolean", pa.bool_())):
            if ddl.startswith(name, at):
                at += len(name)
                return kind
        if ddl.startswith("array<", at):
            at += 6
            inner = read()
            at += 1
            return pa.list_(inner)
        at += len("struct<")
        fields = []
        while ddl[at] != ">":
            at += ddl[at] == ","
            colon = ddl.index(":", at)
            name, at = ddl[at:colon], colon + 1
            fields.append((name, read()))
        at += 1
        return pa.struct(fields)

    return read()


def callee_name(node: Node) -> str | None:
    """a, a.b.c; <computed> for computed names, <expr> for objects without a name; None for other callees."""
    names = []
    while node.type == "Member":
        names.append(node.parts["name"] or "<computed>")
        node = node.object
    if node.type != "Identifier" and not names:
        return None
    return ".".join([node.name if node.type == "Identifier" else "<expr>", *reversed(names)])


class _Walk:
    """One pass over a program in source order, keeping the names of the functions and classes around."""

    def __init__(self, text: str, parts: Iterable[str] = PARTS):
        self.text, self.source = text, Source(text)
        wanted = set(parts)
        self.wants_symbols = bool(wanted & {"symbols", "classes", "interfaces", "type_aliases"})
        self.wants_issues, self.wants_edges = "issues" in wanted, "call_edges" in wanted
        self.symbols, self.classes, self.interfaces, self.aliases, self.edges, self.lints = [], [], [], [], [], []
        self.scopes, self.owners = ["<module>"], []

    def where(self, node: Node) -> dict:
        line, column = self.source.location(node.start)
        return {"line": line, "column": column}

    def span(self, node: Node | None) -> str | None:
        return self.text[node.start : node.end].strip() if node else None

    def symbol(self, node: Node, name: str, kind: str, params=(), returns=None, type_params=(), exported=False) -> dict:
        return {"name": name, "kind": kind, "params": list(params), "return_type": returns, "type_params": list(type_params), "exported": exported, **self.where(node)}

    def visit(self, program: Node) -> None:
        """Handlers say what is to be done when all that is inside a node has been visited. The stack is a list: a chain of any length is fine."""
        todo: list = [program]
        while todo:
            item = todo.pop()
            if type(item) is not Node:
                item.pop()  # the scope or class that ends here
                continue
            handler = getattr(self, f"on_{item.type}", None)
            entered = handler(item) if handler else None
            if entered is not None:
                todo.append(entered)
            if item.type not in ("Interface", "TypeAlias"):
                todo += reversed(list(item.nodes()))

    def scoped(self, name: str) -> list[str]:
        self.scopes.append(name)
        return self.scopes

    @staticmethod
    def names(function: Node) -> list[str]:
        return [p.target.name for p in function.params if p.target.type == "Binding" and not p.rest]

    def on_VariableDeclaration(self, node: Node) -> None:
        if node.kind == "var" and self.wants_issues:
            self.lints.append({"category": "best-practices", "severity": "warning", "message": VAR_MESSAGE, **self.where(node)})

    def on_Function(self, node: Node) -> list[str]:
        name = node.name or f"<anonymous@{self.where(node)['line']}>"
        if self.wants_symbols:
            self.symbols.append(self.symbol(node, name, "function", self.names(node), self.span(node.returns), node.type_params))
        return self.scoped(name)

    def on_Class(self, node: Node) -> list[str]:
        name = node.name or "<anonymous-class>"
        if self.wants_symbols:
            found = self.symbol(node, name, "class")
            self.classes.append(found)
            self.symbols.append(found)
        self.owners.append(name)
        return self.owners

    def on_Method(self, node: Node) -> list[str]:
        own = node.key.name if node.key.type == "Name" else "<computed>"
        name = f"{self.owners[-1] if self.owners else '<class>'}.{own}"
        if self.wants_symbols:
            self.symbols.append(self.symbol(node, name, "method", self.names(node.function), self.span(node.function.returns)))
        return self.scoped(name)

    def on_Interface(self, node: Node) -> None:
        found = self.symbol(node, node.name, "interface", type_params=node.type_params)
        self.interfaces.append(found)
        self.symbols.append(found)

    def on_TypeAlias(self, node: Node) -> None:
        found = self.symbol(node, node.name, "type", returns=self.span(node.annotation), type_params=node.type_params)
        self.aliases.append(found)
        self.symbols.append(found)

    def on_Call(self, node: Node) -> None:
        callee = callee_name(node.callee) if self.wants_edges else None
        if callee is not None:
            self.edges.append({"caller": self.scopes[-1], "callee": callee, **self.where(node)})
        target = node.callee
        if target.type == "Member" and target.object.type == "Identifier" and target.object.name == "console" and self.wants_issues:
            self.lints.append({"category": "dev-code", "severity": "warning", "message": CONSOLE_MESSAGE, **self.where(node)})

    # -- modules ------------------------------------------------------------------------

    def exports_of(self, node: Node) -> list[tuple[str, str, str]]:
        """(name, kind, kind of the signature) of an export statement."""
        if node.type == "ExportDefault":
            d = node.declaration
            kind = {"Function": "function", "Class": "class", "Interface": "interface"}.get(d.type, "value")
            name = (d.name if kind != "value" else None) or "default"
            return [(name, kind, kind)]
        if node.type == "ExportAll":
            return [(node.alias or "*", "type" if node.type_only else "value", "re-export")]
        if node.type != "ExportNamed":
            return []
        d, found = node.declaration, []
        if d is not None:
            if d.type == "FunctionDeclaration" and d.function.name:
                found = [(d.function.name, "function")]
            elif d.type == "ClassDeclaration" and d.klass.name:
                found = [(d.klass.name, "class")]
            elif d.type == "VariableDeclaration":
                found = [(x.target.name, "variable") for x in d.items if x.target.type == "Binding"]
            elif d.type in ("Interface", "TypeAlias"):
                found = [(d.name, "interface" if d.type == "Interface" else "type")]
        found += [(name, "type" if own_type else "value") for name, own_type in node.names]
        return [(name, kind, kind) for name, kind in found]


def analyze_text(text: str, parts: Iterable[str] = PARTS) -> dict:
    """ANALYSIS of one file, as plain values; of the lists only the given ones. Whatever is wrong with a file is an issue of that file."""
    wanted = set(parts)
    try:
        program, comments = parse(text, "tsx")
        walk = _Walk(text, wanted)
        walk.visit(program)
        semantic = redeclarations(program) if "issues" in wanted else []
    except (JsSyntaxError, RecursionError) as e:
        found = {p: [] for p in wanted}
        if "issues" in wanted:
            found["issues"] = [{"category": "parse", "severity": "error", "message": str(e), "line": None, "column": None}]
        return {"language": "tsx", **found}
    issues = [{"category": "semantic", "severity": "error", "message": f"Identifier `{n}` has already been declared", "line": None, "column": None} for n in semantic]
    exports, signatures = [], []
    for s in program.body if wanted & {"exports", "export_signatures"} else ():
        for name, kind, signature in walk.exports_of(s):
            exports.append({"name": name, "kind": kind, **walk.where(s)})
            signatures.append(walk.symbol(s, name, signature, exported=True))
    imports = [{"source": s.source, "kind": "import", "specifiers": list(s.names), "is_type_only": s.type_only, **walk.where(s)} for s in program.body if s.type == "Import"] if "imports" in wanted else []
    found = {
        "exports": exports,
        "issues": issues + walk.lints,
        "imports": imports,
        "export_signatures": signatures,
        "symbols": walk.symbols,
        "classes": walk.classes,
        "interfaces": walk.interfaces,
        "type_aliases": walk.aliases,
        "comments": [text[a:b] for a, b in comments],
        "jsdoc": [],
        "call_edges": walk.edges,
    }
    return {"language": "tsx", **{p: found[p] for p in wanted}}


def analysis_of(code: Column, parts: Iterable[str] = PARTS) -> Column:
    """ANALYSIS of a code column, by one Arrow UDF. What isn't asked for isn't collected in Python nor sent to the JVM."""
    parts = [p for p in PARTS if p in set(parts)]
    kind = analysis_type(parts)

    def run(codes: pa.Array) -> pa.Array:
        return pa.array([None if c is None else analyze_text(c, parts) for c in codes.to_pylist()], _arrow(kind))

    # It is deterministic, but said not to be: else filters that Spark infers from an explode run it a second time, below shuffles.
    return F.arrow_udf(run, kind).asNondeterministic()(code)


def analyze(df: DataFrame, code: str = "code", parts: Iterable[str] = PARTS) -> DataFrame:
    """df with analysis, one row a file; parts: the lists that are wanted."""
    return df.withColumn("analysis", analysis_of(F.col(code), parts))


def unnest(analyzed: DataFrame, part: str, key: str = "path") -> DataFrame:
    """A row for each entry of an analysis list: key, seq, and the entry's fields (comments: text)."""
    rows = analyzed.select(key, F.posexplode(F.col("analysis")[part]).alias("seq", "__e"))
    return rows.select(key, "seq", F.col("__e").alias("text")) if part in ("comments", "jsdoc") else rows.select(key, "seq", "__e.*")


def analyze_json(text: str) -> str:
    """One file's analysis as JSON, locations as [line, column]."""

    def outward(x):
        if isinstance(x, dict):
            out = {k: outward(v) for k, v in x.items() if k not in ("line", "column")}
            if "line" in x:
                out["location"] = None if x["line"] is None else [x["line"], x["column"]]
            return out
        return [outward(v) for v in x] if isinstance(x, list) else x

    a = outward(analyze_text(text))
    structure = {k: a[k] for k in ("language", "imports", "symbols", "classes", "interfaces", "type_aliases", "comments", "jsdoc")}
    structure |= {"exports": a["export_signatures"], "call_graph": {"edges": a["call_edges"]}}
    return json.dumps({"exports": a["exports"], "issues": a["issues"], "file_structure": structure}, ensure_ascii=False)


def annotate_issues(df: DataFrame, code: str = "code", title: str = "Issues", inject: bool = True, log: bool = False, name: str = "path") -> DataFrame:
    """df with annotated: the code, with its issues as a comment at its end if `inject`. log adds the lines that a build would print about the file
    (array of strings, empty without issues); files that aren't scripts by their name have none, and keep their code."""
    from ..functions.text_ops import annotate, should_analyze

    rows = analyze(df, code, ["issues"])
    issues = F.when(should_analyze(F.col(name)), F.col("analysis.issues")).otherwise(F.array().cast(f"array<{ISSUE}>")) if name in df.columns else F.col("analysis.issues")
    rows = rows.withColumn("annotated", annotate(F.col(code), issues, title) if inject else F.col(code))
    if not log:
        return rows
    where = F.concat(F.lit(" in "), F.col(name)) if name in df.columns else F.lit("")
    head = F.concat(F.lit("Found "), F.size(issues).cast("string"), F.lit(" issues"), where)
    lines = F.concat(F.array(head), F.transform(issues, lambda i: F.concat(F.lit("  - "), i["message"])))
    return rows.withColumn("log", F.when(F.size(issues) > 0, lines).otherwise(F.array().cast("array<string>")))
