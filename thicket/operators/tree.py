"""The shallow typed tree that rules and patterns see.

Function bodies, compound statements and all expressions but calls have no children; a statement and what it wraps are two nodes with one span.
"""

from __future__ import annotations

from functools import cached_property

from . import js_parser
from .js_parser import Source

_STATEMENTS = {
    "Import": "ImportDeclaration",
    "VariableDeclaration": "VariableDeclaration",
    "FunctionDeclaration": "FunctionDeclaration",
    "ClassDeclaration": "ClassDeclaration",
    "ExpressionStatement": "ExpressionStatement",
    "ExportNamed": "ExportNamedDeclaration",
    "ExportDefault": "ExportDefaultDeclaration",
    "ExportAll": "ExportAllDeclaration",
    "Interface": "TSInterfaceDeclaration",
    "TypeAlias": "TSTypeAliasDeclaration",
}
_DECLARATIONS = frozenset(("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration", "Interface", "TypeAlias"))


class TreeNode:
    """kind, variant, character span, children; identifier: the name, for identifier expressions."""

    def __init__(self, source: Source, variant: str, kind: str, node: js_parser.Node, children: list[TreeNode], identifier: str | None = None):
        self.source, self.variant, self.kind = source, variant, kind
        self.at, self.to, self.children, self.identifier = node.start, node.end, children, identifier

    @cached_property
    def text(self) -> str:
        return self.source.text[self.at : self.to]

    @property
    def start(self) -> int:
        return self.source.byte(self.at)

    @property
    def end(self) -> int:
        return self.source.byte(self.to)

    def walk(self):
        """(node, ancestors from the root) in preorder."""
        todo: list[tuple[TreeNode, tuple[TreeNode, ...]]] = [(self, ())]
        while todo:
            node, above = todo.pop()
            yield node, above
            if node.children:
                below = (*above, node)
                todo += [(child, below) for child in reversed(node.children)]


def _inner(source: Source, node: js_parser.Node) -> list[TreeNode]:
    """The typed node within a statement or declaration."""
    make = lambda kind, n, children: TreeNode(source, kind, kind, n, children)
    if node.type == "Import":
        return [make("ImportDeclaration", node, [])]
    if node.type == "VariableDeclaration":
        return [make("VariableDeclaration", node, [_expression(source, d.init) for d in node.items if d.init])]
    if node.type == "FunctionDeclaration":
        return [make("Function", node.function, [])]
    if node.type == "ClassDeclaration":
        return [_class(source, node.klass)]
    if node.type == "Interface":
        return [make("TSInterfaceDeclaration", node, [])]
    if node.type == "TypeAlias":
        return [make("TSTypeAliasDeclaration", node, [])]
    return []


def _class(source: Source, node: js_parser.Node) -> TreeNode:
    methods = [TreeNode(source, "MethodDefinition", "MethodDefinition", m, [TreeNode(source, "Function", "Function", m.function, [])]) for m in node.body if m.type == "Method"]
    return TreeNode(source, "Class", "Class", node, methods)


def _statement(source: Source, node: js_parser.Node) -> TreeNode:
    children = _inner(source, node)
    if node.type == "ExpressionStatement":
        children = [_expression(source, node.expression)]
    elif node.type == "ExportNamed" and node.declaration:
        d = node.declaration
        kind = _STATEMENTS[d.type] if d.type in _DECLARATIONS else "Declaration"
        children = [TreeNode(source, "Declaration", kind, d, _inner(source, d))]
    elif node.type == "ExportDefault":
        d = node.declaration
        children = [TreeNode(source, "Function", "Function", d, [])] if d.type == "Function" else [_class(source, d)] if d.type == "Class" else _inner(source, d) if d.type == "Interface" else []
    return TreeNode(source, "Statement", _STATEMENTS.get(node.type, "Statement"), node, children)


def _expression(source: Source, node: js_parser.Node) -> TreeNode:
    """Calls are wrapped in an expression node and have their callee and arguments as children; nothing else has any."""
    top: list[TreeNode] = []
    todo = [(node, top)]  # what is still to be made, and whose children it joins
    while todo:
        node, siblings = todo.pop()
        if node.type == "Call":
            call = TreeNode(source, "CallExpression", "CallExpression", node, [])
            siblings.append(TreeNode(source, "Expression", "CallExpression", node, [call]))
            todo += [(x, call.children) for x in reversed((node.callee, *node.args)) if x.type != "Spread"]
        elif node.type == "Identifier":
            siblings.append(TreeNode(source, "Expression", "Identifier", node, [], node.name))
        else:
            siblings.append(TreeNode(source, "Expression", "MemberExpression" if node.type == "Member" else "Expression", node, []))
    return top[0]


def shallow_tree(text: str, language: str = "tsx") -> TreeNode:
    """Parses a text. Raises JsSyntaxError. Directives at the top aren't statements."""
    program, _ = js_parser.parse(text, language)
    source, body = Source(text), program.body
    while body and body[0].type == "ExpressionStatement" and body[0].expression.type == "String":
        body = body[1:]
    return TreeNode(source, "Program", "Program", program, [_statement(source, s) for s in body])
