"""Names declared twice where the language has room for one declaration.

let, const, classes and imports are lexical: one for each name and block. A var belongs to its function and clashes with a lexical name of any block between.
Functions may be declared again (overloads), parameters and catch bindings may be covered by a var, but by nothing lexical in the same block.
"""

from __future__ import annotations

from collections.abc import Iterator

from .js_parser import Node


class _Scope:
    """names: what declares each. above: the block around, None for a function's own block."""

    __slots__ = ("above", "names")

    def __init__(self, above: _Scope | None = None):
        self.names: dict[str, str] = {}
        self.above = above

    def clashes(self, name: str, kind: str) -> bool:
        """Declares the name; whether it was taken."""
        old = self.names.get(name)
        if kind == "var":
            scope, clash = self, False
            while scope is not None:
                here = scope.names.setdefault(name, "var")
                clash = clash or here == "lexical" or here == "function" and scope.above is not None
                scope = scope.above
            return clash
        self.names[name] = "lexical" if "lexical" in (kind, old) else kind
        if kind == "lexical":
            return old is not None
        return kind == "function" and (old == "lexical" or old == "var" and self.above is not None)


def bound_names(target: Node) -> list[str]:
    """The names that a binding or a pattern declares, in order."""
    found, todo = [], [target]
    while todo:
        node = todo.pop()
        if node.type == "Binding":
            found.append(node.name)
        elif node.type == "Pattern":
            todo += [x for x in reversed(node.items) if x.type in ("Binding", "Pattern")]
    return found


def _declared(node: Node) -> Iterator[tuple[str, str]]:
    if node.type == "VariableDeclaration":
        kind = "var" if node.kind == "var" else "lexical"
        for item in node.items:
            for name in bound_names(item.target):
                yield name, kind
    elif node.type == "ClassDeclaration" and node.klass.name:
        yield node.klass.name, "lexical"
    elif node.type == "FunctionDeclaration" and node.function.name:
        yield node.function.name, "function"
    elif node.type == "Import" and not node.type_only:
        for name in node.names:
            yield name.removeprefix("* as "), "lexical"


def redeclarations(program: Node) -> list[str]:
    """Names declared again, in source order of the later declarations."""
    found: list[str] = []
    todo: list[tuple[Node, _Scope]] = [(program, _Scope())]
    while todo:
        node, scope = todo.pop()
        found += [name for name, kind in _declared(node) if scope.clashes(name, kind)]
        inside = [(child, scope) for child in node.nodes()]
        if node.type in ("Function", "Arrow"):
            own = _Scope()
            for p in node.params:
                own.names |= dict.fromkeys(bound_names(p.target), "parameter")
            body = node.body
            inside = [(p, own) for p in node.params]
            if body is not None:
                inside += [(s, own) for s in body.body] if body.type == "Block" else [(body, own)]
        elif node.type in ("Block", "Switch", "For"):
            block = _Scope(scope)
            inside = [(child, block) for child in node.nodes()]
        elif node.type in ("Namespace", "StaticBlock") and node.body is not None:
            own = _Scope()
            inside = [(s, own) for s in node.body.body]
        elif node.type == "Try":
            inside = []
            for k, part in enumerate(node.items):
                before = node.items[k - 1] if k else None
                if before is not None and before.type != "Block":
                    block = _Scope(scope)
                    block.names = dict.fromkeys(bound_names(before), "caught")
                    inside += [(s, block) for s in part.body]
                else:
                    inside.append((part, scope))
        todo += reversed(inside)
    return found
