import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.operators.js_parser import JsSyntaxError, Source, parse
from thicket.operators.tree import shallow_tree


def kinds(node):
    out = [node.kind]
    while node.children:
        node = node.children[0]
        out.append(node.kind)
    return out


@pytest.mark.parametrize(
    "code, chain",
    [
        ("const value = foo(1, bar);", ["Program", "VariableDeclaration", "VariableDeclaration", "CallExpression", "CallExpression", "Identifier"]),
        ("export function greet(name) { return name; }", ["Program", "ExportNamedDeclaration", "FunctionDeclaration", "Function"]),
        ("class A { m() { return 1; } }", ["Program", "ClassDeclaration", "Class", "MethodDefinition", "Function"]),
        ("export default class { }", ["Program", "ExportDefaultDeclaration", "Class"]),
        ("interface I { a: 1 }", ["Program", "TSInterfaceDeclaration", "TSInterfaceDeclaration"]),
        ("if (a) { f(); }", ["Program", "Statement"]),
        ("a?.b();", ["Program", "ExpressionStatement", "Expression"]),
        ("(f)(1);", ["Program", "ExpressionStatement", "CallExpression", "CallExpression", "Expression"]),
        ("import x from 'y';", ["Program", "ImportDeclaration", "ImportDeclaration"]),
    ],
)
def test_kind_chains(code, chain):
    assert kinds(shallow_tree(code)) == chain


def test_root_span_and_spread_arguments():
    root = shallow_tree("f(...a, b);")
    assert (root.start, root.end) == (0, 11)
    call = root.children[0].children[0].children[0]
    assert [c.text for c in call.children] == ["f", "b"]


def test_spans_are_bytes():
    root = shallow_tree('let é = "é"; g(1);')
    assert [(s.start, s.end) for s in root.children] == [(0, 14), (15, 20)]


@pytest.mark.parametrize("code", ["const = 1;", "foo(", "{", '"abc', "`x", "function (", "a b", "let x = ;", "/* x", "if (a", "class { m( }", "<a></b>", "x = /abc"])
def test_rejects(code):
    with pytest.raises(JsSyntaxError):
        parse(code)


@pytest.mark.parametrize(
    "code",
    [
        "const re = /a[/]b/g.test(s) ? x / y / z : <div a={b} {...c}>it's {fn(x)} <b/></div>;",
        "for (const x of y) z(x); for (k in o) {} label: for (;;) { continue label }",
        "const gen = <T,>(x: T) => x; let t = a ? (b, c) => d : e; foo<T>(x); a < b > c;",
        "type F = new (...a: any[]) => void; type C<T> = T extends { a: infer U } ? U : never;",
        "declare module 'x' { export const y: number } abstract class Q { abstract m(): void; }",
        "@dec class D { @p() prop = 1; static { f() } #x = 1; get y() { return this.#x } }",
        "export { a as default, type T }; export * as z from 'q'; import type { U } from 'u';",
        "const x = `a${b + `c${d}`}e`;\nasync function* g() { for await (const v of w) yield* v }",
    ],
)
def test_accepts(code):
    assert parse(code)[0].body


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=30))
def test_locations_match_their_definition(text):
    source = Source(text)
    for at in range(len(text) + 1):
        before = text[:at]
        assert source.location(at) == (1 + before.count("\n"), len(before.rsplit("\n", 1)[-1].encode()))
