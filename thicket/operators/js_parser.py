"""A JavaScript and TypeScript parser for structural search: statements, declarations and expressions with exact spans.

The tree keeps what search and analysis look at; types are read but kept only as spans. Offsets are characters; Source maps them to UTF-8 bytes.
It accepts somewhat more than the languages allow, but reports unbalanced, unterminated and misplaced syntax as JsSyntaxError.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from itertools import accumulate


class JsSyntaxError(ValueError):
    """What the file's first syntax error is; `at` is a character offset."""

    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


class Node:
    """A syntax node: type, span, and named parts that are nodes, lists of nodes or plain values."""

    __slots__ = ("type", "start", "end", "parts")

    def __init__(self, type_: str, start: int, end: int, **parts):
        self.type, self.start, self.end, self.parts = type_, start, end, parts

    def __getattr__(self, name: str):
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def __repr__(self) -> str:
        return f"{self.type}[{self.start},{self.end})"

    def nodes(self):
        """Child nodes in the order they were given."""
        for part in self.parts.values():
            if type(part) is Node:
                yield part
            elif type(part) is list:
                for x in part:
                    if type(x) is Node:
                        yield x


_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.S)
_COMMENT = re.compile(r"//[^\n\r\u2028\u2029]*|/\*.*?\*/", re.S)
_TOKEN = re.compile(
    r"""(?P<name>(?:[A-Za-z_$]|[^\W\d]|\\u\{?[0-9A-Fa-f]+\}?)(?:[\w$\u200c\u200d]|\\u\{?[0-9A-Fa-f]+\}?)*)
    |(?P<num>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')
    |(?P<tmpl>`)
    |(?P<priv>\#[\w$]+)
    |(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JSX_NAME = re.compile(r"[\w$.:-]+")

RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
# Operators by how tightly they bind.
BINARY = {op: n for n, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in as satisfies", "<< >> >>>", "+ -", "* / %", "**"), 1) for op in ops.split()}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset("! ~ + - ++ -- typeof void delete await".split())
MEMBER_MODIFIERS = frozenset("static public private protected readonly abstract override declare async get set accessor".split())


#: Statements and expressions within each other; the interpreter's limit leaves room for a parser's frames at each.
MAX_DEPTH = 1000
FRAMES = 40 * MAX_DEPTH


class Parser:
    """Recursive descent over one text. jsx and ts switch the grammar."""

    def __init__(self, text: str, ts: bool = True, jsx: bool = True):
        self.text, self.ts, self.jsx = text, ts, jsx
        self.comments: dict[int, int] = {}
        self.pos = self.end_of_last = 0
        self.depth = 0
        self.no_in = False
        self.unannotated: set[int] = set()  # where a parenthesis can't begin an arrow function with a return type
        if text.startswith("#!"):
            self.pos = len(text.split("\n", 1)[0])
        self.advance()

    # -- tokens ---------------------------------------------------------------

    def fail(self, message: str = "Unexpected token", at: int | None = None):
        raise JsSyntaxError(message, self.start if at is None else at)

    def advance(self) -> None:
        """Reads the token at pos: kind, value, start, and whether a line ends before it."""
        text, at = self.text, self.pos
        skip = _SKIP.match(text, at).end()
        self.newline = False
        if skip > at:
            gap = text[at:skip]
            self.newline = "\n" in gap or "\r" in gap
            if "/" in gap:
                for m in _COMMENT.finditer(gap):
                    self.comments[at + m.start()] = at + m.end()
        self.start = skip
        if skip >= len(text):
            self.kind, self.value, self.pos = "eof", "", skip
            return
        m = _TOKEN.match(text, skip)
        if not m:
            if text.startswith("/*", skip):
                self.fail("Unterminated multi-line comment", skip)
            self.fail("Unterminated string" if text[skip] in "\"'" else "Invalid character", skip)
        if text.startswith("/*", skip):
            self.fail("Unterminated multi-line comment", skip)
        self.kind, self.value, self.pos = m.lastgroup, m[0], m.end()

    def next(self) -> str:
        value, self.end_of_last = self.value, self.pos
        self.advance()
        return value

    def seek(self, start: int) -> None:
        self.pos = start
        self.advance()

    def mark(self) -> tuple[int, int, bool]:
        return self.start, self.end_of_last, self.newline

    def back(self, mark: tuple[int, int, bool]) -> None:
        self.seek(mark[0])
        self.end_of_last, self.newline = mark[1], mark[2]

    def at(self, *values: str) -> bool:
        return self.value in values and self.kind in ("punct", "name")

    def take(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.at(value):
            self.fail(f"Expected `{value}` but found `{self.value or 'EOF'}`")
        self.next()

    def peek(self) -> tuple[str, str, bool]:
        """Kind, value and newline flag of the token after this one."""
        keep = self.kind, self.value, self.start, self.pos, self.newline
        try:
            self.advance()
            return self.kind, self.value, self.newline
        except JsSyntaxError:
            return "bad", "", False
        finally:
            self.kind, self.value, self.start, self.pos, self.newline = keep

    def end_statement(self) -> None:
        if not self.take(";") and not (self.at("}") or self.kind == "eof" or self.newline):
            self.fail("Expected a semicolon or an implicit semicolon after a statement, but found none")

    def word(self, *values: str) -> bool:
        """A contextual keyword, followed by something on the same line."""
        return self.kind == "name" and self.value in values

    def split_angle(self) -> None:
        """Turns a token that begins with > into a lone >."""
        if self.kind == "punct" and self.value[0] == ">" and len(self.value) > 1:
            self.value, self.pos = ">", self.start + 1

    # -- program and statements ---------------------------------------------------

    def program(self) -> Node:
        body = []
        while self.kind != "eof":
            body.append(self.statement())
        return Node("Program", 0, len(self.text), body=body)

    def block(self) -> Node:
        start, body = self.start, []
        self.expect("{")
        while not self.at("}"):
            if self.kind == "eof":
                self.fail("Expected `}` but found `EOF`")
            body.append(self.statement())
        self.next()
        return Node("Block", start, self.end_of_last, body=body)

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("Nested too deeply")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        start, value = self.start, self.value
        if self.kind == "punct":
            if value == "{":
                return self.block()
            if value == ";":
                self.next()
                return Node("Empty", start, self.end_of_last)
            if value == "@":
                decorators = self.decorators()
                node = self.statement()
                node.parts["decorators"] = decorators
                return node
        elif self.kind == "name":
            method = getattr(self, f"_{value}_statement", None) if value in RESERVED else None
            if method:
                found = method(start)
                if found:
                    return found
            elif value not in RESERVED or value == "enum":
                found = self.contextual(start)
                if found:
                    return found
        expression = self.expression()
        self.end_statement()
        return Node("ExpressionStatement", start, self.end_of_last, expression=expression)

    def contextual(self, start: int) -> Node | None:
        """Statements that begin with a word that isn't reserved."""
        kind, value, newline = self.peek()
        word = self.value
        if kind == "punct" and value == ":" and word not in ("yield",):
            self.next()
            self.next()
            body = self.statement()
            return Node("Labeled", start, self.end_of_last, body=body)
        if word == "async" and value == "function" and not newline:
            return self.function(start, declaration=True)
        if word == "let" and (kind == "name" and value not in ("in", "of", "instanceof") or value in ("[", "{")):
            return self.variables(start)
        if word == "using" and kind == "name" and not newline and value not in ("in", "of", "instanceof"):
            return self.variables(start)
        if not self.ts or newline and word != "abstract":
            return None
        if word == "type" and kind == "name" and value not in RESERVED:
            return self.type_alias(start)
        if word == "interface" and kind == "name":
            return self.interface(start)
        if word == "abstract" and value == "class":
            self.next()
            return self.klass(start, declaration=True)
        if word == "enum" and kind == "name":
            return self.enum(start)
        if word in ("namespace", "module") and kind in ("name", "str") or word == "global" and value == "{":
            return self.namespace(start)
        if word == "declare" and kind == "name":
            self.next()
            node = self.statement()
            node.start = start
            for part in node.parts.values():  # wrapped declarations share the statement's span
                if type(part) is Node and part.type in ("Function", "Class"):
                    part.start = start
            return node
        return None

    def _var_statement(self, start: int) -> Node:
        return self.variables(start)

    def _const_statement(self, start: int) -> Node:
        if self.ts and self.peek()[1] == "enum":
            self.next()
            return self.enum(start)
        return self.variables(start)

    def variables(self, start: int, in_for: bool = False) -> Node:
        kind, items = self.next(), []
        while True:
            at = self.start
            target = self.binding()
            self.ts and self.take("!")
            annotation = self.annotation()
            init = self.assignment() if self.take("=") else None
            items.append(Node("Declarator", at, self.end_of_last, target=target, annotation=annotation, init=init))
            if not self.take(","):
                break
        if not in_for:
            self.end_statement()
        return Node("VariableDeclaration", start, self.end_of_last, kind=kind, items=items)

    def _function_statement(self, start: int) -> Node:
        return self.function(start, declaration=True)

    def _class_statement(self, start: int) -> Node:
        return self.klass(start, declaration=True)

    def _enum_statement(self, start: int) -> Node | None:
        return self.enum(start)

    def enum(self, start: int) -> Node:
        self.next()
        name = self.next()
        members = []
        self.expect("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                members.append(self.assignment())
            if not self.at("}"):
                self.expect(",")
        return Node("Enum", start, self.end_of_last, name=name, members=members)

    def namespace(self, start: int) -> Node:
        self.next()
        if not self.at("{"):
            self.next()
            while self.take("."):
                self.next()
        body = self.block() if self.at("{") else self.end_statement()
        return Node("Namespace", start, self.end_of_last, body=body)

    def interface(self, start: int) -> Node:
        self.next()
        name, params = self.next(), self.type_parameters()
        if self.take("extends"):
            self.type_()
            while self.take(","):
                self.type_()
        if not self.at("{"):
            self.fail()
        self.balanced()
        return Node("Interface", start, self.end_of_last, name=name, type_params=params)

    def type_alias(self, start: int) -> Node:
        self.next()
        name, params = self.next(), self.type_parameters()
        self.expect("=")
        annotation = self.type_()
        self.end_statement()
        return Node("TypeAlias", start, self.end_of_last, name=name, type_params=params, annotation=annotation)

    def parenthesized(self) -> Node:
        self.expect("(")
        inner = self.expression()
        self.expect(")")
        return inner

    def _if_statement(self, start: int) -> Node:
        self.next()
        test = self.parenthesized()
        then = self.statement()
        other = self.statement() if self.take("else") else None
        return Node("If", start, self.end_of_last, test=test, then=then, other=other)

    def _while_statement(self, start: int) -> Node:
        self.next()
        test = self.parenthesized()
        return Node("While", start, (body := self.statement()).end, test=test, body=body)

    def _do_statement(self, start: int) -> Node:
        self.next()
        body = self.statement()
        self.expect("while")
        test = self.parenthesized()
        self.take(";")
        return Node("Do", start, self.end_of_last, body=body, test=test)

    def _for_statement(self, start: int) -> Node:
        self.next()
        self.take("await")
        self.expect("(")
        head: list[Node] = []
        if not self.at(";"):
            at, keep, self.no_in = self.start, self.no_in, True
            declares = self.at("var", "const") or self.word("let", "using") and self.peek()[0] in ("name", "punct") and self.peek()[1] not in ("in", "of", ".", "(", "=", ";", ")")
            head.append(self.variables(at, in_for=True) if declares else self.expression())
            self.no_in = keep
        if self.at("in", "of"):
            self.next()
            head.append(self.expression())
        else:
            self.expect(";")
            if not self.at(";"):
                head.append(self.expression())
            self.expect(";")
            if not self.at(")"):
                head.append(self.expression())
        self.expect(")")
        body = self.statement()
        return Node("For", start, self.end_of_last, head=head, body=body)

    def _return_statement(self, start: int) -> Node:
        self.next()
        value = None if self.at(";", "}") or self.kind == "eof" or self.newline else self.expression()
        self.end_statement()
        return Node("Return", start, self.end_of_last, value=value)

    def _throw_statement(self, start: int) -> Node:
        self.next()
        if self.newline:
            self.fail("Illegal newline after throw")
        value = self.expression()
        self.end_statement()
        return Node("Throw", start, self.end_of_last, value=value)

    def _jump(self, start: int) -> Node:
        self.next()
        if self.kind == "name" and not self.newline and self.value not in RESERVED:
            self.next()
        self.end_statement()
        return Node("Jump", start, self.end_of_last)

    _break_statement = _continue_statement = _debugger_statement = _jump

    def _try_statement(self, start: int) -> Node:
        self.next()
        parts: list[Node] = [self.block()]
        if self.take("catch"):
            if self.take("("):
                parts.append(self.binding())
                self.annotation()
                self.expect(")")
            parts.append(self.block())
        elif not self.at("finally"):
            self.fail("Missing catch or finally clause")
        if self.take("finally"):
            parts.append(self.block())
        return Node("Try", start, self.end_of_last, items=parts)

    def _switch_statement(self, start: int) -> Node:
        self.next()
        parts = [self.parenthesized()]
        self.expect("{")
        while not self.take("}"):
            if self.take("case"):
                parts.append(self.expression())
            else:
                self.expect("default")
            self.expect(":")
            while not self.at("case", "default", "}"):
                parts.append(self.statement())
        return Node("Switch", start, self.end_of_last, items=parts)

    def _with_statement(self, start: int) -> Node:
        self.next()
        test = self.parenthesized()
        return Node("With", start, (body := self.statement()).end, test=test, body=body)

    # -- modules --------------------------------------------------------------------

    def module_name(self) -> str:
        if self.kind == "str":
            return self.string()
        if self.kind != "name":
            self.fail()
        return self.next()

    def string(self) -> str:
        if self.kind != "str":
            self.fail("Expected a string")
        return unquote(self.next())

    def attributes(self) -> None:
        if self.word("with", "assert") and self.peek()[1] == "{":
            self.next()
            self.balanced()

    def _import_statement(self, start: int) -> Node | None:
        if self.peek()[1] in ("(", "."):
            return None
        self.next()
        type_only, names = False, []
        if self.kind != "str":
            if self.word("type") and (self.peek()[1] in ("{", "*") or self.peek()[0] == "name" and self.peek()[1] != "from"):
                self.next()
                type_only = True
            if self.kind == "name":
                names.append(self.next())
                if self.ts and self.take("="):
                    value = self.expression()
                    self.end_statement()
                    return Node("ImportEquals", start, self.end_of_last, value=value)
                self.take(",")
            if self.take("*"):
                self.expect("as")
                names.append(f"* as {self.next()}")
            elif self.take("{"):
                while not self.take("}"):
                    if self.word("type") and self.peek()[0] in ("name", "str") and self.peek()[1] != "as":
                        self.next()
                    local = self.module_name()
                    if self.take("as"):
                        local = self.next()
                    names.append(local)
                    if not self.at("}"):
                        self.expect(",")
            self.expect("from")
        source = self.string()
        self.attributes()
        self.end_statement()
        return Node("Import", start, self.end_of_last, names=names, source=source, type_only=type_only)

    def _export_statement(self, start: int) -> Node:
        self.next()
        if self.take("default"):
            return self.export_default(start)
        type_only = self.word("type") and self.peek()[1] in ("{", "*") and bool(self.next())
        if self.take("*"):
            alias = self.module_name() if self.take("as") else None
            self.expect("from")
            source = self.string()
            self.attributes()
            self.end_statement()
            return Node("ExportAll", start, self.end_of_last, alias=alias, source=source, type_only=type_only)
        if self.take("{"):
            names = []
            while not self.take("}"):
                own_type = self.word("type") and self.peek()[0] in ("name", "str") and self.peek()[1] != "as" and bool(self.next())
                name = self.module_name()
                if self.take("as"):
                    name = self.module_name()
                names.append((name, own_type))
                if not self.at("}"):
                    self.expect(",")
            if self.take("from"):
                self.string()
                self.attributes()
            self.end_statement()
            return Node("ExportNamed", start, self.end_of_last, declaration=None, names=names)
        if self.ts and self.take("="):
            value = self.expression()
            self.end_statement()
            return Node("ExportEquals", start, self.end_of_last, value=value)
        if not (self.at("var", "const", "function", "class", "enum", "@", "import") or self.word("let", "async", "type", "interface", "abstract", "declare", "namespace", "module", "using")):
            self.fail()
        declaration = self.statement()
        return Node("ExportNamed", start, declaration.end, declaration=declaration, names=[])

    def export_default(self, start: int) -> Node:
        at = self.start
        if self.at("@"):
            self.decorators()
        if self.at("function") or self.word("async") and self.peek()[1] == "function" and not self.peek()[2]:
            value = self.function(at, declaration=False)
        elif self.at("class") or self.word("abstract") and self.peek()[1] == "class":
            self.word("abstract") and self.next()
            value = self.klass(at, declaration=False)
        elif self.ts and self.word("interface") and self.peek()[0] == "name":
            value = self.interface(at)
        else:
            value = self.assignment()
            self.end_statement()
        return Node("ExportDefault", start, self.end_of_last, declaration=value)

    # -- functions and classes --------------------------------------------------------

    def function(self, start: int, declaration: bool) -> Node:
        self.take("async")
        self.expect("function")
        self.take("*")
        name = self.next() if self.kind == "name" and self.value not in ("extends",) else None
        inner = self.function_rest(start, name, need_body=not (declaration and self.ts))
        if not declaration:
            return inner
        return Node("FunctionDeclaration", start, inner.end, function=inner)

    def function_rest(self, start: int, name: str | None, need_body: bool = True) -> Node:
        type_params = self.type_parameters()
        params = self.parameters()
        returns = self.annotation(predicate=True)
        body = None
        if self.at("{"):
            keep, self.no_in = self.no_in, False
            body = self.block()
            self.no_in = keep
        elif need_body:
            self.fail("Expected `{` but found `%s`" % (self.value or "EOF"))
        else:
            self.end_statement()
        return Node("Function", start, self.end_of_last, name=name, type_params=type_params, params=params, returns=returns, body=body)

    def parameters(self) -> list[Node]:
        self.expect("(")
        params, keep, self.no_in = [], self.no_in, False
        while not self.take(")"):
            start = self.start
            decorators = self.decorators()
            rest = self.take("...")
            while self.ts and self.word("public", "private", "protected", "readonly", "override") and self.peek()[0] == "name" or self.ts and self.word("public", "private", "protected", "readonly") and self.peek()[1] in ("{", "["):
                self.next()
            if self.at("this"):
                self.next()
                target = Node("This", start, self.end_of_last)
            else:
                target = self.binding()
            self.ts and self.take("?")
            self.annotation()
            default = self.assignment() if self.take("=") else None
            params.append(Node("Parameter", start, self.end_of_last, target=target, default=default, rest=rest, decorators=decorators))
            if not self.at(")"):
                self.expect(",")
        self.no_in = keep
        return params

    def binding(self) -> Node:
        start = self.start
        if self.at("[", "{"):
            closing, items = {"[": "]", "{": "}"}[self.next()], []
            while not self.take(closing):
                if self.take(","):
                    continue
                self.take("...")
                if closing == "}" and (self.kind in ("str", "num") or self.at("[") or self.peek()[1] == ":"):
                    key = self.property_name()
                    items += [key] if key.type != "Name" else []
                    self.expect(":")
                items.append(self.binding())
                if self.take("="):
                    items.append(self.assignment())
                if not self.at(closing):
                    self.expect(",")
            return Node("Pattern", start, self.end_of_last, items=items)
        if self.kind != "name" or self.value in RESERVED:
            self.fail(f"Expected an identifier but found `{self.value or 'EOF'}`")
        return Node("Binding", start, self.pos, name=self.next())

    def decorators(self) -> list[Node]:
        found = []
        while self.at("@"):
            self.next()
            found.append(self.postfix(self.primary()))
        return found

    def klass(self, start: int, declaration: bool) -> Node:
        self.expect("class")
        name = None
        if self.kind == "name" and not self.at("extends", "implements") or self.word("implements") and self.peek()[1] not in RESERVED and self.peek()[0] == "punct":
            name = self.next()
        self.type_parameters()
        base = None
        if self.take("extends"):
            base = self.postfix(self.primary())
            if self.ts and self.at("<"):
                self.type_arguments()
        if self.ts and self.word("implements"):
            self.next()
            self.type_()
            while self.take(","):
                self.type_()
        body = []
        self.expect("{")
        while not self.take("}"):
            if not self.take(";"):
                body.append(self.member())
        inner = Node("Class", start, self.end_of_last, name=name, base=base, body=body)
        return Node("ClassDeclaration", start, inner.end, klass=inner) if declaration else inner

    def member(self) -> Node:
        start = self.start
        decorators = self.decorators()
        if self.at("static") and self.peek()[1] == "{":
            self.next()
            return Node("StaticBlock", start, self.end_of_last, body=self.block())
        while self.kind == "name" and self.value in MEMBER_MODIFIERS:
            kind, value, newline = self.peek()
            if kind in ("punct", "eof") and value not in ("[", "*", "{") or value == "{" and self.value != "static":
                break
            if newline and self.value not in ("static", "public", "private", "protected", "abstract", "override"):
                break
            self.next()
        self.take("*")
        if self.ts and self.at("["):
            mark = self.mark()
            self.next()
            if self.kind == "name" and self.peek()[1] == ":":
                self.back(mark)
                self.balanced()
                self.annotation()
                self.take(";")
                return Node("Signature", start, self.end_of_last)
            self.back(mark)
        key = self.property_name()
        self.ts and (self.take("?") or self.take("!"))
        if self.at("(", "<"):
            value = self.function_rest(self.start, None, need_body=not self.ts)
            return Node("Method", start, value.end, key=key, function=value, decorators=decorators)
        self.annotation()
        value = self.assignment() if self.take("=") else None
        if not self.at("}"):
            self.end_statement()
        return Node("Field", start, self.end_of_last, key=key, value=value, decorators=decorators)

    def property_name(self) -> Node:
        """A key: Name with its static name, or Computed with the expression."""
        start = self.start
        if self.take("["):
            inner = self.assignment()
            self.expect("]")
            return Node("Computed", start, self.end_of_last, expression=inner)
        if self.kind == "eof" or self.kind == "punct" or self.kind == "tmpl":
            self.fail()
        kind, value = self.kind, self.next()
        name = unquote(value) if kind == "str" else value[1:] if kind == "priv" else value
        return Node("Name", start, self.end_of_last, name=name)

    # -- expressions --------------------------------------------------------------------

    def expression(self) -> Node:
        start, first = self.start, self.assignment()
        if not self.at(","):
            return first
        items = [first]
        while self.take(","):
            items.append(self.assignment())
        return Node("Sequence", start, self.end_of_last, items=items)

    def assignment(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("Nested too deeply")
        try:
            return self._assignment()
        finally:
            self.depth -= 1

    def _assignment(self) -> Node:
        start = self.start
        if self.kind == "name":
            if self.value == "yield" and self.peek()[1] not in (".", "=", "=>"):
                self.next()
                self.take("*")
                value = None if self.newline or self.at(")", "]", "}", ",", ";", ":") or self.kind == "eof" else self.assignment()
                return Node("Yield", start, self.end_of_last, value=value)
            if self.value not in RESERVED:
                kind, value, newline = self.peek()
                if value == "=>" and not newline:
                    name = Node("Binding", start, self.pos, name=self.next())
                    return self.arrow(start, [Node("Parameter", start, name.end, target=name, default=None, rest=False, decorators=[])])
                if self.value == "async" and not newline and (kind == "name" and value not in RESERVED or value in ("(", "<")):
                    mark = self.mark()
                    self.next()
                    if self.kind == "name" and self.peek()[1] == "=>":
                        return self._assignment_arrow(start)
                    if self.at("(", "<") and self.is_arrow():
                        return self.typed_arrow(start)
                    self.back(mark)
        if self.at("(") and self.is_arrow() or self.ts and self.at("<") and self.is_generic_arrow():
            return self.typed_arrow(start)
        left = self.conditional()
        if self.kind == "punct" and self.value in ASSIGN:
            if left.type not in ("Identifier", "Member", "Object", "Array", "Paren", "As", "Chain", "NonNull"):
                self.fail("Cannot assign to this expression", left.start)
            self.next()
            return Node("Assign", start, (right := self.assignment()).end, left=left, right=right)
        return left

    def _assignment_arrow(self, start: int) -> Node:
        at = self.start
        name = Node("Binding", at, self.pos, name=self.next())
        return self.arrow(start, [Node("Parameter", at, name.end, target=name, default=None, rest=False, decorators=[])])

    def typed_arrow(self, start: int) -> Node:
        self.type_parameters()
        params = self.parameters()
        self.annotation(predicate=True)
        return self.arrow(start, params)

    def arrow(self, start: int, params: list[Node]) -> Node:
        if self.newline:
            self.fail()
        self.expect("=>")
        if self.at("{"):
            keep, self.no_in = self.no_in, False
            body = self.block()
            self.no_in = keep
        else:
            body = self.assignment()
        return Node("Arrow", start, self.end_of_last, params=params, body=body)

    def is_arrow(self) -> bool:
        """At a parenthesis: whether an arrow follows its closing one (with a return type in between)."""
        mark = self.mark()
        try:
            if self.at("<"):
                self.type_parameters()
            self.balanced()
            if self.at("=>"):
                return not self.newline
            if not (self.ts and self.at(":")) or mark[0] in self.unannotated:
                return False
            self.annotation(predicate=True)
            return self.at("=>")
        except JsSyntaxError:
            return False
        finally:
            self.forget_comments(mark[0])
            self.back(mark)

    def forget_comments(self, start: int) -> None:
        """Drops the comments found beyond start: what was read ahead is read again. They lie in the order of their starts."""
        while self.comments and next(reversed(self.comments)) >= start:
            self.comments.popitem()

    def is_generic_arrow(self) -> bool:
        if self.jsx and not re.match(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)", self.text[self.start :]):
            return False
        return self.is_arrow()

    def balanced(self) -> None:
        """Skips a bracketed run of tokens."""
        closing, before = [], ""
        while True:
            if self.kind == "eof":
                self.fail("Unbalanced brackets")
            if self.kind == "tmpl":
                self.template()
                before = "`"
                continue
            if self.at("/", "/=") and not (re.match(r"[\w$)\]}\"'`]", before[-1:] or "(") and before not in RESERVED):
                self.regex()
                before = "/x"
                continue
            value = before = self.value
            if self.kind == "punct":
                if value in "([{":
                    closing.append({"(": ")", "[": "]", "{": "}"}[value])
                elif value in ")]}":
                    if not closing or closing.pop() != value:
                        self.fail()
            self.next()
            if not closing:
                return

    def conditional(self) -> Node:
        start, test = self.start, self.binary(0)
        if not self.at("?"):
            return test
        self.next()
        keep, self.no_in = self.no_in, False
        then = self.branch()
        self.no_in = keep
        self.expect(":")
        other = self.assignment()
        return Node("Conditional", start, self.end_of_last, test=test, then=then, other=other)

    def branch(self) -> Node:
        """What a conditional's question mark is followed by. In `a ? (b) : c => d` the colon is the conditional's, though (b): c => d is an arrow function, too."""
        mark, depth = self.mark(), self.depth
        if not self.ts or not self.at("("):
            return self.assignment()
        try:
            found = self.assignment()
            if self.at(":"):
                return found
        except JsSyntaxError:
            pass
        self.depth = depth
        self.forget_comments(mark[0])
        self.back(mark)
        self.unannotated.add(mark[0])
        return self.assignment()

    def binary(self, least: int) -> Node:
        start = self.start
        left = self.unary()
        while True:
            op = self.value if self.kind in ("punct", "name") else ""
            rank = BINARY.get(op, 0)
            if not rank or rank <= least and not (op == "**" and rank == least) or op == "in" and self.no_in:
                return left
            if op in ("as", "satisfies"):
                if not self.ts or self.newline:
                    return left
                self.next()
                self.take("const") or self.type_()
                left = Node("As", start, self.end_of_last, expression=left)
                continue
            self.next()
            right = self.binary(rank - 1 if op == "**" else rank)
            left = Node("Binary", start, right.end, left=left, right=right)

    def unary(self) -> Node:
        start = self.start
        if self.kind == "punct" and self.value in PREFIX or self.kind == "name" and self.value in PREFIX and not (self.value == "await" and self.peek()[1] in (")", ",", ";", ".", "=", "=>")):
            self.next()
            self.depth += 1
            if self.depth > MAX_DEPTH:
                self.fail("Nested too deeply")
            value = self.unary()
            self.depth -= 1
            return Node("Unary", start, value.end, value=value)
        if self.ts and not self.jsx and self.at("<"):
            self.type_arguments()
            value = self.unary()
            return Node("As", start, value.end, expression=value)
        value = self.postfix(self.primary())
        if self.at("++", "--") and not self.newline:
            self.next()
            return Node("Update", start, self.end_of_last, value=value)
        return value

    def arguments(self) -> list[Node]:
        self.expect("(")
        found, keep, self.no_in = [], self.no_in, False
        while not self.take(")"):
            start = self.start
            if self.take("..."):
                value = self.assignment()
                found.append(Node("Spread", start, value.end, value=value))
            else:
                found.append(self.assignment())
            if not self.at(")"):
                self.expect(",")
        self.no_in = keep
        return found

    def postfix(self, node: Node, calls: bool = True) -> Node:
        """Member accesses and calls after a primary expression. An optional chain is wrapped whole."""
        start, chained = node.start, False
        while True:
            if self.at("."):
                self.next()
                node = self.named_member(start, node)
            elif self.at("?.") and calls:
                self.next()
                chained = True
                if self.at("("):
                    args = self.arguments()
                    node = Node("Call", start, self.end_of_last, callee=node, args=args)
                elif self.at("["):
                    node = self.computed_member(start, node)
                else:
                    node = self.named_member(start, node)
            elif self.at("["):
                node = self.computed_member(start, node)
            elif self.at("(") and calls:
                args = self.arguments()
                node = Node("Call", start, self.end_of_last, callee=node, args=args)
            elif self.kind == "tmpl":
                quasi = self.template()
                node = Node("Tagged", start, self.end_of_last, tag=node, quasi=quasi)
            elif self.ts and self.at("!") and not self.newline:
                self.next()
                node = Node("NonNull", start, self.end_of_last, expression=node)
            elif self.ts and self.at("<", "<<") and calls:
                args = self.call_type_arguments(start, node)
                if args is None:
                    break
                node = args
            else:
                break
        return Node("Chain", start, node.end, expression=node) if chained else node

    def call_type_arguments(self, start: int, node: Node) -> Node | None:
        """f<T>(x): None if the angle isn't the start of type arguments."""
        mark = self.mark()
        try:
            self.type_arguments()
            if self.kind == "tmpl":
                return Node("Instantiation", start, self.end_of_last, expression=node)
            if self.at("("):
                args = self.arguments()
                return Node("Call", start, self.end_of_last, callee=node, args=args)
        except JsSyntaxError:
            pass
        self.back(mark)
        return None

    def named_member(self, start: int, node: Node) -> Node:
        if self.kind not in ("name", "priv"):
            self.fail()
        private = self.kind == "priv"
        name = self.next()
        return Node("Member", start, self.end_of_last, object=node, name=None if private else name, property=None)

    def computed_member(self, start: int, node: Node) -> Node:
        self.next()
        keep, self.no_in = self.no_in, False
        inner = self.expression()
        self.no_in = keep
        self.expect("]")
        name = unquote(self.text[inner.start : inner.end]) if inner.type == "String" else None
        return Node("Member", start, self.end_of_last, object=node, name=name, property=inner)

    def primary(self) -> Node:
        start, kind, value = self.start, self.kind, self.value
        if kind == "name":
            if value == "function" or value == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                return self.function(start, declaration=False)
            if value == "class":
                return self.klass(start, declaration=False)
            if value == "new":
                return self.new(start)
            if value == "import":
                return self.import_expression(start)
            if value in ("this", "null", "true", "false", "super"):
                self.next()
                return Node(value.title(), start, self.end_of_last)
            if value in RESERVED:
                self.fail()
            self.next()
            return Node("Identifier", start, self.end_of_last, name=value)
        if kind in ("num", "str"):
            self.next()
            return Node("String" if kind == "str" else "Number", start, self.end_of_last)
        if kind == "tmpl":
            return self.template()
        if kind == "priv":
            self.next()
            return Node("PrivateIn", start, self.end_of_last)
        if value == "(":
            self.next()
            keep, self.no_in = self.no_in, False
            inner = self.expression()
            self.no_in = keep
            self.expect(")")
            return Node("Paren", start, self.end_of_last, expression=inner)
        if value == "[":
            return self.array(start)
        if value == "{":
            return self.object(start)
        if value in ("/", "/="):
            return self.regex()
        if value == "<" and self.jsx:
            return self.jsx_element()
        if value == "@":
            self.decorators()
            return self.klass(start, declaration=False)
        self.fail(f"Unexpected token `{value}`" if value else "Unexpected end of file")

    def regex(self) -> Node:
        m = _REGEX.match(self.text, self.start)
        if not m:
            self.fail("Unterminated regular expression")
        start, self.pos = self.start, m.end()
        self.next()
        return Node("Regex", start, self.end_of_last)

    def new(self, start: int) -> Node:
        self.next()
        if self.take("."):
            self.next()
            return Node("Meta", start, self.end_of_last)
        callee = self.new(self.start) if self.at("new") else self.primary()
        callee = self.postfix(callee, calls=False)
        if self.ts and self.at("<"):
            self.type_arguments()
        args = self.arguments() if self.at("(") else []
        return Node("New", start, self.end_of_last, callee=callee, args=args)

    def import_expression(self, start: int) -> Node:
        self.next()
        if self.take("."):
            self.next()
            return Node("Meta", start, self.end_of_last)
        args = self.arguments()
        return Node("ImportCall", start, self.end_of_last, args=args)

    def array(self, start: int) -> Node:
        self.next()
        items, keep, self.no_in = [], self.no_in, False
        while not self.take("]"):
            if self.take(","):
                continue
            self.take("...")
            items.append(self.assignment())
            if not self.at("]"):
                self.expect(",")
        self.no_in = keep
        return Node("Array", start, self.end_of_last, items=items)

    def object(self, start: int) -> Node:
        self.next()
        items, keep, self.no_in = [], self.no_in, False
        while not self.take("}"):
            if self.take("..."):
                items.append(self.assignment())
            else:
                items.append(self.object_member())
            if not self.at("}"):
                self.expect(",")
        self.no_in = keep
        return Node("Object", start, self.end_of_last, items=items)

    def object_member(self) -> Node:
        start = self.start
        while self.word("async", "get", "set") and self.peek()[1] not in ("(", ":", ",", "}", "=", "<"):
            self.next()
        self.take("*")
        kind, value = self.kind, self.value
        key = self.property_name()
        if self.at("(", "<"):
            function = self.function_rest(self.start, None)
            return Node("Property", start, self.end_of_last, key=key, value=function)
        if self.take(":"):
            return Node("Property", start, (item := self.assignment()).end, key=key, value=item)
        if kind != "name" or value in RESERVED:
            self.fail()
        default = self.assignment() if self.take("=") else None
        return Node("Property", start, self.end_of_last, key=None, value=Node("Identifier", key.start, key.end, name=value), default=default)

    def template(self) -> Node:
        """From a backquote to its partner, with the expressions between."""
        start, at, text, items = self.start, self.start + 1, self.text, []
        while True:
            m = re.compile(r"\\.|`|\$\{", re.S).search(text, at)
            if not m:
                self.fail("Unterminated template literal", start)
            at = m.end()
            if m[0] == "`":
                self.pos = at
                self.end_of_last = at
                self.advance()
                self.end_of_last = at
                return Node("Template", start, at, items=items)
            if m[0] == "${":
                self.seek(at)
                items.append(self.expression())
                if not self.at("}"):
                    self.fail()
                at = self.start + 1

    # -- JSX ------------------------------------------------------------------------------

    def jsx_element(self) -> Node:
        start, items = self.start, []
        at = self.start + 1
        skip = lambda k: _SKIP.match(self.text, k).end()
        at = skip(at)
        m = _JSX_NAME.match(self.text, at)
        name, at = (m[0], m.end()) if m else ("", at)
        while True:
            at = skip(at)
            if self.text.startswith("/>", at):
                return self.jsx_end(start, at + 2, items)
            if self.text.startswith(">", at):
                at += 1
                break
            if self.text.startswith("{", at):
                at = self.jsx_braces(at, items)
                continue
            m = _JSX_NAME.match(self.text, at)
            if not m or not name:
                self.fail("Unexpected token", at)
            at = skip(m.end())
            if self.text.startswith("=", at):
                at = skip(at + 1)
                if self.text.startswith("{", at):
                    at = self.jsx_braces(at, items)
                elif self.text.startswith("<", at):
                    self.seek(at)
                    items.append(self.jsx_element())
                    at = items[-1].end
                else:
                    m = re.compile(r"\"[^\"]*\"|'[^']*'").match(self.text, at)
                    if not m:
                        self.fail("Unexpected token", at)
                    at = m.end()
        while True:
            m = re.compile(r"[{<]").search(self.text, at)
            if not m:
                self.fail("Unterminated JSX element", start)
            at = m.start()
            if m[0] == "{":
                at = self.jsx_braces(at, items)
                continue
            close = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(self.text, at)
            if close:
                if close[1] != name:
                    self.fail("Expected corresponding JSX closing tag", at)
                return self.jsx_end(start, close.end(), items)
            self.seek(at)
            items.append(self.jsx_element())
            at = items[-1].end

    def jsx_braces(self, at: int, items: list[Node]) -> int:
        self.seek(at)
        self.next()
        if not self.at("}"):
            self.take("...")
            items.append(self.expression())
        if not self.at("}"):
            self.fail()
        return self.start + 1

    def jsx_end(self, start: int, end: int, items: list[Node]) -> Node:
        self.pos = end
        self.advance()
        self.end_of_last = end
        return Node("Jsx", start, end, items=items)

    # -- types ------------------------------------------------------------------------------

    def annotation(self, predicate: bool = False) -> Node | None:
        if not (self.ts and self.at(":")):
            return None
        start = self.start
        self.next()
        if predicate and self.word("asserts") and self.peek()[0] == "name" and not self.peek()[2]:
            self.next()
        if predicate and self.kind == "name" and self.peek()[1] == "is":
            self.next()
            self.next()
        self.type_()
        return Node("Annotation", start, self.end_of_last)

    def type_parameters(self) -> list[str]:
        names: list[str] = []
        if not (self.ts and self.at("<")):
            return names
        self.next()
        while True:
            self.split_angle()
            if self.at(">"):
                self.next()
                return names
            while self.at("const", "in") or self.word("out") and self.peek()[0] == "name":
                self.next()
            if self.kind != "name":
                self.fail()
            names.append(self.next())
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            self.split_angle()
            if not self.at(">"):
                self.expect(",")

    def type_arguments(self) -> None:
        if self.at("<<"):
            self.value, self.pos = "<", self.start + 1
        self.expect("<")
        while True:
            self.type_()
            self.split_angle()
            if self.at(">"):
                break
            self.expect(",")
        self.next()

    def type_(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("Nested too deeply")
        start = self.start
        self.type_union()
        if self.at("extends") and not self.newline:
            self.next()
            self.type_union()
            if self.take("?"):
                self.type_()
                self.expect(":")
                self.type_()
        self.depth -= 1
        return Node("Type", start, self.end_of_last)

    def type_union(self) -> None:
        self.take("|") or self.take("&")
        self.type_operand()
        while self.at("|", "&"):
            self.next()
            self.type_operand()

    def type_operand(self) -> None:
        while self.word("keyof", "unique", "readonly", "infer", "abstract", "asserts") and (self.peek()[0] in ("name", "str") or self.peek()[1] in ("(", "[", "{")) and not self.peek()[2]:
            self.next()
        if self.at("new"):
            self.next()
        if self.at("<") or self.at("(") and self.is_function_type():
            self.type_parameters()
            self.balanced()
            self.expect("=>")
            if self.kind == "name" and self.peek()[1] == "is":
                self.next()
                self.next()
            self.type_()
            return
        if self.at("(", "{", "["):
            self.balanced()
        elif self.at("typeof") and self.peek()[1] != "import":
            self.next()
            self.type_name()
        elif self.at("import", "typeof"):
            self.take("typeof")
            self.next()
            self.balanced()
            while self.take("."):
                self.next()
        elif self.kind == "tmpl":
            self.template()
        elif self.at("-"):
            self.next()
            self.next()
        elif self.kind in ("str", "num"):
            self.next()
        elif self.kind == "name" and (self.value not in RESERVED or self.value in ("this", "void", "null", "true", "false")):
            self.type_name()
        else:
            self.fail()
        while self.at("[") and not self.newline:
            self.balanced()

    def type_name(self) -> None:
        self.next()
        while self.take("."):
            self.next()
        if self.at("<") and not self.newline:
            self.type_arguments()
        if self.at("is") and not self.newline and self.peek()[0] == "name":
            self.next()
            self.type_()

    def is_function_type(self) -> bool:
        mark = self.mark()
        try:
            self.balanced()
            return self.at("=>")
        except JsSyntaxError:
            return False
        finally:
            self.back(mark)


_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}


def unquote(literal: str) -> str:
    """The value of a string literal."""
    body = literal[1:-1]
    if "\\" not in body:
        return body
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _NAMED.get(m[4], m[4]), body)


class Source:
    """A text with its byte offsets and lines."""

    def __init__(self, text: str):
        self.text = text
        self.ascii = text.isascii()
        self._bytes = None if self.ascii else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
        self._lines: list[int] | None = None

    def byte(self, at: int) -> int:
        return at if self.ascii else self._bytes[at]

    def location(self, at: int) -> tuple[int, int]:
        """(line from 1, column in bytes from 0) of a character offset."""
        if self._lines is None:
            self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        line = bisect_right(self._lines, at)
        return line, self.byte(at) - self.byte(self._lines[line - 1])


#: Language names of rules -> (typescript, jsx).
LANGUAGES = {"js": (False, True), "jsx": (False, True), "javascript": (False, True), "ts": (True, False), "tsx": (True, True), "typescript": (True, False)}


def parse(text: str, language: str = "tsx") -> tuple[Node, list[tuple[int, int]]]:
    """The program and the spans of its comments in order. Raises JsSyntaxError."""
    ts, jsx = LANGUAGES[language]
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    parser = None
    try:
        parser = Parser(text, ts, jsx)
        program = parser.program()
    except JsSyntaxError:
        raise
    except RecursionError:
        raise JsSyntaxError("Nested too deeply", parser.start) from None
    except Exception as e:  # a fault of the parser's is one file's fault, not the job's
        raise JsSyntaxError(f"The parser failed: {type(e).__name__}: {e}", parser.start if parser else 0) from e
    return program, sorted(parser.comments.items())
