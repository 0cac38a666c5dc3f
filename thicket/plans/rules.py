"""Rule documents: YAML to a checked tree of rules, patterns, and fix templates."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import regex
import yaml

from ..operators.js_parser import LANGUAGES, JsSyntaxError
from ..operators.tree import TreeNode, shallow_tree

META_NAME = r"[A-Z_][A-Z0-9_]*"
_META = re.compile(rf"(\$\$\$|\$)({META_NAME})\Z")


class RuleError(ValueError):
    """A rule, pattern or fix that can't be used."""


def is_meta_name(name: str) -> bool:
    return bool(re.fullmatch(META_NAME, name))


@dataclass(frozen=True)
class PatternNode:
    """role: node, single, multi or any (the nameless $$$). name: of the metavariable. kind and text: of a node."""

    role: str
    kind: str = ""
    text: str = ""
    name: str = ""
    children: tuple[PatternNode, ...] = ()


def classify_identifier(name: str) -> tuple[str, str] | None:
    """(role, metavariable name) if an identifier is a placeholder."""
    if name == "$$$":
        return "any", ""
    m = _META.match(name)
    return ("multi" if m[1] == "$$$" else "single", m[2]) if m else None


def meta_variables(root: TreeNode) -> dict[tuple[int, int], tuple[str, str]]:
    """Placeholders by span: only identifier expressions of the shallow tree count."""
    found = {}
    for node, _ in root.walk():
        if node.identifier is not None and (meta := classify_identifier(node.identifier)):
            found[node.at, node.to] = meta
    return found


def pattern_of(root: TreeNode) -> PatternNode:
    """Nodes that share a placeholder's span become the placeholder too."""
    metas = meta_variables(root)

    def build(node: TreeNode) -> PatternNode:
        role, name = metas.get((node.at, node.to), ("node", ""))
        return PatternNode(role, node.kind, node.text, name, tuple(map(build, node.children)))

    return build(root)


def compile_pattern(text: str, language: str = "tsx") -> PatternNode:
    """One statement stands for itself, anything else for a whole program."""
    try:
        root = shallow_tree(text, language)
    except JsSyntaxError as e:
        raise RuleError(f"Invalid pattern: {e}") from None
    return pattern_of(root.children[0] if len(root.children) == 1 else root)


@dataclass(frozen=True)
class Rule:
    """op: pattern, regex, kind, all, any, not, inside or has; with a value or sub-rules."""

    op: str
    value: object = None
    rules: tuple[Rule, ...] = ()


def check_regex(text: str) -> str:
    """Patterns of the linear-time dialect only: no look-around, no backreferences."""
    plain = re.sub(r"\\\\|\[(?:\\.|[^\]\\])*\]", "", text)
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k[<{']|\(\?P=", plain):
        raise RuleError(f"Invalid regex '{text}': look-around and backreferences are not supported")
    try:
        regex.compile(text)
    except regex.error as e:
        raise RuleError(f"Invalid regex '{text}': {e}") from None
    return text


def compile_rule(body: object, language: str) -> Rule:
    if not isinstance(body, dict) or len(body) != 1:
        raise RuleError("A rule must have exactly one key")
    ((op, value),) = body.items()
    if op in ("pattern", "regex", "kind"):
        if not isinstance(value, str):
            raise RuleError(f"`{op}` must be a string")
        return Rule(op, compile_pattern(value, language) if op == "pattern" else check_regex(value) if op == "regex" else value)
    if op in ("all", "any"):
        if not isinstance(value, list):
            raise RuleError(f"`{op}` must be a list")
        return Rule(op, rules=tuple(compile_rule(x, language) for x in value))
    if op in ("not", "inside", "has"):
        return Rule(op, rules=(compile_rule(value, language),))
    raise RuleError(f"unknown rule `{op}`")


@dataclass(frozen=True)
class RuleDocument:
    id: str
    language: str
    rule: Rule
    fix: str | None = None
    body: object = field(default=None, compare=False, hash=False)


def parse_rule(text: str) -> RuleDocument:
    """id, language and rule are needed, fix is optional, other keys at the top are ignored."""
    try:
        document = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"Invalid YAML: {e}") from None
    if not isinstance(document, dict):
        raise RuleError("A rule document must be a mapping")
    for key in ("id", "language", "rule"):
        if key not in document:
            raise RuleError(f"missing field `{key}`")
    if document["language"] not in LANGUAGES:
        raise RuleError(f"unknown language `{document['language']}`")
    fix = document.get("fix")
    return RuleDocument(str(document["id"]), document["language"], compile_rule(document["rule"], document["language"]), fix if isinstance(fix, str) else None, document["rule"])


def load_rule(rule: str) -> RuleDocument:
    """A path if there is such a file, else the document itself."""
    if "\n" not in rule and os.path.exists(rule):
        with open(rule, encoding="utf-8") as f:
            rule = f.read()
    return parse_rule(rule)


def parse_template(fix: str) -> list[tuple[str, str]]:
    """[(literal | single | multi, text or name)]: the longest name after $ or $$$; any other $ is literal."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in re.finditer(rf"(\$\$\$|\$)({META_NAME})", fix):
        if m.start() > at:
            out.append(("literal", fix[at : m.start()]))
        out.append(("multi" if len(m[1]) == 3 else "single", m[2]))
        at = m.end()
    if at < len(fix):
        out.append(("literal", fix[at:]))
    return out


def required_word(rule: Rule) -> str | None:
    """An identifier that every text with a match must hold, or None if none can be told: for skipping files before they are parsed."""
    if rule.op == "pattern":
        words: list[str] = []

        def collect(p: PatternNode) -> None:
            if p.role == "node" and not p.children and p.kind in ("Identifier", "MemberExpression"):
                words.extend(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", p.text.split("/")[0]))
            for c in p.children:
                collect(c)

        collect(rule.value)
        return max(words, key=len, default=None)
    if rule.op == "all":
        return max(filter(None, map(required_word, rule.rules)), key=len, default=None)
    return None
