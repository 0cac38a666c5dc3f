"""Structural matching over shallow trees: patterns with metavariables, combinators, relations, overlap resolution.

Pure functions on one file's tree; `scan` and the other DataFrame operators run them in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import regex

from ..plans.rules import PatternNode, Rule
from .tree import TreeNode

STRICTNESS = ("ast", "relaxed", "cst", "signature", "template")
_TRIVIA = re.compile(r"//[^\n]*\n?|/\*.*?(?:\*/|\Z)|\s", re.S)


def normalize_text(text: str) -> str:
    """Without comments and white space; blind to string literals."""
    return _TRIVIA.sub("", text)


def is_ignorable(text: str) -> bool:
    """Whether nothing is left of a text once normalized."""
    first = text[:1]
    return not first or (first == "/" or first.isspace()) and not normalize_text(text)


def normalize_signature(text: str) -> str:
    return normalize_text(text).split("{", 1)[0]


@dataclass(frozen=True)
class Captured:
    kind: str
    text: str
    start: int
    end: int

    @classmethod
    def of(cls, node: TreeNode) -> Captured:
        return cls(node.kind, node.text, node.start, node.end)


#: Bindings: name -> Captured for $A, tuple of Captured for $$$A. Never changed in place.
Env = dict[str, "Captured | tuple[Captured, ...]"]


class Matcher:
    """Extension point: subclasses say how a node is matched; None means no match."""

    def match(self, node: TreeNode, env: Env) -> Env | None:
        raise NotImplementedError

    def find_all(self, root: TreeNode, prefer: str = "outer") -> list[Match]:
        found = [Match(n, env, len(above)) for n, above in root.walk() if (env := self.match(n, {})) is not None]
        return resolve_overlaps(found, prefer)


@dataclass(frozen=True)
class Match:
    node: TreeNode
    env: Env
    depth: int = 0

    @property
    def span(self) -> tuple[int, int]:
        return self.node.start, self.node.end


class PatternMatcher(Matcher):
    """strictness: cst compares exact text and keeps trivia; signature looks no further than the first brace; the others normalize."""

    def __init__(self, pattern: PatternNode, strictness: str = "ast"):
        if strictness not in STRICTNESS:
            raise ValueError(f"unknown strictness {strictness}")
        self.pattern, self.exact = pattern, strictness == "cst"
        self.form: Callable[[str], str] = str if self.exact else normalize_signature if strictness == "signature" else normalize_text

    def match(self, node: TreeNode, env: Env) -> Env | None:
        return self._node(node, self.pattern, env)

    def _same(self, a: str, b: str) -> bool:
        return a == b or self.form(a) == self.form(b)

    def _agree(self, old: Captured, new: Captured) -> bool:
        return old.kind == new.kind and self._same(old.text, new.text)

    def _bind(self, env: Env, name: str, value) -> Env | None:
        """env with the binding, if it agrees with one of the same sort that is there."""
        if name not in env:
            return env | {name: value}
        old = env[name]
        if isinstance(old, tuple) != isinstance(value, tuple):
            return None
        pairs = zip(old, value, strict=False) if isinstance(old, tuple) else ((old, value),)
        return env if (not isinstance(old, tuple) or len(old) == len(value)) and all(self._agree(a, b) for a, b in pairs) else None

    def _node(self, node: TreeNode, pattern: PatternNode, env: Env) -> Env | None:
        if pattern.role == "single":
            return self._bind(env, pattern.name, Captured.of(node))
        if pattern.role != "node" or pattern.kind != node.kind or self.exact and pattern.text != node.text:
            return None
        nodes, wanted = node.children, pattern.children
        if not self.exact:
            nodes = [n for n in nodes if not is_ignorable(n.text)]
            wanted = tuple(p for p in wanted if p.role != "node" or not is_ignorable(p.text))
        if not nodes and not wanted:
            return env if self._same(pattern.text, node.text) else None
        return self._sequence(nodes, wanted, env)

    def _sequence(self, nodes: list[TreeNode], wanted: tuple[PatternNode, ...], env: Env) -> Env | None:
        """Siblings against a list of patterns. Placeholders for several take as few as they can."""
        several = sum(p.role in ("multi", "any") for p in wanted)
        if len(wanted) - several > len(nodes) or not several and len(wanted) != len(nodes):
            return None
        if not several:
            for node, p in zip(nodes, wanted):
                found = self._node(node, p, env)
                if found is None:
                    return None
                env = found
            return env
        failed: set[tuple] = set()
        captured = [Captured.of(n) for n in nodes]

        def go(i: int, j: int, env: Env) -> Env | None:
            if j == len(wanted):
                return env if i == len(nodes) else None
            state = (i, j, frozenset(env.items()))
            if state in failed:
                return None
            p, result = wanted[j], None
            if p.role in ("multi", "any"):
                for k in range(i, len(nodes) + 1):
                    bound = env if p.role == "any" else self._bind(env, p.name, tuple(captured[i:k]))
                    result = go(k, j + 1, bound) if bound is not None else None
                    if result is not None:
                        break
            elif i < len(nodes):
                bound = self._node(nodes[i], p, env)
                result = go(i + 1, j + 1, bound) if bound is not None else None
            if result is None:
                failed.add(state)
            return result

        return go(0, 0, env)


class All(Matcher):
    """All matchers in turn on one environment; nothing is kept unless all match."""

    def __init__(self, *matchers: Matcher):
        self.matchers = matchers

    def match(self, node: TreeNode, env: Env) -> Env | None:
        for m in self.matchers:
            found = m.match(node, env)
            if found is None:
                return None
            env = found
        return env


Composite = All


class AnyOf(Matcher):
    def __init__(self, *matchers: Matcher):
        self.matchers = matchers

    def match(self, node: TreeNode, env: Env) -> Env | None:
        return next((found for m in self.matchers if (found := m.match(node, env)) is not None), None)


class Not(Matcher):
    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def match(self, node: TreeNode, env: Env) -> Env | None:
        return env if self.matcher.match(node, env) is None else None


class Where(Matcher):
    """A Python predicate on nodes."""

    def __init__(self, predicate: Callable[[TreeNode], bool]):
        self.predicate = predicate

    def match(self, node: TreeNode, env: Env) -> Env | None:
        return env if self.predicate(node) else None


def descendants_last_first(node: TreeNode) -> Iterable[TreeNode]:
    """Proper descendants in the order in which `has` looks at them."""
    waiting = list(node.children)
    while waiting:
        node = waiting.pop()
        yield node
        waiting += node.children


def relation_holds(node: TreeNode, above: tuple[TreeNode, ...], relation: str, predicate: Callable[[TreeNode], bool]) -> bool:
    """inside: some proper ancestor satisfies the predicate; has: some proper descendant."""
    return any(map(predicate, reversed(above) if relation == "inside" else descendants_last_first(node)))


class RuleEvaluator:
    """A compiled rule, evaluated on a node with its ancestors. Sub-rules of inside and has see the original node's ancestors."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self._evaluate = self._compile(rule)

    def evaluate(self, node: TreeNode, above: tuple[TreeNode, ...]) -> Env | None:
        return self._evaluate(node, above)

    def matches(self, root: TreeNode) -> list[Match]:
        """In preorder; overlaps stay."""
        return [Match(n, env, len(above)) for n, above in root.walk() if (env := self._evaluate(n, above)) is not None]

    def _compile(self, rule: Rule) -> Callable[[TreeNode, tuple[TreeNode, ...]], Env | None]:
        if rule.op == "pattern":
            matcher = PatternMatcher(rule.value)
            return lambda n, above: matcher.match(n, {})
        if rule.op == "regex":
            search = regex.compile(rule.value).search
            return lambda n, above: {} if search(n.text) else None
        if rule.op == "kind":
            return lambda n, above: {} if n.kind == rule.value else None
        parts = [self._compile(r) for r in rule.rules]
        if rule.op == "all":
            return lambda n, above: self._merged(part(n, above) for part in parts)
        first = lambda envs: next((e for e in envs if e is not None), None)
        if rule.op == "any":
            return lambda n, above: first(part(n, above) for part in parts)
        part = parts[0]
        if rule.op == "not":
            return lambda n, above: {} if part(n, above) is None else None
        if rule.op == "inside":
            return lambda n, above: first(part(a, above) for a in reversed(above))
        return lambda n, above: first(part(d, above) for d in descendants_last_first(n))

    @staticmethod
    def _merged(envs: Iterable[Env | None]) -> Env | None:
        """The union, if no name has different bindings; text, kind and span count."""
        out: Env = {}
        for env in envs:
            if env is None or any(k in out and out[k] != v for k, v in env.items()):
                return None
            out = out | env
        return out


def resolve_overlaps(matches: list[Match], prefer: str = "outer") -> list[Match]:
    """Greedy choice of matches that don't overlap, longest first (prefer outer) or shortest first (inner); in source order."""
    sign = -1 if prefer == "outer" else 1
    ranked = sorted(range(len(matches)), key=lambda k: (sign * (matches[k].span[1] - matches[k].span[0]), *matches[k].span, matches[k].depth, k))
    taken: list[tuple[int, int, int]] = []  # by start; taken spans are disjoint, so only neighbours can overlap
    for k in ranked:
        start, end = matches[k].span
        at = bisect_left(taken, (start, end, -1))
        near = taken[max(0, at - 1) : at + 1]
        if start == end:
            near = [x for x in taken if x[0] < end and start < x[1]]
        if not any(s < end and start < e for s, e, _ in near):
            insort(taken, (start, end, k))
    out: list[Match] = []
    for *_, k in taken:
        if not out or out[-1].span != matches[k].span:
            out.append(matches[k])
    return out


def flat_metavariables(env: Env) -> dict[str, str]:
    """Texts by name; several captured nodes are joined without a separator."""
    return {k: v.text if isinstance(v, Captured) else "".join(c.text for c in v) for k, v in sorted(env.items())}
