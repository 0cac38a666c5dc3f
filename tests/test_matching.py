import pytest

from thicket.operators.matching import All, AnyOf, Match, Matcher, Not, PatternMatcher, RuleEvaluator, Where, flat_metavariables, relation_holds, resolve_overlaps
from thicket.operators.tree import shallow_tree
from thicket.plans.rules import RuleError, check_regex, compile_pattern, is_meta_name, meta_variables, parse_rule, parse_template, pattern_of, required_word


def find(code, pattern, strictness="ast", prefer="outer"):
    return [(m.node.text, flat_metavariables(m.env)) for m in PatternMatcher(compile_pattern(pattern), strictness).find_all(shallow_tree(code), prefer)]


@pytest.mark.parametrize(
    "code, pattern, expected",
    [
        # one, then all the others
        ("let cargo = load(port, crane, crew, dock);", "let cargo = load($FIRST, $$$REST);", {"FIRST": "port", "REST": "cranecrewdock"}),
        # a name that is used twice must stand for the same
        ("route(oslo, lima);", "route($P, $P);", None),
        ("route(oslo, oslo);", "route($P, $P);", {"P": "oslo"}),
        ("tour(oslo, lima, oslo, lima);", "tour($$$LEG, $$$LEG);", {"LEG": "oslolima"}),
        ("tour(oslo, lima, rome, lima);", "tour($$$LEG, $$$LEG);", None),
        # one node isn't a list of one
        ("route(oslo, oslo);", "route($P, $$$P);", None),
        ("route(oslo, oslo);", "route($$$P, $P);", None),
        # a list without a name binds nothing
        ("tour(1, 2, 3, 4);", "tour($$$);", {}),
        # what is declared isn't in the tree, nor what spreads, nor the parts of a member
        ("let anchor = drop(7);", "var $NAME = drop($DEPTH);", {"DEPTH": "7"}),
        ("sail();", "sail(...crew);", {}),
        ("ship.sail(3);", "$SHIP.sail($DAYS);", None),
        ("let knots = 18;", "let knots = 18;", {}),
    ],
)
def test_patterns(code, pattern, expected):
    found = find(code, pattern)
    assert found == ([] if expected is None else [(code, expected)])


@pytest.mark.parametrize("strictness, n", [("ast", 1), ("relaxed", 1), ("template", 1), ("signature", 1), ("cst", 0)])
def test_strictness(strictness, n):
    assert len(find("let /* in knots */ speed = 18;", "let speed = 18;", strictness)) == n


def test_signature_looks_at_the_head_only():
    assert find("function tonnage(hull, deck) { return hull * deck; }", "function tonnage(hull,deck){ while (hull) hull--; }", "signature")
    assert not find("function tonnage(hull, deck) { return hull * deck; }", "function tonnage(deck, hull) { return hull * deck; }", "signature")


def test_bare_placeholder_matches_every_node():
    root = shallow_tree("sail(3); anchor")
    matcher = PatternMatcher(compile_pattern("$A"))
    assert all(matcher.match(n, {}) is not None for n, _ in root.walk())


def call_pattern(text):
    return pattern_of(shallow_tree(text).children[0].children[0])


def test_overlaps():
    root = shallow_tree("let crate = wrap(wrap(wrap(tea)));")
    matcher = PatternMatcher(call_pattern("wrap($$$A)"))
    assert [m.node.text for m in matcher.find_all(root, "outer")] == ["wrap(wrap(wrap(tea)))"]
    assert [m.node.text for m in matcher.find_all(root, "inner")] == ["wrap(tea)"]
    apart = PatternMatcher(call_pattern("wrap($A)")).find_all(shallow_tree("wrap(tea); let box = wrap(salt);\nwrap(rum)"))
    assert [flat_metavariables(m.env)["A"] for m in apart] == ["tea", "salt", "rum"]


def test_overlap_result_is_disjoint_and_maximal():
    root = shallow_tree("pack(tea(1), box(lid(2)), 3); let hold = stow(deck(4));")
    every = [Match(n, {}, len(a)) for n, a in root.walk()]
    for prefer in ("outer", "inner"):
        spans = [m.span for m in resolve_overlaps(every, prefer)]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(any(s < b and a < e for s, e in spans) for a, b in (m.span for m in every))


class Reject(Matcher):
    def match(self, node, env):
        return None


def test_combinators():
    root = shallow_tree("let pilot = hire(anna);").children[0]
    capture = PatternMatcher(compile_pattern("let pilot = hire($WHO);"))
    assert All(capture, Where(lambda n: n.start == 0)).match(root, {})["WHO"].text == "anna"
    assert All(capture, Reject()).match(root, {}) is None
    assert AnyOf(Reject(), capture).match(root, {})["WHO"].text == "anna"
    assert AnyOf(Reject(), Reject()).match(root, {}) is None
    assert Not(capture).match(root, {}) is None and Not(Reject()).match(root, {}) == {}


def test_relations():
    root = shallow_tree("let port = find(3);")
    call, above = next((n, a) for n, a in root.walk() if n.kind == "CallExpression")
    declaration = root.children[0]
    kind = lambda k: lambda n: n.kind == k
    assert relation_holds(call, above, "inside", kind("VariableDeclaration")) and not relation_holds(call, above, "inside", kind("ClassDeclaration"))
    assert relation_holds(declaration, (), "has", kind("CallExpression")) and not relation_holds(declaration, (), "has", kind("ClassDeclaration"))


def rule_texts(code, rule):
    return [m.node.text for m in RuleEvaluator(parse_rule(f"id: r\nlanguage: ts\nrule: {rule}").rule).matches(shallow_tree(code, "ts"))]


def test_rule_algebra():
    code = "let tide = read(1); wait(2);"
    assert rule_texts(code, "{kind: CallExpression}") == ["read(1)", "read(1)", "wait(2)", "wait(2)"]
    for wrapped in ("{all: [{kind: CallExpression}]}", "{any: [{kind: CallExpression}]}", "{not: {not: {kind: CallExpression}}}"):
        assert rule_texts(code, wrapped) == rule_texts(code, "{kind: CallExpression}")
    assert len(rule_texts(code, "{all: []}")) == len(list(shallow_tree(code).walk())) and rule_texts(code, "{any: []}") == []
    assert rule_texts(code, "{all: [{kind: CallExpression}, {inside: {inside: {kind: Program}}}]}") == rule_texts(code, "{all: [{kind: CallExpression}, {inside: {kind: Program}}]}")
    assert rule_texts("function watch() { ring(4); }", "{pattern: 'ring($A)'}") == []


def test_all_merges_only_equal_bindings():
    assert rule_texts("moor(bow, stern);", "{all: [{pattern: 'moor($END, stern);'}, {pattern: 'moor(bow, $END);'}]}") == []
    assert rule_texts("moor(bow, stern);", "{all: [{pattern: 'moor($END, stern);'}, {pattern: 'moor(bow, $OTHER);'}]}") == ["moor(bow, stern);"]


@pytest.mark.parametrize("body", ["{pattern: a, regex: b}", "{pattern: a, kind: b}", "{all: [], any: []}", "{what: 1}", "{all: 3}", "{pattern: 'f('}", "{regex: '(?=a)'}", "{regex: '(a)\\1'}", "3"])
def test_bad_rules(body):
    with pytest.raises(RuleError):
        parse_rule(f"id: r\nlanguage: ts\nrule: {body}")


def test_document_fields():
    with pytest.raises(RuleError):
        parse_rule("id: r\nlanguage: python\nrule: {kind: a}")
    with pytest.raises(RuleError):
        parse_rule("id: r\nrule: {kind: a}")
    assert parse_rule("id: r\nlanguage: ts\nmore: 1\nrule: {kind: a}\nfix: x").fix == "x"
    assert check_regex(r"[(?=]\w+") == r"[(?=]\w+"


def test_meta_names():
    assert all(map(is_meta_name, ("A", "_", "A_1"))) and not any(map(is_meta_name, ("", "a", "1A", "A-b")))
    roles = sorted(meta_variables(shallow_tree("tow($SHIP, $$$ROPES, $$$)")).values())
    assert roles == [("any", ""), ("multi", "ROPES"), ("single", "SHIP")]
    assert list(meta_variables(shallow_tree("tow($low, $$$low, $7, $$$7, $_UP)")).values()) == [("single", "_UP")]
    assert not meta_variables(shallow_tree("let $X = 1; let tug = fleet.$X;"))


def test_templates_and_required_words():
    assert parse_template("to $PORT[$DAY: $$$CREW] $low $$") == [("literal", "to "), ("single", "PORT"), ("literal", "["), ("single", "DAY"), ("literal", ": "), ("multi", "CREW"), ("literal", "] $low $$")]
    assert required_word(parse_rule("id: r\nlanguage: ts\nrule: {pattern: 'beacon.blink($A)'}").rule) == "beacon"
    assert required_word(parse_rule("id: r\nlanguage: ts\nrule: {any: [{kind: a}]}").rule) is None
