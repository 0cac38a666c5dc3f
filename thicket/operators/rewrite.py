"""Rewriting as Columns: fix templates, edit checks, trivia absorption, splicing. Spans are UTF-8 bytes.

An edit is a struct (start, end, replacement, absorb). All edits of a text are one array, so a file is one row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text_ops import on_boundary
from ..plans.rules import parse_template

EDIT = "struct<start:bigint,end:bigint,replacement:string,absorb:boolean>"


def edit(start: Column, end: Column, replacement: Column, absorb: Column | bool = False) -> Column:
    absorb = F.lit(absorb) if isinstance(absorb, bool) else absorb
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), replacement.alias("replacement"), absorb.alias("absorb"))


def render(fix: str, single: Column, multi: Column) -> Column:
    """A fix template filled in. single: map name -> text, multi: map name -> array of texts, joined without separator.
    $A takes a multi capture if there is no single one; unbound placeholders stay as they are."""
    parts = []
    for kind, value in parse_template(fix):
        if kind == "literal":
            parts.append(F.lit(value))
            continue
        several = F.array_join(F.element_at(multi, value), "")
        parts.append(F.coalesce(F.element_at(single, value), several, F.lit(f"${value}")) if kind == "single" else F.coalesce(several, F.lit(f"$$${value}")))
    return F.concat(*parts) if parts else F.lit("")


def _span(s: Column) -> Column:
    return F.concat(F.lit("["), s["start"].cast("string"), F.lit(", "), s["end"].cast("string"), F.lit(")"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def edit_error(code: Column, edits: Column) -> Column:
    """The first fault of the edits in their order, then the first overlap in source order; null if there is none."""
    n = F.octet_length(code)

    def fault(e: Column) -> Column:
        return (
            F.when(e["start"] > e["end"], F.concat(F.lit("Invalid span range: start ("), e["start"].cast("string"), F.lit(") > end ("), e["end"].cast("string"), F.lit(")")))
            .when(e["end"] > n, F.concat(F.lit("Span "), _span(e), F.lit(" is out of bounds for source length "), n.cast("string")))
            .when(~on_boundary(code, e["start"]) | ~on_boundary(code, e["end"]), F.concat(F.lit("Span "), _span(e), F.lit(" does not align to UTF-8 char boundary")))
        )

    faults = F.filter(F.transform(edits, fault), lambda m: m.isNotNull())
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    clash = F.filter(pairs, lambda p: overlaps(p["a"], p["b"]))
    message = F.transform(clash, lambda p: F.concat(F.lit("Overlapping spans detected: "), _span(p["a"]), F.lit(" and "), _span(p["b"])))
    return F.coalesce(F.get(faults, 0), F.get(message, 0))


def mismatch_error(code: Column, diffs: Column) -> Column:
    """diffs: array of (start, end, original, replacement). The first whose original isn't what the code has there."""
    raw = F.encode(code, "UTF-8")
    wrong = F.filter(diffs, lambda d: F.substring(raw, (d["start"] + 1).cast("int"), (d["end"] - d["start"]).cast("int")) != F.encode(d["original"], "UTF-8"))
    return F.get(F.transform(wrong, lambda d: F.concat(F.lit("Source text does not match expected original content at span "), _span(d))), 0)


def resolve_edits(code: Column, edits: Column) -> Column:
    """The edits in source order. Empty replacements that absorb take in the blanks around them and one line end, up to their neighbours."""
    raw, n = F.encode(code, "UTF-8"), F.octet_length(code).cast("long")
    piece = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    ordered = F.array_sort(edits)
    rights = F.concat(F.transform(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda e: e["start"]), F.array(n))
    limited = F.zip_with(ordered, rights, lambda e, r: F.struct(e.alias("e"), r.alias("right")))
    start = F.struct(F.lit(0).cast("long").alias("left"), F.array().cast(f"array<{EDIT}>").alias("out"))

    def settle(acc: Column, x: Column) -> Column:
        e, left, right = x["e"], acc["left"], x["right"]
        absorb = e["absorb"] & (e["replacement"] == "")
        before = F.octet_length(F.regexp_extract(piece(left, e["start"]), r"(?U)([^\S\r\n]*)\z", 1))
        after = F.octet_length(F.regexp_extract(piece(e["end"], right), r"(?U)^([^\S\r\n]*(?:\r\n|[\r\n])?)", 1))
        a = F.greatest(F.when(absorb, e["start"] - before).otherwise(e["start"]), left)
        b = F.least(F.greatest(F.when(absorb, e["end"] + after).otherwise(e["end"]), a), right)
        return F.struct(b.alias("left"), F.concat(acc["out"], F.array(edit(a, b, e["replacement"], e["absorb"]))).alias("out"))

    return F.when(F.size(edits) == 0, F.array().cast(f"array<{EDIT}>")).otherwise(F.aggregate(limited, start, settle, lambda acc: acc["out"]))


def splice(code: Column, resolved: Column) -> Column:
    """The code with resolved edits (in order, disjoint) in place."""
    raw = F.encode(code, "UTF-8")
    piece = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], e["start"]), e["replacement"])).alias("out"))
    return F.aggregate(resolved, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), piece(acc["at"], F.octet_length(code).cast("long"))))


def apply_edits(code: Column, edits: Column) -> Column:
    """Struct (updated, error): the edited code, or why it can't be edited (updated is null then)."""
    error = edit_error(code, edits)
    return F.struct(F.when(error.isNull(), splice(code, resolve_edits(code, edits))).alias("updated"), error.alias("error"))


def edit_diffs(code: Column, edits: Column) -> Column:
    """Array of (start, end, original, replacement) in the order of the edits; null if the edits are faulty."""
    raw = F.encode(code, "UTF-8")
    original = lambda e: F.decode(F.substring(raw, (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int")), "UTF-8")
    diffs = F.transform(resolve_edits(code, edits), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), original(e).alias("original"), e["replacement"].alias("replacement")))
    # resolved edits are in source order; the k-th of them is the edit of this number
    numbered = F.array_sort(F.transform(edits, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"), e["absorb"].alias("absorb"), i.alias("i"))))
    given = F.array_sort(F.zip_with(numbered, diffs, lambda e, d: F.struct(e["i"].alias("i"), d.alias("d"))))
    return F.when(edit_error(code, edits).isNull(), F.transform(given, lambda p: p["d"]))


def apply_diffs(code: Column, diffs: Column) -> Column:
    """Struct (updated, error): diffs checked against the code first."""
    edits = F.transform(diffs, lambda d: edit(d["start"], d["end"], d["replacement"]))
    error = F.coalesce(edit_error(code, edits), mismatch_error(code, diffs))
    return F.struct(F.when(error.isNull(), splice(code, F.array_sort(edits))).alias("updated"), error.alias("error"))
