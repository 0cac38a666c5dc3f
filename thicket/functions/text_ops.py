"""Text, offset and path functions as Columns. Offsets are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIVIA = r"(?sU)//[^\n]*\n?|/\*.*?(?:\*/|\z)|\s"
#: What a relative import may stand for, in order of preference.
CANDIDATE_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def normalize_text(text: Column) -> Column:
    """Without comments and white space; blind to string literals."""
    return F.regexp_replace(text, TRIVIA, "")


def normalize_signature(text: Column) -> Column:
    return F.substring_index(normalize_text(text), "{", 1)


def is_ignorable(text: Column) -> Column:
    return normalize_text(text) == ""


def content_hash(code: Column) -> Column:
    return F.xxhash64(code)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in bytes, as a string; null if the span is invalid or cuts a character."""
    raw = F.encode(text, "UTF-8")
    inside = (start >= 0) & (start <= end) & (end <= F.octet_length(text))
    return F.when(inside & on_boundary(text, start) & on_boundary(text, end), F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8"))


def on_boundary(text: Column, offset: Column) -> Column:
    """Whether a byte offset lies between characters."""
    return (offset == F.octet_length(text)) | ~F.hex(F.substring(F.encode(text, "UTF-8"), (offset + 1).cast("int"), F.lit(1))).rlike("^[89AB]")


def prefix(text: Column, offset: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a byte offset."""
    before = prefix(text, offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(text: Column, offset: Column) -> Column:
    """Bytes between the line's start and a byte offset."""
    return F.octet_length(F.substring_index(prefix(text, offset), "\n", -1)).cast("long")


def line_starts(text: Column) -> Column:
    """Array of the byte offsets at which lines start."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.octet_length(x).cast("long") + 1)
    return F.aggregate(F.slice(lines, 1, F.size(lines) - 1), F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def to_absolute(offset: Column, block_start: Column, block_end: Column) -> Column:
    """An offset in a block -> in its container; null outside."""
    return F.when((offset >= 0) & (offset <= block_end - block_start), offset + block_start)


def to_relative(offset: Column, block_start: Column, block_end: Column) -> Column:
    return F.when((offset >= block_start) & (offset <= block_end), offset - block_start)


def normalize_path(path: Column) -> Column:
    """Without empty parts and dots; .. takes away a part, never the root; backslashes become slashes."""
    parts = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, c: F.when(c == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(c))))
    return F.replace(F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/")), F.lit("\\"), F.lit("/"))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def import_candidates(file_path: Column, source: Column) -> Column:
    """Array of the paths that a relative import may stand for; empty for other imports."""
    parent = parent_path(file_path)
    joined = normalize_path(F.when(parent == "", source).otherwise(F.concat(parent, F.lit("/"), source)))
    return F.when(source.startswith("."), F.array(*[F.concat(joined, F.lit(s)) for s in CANDIDATE_SUFFIXES])).otherwise(F.array().cast("array<string>"))


def should_analyze(path: Column) -> Column:
    return path.rlike(r"\.(ts|js|tsx|jsx)$")


def issues_comment(issues: Column, title: str = "Issues") -> Column:
    """A comment block that lists the messages of issues (array of structs); null if there are none."""
    lines = F.transform(issues, lambda i: F.concat(F.lit(" * - "), i["message"]))
    return F.when(F.size(issues) > 0, F.concat(F.lit(f"\n/* {title}:\n"), F.array_join(lines, "\n"), F.lit("\n */")))


def annotate(code: Column, issues: Column, title: str = "Issues") -> Column:
    """The code, with its issues as a comment at its end."""
    return F.concat(code, F.coalesce(issues_comment(issues, title), F.lit("")))
