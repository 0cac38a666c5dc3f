"""Script blocks of single-file components and web pages, with byte offsets into the container."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = r"<{0}(?:[ \t\r\n/][^>]*)?>"
SCRIPT = r"(?is)<script(?:[ \t\r\n/][^>]*)?>(.*?)</script>"
# The whole block, and what comes before its content.
_BLOCK_PARTS = r"(?is)(<script(?:[ \t\r\n/][^>]*)?>)(.*?)(</script>)"
# One attribute: a name (quotes belong to it), then a value if there is an equals sign.
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r=>/]*)[ \t\n\f\r]*(?:=[ \t\n\f\r]*(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*|))?""")


def has_attribute(tag: str, name: str) -> bool:
    """Whether a start tag has the attribute: quoted values don't count, a slash where a name could begin ends the search."""
    at = re.match(r"<?[A-Za-z]*", tag).end()
    while True:
        at += len(tag[at:]) - len(tag[at:].lstrip(" \t\n\f\r"))
        m = _ATTRIBUTE.match(tag, at)
        if m[1].lower() == name:
            return True
        if m.end() == at:  # at the end, a slash or the closing bracket
            return False
        at = m.end()


def is_setup_tag(tag: Column) -> Column:
    def test(tags: pa.Array) -> pa.Array:
        return pa.array([t is not None and has_attribute(t, "setup") for t in tags.to_pylist()], pa.bool_())

    return F.arrow_udf(test, T.BooleanType())(tag)


def has_block(text: Column, tag: str) -> Column:
    """Whether there is such a block, opened and closed."""
    return text.rlike("(?is)" + _OPEN.format(tag) + ".*?</" + tag + ">")


def script_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)(" + _OPEN.format("script") + ")"), F.lit(1))


def block_presence(df: DataFrame, text: str = "code") -> DataFrame:
    """Adds has_script, has_script_setup, has_template, has_style."""
    tags = F.regexp_extract_all(F.col(text), F.lit(_BLOCK_PARTS), F.lit(1))
    tagged = df.withColumns({"__n": F.size(tags), "__setup": setup_tags(tags)})
    n, setup = F.col("__n"), F.col("__setup")
    blocks = {"has_template": has_block(F.col(text), "template"), "has_style": has_block(F.col(text), "style")}
    return tagged.withColumns({"has_script": n > setup, "has_script_setup": setup > 0, **blocks}).drop("__n", "__setup")


def setup_tags(tags: Column) -> Column:
    """How many of an array of tags have the setup attribute."""

    def count(rows: pa.Array) -> pa.Array:
        return pa.array([sum(has_attribute(t, "setup") for t in row or ()) for row in rows.to_pylist()], pa.int32())

    return F.arrow_udf(count, T.IntegerType())(tags)


def script_blocks(df: DataFrame, text: str = "code") -> DataFrame:
    """A row for each script block: df's columns, block (its number), tag, content, start, end (bytes of the content in the container)."""
    code = F.col(text)
    whole, tags, contents = (F.regexp_extract_all(code, F.lit(_BLOCK_PARTS), F.lit(k)) for k in (0, 1, 2))
    # what lies between blocks: everything before block k is k gaps and k blocks
    gaps = F.split(code, _BLOCK_PARTS, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    size = lambda x: F.octet_length(x).cast("long")
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.struct(size(g).alias("g"), size(w).alias("w"))), tags, lambda s, t: F.struct(s["g"].alias("g"), s["w"].alias("w"), size(t).alias("t")))
    offsets = F.aggregate(steps, start, lambda acc, s: F.struct((acc["at"] + s["g"] + s["w"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s["g"] + s["t"])).alias("out")), lambda acc: acc["out"])
    rows = df.select("*", F.posexplode(F.arrays_zip(tags.alias("tag"), contents.alias("content"), offsets.alias("start"))).alias("block", "__b"))
    return rows.withColumns({"tag": F.col("__b.tag"), "content": F.col("__b.content"), "start": F.col("__b.start"), "end": F.col("__b.start") + size(F.col("__b.content"))}).drop("__b")


def first_script(df: DataFrame, text: str = "code") -> DataFrame:
    """df with script: struct (kind, content, start, end) of the first script block, or null; kind is script or scriptSetup. A plain projection."""
    code = F.col(text)
    tag = F.regexp_extract(code, _BLOCK_PARTS, 1)
    content = F.regexp_extract(code, _BLOCK_PARTS, 2)
    before = F.regexp_extract(code, r"(?is)^(.*?)<script(?:[ \t\r\n/][^>]*)?>.*?</script>", 1)
    start = (F.octet_length(before) + F.octet_length(tag)).cast("long")
    found = F.struct(
        F.when(is_setup_tag(tag), "scriptSetup").otherwise("script").alias("kind"), content.alias("content"), start.alias("start"), (start + F.octet_length(content)).alias("end")
    )
    return df.withColumn("script", F.when(tag != "", found))
