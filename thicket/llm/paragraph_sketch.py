"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in built-in functions only.

A text's paragraphs are its lines, long ones in pieces of `PIECE_WORDS` words; their digests form a set. A sketch has three tables of cells, each digest goes into
one cell of each: the cell keeps a count, the digests' exclusive or, and that of their check hashes. Two versions' sketches subtract cell by cell, what both
have cancels out, and peeling recovers the rest: a cell whose check fits its digest holds one alone, which is taken out of its two other cells, and so on.

A fingerprint is the sketch with `SMALL` cells a table, in hexadecimal; it depends on the text alone. If two fingerprints don't peel to nothing, the
comparison is tried again larger: the digests are dealt into as many parts as they need, each part is a sketch of `LARGER[0]` cells a table, and a part that
still fails is tried with more cells and other positions, at last by exact set difference.
Likeness is the share of common digests among all: |A and B| / |A or B|, 1 if both have none.

`next_text` pairs every document with the one after it in descending doc_id without bringing all to one task: documents are dealt into ranges of (doc_id,
text's hash, a number of the row) by sampled quantiles, of about `RANGE_BYTES` of text each, and the first document of each range is a guest at the end of the
range before it. So documents that share one doc_id, or even all of their text, are dealt out like any others. The driver knows the ranges' bounds, some numbers a range.

Defined cases: null text is empty: no paragraphs. Ties of doc_id are ordered by the text's hash; a null doc_id comes last. A lone document is its own next.
Ids of other types than whole numbers are numbered in their order first. Extra columns are carried along unless named like a result.
Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import pack, partitions, stash, table, unit_interval, unpack

PIECE_WORDS = 12
PIECES = rf"\S+(?:[ \t]+\S+){{0,{PIECE_WORDS - 1}}}"
SMALL = 8
#: Cells of a table on the later tries; digests in a part of the second one on average.
LARGER = (8, 32, 128)
PART = 8
ROUNDS = 12
#: Text of a range, and sampled rows for each.
RANGE_BYTES = 32 << 20
SAMPLED = 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests, as an array of longs."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _place(digest: Column, k: int, cells: int, seed: int) -> Column:
    """The digest's cell in table k, numbered through all three tables."""
    source = F.xxhash64(digest, F.lit(seed)) if seed else digest
    return (F.shiftrightunsigned(source, k * 12 + 8).bitwiseAND(F.lit(cells - 1)) + k * cells).cast("int")


def _entry(digest: Column, count: Column, cells: int, seed: int) -> Column:
    """What goes into cells: the count (1 to insert, -1 to delete), digest, check hash, and its three cells."""
    return F.struct(count.alias("n"), digest.alias("k"), F.xxhash64(digest).alias("h"), *(_place(digest, k, cells, seed).alias(f"g{k}") for k in range(3)))


def _goes_to(entry: Column, i: Column) -> Column:
    return (entry["g0"] == i) | (entry["g1"] == i) | (entry["g2"] == i)


def _join(c: Column, q: Column, sign: int = 1) -> Column:
    return F.struct((c["n"] + sign * q["n"]).alias("n"), c["k"].bitwiseXOR(q["k"]).alias("k"), c["h"].bitwiseXOR(q["h"]).alias("h"))


def _sketch_of(entries: Column, cells: int) -> Column:
    """Array of 3 * cells structs (n, k, h)."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def cell(i: Column) -> Column:
        return F.aggregate(entries, empty, lambda c, q: F.when(_goes_to(q, i), _join(c, q)).otherwise(c))

    return F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), cell)


def sketch(keys: Column, cells: int, seed: int = 0) -> Column:
    """Array of 3 * cells structs (n, k, h)."""
    return _let(F.transform(keys, lambda d: _entry(d, F.lit(1), cells, seed)), lambda entries: _sketch_of(entries, cells))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _join(x, F.struct((-y["n"]).alias("n"), y["k"].alias("k"), y["h"].alias("h"))))


def signed_sketch(signed: Column, cells: int, seed: int) -> Column:
    """The difference of two sketches made in one: digests of the first version are inserted, of the second deleted."""
    return _let(F.transform(signed, lambda q: _entry(q["d"], q["n"], cells, seed)), lambda entries: _sketch_of(entries, cells))


def peel(cells: Column, size: int, seed: int = 0) -> Column:
    """Struct (ok, a, b): whether all was recovered, and how many digests each side has alone."""
    start = F.struct(cells.alias("cells"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("done"))

    def take_out(state: Column, alone: Column) -> Column:
        a = F.size(F.filter(alone, lambda q: q["n"] == 1))
        left = F.transform(state["cells"], lambda cell, i: F.aggregate(alone, cell, lambda c, q: F.when(_goes_to(q, i), _join(c, q, -1)).otherwise(c)))
        return F.struct(F.when(F.size(alone) > 0, left).otherwise(state["cells"]).alias("cells"), (state["a"] + a).alias("a"), (state["b"] + F.size(alone) - a).alias("b"), (F.size(alone) == 0).alias("done"))

    def once(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (c["h"] == F.xxhash64(c["k"]))))
        alone = F.transform(pure, lambda c: _entry(c["k"], c["n"], size, seed))
        return F.when(state["done"], state).otherwise(_let(alone, lambda x: take_out(state, x)))

    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, once, lambda s: F.struct((~left(s)).alias("ok"), s["a"].alias("a"), s["b"].alias("b")))


def _try_part(signed: Column, tries: tuple[int, ...], seed: int = 1) -> Column:
    """How many digests each side has alone: each try with more cells and other places, then exactly."""
    if not tries:
        side = lambda n: F.transform(F.filter(signed, lambda q: q["n"] == n), lambda q: q["d"])
        return F.struct(F.lit(True).alias("ok"), F.size(F.array_except(side(1), side(-1))).alias("a"), F.size(F.array_except(side(-1), side(1))).alias("b"))
    now = peel(signed_sketch(signed, tries[0], seed), tries[0], seed)
    return _let(now, lambda r: F.when(r["ok"], r).otherwise(_try_part(signed, tries[1:], seed + 1)))


def only_in_one(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    """Struct (a, b): how many digests only a, only b has. First by the fingerprints' own sketches, then larger."""
    signs = lambda x, n: F.transform(x, lambda d: F.struct(d.alias("d"), F.lit(n).alias("n")))
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    add = lambda acc, r: F.struct((acc["a"] + r["a"]).alias("a"), (acc["b"] + r["b"]).alias("b"))

    def in_parts(signed: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.size(signed) / PART).cast("int"))
        part = lambda s: _let(F.filter(signed, lambda q: F.pmod(q["d"], n) == s), lambda mine: _try_part(mine, LARGER))
        return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), zero, add)

    larger = _let(F.concat(signs(a, 1), signs(b, -1)), in_parts)
    return _let(peel(difference(small_a, small_b), SMALL), lambda r: F.when(r["ok"], F.struct(r["a"].alias("a"), r["b"].alias("b"))).otherwise(larger))


def likeness(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    def share(only: Column) -> Column:
        either = F.size(b) + only["a"]
        return F.when(either == 0, 1.0).otherwise((F.size(a) - only["a"]) / either)

    return _let(only_in_one(a, b, small_a, small_b), share)


def as_text(cells: Column) -> Column:
    digits = lambda x, n: F.lpad(F.right(F.hex(x), F.lit(n)), n, "0")
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(digits(c["n"], 4), digits(c["k"], 16), digits(c["h"], 8))), ""))


def _numbered(docs: DataFrame, order_by: str) -> tuple[DataFrame, Column]:
    """docs, and a long by which they are in the order of a column of any type; a null comes first."""
    least = F.lit(-(1 << 63))
    if isinstance(docs.schema[order_by].dataType, IntegralType):
        return docs, F.coalesce(F.col(order_by).cast("long"), least)
    ids = docs.select(F.col(order_by).alias("__value")).where("__value IS NOT NULL").distinct()
    ids = stash(ids.repartitionByRange("__value").sortWithinPartitions("__value").withColumn("__number", F.monotonically_increasing_id()))
    return docs.join(ids, F.col(order_by) == F.col("__value"), "left").drop("__value"), F.coalesce("__number", least)


def next_text(docs: DataFrame, order_by: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with next_text: the text of the document after each in descending order_by, of the first one after the last."""
    spark, columns = docs.sparkSession, docs.columns
    docs, number = _numbered(docs, order_by)
    # descending in all three: the hash's complement rises as the hash falls
    order = ["__id", "__hash", "__row"]
    keyed = docs.withColumns({"__id": number, "__hash": F.bitwise_not(F.xxhash64(text)), "__row": F.xxhash64(F.monotonically_increasing_id())})
    rows, size = keyed.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    wanted = max(1, min(rows, max(8 * partitions(spark), -(-(size or 0) // RANGE_BYTES))))
    sample = keyed.select(*order).where(unit_interval(F.lit(11), *order) < SAMPLED * wanted / max(1, rows)).orderBy(*order).collect()  # about SAMPLED rows a range
    edges = sorted({tuple(sample[k * len(sample) // wanted]) for k in range(1, wanted)}) if sample else []
    longs = lambda xs: F.expr("cast(array(" + ",".join(f"{x}L" if x > -(1 << 63) else "-9223372036854775807L - 1L" for x in xs) + ") as array<bigint>)")
    bounds = [longs([e[k] for e in edges]) for k in range(3)]

    def lies_below(k: Column) -> Column:
        """Whether edge k lies below the row."""
        (a, x), (b, y), (c, z) = ((F.get(bounds[i], k), F.col(order[i])) for i in range(3))
        return (a < x) | (a == x) & ((b < y) | (b == y) & (c < z))

    # how many edges lie below the row, by binary search
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(edges)).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda acc, step: F.when((acc + step <= len(edges)) & lies_below(acc + step - 1), acc + step).otherwise(acc))
    placed = keyed.withColumn("__range", below)
    heads = {r["__range"]: r["head"] for r in placed.groupBy("__range").agg(F.max(F.struct(*order)).alias("head")).collect()}  # one row a range
    filled = sorted(heads)
    above = {k: filled[(i + 1) % len(filled)] for i, k in enumerate(filled)}
    ranges = range(len(edges) + 1)
    is_head = reduce(and_, (F.col(c) == F.get(longs([heads[k][i] if k in heads else 0 for k in ranges]), F.col("__range")) for i, c in enumerate(order)))
    target = F.get(longs([above.get(k, 0) for k in ranges]), F.col("__range")).cast("int")
    at = lambda r, guest: F.struct(r.alias("r"), F.lit(guest).alias("guest"))
    dealt = placed.withColumn("__at", F.explode(F.when(is_head, F.array(at(F.col("__range"), False), at(target, True))).otherwise(F.array(at(F.col("__range"), False)))))
    dealt = dealt.withColumns({"__range": F.col("__at.r"), "__guest": F.col("__at.guest")})
    following = F.lead(text).over(Window.partitionBy("__range").orderBy("__guest", *map(F.desc, order)))
    return dealt.withColumn("next_text", following).where(~F.col("__guest")).select(*columns, "next_text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, any more. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the others but text."""
    rows = next_text(pack(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    text, following = F.col("text"), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
    rows = rows.withColumns({"n_chars": F.length(text).cast("long"), "edited": edited})
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "own": digests(text), "changed": digests(F.col("edited")), "other": digests(following)}).drop("text", "next_text", "edited")
    rows = rows.withColumns({f"{c}_cells": sketch(F.col(c), SMALL) for c in ("own", "changed", "other")})
    own, changed, other = (F.col(c) for c in ("own", "changed", "other"))
    rows = rows.withColumns(
        {
            "fingerprint": as_text(F.col("own_cells")),
            "edited_fingerprint": as_text(F.col("changed_cells")),
            "near_edited": likeness(own, changed, F.col("own_cells"), F.col("changed_cells")),
            "near_next": likeness(own, other, F.col("own_cells"), F.col("other_cells")),
        }
    )
    return unpack(rows, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
