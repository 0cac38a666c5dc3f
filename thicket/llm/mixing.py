"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of the corpus' size by weight, no more than `max_epochs` times
its own size; what a capped source can't use is shared out again by weight. A source's
target is met by complete epochs first, then by a fractional one: its documents are ordered by
exponential keys (-ln(u) / quality weight) and taken up to the budget. The document that
crosses the budget is taken in part, so that a source's sum equals its whole target.

Distributed prefix sums: keys, as whole numbers, are binned by their leading digits; the bins are summed and accumulated, and the one bin of each source in which its
budget ends is binned again by the next digits, until it has no more than `CROSSING` rows, which are ordered one by one. So no source, however large and however
its weights lie, is collected into one task: a window sees at most some thousand bins, or the last bin's rows. The one single-task step works on one row a source.

Defined cases: null text or no words: size 0, taken 0. Null source: a source of its own, ranked last. Repeated rows: each counts; rows with equal doc_id and text
are taken in the order of a hash of their other columns. An empty table gives an empty result. Other columns are carried along untouched unless
they are named like a result column, in which case the result's replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import EXTRA, WORD, pack, quoted, stash, table, unpack

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
#: Keys lie in (0, 740); as whole numbers they are counted in units of 2 ** -UNIT. Digits that are dropped from one level of bins to the next.
UNIT = 50
LEVELS = (48, 36, 24, 12, 0)
#: Rows of a source that one task puts in order.
CROSSING = 10_000


def quality_weight(text: Column) -> Column:
    """Share of letters and spaces in the text, 0.05 at least: markup and symbol runs weigh less."""
    n = F.length(text)
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\t\n\x0B\f\r ]"))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - odd / F.greatest(n, F.lit(1))), F.lit(0.05))


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the document: 52 bits of an MD5 digest, which other engines have, too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), text))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(totals: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """totals: (source, source_size), one row a source. Adds `target` by water filling.

    With level L a source gets min(L * weight, max_epochs * size). In the order of cap / weight,
    the sources below the level are the capped ones; the first prefix whose remaining level
    lies below the next source's ratio is the solution.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_sum_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    filled = (
        ranked.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_sum_w", F.sum("_w").over(everything))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("_w"))
        .withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(everything)["_level"])
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap")))
    return filled.select("source", "source_size", target.alias("target"))


def _plan(base: DataFrame, weights: Sequence[float], max_epochs: float, crossing: int) -> DataFrame:
    """base: source, size, _units. A row a source: its target, whole epochs, what is to be taken in part (_rest), and where that ends: documents with _units
    below _low are taken once more, those from _low on and below _high in order until _rest is reached; _before is the size below _low."""
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_epochs", epochs).withColumn("_rest", F.when(F.col("source_size") > 0, whole - F.col("_epochs") * F.col("source_size")).otherwise(0))
    plan = stash(plan.withColumns({"_low": F.lit(0).cast("long"), "_high": F.lit((1 << 63) - 1), "_before": F.lit(0).cast("long"), "_rows": F.lit(0).cast("long")}))
    for level in LEVELS:
        p = plan.select(F.col("source").alias("_s"), "_low", "_high")
        open_rows = base.join(p, base["source"].eqNullSafe(F.col("_s")) & (F.col("_units") >= F.col("_low")) & (F.col("_units") < F.col("_high")))
        bins = open_rows.groupBy("source", F.shiftright("_units", level).alias("_bin")).agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
        upto = F.sum("_size").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        p = plan.select(F.col("source").alias("_s"), "_rest", "_before")
        met = bins.withColumn("_upto", upto).join(p, bins["source"].eqNullSafe(F.col("_s")))
        # the first bin by which the budget is reached
        first = met.where(F.col("_before") + F.col("_upto") >= F.col("_rest")).groupBy("_s").agg(F.min_by(F.struct("_bin", "_size", "_n", "_upto"), "_bin").alias("_b"))
        at = lambda bin_: F.call_function("shiftleft", bin_, F.lit(level))
        found = first.select("_s", at(F.col("_b._bin")).alias("_l"), at(F.col("_b._bin") + 1).alias("_h"), (F.col("_b._upto") - F.col("_b._size")).alias("_more"), F.col("_b._n").alias("_n"))
        joined = plan.join(found, plan["source"].eqNullSafe(F.col("_s")), "left")
        plan = stash(
            joined.select(
                "source", "source_size", "target", "_epochs", "_rest",
                F.coalesce("_l", "_low").alias("_low"), F.coalesce("_h", "_high").alias("_high"), (F.col("_before") + F.coalesce("_more", F.lit(0))).alias("_before"), F.coalesce("_n", F.lit(0)).alias("_rows"),
            )
        )
        if (plan.agg(F.max("_rows")).first()[0] or 0) <= crossing:
            break
    return plan


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 7, with_text: bool = False, crossing: int = CROSSING) -> DataFrame:
    """docs: doc_id, text, source, any more. Returns doc_id, source, size, source_size, target, taken, with_text: the text, and the others."""
    packed = pack(docs, "doc_id", "text", "source")
    text = F.col("text")
    carried = [c for c in ("doc_id", "source", *["text"] * with_text, EXTRA) if c in packed.columns]
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    base = packed.select(*carried, size.alias("size"), uniform(seed, F.col("doc_id"), text).alias("_u"), quality_weight(text).alias("_q"))
    base = base.withColumn("_key", -F.log("_u") / F.col("_q")).drop("_u", "_q")
    base = stash(base.withColumn("_units", F.floor(F.col("_key") * F.lit(float(1 << UNIT))).cast("long")))
    plan = _plan(base.select("source", "size", "_units"), weights, max_epochs, crossing)

    p = plan.withColumnRenamed("source", "_s")
    joined = base.join(p, base["source"].eqNullSafe(F.col("_s"))).drop("_s")
    open_row = (F.col("_units") >= F.col("_low")) & (F.col("_units") < F.col("_high")) & (F.col("size") > 0)
    settled = joined.where(~open_row).withColumn("_part", F.when(F.col("_units") < F.col("_low"), F.col("size")).otherwise(F.lit(0)))
    tie = F.xxhash64(*[F.col(EXTRA)[f.name] for f in packed.schema[EXTRA].dataType.fields if f.dataType.typeName() not in ("map", "variant")]) if EXTRA in carried else F.lit(0)
    row_order = Window.partitionBy("source").orderBy("_key", "doc_id", "size", tie).rowsBetween(Window.unboundedPreceding, -1)
    split = joined.where(open_row)
    ahead = F.col("_before") + F.coalesce(F.sum("size").over(row_order), F.lit(0))
    split = split.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - ahead)))
    both = settled.unionByName(split).withColumn("taken", (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long"))
    return unpack(both, "doc_id", *["text"] * with_text, "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of which the mix takes any words, all columns, with size, source_size, target, taken."""
    results = ("size", "source_size", "target", "taken")
    others = [c for c in docs.columns if c not in results]
    return mix(docs, with_text=True).where("taken > 0").select(*map(quoted, others), *results)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR), text)), 1, 13) AS BIGINT) AS m,
    coalesce(greatest(0.05, 1.0 - length(regexp_replace(text, '[\p{L}\t\n\x0b\f\r ]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE)), 0.05) AS q FROM documents),
k AS (SELECT *, -ln((m + 0.5) / 4503599627370496.0) / q AS key FROM d),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
c AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1] :: DOUBLE AS w, source_size * 3.0 :: DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM c WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT min(level) FILTER (cap / w = first_open) AS final FROM f, (SELECT min(cap / w) AS first_open FROM f WHERE level <= cap / w)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce(final * w, cap)) AS target FROM f, b),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - epochs * source_size - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
