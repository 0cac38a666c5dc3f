"""Overlap resolution as Columns, for spans that are already in tables or arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rewrite import overlaps


def resolve_spans(spans: Column, prefer: str = "outer") -> Column:
    """spans: array of structs with start and end. Greedy choice, longest first (outer) or shortest first (inner), of spans that don't overlap; in source order."""
    sign = -1 if prefer == "outer" else 1
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((sign * (s["end"] - s["start"])).alias("rank"), s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own = lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))
    kept = F.aggregate(ranked, none, lambda acc, s: F.when(F.exists(acc, lambda t: overlaps(t, s)), acc).otherwise(F.concat(acc, F.array(own(s)))))
    return F.array_distinct(F.array_sort(kept))


def outermost(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """For nested spans in rows, the outer choice by one window: a span is kept if none before it reaches beyond its start."""
    before = Window.partitionBy(key).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    return df.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("__reach") <= F.col(start))).drop("__reach")
