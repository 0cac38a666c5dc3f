"""Leaks of benchmarks of several blocks, with ids of any type, and of items that are too short."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from thicket.llm import decontaminate


def test_several_blocks_in_one_read(spark, monkeypatch):
    """Every document goes through every block, in chunks; string ids; extra columns with odd names."""
    monkeypatch.setattr(decontaminate, "CHUNK", 2000)
    r = random.Random(8)
    words = lambda n: [r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(n)]
    items = [(f"i{k}", " ".join(words(r.randint(12, 30)))) for k in range(60)] + [("one", "yes"), ("none", ""), (None, " ".join(words(14)))]
    docs, want = [], set()
    for k in range(120):
        text = words(r.randint(20, 300))
        if k % 3 == 0:
            name, leak = r.choice(items[:60])
            at = r.randrange(len(text))
            text[at:at] = leak.upper().split()
            want.add((f"d{k}", name))
        docs.append((f"d{k}", " ".join(text) + " yes"))
    docs.append((None, items[-1][1]))
    want.add((None, None))
    df = spark.createDataFrame(docs, "doc_id string, text string").withColumn("my-col", F.lit(1)).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert len(list(decontaminate.indexes(benchmark, 10))) == 7
    found = decontaminate.find_leaks(df, benchmark, block_items=10)
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    kept = decontaminate.decontaminate(df, benchmark)
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == df.columns


def test_items_of_one_word_hit_nothing(spark):
    docs = spark.createDataFrame([(1, "yes"), (2, "oh yes indeed")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "Yes!")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items).count() == 0 and decontaminate.decontaminate(docs, items).count() == 2
