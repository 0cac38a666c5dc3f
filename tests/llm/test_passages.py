"""Repeated passages of over 50 words, against brute force."""

from __future__ import annotations

import random
from collections import Counter

from thicket.llm import suffix


def texts_with_passages() -> list[tuple[int, str]]:
    """Short words, passages of 50, 51 and 70 words in two texts each, one of 51 with other white space, and a text of one word only."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choice("abcdefg") for _ in range(r.choice([1, 3, 4, 6]))) for _ in range(n)]
    docs = []
    for n in (50, 51, 51, 70):
        passage = words(n)
        docs += [words(r.randrange(40)) + passage + words(30) for _ in range(2)]
    docs = [" ".join(d) for d in docs]
    spaced = words(51)
    return list(enumerate([*docs, " ".join([*words(9), *spaced, *words(5)]), "\n\t".join([*words(4), *spaced, *words(3)]), "é " * 90, " ".join(words(51)), "", " \n"]))


def test_passages_of_over_50_words_go(spark):
    import corpus_pipeline

    docs = texts_with_passages()
    seen = Counter(tuple(w[k : k + 51]) for _, t in docs for w in [t.split()] for k in range(len(w) - 50))
    want = {}
    for i, text in docs:
        w = text.split()
        gone = {k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)}
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    left = corpus_pipeline.repeated_strings(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    got = {r.doc_id: r.text for r in left.collect()}
    assert {i: t.split() for i, t in got.items()} == want and got[len(docs) - 1] == " \n"
    assert len(want[0]) == len(docs[0][1].split()) and all(len(want[k]) < len(docs[k][1].split()) for k in range(2, 11))
    assert max(len(t.encode()) for _, t in docs[2:6]) < 700 and suffix.remove_repeats(spark.createDataFrame(docs[2:6], "doc_id long, text string")).agg({"n_removed": "sum"}).first()[0] == 0


def test_few_texts_at_once(spark):
    """Cut texts are sent on for few rows at a time; a bitmap's filter gives Python the keys without the texts."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from thicket.llm import common, suffix

    texts = [f"text {k}" for k in range(1300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1300)), "text": texts})
    made = list(suffix._cutter(True)(iter([batch])))
    assert max(b.num_rows for b in made) <= suffix.CUT_ROWS and [t for b in made for t in b.column("text").to_pylist()] == texts
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    shared = common.bitmap_of(rows.where("doc_id < 5").select("key"), "key")
    inside, outside = common.held(rows, shared, "key"), common.held(rows, shared, "key", inside=False)
    assert "MapInArrow" not in inside._jdf.queryExecution().executedPlan().toString()
    assert set(range(5)) <= {r.doc_id for r in inside.collect()} and sorted(r.doc_id for r in inside.unionByName(outside).collect()) == list(range(1300))
