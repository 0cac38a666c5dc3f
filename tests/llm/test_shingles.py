"""Near copies by shingles, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thicket.llm import shingles, simhash


def near_copies() -> list[tuple[int, str]]:
    """Chains and stars of edited texts, a group of many copies, a line that is in most texts, and short ones."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    line = [word() for _ in range(12)]
    texts = [[word() for _ in range(r.choice([6, 30, 60, 200]))] for _ in range(40)]
    crowd = [word() for _ in range(90)]
    for _ in range(60):
        base = crowd if r.random() < 0.4 else r.choice(texts)
        new = list(base)
        for _ in range(r.choice([1, 1, 2, 4])):
            new[r.randrange(len(new))] = word()
        texts.append(new[: r.choice([len(new), len(new) * 9 // 10])])
    texts += [t + line for t in r.sample(texts, 30)] + [line, line[:4], line[:4], []]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def brute_components(docs: list[tuple[int, str]], width: int = 5, similarity: float = 0.8) -> list[int]:
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)} for w in (t.lower().split() for _, t in docs)]
    parent = list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(docs))]


@pytest.mark.parametrize("limit", [64, 3])
def test_similar_documents_against_brute_force(spark, limit):
    """Limit 3 sends most lists through leaders."""
    docs = near_copies()
    want = brute_components(docs)
    found = shingles.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8, limit)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(want)) and len(set(want)) < len(docs) - 30


def test_stage_drops_near_copies(spark):
    """Texts that differ in one word of a hundred: their fingerprints mostly differ in more than two bits."""
    import corpus_pipeline

    docs = near_copies()
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(docs)))
    with pytest.raises(ValueError):
        simhash.deduplicate(kept, 5)


def test_byte_links_against_brute_force(spark):
    """Fingerprints up to four bits apart meet; of a long list, all meet its least class."""
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), k)) for p in prints for k in range(7)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame(list(enumerate(signed)), "fp long, bits long")
    want = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4}
    assert len(simhash.TRIPLES) == 20 and {(r.u, r.v) for r in simhash.byte_links(classes).collect()} == want
    crowd = classes.where("bits = %d" % signed[0]).limit(1).unionByName(spark.createDataFrame([(1000 + k, signed[0] ^ 1 << k % 60 ^ 1 << k // 60) for k in range(60, 200)], "fp long, bits long"))
    assert {(1000 + k, 0) for k in range(60, 200)} <= {(r.u, r.v) for r in simhash.byte_links(crowd.withColumn("fp", F.when(F.col("fp") < 1000, 0).otherwise(F.col("fp")).cast("long")), 2).collect()}


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Without the exact search a copy with one word changed in a thousand is still found, by its fingerprint; and verified, as 0.8 is asked for."""
    import corpus_pipeline

    r = random.Random(3)
    text = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(1000)]
    docs = [(1, " ".join(text)), (2, " ".join([*text[:500], "changed", *text[501:]])), (3, " ".join(text[300:] + text[:20]))]
    monkeypatch.setattr(shingles, "_meeter", lambda *_: lambda batches: iter(()))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
