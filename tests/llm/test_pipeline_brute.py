"""Every stage of the pipeline against brute force or SQL, each on what the one before it kept."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from thicket.llm import mixing, quality
from test_shingles import brute_components

DATA = "/root/testdata/sf0.001"


def brute_cut(texts: list[str]) -> list[str]:
    """Without the bytes of repeated 400-byte strings and of repeated passages of 51 words, both judged on the input."""
    raw = [t.encode() for t in texts]
    strings = Counter(x[p : p + 400] for x in raw for p in range(len(x) - 399))
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    words = [[x[a:b] for a, b in s] for x, s in zip(raw, spans)]
    passages = Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    out = []
    for x, s, w in zip(raw, spans, words):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 399):
            if strings[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        for k in range(len(w) - 50):
            if passages[tuple(w[k : k + 51])] > 1:
                gone[s[k][0] : s[k + 50][1]] = True
        out.append(bytes(np.frombuffer(x, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def plain(text: str) -> str:
    return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "


def test_stages(spark):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda df: df.toPandas().sort_values("doc_id", ignore_index=True)

    scored = quality.score_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")).toPandas()
    good = docs.join(spark.createDataFrame(scored[scored.predicted == 1][["doc_id"]]), "doc_id", "left_semi")
    kept = rows(stages["quality"](spark, docs, DATA))
    pd.testing.assert_frame_equal(kept, rows(good.select(docs.columns)))

    frame = spark.createDataFrame(kept, docs.schema)
    first = brute_components([(k, t) for k, t in enumerate(kept.text)])
    kept = kept[[first[k] == k for k in range(len(kept))]].reset_index(drop=True)
    pd.testing.assert_frame_equal(rows(stages["near_duplicates"](spark, frame, DATA)), kept)

    frame = spark.createDataFrame(kept, docs.schema)
    got = rows(stages["repeated_strings"](spark, frame, DATA))
    kept["text"] = brute_cut(kept.text.tolist())
    kept["n_chars"] = kept.text.str.len().astype(kept.n_chars.dtype)
    pd.testing.assert_frame_equal(got, kept)

    frame = spark.createDataFrame(kept, docs.schema)
    items = [plain(t) for t in pd.read_parquet(f"{DATA}/benchmark.parquet").text]
    kept = kept[[not any(i in plain(t) for i in items) for t in kept.text]].reset_index(drop=True)
    pd.testing.assert_frame_equal(rows(stages["decontamination"](spark, frame, DATA)), kept)

    frame = spark.createDataFrame(kept, docs.schema)
    con = duckdb.connect()
    con.register("documents", kept)
    want = con.sql(mixing.ORACLE_SQL).df()
    want = want[want.taken > 0].sort_values("doc_id", ignore_index=True)
    got = rows(stages["mixing"](spark, frame, DATA))
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False)
    assert got.text.tolist() == kept.set_index("doc_id").text.loc[got.doc_id].tolist()

    pd.testing.assert_frame_equal(rows(P.run(spark, DATA)), got)


def test_mixing_looks_again_into_the_bin_of_the_end(spark):
    """A source of texts without letters, whose weights are least, and few rows that may be ordered at once."""
    docs = [(k, "1 2 3 4 5 6 7 8 9 " * (1 + k % 3), "digits") for k in range(3000)] + [(3000 + k, "some words of text here", "words") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df, weights=(1.0, 8.0)).collect()}
    again = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df.repartition(3), weights=(1.0, 8.0), crossing=5).collect()}
    assert want == again
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]))
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df, crossing=5).collect()}
    assert got == {r.doc_id: (r.size, r.taken) for r in con.sql(mixing.ORACLE_SQL).df().itertuples()}


def test_rows_that_are_equal_in_id_and_text(spark):
    """Their other columns decide, so reruns agree."""
    df = spark.createDataFrame([(1, "a b c", "s", k) for k in range(40)] + [(2, "d", "t", 0)], "doc_id long, text string, source string, mark int")
    first = sorted((r.mark, r.taken) for r in mixing.mixed_documents(df).where(F.col("doc_id") == 1).collect())
    assert first == sorted((r.mark, r.taken) for r in mixing.mixed_documents(df.repartition(7)).where(F.col("doc_id") == 1).collect())
