"""The next document in descending order, whatever the ids are and however many share one."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from thicket.llm import paragraph_sketch


def brute(rows: list[tuple]) -> Counter:
    """(id, text, next text) of each row; ties in the order of the texts' hashes, as given."""
    ordered = sorted(rows, key=lambda r: ((r[0] is None), [-ord(c) for c in str(r[0])] if isinstance(r[0], str) else -(r[0] or 0), r[2]))
    # shorter strings that begin longer ones come after them in descending order
    if any(isinstance(r[0], str) for r in rows):
        ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[2])
        ordered = sorted(ordered, key=lambda r: r[0], reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: r[2])
    return Counter((a[0], a[1], b[1]) for a, b in zip(ordered, ordered[1:] + ordered[:1]))


def check(spark, rows: list[tuple], kind: str):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    hashed = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = Counter((r.doc_id, r.text, r.next_text) for r in paragraph_sketch.next_text(df).collect())
    assert got == brute(hashed)


def test_one_id_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "RANGE_BYTES", 2000)
    rows = [(7, f"text {k}") for k in range(4000)] + [(7, "same")] * 3000 + [(k, f"other {k}") for k in range(1000)] + [(None, "none"), (None, "no id")]
    check(spark, rows, "long")


def test_ids_of_other_types(spark):
    check(spark, [(f"id-{k % 90}", f"text {k}") for k in range(300)] + [(None, "x"), ("", "y")], "string")
    check(spark, [(float(k % 50) / 4, f"text {k}") for k in range(100)], "double")


def test_hot_ids_are_dealt_out(spark, monkeypatch):
    """All rows have one id and text, and yet the ranges are of about one size."""
    monkeypatch.setattr(paragraph_sketch, "RANGE_BYTES", 1000)
    df = spark.createDataFrame([(1, "aaaa")] * 20_000, "doc_id long, text string").repartition(4)
    window = paragraph_sketch.Window.partitionBy
    seen = []
    monkeypatch.setattr(paragraph_sketch.Window, "partitionBy", staticmethod(lambda *by: seen.append(by) or window(*by)))
    dealt = paragraph_sketch.next_text(df)
    assert seen == [("__range",)] and dealt.count() == 20_000
    plan = dealt._jdf.queryExecution().optimizedPlan()
    while "Window" not in plan.nodeName():
        plan = plan.children().head()
    ranges = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().head())
    sizes = [r.getLong(1) for r in ranges.groupBy("__range", spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)).count().collectAsList()]
    assert len(sizes) > 40 and max(sizes) < 3000


def test_conversations_with_ids_of_text(spark):
    from thicket.llm import chat

    rows = [(f"c{k % 7}", k, "user" if k % 2 else "assistant", f"turn {k} <|x|>") for k in range(60)] + [(None, 0, "user", None), ("", 1, None, "é")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.summarize_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))).collect()}
    want = {}
    for c, _, role, text in rows:
        n, loss = want.get(c, (0, 0))
        want[c] = (n + 1, loss + (len(text or "") if role == "assistant" else 0))
    assert got == want
