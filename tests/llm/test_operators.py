"""Each operator against a brute-force version on small tables, and its defined cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from thicket.llm import chat, decontaminate, graph, html_extract, language, mixing, paragraph_sketch, quality, simhash, suffix, url_filter
from thicket.llm.dom_training import labelled_pages

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside: extra columns of these names must travel unharmed.
CLASHING = ("_key", "size", "fp", "text_hash", "key", "cuts", "score", "__extra", "next_text", "gram", "my-col", "a b", "x:y", "back`tick", "dot.ted")


def read(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def odd_documents(spark, extra: bool = False):
    """Nulls everywhere, empty and white texts, repeated rows, ties, a very long text."""
    r = random.Random(3)
    words = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(20_000)]
    long_text = " ".join(words)
    base = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", "a", 3),
        (4, "one two three four five six", "en", "b", 27),
        (4, "one two three four five six", "en", "b", 27),
        (5, "one two three four five six", None, "c", 27),
        (4, "other text under the same id", "en", "b", 28),
        (None, "no id here at all", "en", None, 17),
        (6, long_text, "en", "a", len(long_text)),
        (7, long_text + " end", "de", "a", len(long_text) + 4),
        (8, "é" * 500 + "\n" + "ß" * 700, "de", "d", 1201),
        (9, "aaaa" * 400, None, "d", 1600),
    ]
    df = spark.createDataFrame(base, SCHEMA)
    return df.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING)) if extra else df


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 ---------------------------------------------------------------------------------------------------------------------------


def article_text(page: str) -> str:
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    plain = lambda b: html.unescape(re.sub(r"<br>", " ", re.sub(r"<(?!br)[^>]*>", "", b)))
    blocks = [" ".join(plain(b).split()) for b in re.split(r"</?(?:h1|p)\b[^>]*>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_main_text_of_every_page(spark):
    got = html_extract.op1_main_text(spark, DATA).toPandas().set_index("page_id")
    pages = read("pages")
    assert len(got) == len(pages)
    for p in pages.itertuples():
        assert got.loc[p.page_id].text == article_text(p.html) and got.loc[p.page_id].n_chars == len(article_text(p.html))


def test_node_classifier_on_pages_it_has_not_seen():
    model, right, total = html_extract.trained_model(), 0, 0
    for page in labelled_pages(60, seed=977):
        forest = html_extract.Forest()
        forest.add_page(page)
        a = forest.arrays()
        label = a["label"].tolist()
        for k, p in enumerate(a["parent"].tolist()):
            if label[k] < 0 and p >= 0 and label[p] >= 0:
                label[k] = label[p]
        kept = html_extract.decode(a, model.logits(a))
        assert all(kept[p] for k, p in enumerate(a["parent"]) if p >= 0 and kept[k])
        for node, text in forest.runs:
            if node >= 0 and text and text.strip():
                total += len(text)
                right += len(text) * (bool(kept[node]) == (label[node] == 1))
    assert right / total > 0.97


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(max(0, k - 2), k)) for k in range(1, n)]
        order = sorted(range(n), key=lambda k: _path(parent, k))
        rank = {k: i for i, k in enumerate(order)}
        parent = [rank.get(parent[k], -1) for k in order]
        depth = [0] * n
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        a = {"parent": np.array(parent), "depth": np.array(depth), "end": html_extract.subtree_ends(np.array(depth))}
        z = rng.normal(0, 2, n)
        gain = lambda keep: sum(-np.log1p(np.exp(-z[k])) if keep[k] else -np.log1p(np.exp(z[k])) for k in range(n))  # noqa: B023, E731
        best = max(gain(keep) for bits in range(1 << n) if (keep := [bits >> k & 1 for k in range(n)])[0] and all(keep[parent[k]] or not keep[k] for k in range(1, n)))
        assert gain(html_extract.decode(a, z)) == pytest.approx(best)


def _path(parent, k):
    out = []
    while k >= 0:
        out.append(k)
        k = parent[k]
    return out[::-1]


def test_main_text_cases(spark):
    rows = [
        (1, None, None), (2, "u", ""), (3, "u", "just text &amp; more"), (4, "u", "<p>unclosed <b>bold<p>second&nbsp;one<script>x</p>"),
        (5, "u", "<body><nav><a href=x>m</a></nav><article><h1>T</h1><p>one\n two<p>three</article><footer>f</footer>"), (5, "u", "<body><article><p>a < b</p></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("node", F.lit(1))
    got = [(r.page_id, r.text, r.node) for r in html_extract.extract_main_text(df).collect()]
    assert (1, "", 1) in got and (2, "", 1) in got and (5, "T\n\none two\n\nthree", 1) in got and (5, "a < b", 1) in got
    assert html_extract.extract_main_text(df.where("false")).count() == 0
    model = html_extract.trained_model()
    assert html_extract.extract_texts(["<body><p>Some words here, and more of them.</p><p>A second paragraph, with as many words.</p></body>"], model) == ["Some words here, and more of them.\n\nA second paragraph, with as many words."]
    assert html_extract.extract_texts(["<body><nav><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul></nav><footer>Copyright</footer></body>"], model) == [""]


# -- 2 ---------------------------------------------------------------------------------------------------------------------------


def brute_repeats(texts: list[str | None]) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for x in raw:
        for p in range(len(x) - 399):
            seen[x[p : p + 400]] = seen.get(x[p : p + 400], 0) + 1
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - 399):
            if seen[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        gone = gone[: len(x)]
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return out


def check_repeats(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, with_text=False).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts)


def test_repeats_of_the_given_documents(spark):
    docs = read("documents")
    got = suffix.op2_suffix_dedup(spark, DATA).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute_repeats(docs.text.tolist())


def test_repeats_at_their_edges(spark):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    core, twin = noise(450), noise(700)
    texts = [noise(300) + core + noise(300), noise(80) + core + noise(10), core[:399], core[20:421], "ab" * 600, "xyz" + "ab" * 500, twin, twin, twin[:350] + "!" + twin[350:], noise(900), None, "", "é" * 300]
    texts += [noise(k) + core[: 380 + k] for k in range(1, 60, 7)]
    check_repeats(spark, texts)


def test_repeats_within_a_small_segment(spark, monkeypatch):
    """Texts longer than a segment are worked on in overlapping parts."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    data = [noise(5000), noise(3000)]
    data.append(data[0][1000:4500] + noise(2000) + data[1][100:900])
    whole = suffix.find_runs
    monkeypatch.setattr(suffix, "SEGMENT", 2048)
    parts = list(suffix._segments(__import__("pyarrow").array([d.encode() for d in data]), suffix.BYTES, suffix.BYTES.reader()))
    assert whole is suffix.find_runs and sum(len(p[1]) for p in parts) > 8
    covered = {k: set() for k in range(3)}
    for _, owner, ends, offset in parts:
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            covered[owner[k]] |= set(range(offset[k], offset[k] + (b - a) - 399))
    assert [len(covered[k]) for k in range(3)] == [len(d) - 399 for d in data]


def test_repeats_cases(spark):
    got = suffix.remove_repeats(odd_documents(spark, extra=True)).collect()
    assert len(got) == 12 and {r.key for r in got} == {r.key for r in odd_documents(spark, extra=True).collect()}
    by_id = {r.doc_id: r for r in got if r.doc_id not in (4,)}
    assert by_id[6].text == "" and by_id[7].text == " end" and by_id[9].text == "" and by_id[1].n_bytes == 0
    assert suffix.remove_repeats(empty_documents(spark)).count() == 0


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 20_000).astype(np.uint32) for _ in range(4)]
    order = suffix.multikey_quicksort(keys, small=50)
    rows = list(zip(*(k[order].tolist() for k in keys)))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(20_000))


# -- 3 ---------------------------------------------------------------------------------------------------------------------------


def pieces(text: str) -> set[str]:
    return set(re.findall(r"\S+(?:[ \t]+\S+){0,11}", text, re.A))


def test_paragraph_sketches(spark):
    docs = read("documents").sort_values("doc_id", ascending=False)
    got = paragraph_sketch.op3_paragraph_sketch(spark, DATA).toPandas().set_index("doc_id")
    texts = docs.text.tolist()
    likeness = lambda a, b: len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b)) if pieces(a) | pieces(b) else 1.0
    for doc_id, text, after in zip(docs.doc_id, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got.loc[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(text, edited)) and r.near_next == pytest.approx(likeness(text, after))
    prints = docs.assign(f=got.loc[docs.doc_id].fingerprint.to_numpy()).groupby("text").f.nunique()
    assert prints.max() == 1 and (got.near_edited > got.near_next).mean() > 0.9


def test_peeling_recovers_or_says_so(spark):
    rng = random.Random(1)
    for n in (0, 1, 5, 9, 60):
        a, b, both = ({rng.getrandbits(60) for _ in range(n)} for _ in range(3))
        df = spark.createDataFrame([(list(a | both), list(b | both))], "a array<long>, b array<long>")
        diff = paragraph_sketch.difference(paragraph_sketch.sketch(F.col("a"), 8), paragraph_sketch.sketch(F.col("b"), 8))
        r = df.select(paragraph_sketch.peel(diff, 8).alias("r")).first().r
        assert not r.ok and n > 5 or (r.a, r.b) == (n, n)
        whole = df.select(paragraph_sketch.only_in_one(F.col("a"), F.col("b"), paragraph_sketch.sketch(F.col("a"), 8), paragraph_sketch.sketch(F.col("b"), 8)).alias("r")).first().r
        assert (whole.a, whole.b) == (n, n)


def test_paragraph_sketch_cases(spark):
    got = paragraph_sketch.fingerprint_edits(odd_documents(spark, extra=True)).collect()
    assert len(got) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 3)}) == 1 and {r.n_chars for r in got if r.doc_id == 1} == {0}
    assert paragraph_sketch.fingerprint_edits(empty_documents(spark)).count() == 0
    lone = paragraph_sketch.fingerprint_edits(odd_documents(spark).where("doc_id = 8")).first()
    assert lone.near_next == 1.0
    ordered = paragraph_sketch.next_text(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))).collect()
    assert {(r.doc_id, r.next_text) for r in ordered} == {(k, str((k - 1) % 50)) for k in range(50)}


# -- 4 and 5 -----------------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    got = language.op4_language(spark, d).toPandas().merge(docs)
    assert ((got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5) == 0) == got.held_out).all()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_gradients_are_those_of_the_loss():
    net, rng = language.Network(["a", "b", "c"]), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (3, 4)).astype(np.uint8), np.array([0, 2, 1])
    loss = lambda: -np.mean([np.log(net.labels(x)[t, k, y[k]]) for t in range(4) for k in range(3)])
    grads = net.gradients(x, y)
    for name in ("out", "bias", "rec_f", "rec_b"):
        at = (1,) * net.p[name].ndim
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        slope = (up - loss()) / (2 * step)
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx(slope, abs=2e-4)


def test_language_cases(spark):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd_documents(spark, extra=True)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert {r.lang_pred for r in language.identify(odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(empty_documents(spark)).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, d).toPandas()
    assert ((got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 4) == 2) == got.held_out).all()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    m = got.merge(pd.read_parquet(f"{d}/labels.parquet"))
    m = m[m.held_out]
    assert (m.quality == m.predicted).mean() > 0.95
    good, bad = m[m.quality == 1].score.to_numpy(), m[m.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97


def test_quality_cases(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (6, 1), (None, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    got = quality.score_quality(odd_documents(spark, extra=True), labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty_documents(spark), labels).count() == 0
    unknown = quality.score_quality(odd_documents(spark), labels.where("false")).collect()
    assert {(round(r.score, 9), r.predicted) for r in unknown} == {(quality.UNKNOWN, 1)}
    kept = quality.keep_good(odd_documents(spark, extra=True), labels)
    assert set(kept.columns) == set(odd_documents(spark, extra=True).columns)


# -- 6 and 7 -----------------------------------------------------------------------------------------------------------------------


def brute_verdict(url, weights, bias):
    host, path = url_filter.split_url(url)
    hits = [(len(h + p), kind == "allow", h + p, kind) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if hits:
        return host, path, max(hits)[2], max(hits)[3]
    grams = url_filter.gram_buckets(host, path)
    z = bias + sum(weights[g] for g in grams) / max(1, len(grams)) ** 0.5
    return host, path, None, "block" if z >= 0 else "allow"


def test_url_filter(spark):
    weights, bias = url_filter.train(url_filter.LABELLED)
    urls = read("pages").url.tolist() + [None, "", "no scheme", "HTTP://A.Example.NET/EN/x", "http://example.net/en/", "http://x.org/fr/a", "http://net", "http://É.net/ü?x#y", "a://b://c/d", "http://example.com?/de/", "http://www.casino-win.test/de/1", "http://library.test/en/2", "x://a.net/\n/b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("verdict_", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert [got[k] for k in range(len(urls))] == [brute_verdict(u, weights, bias) for u in urls]
    assert got[len(urls) - 3][3] == "block" and got[len(urls) - 2][3] == "allow" and url_filter.filter_urls(df.where("false")).count() == 0


def test_chat_format_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{DATA}/conversations.parquet'")
    want = duckdb.sql(chat.ORACLE_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = chat.op7_chat_format(spark, DATA).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got.equals(want[got.columns]) and got.conv_id[0] == -1


def test_chat_round_trip(spark):
    rows = [(None, None, None, None), (1, 1, "assistant", "a\\<|\n\\n<|im_end|>\n"), (1, 1, "assistant", "a\\<|\n\\n<|im_end|>\n"), (1, 0, "us\ner\\", "é" * 5), (1, None, "user", ""), (2, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    turns: dict = {}
    for b in chat.format_chats(df).collect():
        for m in chat.TURN.finditer(bytes(b.formatted)):
            turns.setdefault(b.conv_id, []).append((chat.unescape(m[1]).decode(), chat.unescape(m[2]).decode()))
        for s, e in zip(b.loss_starts, b.loss_ends):
            assert chat.unescape(bytes(b.formatted)[s:e]).decode() in (rows[1][3], rows[5][3])
    assert turns == {None: [("", "")], 1: [("user", ""), ("us\ner\\", "é" * 5), rows[1][2:], rows[1][2:]], 2: [rows[5][2:]]}
    assert chat.summarize_chats(chat.format_chats(df.where("false"))).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], ids: list) -> list:
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least: dict = {}
    for k, i in enumerate(ids):
        c = find(k)
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(find(k)) for k in range(len(prints))]


def test_simhash(spark):
    docs = read("documents")
    got = simhash.op8_simhash(spark, DATA).toPandas().set_index("doc_id").loc[docs.doc_id]
    prints = [brute_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints] and got.component_id.tolist() == brute_components(prints, docs.doc_id.tolist())


@pytest.mark.parametrize("limit", [64, 1])
def test_links_connect_exactly(spark, limit):
    """Chains, hot posting lists and far pairs; limit 1 sends every shared list through the hubs."""
    rng = random.Random(8)
    prints = {0}
    while len(prints) < 300:
        p = rng.choice([*prints]) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3])):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), limit)
    got = {r.u: r.component for r in graph.connected_components(links).collect()}
    assert [got.get(p, p) for p in signed] == brute_components([p & (2**64 - 1) for p in signed], signed)


def test_simhash_pieces_and_cases(spark, monkeypatch):
    text = ("Alpha beta\tGAMMA delta  " * 3000).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert simhash.fingerprint(text) == whole and simhash.fingerprint(b"a b") == xxhash.xxh64_intdigest(b"a b", 42)
    got = simhash.near_duplicates(odd_documents(spark, extra=True)).collect()
    assert len(got) == 12 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.text_hash == [g for g in got if g.doc_id == 5][0].text_hash} == {4}
    kept = simhash.deduplicate(odd_documents(spark, extra=True)).collect()
    assert len(kept) == len({r.component_id for r in got}) + sum(r.component_id is None for r in got and {g.fp: g for g in got if g.component_id is None}.values()) - (None in {r.component_id for r in got})
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0 and simhash.deduplicate(empty_documents(spark)).count() == 0


# -- 9 and 10 ----------------------------------------------------------------------------------------------------------------------


def test_leaks_of_the_given_documents(spark):
    plain = lambda t: " ".join(["", *re.findall(r"[^\W_]+", t.lower()), ""])
    docs, items = read("documents"), read("benchmark")
    texts = [(i, plain(t)) for i, t in zip(docs.doc_id, docs.text)]
    want = {(i, k) for k, t in zip(items.item_id, items.text) for i, x in texts if plain(t) in x}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9_decontaminate(spark, DATA).collect()}
    assert got == want


def test_wand_equals_exhaustive_scoring():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for k in range(70)]
    idf = {w: 1.0 + rng.random() for w in vocabulary}
    index = decontaminate.Index.build(items, idf, 15.0)
    for _ in range(40):
        terms = {index.words[w] for w in rng.sample(vocabulary, 25) if w in index.words}
        scores: dict[int, float] = {}
        for t in terms:
            for k, g in index.postings[t]:
                scores[k] = scores.get(k, 0) + g
        want = {k for k, s in scores.items() if s >= 0.5}
        words = np.array(sorted(terms))
        blocks = decontaminate.blocks_within_reach(index, np.zeros(len(words), np.int64), words, 0.5).get(0, [])
        assert {k for k, _ in decontaminate.wand(index, terms, blocks, 0.5)} == want


def test_leak_cases(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    question, answer, short = words(20), words(20), "tiny item"
    items = spark.createDataFrame([(1, f"{question}\n{answer}"), (2, short), (3, ""), (4, None), (1, f"{question}\n{answer}")], "item_id long, text string")
    filler = words(400)
    docs = [(1, f"{filler} {question.upper()}, {answer} {filler}"), (2, f"{filler} {question} {filler}"), (3, f"x Tiny   ITEM y"), (4, None), (5, ""), (6, filler), (7, f"{question} {answer}"), (7, f"{question} {answer}"), (None, f"{question} {answer}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = decontaminate.find_leaks(df, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (3, 2), (7, 1), (None, 1)}
    in_blocks = decontaminate.find_leaks(df, items, block_items=2)
    assert {(r.doc_id, r.item_id) for r in in_blocks.collect()} == {(1, 1), (3, 2), (7, 1), (None, 1)}
    assert {r.doc_id for r in decontaminate.decontaminate(df, items).collect()} == {2, 4, 5, 6}
    assert decontaminate.find_leaks(df.where("false"), items).count() == 0 and decontaminate.find_leaks(df, items.where("false")).count() == 0


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in names}
        capped |= over


def check_mix(rows):
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    taken: dict = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.size * int(round(r.target) // max(1, r.source_size)) <= r.taken <= 3 * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in zip(read("documents").doc_id, read("documents").text)}
    check_mix(rows)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())


def test_mix_cases(spark):
    rows = mixing.mix(odd_documents(spark, extra=True)).collect()
    assert len(rows) == 12 and "key" in rows[0]
    check_mix(rows)
    uneven = spark.createDataFrame([(k, "w " * (1 if k < 3 else 50), ["a", "b", None][min(k, 2)]) for k in range(40)], "doc_id long, text string, source string")
    check_mix(mixing.mix(uneven).collect())
    check_mix(mixing.mix(uneven.where("doc_id < 2")).collect())
    assert mixing.mix(empty_documents(spark)).count() == 0
    kept = mixing.mixed_documents(odd_documents(spark)).collect()
    assert all(r.taken > 0 and r.text is not None for r in kept)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op9_decontaminate", "op10_mixing"])
def test_queries_equal_their_sql(spark, name):
    from thicket.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, DATA).toPandas()
    key = [c for c in ("doc_id", "item_id") if c in got]
    pd.testing.assert_frame_equal(got[sorted(got)].sort_values(key, ignore_index=True), want[sorted(want)].sort_values(key, ignore_index=True), check_dtype=False, rtol=1e-12)


# -- pipeline ----------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontamination", "mixing"]
    docs = read("documents")
    frame, before = spark.read.parquet(f"{DATA}/documents.parquet"), len(docs)
    for name, stage in P.STAGES[:-1]:
        rows = [tuple(r) for r in stage(spark, frame, DATA).select(*docs.columns).collect()]
        assert 0 < len(rows) <= before
        if name == "near_duplicates":
            prints = [brute_fingerprint(r[1]) for r in rows]
            assert brute_components(prints, [r[0] for r in rows]) == [r[0] for r in rows]
        if name == "repeated_strings":
            source = {r.doc_id: r for r in frame.collect()}
            assert {r[0] for r in rows} == set(source)
            kept = {i: (t or "").encode() for i, t in zip(source, [source[i].text for i in source])}
            brute = dict(zip(source, brute_repeats([source[i].text for i in source])))
            assert all(len(r[1].encode()) <= brute[r[0]][0] - brute[r[0]][1] and r[4] == len(r[1]) for r in rows) and kept
        before = len(rows)
        frame = spark.createDataFrame(rows, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    leaks = decontaminate.find_leaks(frame, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert leaks.count() == 0
    out = P.run(spark, DATA)
    assert 0 < out.count() <= before and out.where("taken <= 0").count() == 0


def test_pipeline_cases(spark, tmp_path):
    import corpus_pipeline as P

    for name, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for frame in (odd_documents(spark, extra=True), empty_documents(spark)):
        for name, stage in P.STAGES:
            assert set(frame.columns) <= set(stage(spark, frame, str(tmp_path)).columns) | {"size"} and stage(spark, frame, str(tmp_path)).count() <= frame.count()
