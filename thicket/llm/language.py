"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a sequence of bytes in both directions, labels every position with a distribution over the languages, and a document's
probabilities are the mean of its positions'. A sequence is one word with the space before it (ASCII lower-cased, at most `WIDTH` bytes, longer words in pieces): as the state
starts anew with each word, equal words have equal labels, so each distinct word is computed once and counted as often as it occurs. The whole text is read.

Training is backpropagation through time in numpy, on the driver, from a bounded sample: `SAMPLE_DOCS` labelled documents by hash of doc_id, and from each
`SAMPLE_WORDS` words evenly spread over the text at most.

Defined cases: null text or one without a letter: `und`, score 0. Without any labelled document every prediction is `und`. Rows with a null lang aren't learnt from,
but predicted. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, hashed_sample, table
from .quality import fold

WIDTH = 24
HIDDEN = 12
SAMPLE_DOCS = 4000
SAMPLE_WORDS = 48
FOLDS, HELD_OUT = 5, 0
#: Distinct words whose labels a worker keeps, and words looked up at once.
CACHE, JOB = 200_000, 200_000


def words_of(text: bytes) -> list[bytes]:
    """A text's sequences, in order."""
    words = text.lower().split()
    if words and max(map(len, words)) >= WIDTH:
        words = [w[a : a + WIDTH - 1] for w in words for a in range(0, len(w), WIDTH - 1)]
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs of HIDDEN units and a softmax over each position. x: bytes, one sequence a row, all of one length."""

    def __init__(self, langs: list[str], seed: int = 4):
        rng = np.random.default_rng(seed)
        h, self.langs = HIDDEN, langs
        self.p = {"out": rng.normal(0, 0.3, (2 * h, len(langs))), "bias": np.zeros(len(langs))}
        for d in "fb":
            self.p |= {f"in_{d}": rng.normal(0, 0.3, (256, 3 * h)), f"rec_{d}": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states after each position, in the order read: (length, rows, HIDDEN)."""
        h, (n, length) = HIDDEN, x.shape
        given, rec = self.p[f"in_{d}"], self.p[f"rec_{d}"]
        state, out = np.zeros((n, h), np.float32), np.empty((length, n, h), np.float32)
        for t in range(length):
            a, b = given[x[:, t]], state @ rec
            gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            keep, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + reset * b[:, 2 * h :])
            if tape is not None:
                tape.append((state, keep, reset, new, b[:, 2 * h :]))
            state = new + keep * (state - new)
            out[t] = state
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities at every position: (length, rows, languages)."""
        both = np.concatenate([self.states(x, "f"), self.states(x[:, ::-1], "b")[::-1]], axis=2)
        z = both @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(2, keepdims=True))
        return z / z.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        h, (n, length) = HIDDEN, x.shape
        tapes, reads = {"f": [], "b": []}, {"f": x, "b": x[:, ::-1]}
        s = {d: self.states(reads[d], d, tapes[d]) for d in "fb"}
        both = np.concatenate([s["f"], s["b"][::-1]], axis=2)
        z = both @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(2, keepdims=True))
        slope = z / z.sum(2, keepdims=True)
        slope[:, np.arange(n), y] -= 1
        slope /= n * length
        g = {"out": np.einsum("tnh,tnl->hl", both, slope), "bias": slope.sum((0, 1))}
        back = slope @ self.p["out"].T
        for d, grads in (("f", back[:, :, :h]), ("b", back[::-1, :, h:])):
            g_in, g_rec = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(self.p[f"rec_{d}"])
            carry = np.zeros((n, h), np.float32)
            for t in range(length - 1, -1, -1):
                before, keep, reset, new, part = tapes[d][t]
                total = grads[t] + carry
                g_new = total * (1 - keep) * (1 - new**2)
                g_keep = total * (before - new) * keep * (1 - keep)
                g_reset = g_new * part * reset * (1 - reset)
                g_b = np.concatenate([g_keep, g_reset, g_new * reset], axis=1)
                np.add.at(g_in, reads[d][:, t], np.concatenate([g_keep, g_reset, g_new], axis=1))
                g_rec += before.T @ g_b
                carry = total * keep + g_b @ self.p[f"rec_{d}"].T
            g |= {f"in_{d}": g_in, f"rec_{d}": g_rec}
        return g


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their bytes after a space) for words of equal length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else ():
        for a in range(0, len(rows), 2048):
            part = rows[a : a + 2048]
            yield part, np.frombuffer(b"".join(b" " + words[k] for k in part.tolist()), np.uint8).reshape(len(part), -1)


def train(samples: list[tuple[list[bytes], str]], epochs: int = 4, batch: int = 256, seed: int = 9) -> Network | None:
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    net, rng = Network(langs), np.random.default_rng(seed)
    words = [w for ws, _ in samples for w in ws]
    y = np.array([langs.index(lang) for ws, lang in samples for _ in ws], np.int64)
    m, v, t = {k: np.zeros_like(w) for k, w in net.p.items()}, {k: np.zeros_like(w) for k, w in net.p.items()}, 0
    for epoch in range(epochs):
        jobs = []
        for rows, x in _by_length(words):
            mixed = rng.permutation(len(rows))
            jobs += [(rows[mixed[a : a + batch]], x[mixed[a : a + batch]]) for a in range(0, len(rows), batch)]
        rate = 0.015 / (1 + epoch)
        for k in rng.permutation(len(jobs)):
            rows, x = jobs[k]
            t += 1
            for name, g in net.gradients(x, y[rows]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.p[name] -= (rate * min(1.0, len(rows) / batch + 0.1) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


class Pooler:
    """Sums of position labels over documents; keeps the labels of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known = defaultdict(count().__next__)
        self.sums = np.zeros((0, len(self.net.langs) + 1), np.float32)

    def _learn(self) -> None:
        done = len(self.sums)
        words = list(self.known)[done:]
        more = np.empty((len(words), len(self.net.langs) + 1), np.float32)
        for rows, x in _by_length(words):
            more[rows, :-1] = self.net.labels(x).sum(0)
            more[rows, -1] = x.shape[1]
        self.sums = np.concatenate([self.sums, more])

    def pool(self, texts: Iterator[bytes]) -> np.ndarray:
        """Mean probabilities, a row a text; zeros for a text without words."""
        totals, owners, ids = [], [], []
        n = 0

        def flush() -> None:
            if ids:
                self._learn()
                lengths = np.array([len(i) for i in ids])
                sums = self.sums[np.concatenate(ids)].astype(np.float64)
                at = np.r_[0, np.cumsum(lengths)[:-1]]
                totals.append((np.array(owners), np.add.reduceat(sums, at)))
                if len(self.known) > CACHE:
                    self._forget()
            owners.clear()
            ids.clear()

        held = 0
        for n, text in enumerate(texts, 1):
            words = words_of(text)
            for a in range(0, len(words), JOB):
                part = words[a : a + JOB]
                owners.append(n - 1)
                ids.append(np.fromiter(map(self.known.__getitem__, part), np.int64, len(part)))
                held += len(part)
                if held >= JOB:
                    flush()
                    held = 0
        flush()
        out = np.zeros((n, len(self.net.langs) + 1))
        for who, sums in totals:
            np.add.at(out, who, sums)
        return out[:, :-1] / np.maximum(1, out[:, -1:])


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        picked = []
        for text in batch.column("text").cast(pa.large_binary()):
            words = words_of(text.as_py())
            picked.append([words[k] for k in np.unique(np.linspace(0, len(words) - 1, SAMPLE_WORDS).astype(int))] if words else [])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(picked, pa.list_(pa.binary()))], ["lang", "words"])


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Network | None:
    """docs: doc_id, text, lang. Learns from at most `sample` rows that are neither held out nor unlabelled."""
    learn = (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    chosen = hashed_sample(docs.where(learn).select("doc_id"), sample, 3, "doc_id").distinct().withColumnRenamed("doc_id", "_id")
    rows = docs.where(learn).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")  # at most `sample` ids
    words = rows.select("doc_id", "text", "lang").mapInArrow(_sample_words, "lang string, words array<binary>")
    picked = sorted(((r.lang, [bytes(w) for w in r.words]) for r in words.orderBy(F.xxhash64("words"), "lang").limit(2 * sample).collect()), key=lambda x: (x[0], x[1]))
    return train([(words, lang) for lang, words in picked])


def identify(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """docs: doc_id, text, lang. Returns doc_id, held_out, lang_pred, score, a row for each row."""
    net = fit(docs.select("doc_id", "text", "lang"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shared.value) if shared.value else None
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            some = np.flatnonzero(batch.column("lettered").to_numpy(zero_copy_only=False))
            if pooler and len(some):
                texts = batch.column("text").cast(pa.large_binary())
                p = pooler.pool(texts[k].as_py() for k in some.tolist())
                for k, best, score in zip(some, p.argmax(1), p.max(1)):
                    names[k], scores[k] = pooler.net.langs[best], min(1.0, score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), text.rlike(r"\p{L}").alias("lettered"), text.alias("text"))
    return rows.mapInArrow(predict, fields(rows, "doc_id", more="held_out boolean, lang_pred string, score double"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
