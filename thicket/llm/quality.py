"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is web text as it comes; negatives are never used as such. With
class prior p (estimated as the share of ones among the labels) and logistic loss l, a small network g minimises
the non-negative unbiased risk  p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]);  its sigmoid is the score.

Features are shape statistics of the whole text (byte classes, words, repetition, lines): one narrow pass, kept as a checkpoint from which
both the training sample and the scores are read. The fit uses at most `SAMPLE` positives and `SAMPLE` unlabelled rows, chosen by hash of doc_id, on the driver.

Defined cases: null text counts as empty; empty texts have the score that the model gives to zero features. A doc_id with several labels
counts as positive if most are 1; a null label says nothing. Without any positive nothing speaks against a text, and every score is `UNKNOWN`, which is accepted. Repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, hashed_sample, pack, quoted, scratch, stash, table, unpack, without

SAMPLE = 8000
THRESHOLD = 0.7
UNKNOWN = 0.75
HIDDEN = 12
FOLDS, HELD_OUT = 4, 2

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!", b"?", b"*$#&%@", b"|", b"<>{}[]\\=+_~^`/", b"'\"()-", bytes(range(128, 256))]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k
N_FEATURES = len(_CLASSES) + 1 + 11
#: Words are counted in runs of so many bytes of text.
RUN = 1 << 20


def features(text: bytes) -> np.ndarray:
    """Shape statistics of a whole UTF-8 text; zeros if it is empty."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.zeros(256, np.int64)
    raw = np.frombuffer(text, np.uint8)
    for a in range(0, len(raw), RUN):
        counts += np.bincount(raw[a : a + RUN], minlength=256)
    n_classes = len(_CLASSES) + 1
    out[:n_classes] = np.bincount(_CLASS_OF, counts, n_classes) / len(text)
    n_words = equal = different = long_words = dotted = chars = runs = 0
    at = 0
    while at < len(text):
        end = len(text) if at + RUN >= len(text) else (text.find(b" ", at + RUN) + 1 or len(text))
        words = text[at:end].split()
        at = end
        if words:
            runs += 1
            n_words += len(words)
            equal += sum(map(eq, words, words[1:]))
            distinct = set(words)
            different += len(distinct) / len(words) ** 0.9
            long_words += sum(len(w) > 18 for w in distinct) / len(distinct)
            dotted += sum(w[-1] in b"*$#&%!" for w in distinct) / len(distinct)
            chars += sum(map(len, words))
    lines = text.split(b"\n")
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    out[n_classes:] = (
        np.log1p(len(text)) / 10,
        np.log1p(n_words) / 8,
        equal / max(1, n_words),
        different / max(1, runs),
        long_words / max(1, runs),
        dotted / max(1, runs),
        chars / max(1, n_words) / 10,
        counts[65:91].sum() / letters,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 5,
        np.count_nonzero(counts) / 128,
    )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        values = np.array([features(t.as_py() or b"") for t in texts], np.float32).reshape(len(texts), N_FEATURES)
        at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.ListArray.from_arrays(at, pa.array(values.ravel()))], [*batch.drop_columns(["text"]).schema.names, "features"])


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


class Model:
    """One hidden layer, trained by Adam on the non-negative PU risk."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.weights
        return np.tanh((np.clip((x - self.mean) / self.scale, -6, 6)) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, seed: int = 11) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [], UNKNOWN)
    prior = min(0.95, max(0.05, prior))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    xs = [np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled)]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        steps = max(8, -(-len(xs[1]) // batch))
        picks = [rng.permutation(np.resize(np.arange(len(x)), steps * min(batch, max(1, len(x))))).reshape(steps, -1) for x in xs]
        rate = 0.01 / (1 + epoch / 15)
        for k in range(steps):
            xp, xu = xs[0][picks[0][k]], xs[1][picks[1][k]]
            x = np.r_[xp, xu]
            hidden = np.tanh(x @ weights[0] + weights[1])
            p = sigmoid(hidden @ weights[2] + weights[3][0])
            pp, pu = p[: len(xp)], p[len(xp) :]
            # logistic loss: l(g) = -log s(g); its slopes are s - 1 for the positive and s for the negative side
            negative = np.mean(-np.log1p(-np.minimum(pu, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(pp, 1 - 1e-12)))
            slope = np.zeros(len(x))
            if negative >= 0:
                slope[: len(xp)] = prior * ((pp - 1) - pp) / len(xp)
                slope[len(xp) :] = pu / len(xu)
            else:  # the negative part is overfitted: step back on it alone
                slope[: len(xp)] = prior * pp / len(xp)
                slope[len(xp) :] = -pu / len(xu)
            back = slope[:, None] * weights[2] * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ slope + 1e-4 * weights[2], np.array([slope.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, weights, prior)


def _sample(featured: DataFrame, n: int) -> np.ndarray:
    """The features of n rows at most, chosen by hash."""
    rows = hashed_sample(featured.select("doc_id", "features"), n, 5, "doc_id").orderBy("doc_id", "features").collect()
    return np.array([r.features for r in rows], np.float64).reshape(len(rows), N_FEATURES)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality. Returns doc_id, text_hash, held_out, score, predicted."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    featured = stash(rows.mapInArrow(_features, fields(rows, "doc_id", more="text_hash long, features array<float>")))
    featured = featured.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    learn = featured.where(~F.col("held_out"))
    marks = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("good"))
    prior = marks.agg(F.avg(F.col("good").cast("int"))).first()[0]
    positive = _sample(learn.join(marks.where("good"), "doc_id", "left_semi"), sample)
    model = fit(positive, _sample(learn, sample), prior or 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, N_FEATURES).astype(np.float64)
            keep = batch.drop_columns(["features"])
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep.schema.names, "score", "predicted"])

    return featured.select("doc_id", "text_hash", "held_out", "features").mapInArrow(score, fields(rows, "doc_id", more="text_hash long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; all columns."""
    with scratch(docs.sparkSession):
        rejected = stash(score_quality(docs, labels).where("predicted = 0").select("doc_id", F.col("text_hash").alias("key")).distinct(), outer=True)
    packed = pack(docs, "doc_id", "text").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return unpack(without(packed, rejected), "doc_id", "text").select(*map(quoted, docs.columns))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")
