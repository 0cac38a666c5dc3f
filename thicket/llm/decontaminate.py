"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The inverted index holds the test items. Every training document is cut into overlapping passages, and each
passage is a query: retrieve all items whose BM25 score reaches `RETRIEVE` of the score the item gives itself (scores are
divided by that, so one threshold serves all items). What is retrieved is verified: the item's first half
of words (question) and second half (answer) must each share `OVERLAP` of their word 5-shingles with the passage.

Passages are twice as long as the block's longest item and begin every one such length, so each place an item can occupy lies
whole in one passage. Items are indexed in blocks of about `BLOCK_ITEMS` items or `BLOCK_CHARS` characters: a block's index is of bounded size and is broadcast.
The documents are read once: a task takes `CHUNK` bytes of them at a time through all blocks, one index after the other in its memory. Nothing is left out.

Block maxima are summed on whole arrays, for many passages at once: items in order of length form posting blocks of `POSTING_BLOCK`,
and a block in which the sum of a passage's block maxima stays below the threshold is skipped for that passage. What
is left goes through WAND's pivoting, which looks at the postings of those blocks only.

Defined cases: null or empty texts have no passages and no hits; an item of one word has no question and hits nothing, like one without words; an item of fewer
than 5 words in a half is compared by that half's whole sequence. Ids may be of any type. Repeated rows give repeated results; repeated items each their own.
Extra columns with any names are left out of what is found and stay where rows are kept. Empty tables give an empty result.
Words are lower-cased runs of letters and digits, so punctuation and case don't hide a leak.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import fields, pack, quoted, scratch, stash, table, unpack, without

RETRIEVE = 0.7
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8 << 20
#: Documents that a Python worker gets at once in `decontaminate`.
ROWS = 2048
#: Bytes of text that go through all blocks before the next are read, where there are several blocks.
CHUNK = 16 << 20
POSTING_BLOCK = 4
K1, B = 1.2, 0.75
WORDS = re.compile(r"[^\W_]+")
#: Documents are read in pieces of so many characters, cut between words.
PIECE = 1 << 20
#: Words of several documents that are looked up together.
JOB_WORDS = 1 << 17


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Index:
    """BM25 index of a block of items. Items in order of length form posting blocks of POSTING_BLOCK; per word
    the largest gain within each posting block is kept, as one sparse table over all words."""

    ids: list = field(default_factory=list)
    halves: list[tuple[set, set]] = field(default_factory=list)
    longest: int = 1
    words: dict[str, int] = field(default_factory=dict)
    postings: list[list[tuple[int, float]]] = field(default_factory=list)
    #: Word k's posting blocks are block_of[at[k]:at[k + 1]], with maxima block_max.
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: By posting block: word -> its postings there.
    cells: list[dict[int, list[tuple[int, float]]]] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[object, str]], idf: dict[str, float], mean_length: float) -> Index:
        self = cls()
        split = [(i, WORDS.findall(t.lower())) for i, t in items]
        for item_id, words in sorted((x for x in split if len(x[1]) > 1), key=lambda x: len(x[1])):
            k = len(self.ids)
            self.ids.append(item_id)
            self.halves.append((shingles(words[: len(words) // 2]), shingles(words[len(words) // 2 :])))
            self.longest = max(self.longest, len(words))
            norm = K1 * (1 - B + B * len(words) / mean_length)
            gain = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
            own = sum(gain.values())
            for w, g in gain.items():
                n = self.words.setdefault(w, len(self.words))
                if n == len(self.postings):
                    self.postings.append([])
                self.postings[n].append((k, g / own))
        maxima = [{} for _ in self.postings]
        self.cells = [{} for _ in range(-(-len(self.ids) // POSTING_BLOCK))]
        for n, posting in enumerate(self.postings):
            for k, g in posting:
                maxima[n][k // POSTING_BLOCK] = max(g, maxima[n].get(k // POSTING_BLOCK, 0.0))
                self.cells[k // POSTING_BLOCK].setdefault(n, []).append((k, g))
        self.at = np.r_[0, np.cumsum([len(m) for m in maxima], dtype=np.int64)].astype(np.int64)
        self.block_of = np.array([k for m in maxima for k in m], np.int64)
        self.block_max = np.array([g for m in maxima for g in m.values()], np.float64)
        return self


def blocks_within_reach(index: Index, passage: np.ndarray, word: np.ndarray, threshold: float) -> dict[int, list[int]]:
    """passage, word: which known word occurs in which passage. By passage, the posting blocks in which the sum of the
    words' block maxima reaches the threshold: no item elsewhere can."""
    pairs = np.unique(passage * len(index.words) + word)
    passage, word = pairs // max(1, len(index.words)), pairs % max(1, len(index.words))
    n = index.at[word + 1] - index.at[word]
    entry = np.arange(n.sum()) + np.repeat(index.at[word] - np.r_[0, np.cumsum(n)[:-1]], n)
    n_blocks = -(-len(index.ids) // POSTING_BLOCK)
    first, found = passage[0] if len(passage) else 0, defaultdict(list)
    cell = np.repeat(passage - first, n) * n_blocks + index.block_of[entry]
    if n_blocks * int(passage[-1] - first + 1 if len(passage) else 0) <= 4 * len(cell) + 1024:
        sums = np.bincount(cell, index.block_max[entry])
        cells = np.flatnonzero(sums >= threshold - 1e-9)
    else:
        cells, where = np.unique(cell, return_inverse=True)
        cells = cells[np.bincount(where, index.block_max[entry]) >= threshold - 1e-9]
    for c in cells.tolist():
        found[c // n_blocks + int(first)].append(c % n_blocks)
    return found


def wand(index: Index, words: set[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) of the given posting blocks with a score of the threshold or more, by WAND's pivoting with each block's own maxima."""
    found = []
    for block in blocks:
        cell = index.cells[block]
        cursors = [[cell[w], 0, max(g for _, g in cell[w])] for w in (words if len(words) < len(cell) else cell) if w in cell and w in words]
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            total, pivot = 0.0, None
            for n, c in enumerate(cursors):
                total += c[2]
                if total >= threshold - 1e-9:
                    pivot = n
                    break
            if pivot is None:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            target = item
            if cursors[0][0][cursors[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == item)
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target = item + 1
            for c in cursors:
                while c[1] < len(c[0]) and c[0][c[1]][0] < target:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
    return found


def _pieces(text: str, overlap: int) -> Iterator[list[str]]:
    """The text's words; a very long text in runs that share `overlap` words."""
    held: list[str] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalnum():
            end += 1
        words = held + WORDS.findall(text[at:end].lower())
        yield words
        held, at = words[-overlap:], end


def matches(index: Index, texts: list[list[str]]) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    """texts: words of each. Yields (text's number, item, (score, question overlap, answer overlap)) of each item's best passage."""
    half = index.longest
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # text k's passages are first[k] and on, each begins half a passage after the one before
    passages = np.maximum(1, -(-(lengths - half) // half))
    first = np.r_[0, np.cumsum(passages)]
    ids = np.fromiter(map(index.words.get, chain.from_iterable(texts), repeat(-1)), np.int64, lengths.sum())
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return
    text_of = np.repeat(np.arange(len(texts)), lengths)[known]
    slot = (known - np.r_[0, np.cumsum(lengths)[:-1]][text_of]) // half
    earlier, later = slot >= 1, slot < passages[text_of]
    passage = np.r_[(first[text_of] + slot - 1)[earlier], (first[text_of] + slot)[later]]
    word = np.r_[ids[known][earlier], ids[known][later]]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, blocks in blocks_within_reach(index, passage, word, RETRIEVE).items():
        text = int(np.searchsorted(first, p, "right")) - 1
        a = (p - int(first[text])) * half
        words = texts[text][a : a + 2 * half]
        got = wand(index, {index.words[w] for w in words if w in index.words}, blocks, RETRIEVE)
        sizes = {len(next(iter(h))) for k, _ in got for h in index.halves[k]}
        grams = {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}
        for k, score in got:
            question, answer = (sum(g in grams for g in h) / len(h) for h in index.halves[k])
            seen = best.get((text, k))
            if min(question, answer) >= OVERLAP and (seen is None or (question + answer, score) > (seen[1] + seen[2], seen[0])):
                best[text, k] = (score, question, answer)
    for (text, k), found in sorted(best.items()):
        yield text, k, found


def _jobs(texts: pa.Array, overlap: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Runs of about JOB_WORDS words: the numbers of the texts they come from, and their words."""
    rows, runs, total = [], [], 0
    for n, text in enumerate(texts):
        for words in _pieces(text.as_py() or "", overlap):
            rows.append(n)
            runs.append(words)
            total += len(words)
            if total >= JOB_WORDS:
                yield rows, runs
                rows, runs, total = [], [], 0
    if rows:
        yield rows, runs


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _searcher(shared: list, item_type: pa.DataType):
    """shared: the blocks' indexes, broadcast. With several, a worker holds one at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK if len(shared) > 1 else 1):
            for block in shared:
                index = block.value
                for batch in chunk:
                    yield look(index, batch)
                if len(shared) > 1:
                    del block._value, index  # else every worker would come to hold all blocks; the next chunk reads it again

    def look(index: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
        best: dict[tuple, tuple] = {}  # a very long text has several runs
        for numbers, runs in _jobs(batch.column("text"), 2 * index.longest):
            for n, k, m in matches(index, runs):
                best[numbers[n], k] = max(best.get((numbers[n], k), m), m, key=lambda x: (x[1] + x[2], x[0]))
        rows = [(n, index.ids[k], *m) for (n, k), m in sorted(best.items())]
        kept = batch.drop_columns(["text"]).take(pa.array([r[0] for r in rows], pa.int64()))
        figures = [pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array([r[1] for r in rows], item_type), *figures], [*kept.schema.names, "item_id", "score", "question_overlap", "answer_overlap"])

    return search


def indexes(benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> Iterator[Index]:
    """The index of each block of the benchmark (item_id, text). The driver holds one block at a time."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    words = items.select("item_id", "text", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([^\W_]+)"), F.lit(1)).alias("w"))
    n, chars, mean_length = words.agg(F.count("*"), F.sum(F.length("text")), F.avg(F.when(F.size("w") > 0, F.size("w")))).first()
    blocks = max(1, -(-n // block_items), -(-(chars or 0) // BLOCK_CHARS))
    ordered = stash(words.withColumn("_block", F.pmod(F.xxhash64(F.col("item_id"), "text"), F.lit(blocks)).cast("int")).repartition(blocks, "_block"))
    # collection statistics cover all items; a block needs those of its own words
    frequency = stash(ordered.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    for k in range(blocks):
        part = ordered.where(F.col("_block") == k)
        block = sorted(((r.item_id, r.text) for r in part.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x))
        own = part.select(F.explode("w").alias("word")).distinct()
        idf = {r.word: math.log(1 + (n - r.df + 0.5) / (r.df + 0.5)) for r in frequency.join(own, "word", "left_semi").collect()}
        yield Index.build(block, defaultdict(lambda: math.log(1 + (n - 0.5) / 1.5), idf), mean_length or 1.0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, text_hash, item_id, score, question_overlap, answer_overlap
    for every pair that is verified."""
    spark = docs.sparkSession
    with scratch(spark):
        shared = [spark.sparkContext.broadcast(index) for index in indexes(benchmark, block_items)]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    item = benchmark.schema["item_id"].dataType
    schema = StructType([*fields(rows, "doc_id", "text_hash"), StructField("item_id", item), *fields(rows, more="score double, question_overlap double, answer_overlap double")])
    return rows.mapInArrow(_searcher(shared, to_arrow_type(item)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a test item; all columns."""
    leaks = stash(find_leaks(docs, benchmark).select("doc_id", F.col("text_hash").alias("key")).distinct(), batch=ROWS)
    packed = pack(docs, "doc_id", "text").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return unpack(without(packed, leaks), "doc_id", "text").select(*map(quoted, docs.columns))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold test items: doc_id, item_id, question_overlap, answer_overlap."""
    leaks = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("text_hash", "score")


ORACLE_SQL = r"""
WITH iw AS (SELECT item_id, words, len(words) // 2 AS h FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark) WHERE len(words) > 1),
halves AS (SELECT item_id, 'q' AS half, words[1 : h] AS ws FROM iw UNION ALL SELECT item_id, 'a', words[h + 1 :] FROM iw),
ig AS (SELECT DISTINCT item_id, half, least(5, len(ws)) AS size, array_to_string(ws[p : p + least(5, len(ws)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM halves WHERE len(ws) > 0)),
need AS (SELECT item_id, half, count(*) AS n FROM ig GROUP BY item_id, half),
l AS (SELECT max(len(words)) AS half_passage FROM iw),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
dg AS (SELECT doc_id, p - 1 AS pos, size, array_to_string(words[p : p + size - 1], ' ') AS gram FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM dw, (SELECT DISTINCT size FROM ig) WHERE len(words) >= size)),
hit AS (SELECT doc_id, pos, size, item_id, half, gram FROM dg JOIN ig USING (gram, size)),
placed AS (SELECT DISTINCT doc_id, item_id, half, gram, passage FROM (SELECT *, unnest([pos // half_passage - 1, pos // half_passage]) AS passage, half_passage FROM hit, l) WHERE passage >= 0 AND pos + size <= (passage + 2) * half_passage),
found AS (SELECT doc_id, item_id, passage, count(*) FILTER (half = 'q') AS q, count(*) FILTER (half = 'a') AS a FROM placed GROUP BY doc_id, item_id, passage),
scored AS (SELECT doc_id, found.item_id, q / nq.n AS question_overlap, a / na.n AS answer_overlap FROM found JOIN need nq ON nq.item_id = found.item_id AND nq.half = 'q' JOIN need na ON na.item_id = found.item_id AND na.half = 'a')
SELECT doc_id, item_id, arg_max(question_overlap, question_overlap + answer_overlap) AS question_overlap, arg_max(answer_overlap, question_overlap + answer_overlap) AS answer_overlap FROM scored WHERE question_overlap >= 0.8 AND answer_overlap >= 0.8 GROUP BY doc_id, item_id
"""
