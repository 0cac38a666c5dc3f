"""Suffix-array dedup: remove every byte that a repeated string of 400 bytes covers, or every word that a repeated passage of some words covers.

A text is an array of symbols: its bytes, or the hashes of its words (however short the words and whatever white space is between them). A `Scheme` says which,
and how many symbols a repeated string must have: a span. Sorting all suffixes of a corpus would move many times its size. Exact reductions come first:

1. Anchors. A span's anchor is the start of the string of `gram` symbols inside it with the least rolling hash (leftmost if equal): it depends on
   the span's symbols alone, so equal spans have equal anchors. Consecutive spans whose anchors have equal grams form a run, of many spans on
   average (of more in periodic text). Spans can only be equal if their runs' grams are.
2. Pieces. A run with an anchor gram of its own has no repeated span and goes. Consecutive runs that are left form a piece, which ends before a run whose gram's
   hash is divisible by `PIECE_RUNS`. Pieces with equal symbols are one class: if it has two or more, all their spans are repeated. One piece of each class
   goes on, so that a text with thousands of copies is looked into once.
3. Classes. The runs of those pieces with equal symbols (anchor gram and the whole run's hash, 128 bits together) are one class. All spans of a class with two
   runs or more are repeated. Only where classes share an anchor gram their spans remain in doubt, and one run of each class speaks for it.
4. The same again with the runs in doubt cut into blocks of up to `block` spans, by distance from the anchor; the symbols that all spans of a
   block share take the anchor gram's place.

The suffixes that begin the spans in doubt are then sorted: a suffix is a string of `TOKENS` tokens, hashes of a quarter of a span each. Sampled splitters
range-partition the suffixes by leading tokens (ties are dealt out further by position, so that a suffix that is everywhere fills several buckets) into as many buckets
as `BUCKET_ROWS` asks for; each bucket sorts by multikey quicksort and compares neighbours; the ends of adjacent buckets are compared in a second, small step.

No group of equal runs or suffixes is ever collected: counts are combined before the shuffle, and joins back have one row a class on one side.
Texts move only for documents that have something to look up; a bitmap, sized by the number of its keys, sorts out most others beforehand.

Defined cases: null text is empty. Texts shorter than a span lose nothing. Rows with equal doc_id and text are different documents, so they repeat each other.
Bytes are cut wherever a span ends, also inside a character; `text` in the general result then drops what is left of that character. Words are cut from the first
one's start to the last one's end. Very long texts are worked on in segments of `SEGMENT` symbols; spans across segments are kept whole. Extra columns of any name and type
are carried along unless named like a result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, fields, held, look_up, pack, partitions, scratch, stash, table, unpack
from .words import Words

TOKENS = 4
PIECE_RUNS = 8
#: Symbols hashed at once.
SEGMENT = 1 << 18
#: Rows with texts that a Python worker gets at once.
ROWS = 2048
#: Texts that are cut at once.
CUT_ROWS = 512
#: Suffixes that one task sorts.
BUCKET_ROWS = 1 << 18


@dataclass(frozen=True)
class Scheme:
    """What a repeated string is: span bytes, or span words."""

    span: int = 400
    words: bool = False

    def __post_init__(self):
        if self.span < TOKENS:
            raise ValueError(f"a span has {TOKENS} symbols or more")

    @property
    def gram(self) -> int:
        return self.span // 2

    @property
    def block(self) -> int:
        return max(1, self.span // 25)

    @property
    def least_bytes(self) -> int:
        """Bytes of the shortest text that can have a span."""
        return 2 * self.span - 1 if self.words else self.span

    @cached_property
    def tokens(self) -> list[tuple[int, int]]:
        """Where the tokens of a span start, and their lengths."""
        bounds = [k * self.span // TOKENS for k in range(TOKENS + 1)]
        return [(a, b - a) for a, b in zip(bounds, bounds[1:])]

    def reader(self):
        """A function from a text (buffer of UTF-8) to its symbols."""
        if not self.words:
            return lambda raw: np.frombuffer(raw, np.uint8)
        words = Words()
        return lambda raw: words.hashes(bytes(raw))


#: The contract of op2_suffix_dedup.
BYTES = Scheme()

_M = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(400).integers(1, 1 << 63, 256).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _INVERSE = np.empty(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        _POWER, _INVERSE = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    return _POWER, _INVERSE


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _M
    h ^= h >> np.uint64(29)
    h *= _M
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of an array of symbols, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _tables(max(len(data) + 1, SEGMENT + 1024))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values, by minima within blocks from either side."""
    n = len(x) - width + 1
    blocks = np.pad(x, (0, -len(x) % width), constant_values=np.iinfo(x.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _segments(texts: pa.Array, scheme: Scheme, read) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in jobs of about SEGMENT symbols: data, and for each part its text's number, its start in the data, its offset in the text.
    Parts of one text overlap by a span less one; texts shorter than a span are left out."""
    parts, size, over = [], 0, scheme.span - 1

    def job():
        data = np.concatenate([p[2] for p in parts])
        return data, np.array([p[0] for p in parts]), np.cumsum([0, *(len(p[2]) for p in parts)]), np.array([p[1] for p in parts])

    for n, text in enumerate(texts):
        symbols = read(text.as_buffer() if text.is_valid else b"")
        for at in range(0, max(0, len(symbols) - over), SEGMENT // 2):
            piece = symbols[at : at + SEGMENT // 2 + over]
            if size + len(piece) > SEGMENT and parts:
                yield job()
                parts, size = [], 0
            parts.append((n, at, piece))
            size += len(piece)
    if parts:
        yield job()


def find_spans(data: np.ndarray, ends: np.ndarray, scheme: Scheme = BYTES) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """The spans in parts of data that lie between the ends. Returns hashes, where spans start, their anchors, the hashes of the anchors' grams."""
    hashes, span = Hashes(data), scheme.span
    mask = np.uint64((1 << 21) - 1)
    grams = hashes.every(scheme.gram)
    keyed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(keyed, span - scheme.gram + 1) & mask).astype(np.int64)
    within = np.ones(len(anchor), bool)
    for e in ends[1:-1]:
        within[e - span + 1 : e] = False
    spans = np.flatnonzero(within)
    anchor = anchor[spans]
    return hashes, spans, anchor, grams[anchor]


def find_runs(data: np.ndarray, ends: np.ndarray, scheme: Scheme = BYTES) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive spans whose anchors have equal grams. Returns hashes, first spans, numbers of spans, hashes of the grams, and whether a run has
    several anchors: its spans may then repeat each other."""
    hashes, spans, anchor, gram = find_spans(data, ends, scheme)
    first = np.r_[0, np.flatnonzero((gram[1:] != gram[:-1]) | (spans[1:] != spans[:-1] + 1)) + 1]
    last = np.r_[first[1:], len(spans)] - 1
    return hashes, spans[first], last - first + 1, gram[first].view(np.int64), anchor[first] != anchor[last]


def _batch(batch: pa.RecordBatch, rows: np.ndarray, drop: list[str], more: dict[str, np.ndarray]) -> pa.RecordBatch:
    kept = batch.drop_columns(drop).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, more.values())], [*kept.schema.names, *more])


def _run_finder(scheme: Scheme, make, busy=None, wanted=None):
    """make: what to return of a job's runs (_grams, _pieces or _runs). busy: bitmap of the grams to keep; wanted: bitmap of the pieces to keep."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = scheme.reader()
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            for data, owner, ends, offset in _segments(batch.column("text").cast(pa.large_binary()), scheme, read):
                hashes, start, n, gram, inner = find_runs(data, ends, scheme)
                if busy is not None:
                    keep = busy.value.holds(gram)
                    start, n, gram, inner = start[keep], n[keep], gram[keep], inner[keep]
                part = np.searchsorted(ends, start, "right") - 1
                shift = offset[part] - ends[part]
                yield _batch(batch, *make(scheme, hashes, start, n, gram, inner, owner[part], shift, keys, wanted))

    return find


def _same(scheme: Scheme, hashes: Hashes, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of all symbols of n consecutive spans."""
    return _mix(hashes.of(start, n - 1 + scheme.span) + n.astype(np.uint64) * _M).view(np.int64)


def _grams(scheme, hashes, start, n, gram, inner, owner, shift, keys, wanted):
    times = 1 + inner  # a run that may repeat itself isn't alone
    return np.repeat(owner, times), ["text"], {"gram": np.repeat(gram, times)}


def _piece_of(hashes, start, n, gram, owner, shift, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run's piece, the pieces' first runs, numbers of spans, and ids."""
    breaks = np.r_[True, (start[1:] != start[:-1] + n[:-1]) | (owner[1:] != owner[:-1]) | (gram[1:] % PIECE_RUNS == 0)] if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(breaks)
    of = np.cumsum(breaks) - 1
    total = np.bincount(of, n, len(first)).astype(np.int64)
    return of, first, total, _unit_ids(start[first] + shift[first], keys[owner[first]])


def _unit_ids(start: np.ndarray, key) -> np.ndarray:
    return _mix(start.astype(np.uint64) * _M + key).view(np.int64)


def _pieces(scheme, hashes, start, n, gram, inner, owner, shift, keys, wanted):
    _, first, total, ids = _piece_of(hashes, start, n, gram, owner, shift, keys)
    return owner[first], ["text"], {"start": (start + shift)[first], "n": total.astype(np.int32), "gram": gram[first], "same": _same(scheme, hashes, start[first], total), "id": ids}


def _runs(scheme, hashes, start, n, gram, inner, owner, shift, keys, wanted):
    of, _, _, ids = _piece_of(hashes, start, n, gram, owner, shift, keys)
    keep = wanted.value.holds(ids)[of]
    start, n, gram, inner, owner, shift = (x[keep] for x in (start, n, gram, inner, owner, shift))
    return owner, ["text"], {"start": start + shift, "n": n.astype(np.int32), "gram": gram, "same": _same(scheme, hashes, start, n), "inner": inner}


def _blocks(scheme: Scheme, symbols: np.ndarray, runs: list[dict]) -> Iterator[tuple]:
    """The runs of one text, cut into blocks, for a stretch of the text at a time: hashes of the stretch, its offset, and for each block its first span
    in the stretch, number of spans, hash of the symbols its spans share, hash of all its symbols."""
    runs, span, block = sorted((r["start"], r["n"]) for r in runs), scheme.span, scheme.block
    at = 0
    while at < len(runs):
        low, k = runs[at][0], at
        while k < len(runs) and runs[k][0] + runs[k][1] + span - low <= SEGMENT:
            k += 1
        start, n = (np.array(x, np.int64) for x in zip(*runs[at:k]))
        of = np.repeat(np.arange(len(n)), n)
        spans = np.arange(n.sum()) - np.r_[0, np.cumsum(n)[:-1]][of] + (start - low)[of]
        stretch = symbols[low : low + int((start + n - low).max()) - 1 + span]
        hashes, _, anchor, _ = find_spans(stretch, np.array([0, len(stretch)]), scheme)
        anchor = anchor[spans]
        distance = anchor - spans
        index = distance // block
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (index[1:] != index[:-1]) | (anchor[1:] != anchor[:-1])])
        size, begin = np.diff(np.r_[first, len(spans)]), spans[first]
        shared = hashes.of(begin + distance[first] - block * index[first], span - block + 1) + index[first].astype(np.uint64)
        full = hashes.of(begin, size - 1 + span) + (size * (1 << 20) + distance[first]).astype(np.uint64) * _M
        yield hashes, low, begin, size, _mix(shared).view(np.int64), _mix(full).view(np.int64)
        at = k


def _block_maker(scheme: Scheme):
    """doc_id, key, text, runs -> a row for each block of the runs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = scheme.reader()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for row in range(batch.num_rows):
                for _, low, begin, size, shared, full in _blocks(scheme, read(texts[row].as_buffer()), batch.column("runs")[row].as_py()):
                    yield _batch(batch, np.full(len(begin), row), ["text", "runs"], {"start": begin + low, "n": size.astype(np.int32), "gram": shared, "same": full, "inner": np.zeros(len(begin), bool)})

    return make


def _suffix_maker(scheme: Scheme):
    """doc_id, key, text, blocks (array of start, n) -> a row for each span of the blocks: where it starts, and its tokens, two in a long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = scheme.reader()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for row in range(batch.num_rows):
                symbols = read(texts[row].as_buffer())
                blocks = sorted((r["start"], r["n"]) for r in batch.column("blocks")[row].as_py())
                at = 0
                while at < len(blocks):
                    low, k = blocks[at][0], at
                    while k < len(blocks) and blocks[k][0] + blocks[k][1] + scheme.span - low <= SEGMENT:
                        k += 1
                    begin, size = (np.array(x, np.int64) for x in zip(*blocks[at:k]))
                    hashes = Hashes(symbols[low : int((begin + size).max()) - 1 + scheme.span])
                    spans = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin - low, size)
                    tokens = [hashes.of(spans + a, width) >> np.uint64(32) for a, width in scheme.tokens]
                    packed = [((tokens[j] << np.uint64(32)) | tokens[j + 1]).view(np.int64) for j in range(0, TOKENS, 2)]
                    yield _batch(batch, np.full(len(spans), row), ["text", "blocks"], {"at": spans + low, **{f"t{j}": p for j, p in enumerate(packed)}})
                    at = k

    return make


def multikey_quicksort(keys: list[np.ndarray], small: int = 1 << 12) -> np.ndarray:
    """Order of the rows by their keys: three-way partition on one key, the equal part goes on with the next; small parts are sorted at once."""
    order, n_keys = np.arange(len(keys[0])), len(keys)
    out, stack = [], [(order, 0)]
    while stack:
        rows, d = stack.pop()
        if d == n_keys or len(rows) <= 1:
            out.append(rows)
        elif len(rows) <= small:
            out.append(rows[np.lexsort([k[rows] for k in keys[: d - 1 if d else None : -1]])])
        else:
            value = keys[d][rows]
            pivot = np.sort(value[:: max(1, len(value) // 63)])[31 if len(value) > 63 else 0]
            stack += [(rows[value > pivot], d), (rows[value == pivot], d + 1), (rows[value < pivot], d)]
    return np.concatenate(out) if out else order


def _bucket_sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket's suffixes and compares neighbours. Returns those that are repeated within the bucket (edge 0), and the first and last suffix (edge 1 and 2)."""
    whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    # in the order in which Spark ranged them, that of signed longs, so that a bucket's ends are its bounds' neighbours
    tokens = [whole.column(f"t{j}").to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for j in range(TOKENS // 2)]
    keys = [part for t in tokens for part in ((t >> np.uint64(32)).astype(np.uint32), t.astype(np.uint32))]
    order = multikey_quicksort(keys)
    equal = np.ones(len(order) - 1, bool)
    for t in tokens:
        s = t[order]
        equal &= s[1:] == s[:-1]
    rows = order[np.r_[False, equal] | np.r_[equal, False]]
    rows = np.r_[rows, order[0], order[-1]]
    edge = np.zeros(len(rows), np.int32)
    edge[-2:] = 1, 2
    for batch in whole.take(pa.array(rows)).append_column("edge", pa.array(edge)).combine_chunks().to_batches(max_chunksize=1 << 16):
        yield batch


def repeated_suffixes(suffixes: DataFrame, total: int) -> DataFrame:
    """suffixes: key columns, at, t0, t1, `total` rows. The rows whose tokens another row has too (key columns, at)."""
    n = max(2 * partitions(suffixes.sparkSession), -(-total // BUCKET_ROWS))
    salt = F.xxhash64(F.lit(1), "doc_id", "key", "at")
    buckets = suffixes.withColumn("salt", salt).repartitionByRange(n, "t0", "t1", "salt").drop("salt")
    found = stash(buckets.mapInArrow(_bucket_sorter, fields(suffixes, *suffixes.columns, more="edge int")))
    # each bucket's ends, two rows a bucket: the same suffix may end one bucket and begin the next
    ends = found.where("edge > 0")
    across = ends.groupBy("t0", "t1").agg(F.count_distinct("doc_id", "key", "at").alias("copies")).where("copies > 1")
    at_ends = ends.join(across, ["t0", "t1"], "left_semi")
    return found.where("edge = 0").unionByName(at_ends).select("doc_id", "key", "at").distinct()


def _busy(units: DataFrame) -> DataFrame:
    """g: the grams that more than one unit has, or one that may repeat itself; split: whether those units differ or may repeat themselves."""
    grams = units.groupBy("gram").agg(F.count("*").alias("units"), F.min("same").alias("low"), F.max("same").alias("high"), F.max("inner").alias("inner"))
    return grams.where("units > 1 OR inner").select(F.col("gram").alias("g"), ((F.col("low") != F.col("high")) | F.col("inner")).alias("split"))


def _interval(span: int) -> list:
    return ["doc_id", "key", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + span).alias("b")]


def _members(units: DataFrame, classes: DataFrame, span: int) -> DataFrame:
    """The symbols (doc_id, key, a, b) of the units of the classes."""
    those = classes.select(F.col("gram").alias("g"), F.col("same").alias("s"))
    return units.join(those.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("same") == F.col("s"))).select(_interval(span))


def _settle(units: DataFrame, busy: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """units: doc_id, key, start, n, gram, same, any more; busy: their _busy(), as a table of its own, so that a gram with very many units can be split
    between tasks when the two are joined. Returns the symbols of units that another one equals (doc_id, key, a, b), and the units in
    doubt: one of each class of equal units that shares its gram with another class."""
    met = stash(units.join(busy.hint("merge"), F.col("gram") == F.col("g")).drop("g"))
    mixed = met.where("split")
    own = [c for c in units.columns if c not in ("gram", "same", "inner")]
    classes = stash(mixed.groupBy("gram", "same").agg(F.count("*").alias("units"), F.min(F.struct(*own)).alias("first")))
    again = _members(mixed, classes.where("units > 1"), span)
    return met.where(~F.col("split")).select(_interval(span)).unionByName(again), classes.select("first.*")


def covered(docs: DataFrame, scheme: Scheme = BYTES) -> DataFrame:
    """docs: doc_id, key, text (no nulls in key and text). Intervals of symbols to remove: doc_id, key, a, b."""
    span = scheme.span
    keyed = lambda more: fields(docs, "doc_id", "key", more=more)
    units_type = keyed("start long, n int, gram long, same long, inner boolean")
    grams = docs.mapInArrow(_run_finder(scheme, _grams), keyed("gram long")).groupBy("gram").agg(F.count("*").alias("runs")).where("runs > 1")
    # a few grams that are alone pass the bitmap, too; they are found out later
    busy = bitmap_of(stash(grams.select("gram"), batch=ROWS), "gram")
    pieces = stash(docs.mapInArrow(_run_finder(scheme, _pieces, busy), keyed("start long, n int, gram long, same long, id long")), batch=ROWS)
    classes = stash(pieces.groupBy("gram", "same").agg(F.count("*").alias("pieces"), F.min("id").alias("id")))
    copied = _members(pieces, classes.where("pieces > 1"), span)

    units = stash(docs.mapInArrow(_run_finder(scheme, _runs, busy, bitmap_of(classes, "id")), units_type), batch=ROWS)
    whole, doubt = _settle(units, stash(_busy(units)), span)
    whole = copied.unionByName(whole)

    runs = stash(doubt.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    texts = stash(look_up(docs, runs, bitmap_of(runs, "key")).select("doc_id", "key", "text", "runs"))
    blocks = stash(texts.mapInArrow(_block_maker(scheme), units_type), batch=ROWS)
    parts, doubt = _settle(blocks, stash(_busy(blocks)), span)

    total = doubt.agg(F.sum("n")).first()[0] or 0
    lists = doubt.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("blocks"))
    chosen = texts.drop("runs").join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "text", "blocks")
    suffixes = chosen.mapInArrow(_suffix_maker(scheme), keyed("at long, " + ", ".join(f"t{j} long" for j in range(TOKENS // 2))))
    single = repeated_suffixes(suffixes, total).select("doc_id", "key", F.col("at").alias("a"), (F.col("at") + span).alias("b"))
    return whole.unionByName(parts).unionByName(single)


def _word_bounds(raw: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    data = np.frombuffer(raw, np.uint8)
    word = np.r_[False, (data != 0x20) & ((data < 0x09) | (data > 0x0D)), False]
    return np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])


def _in_bytes(cuts: list[dict], raw: memoryview) -> list[tuple[int, int]]:
    """The cuts, those in words turned into bytes from the first word's start to the last one's end."""
    starts, ends = _word_bounds(raw) if any(c["words"] for c in cuts) else ((), ())
    return [(int(starts[c["a"]]), int(ends[c["b"] - 1])) if c["words"] else (c["a"], c["b"]) for c in cuts]


def _merge(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(cuts):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _cutter(with_text: bool):
    """Cuts the texts. Rows have the list of their cuts, or no such column: then nothing is cut."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is left of the texts is made and sent on for few rows at a time
        for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
            has_cuts = "cuts" in batch.schema.names
            rows, texts = [], []
            for k, text in enumerate(batch.column("text").cast(pa.large_binary())):
                raw = memoryview(text.as_buffer())
                spans, at, digest, kept = _merge(_in_bytes(batch.column("cuts")[k].as_py() or [], raw)) if has_cuts else [], 0, hashlib.sha256(), []
                for a, b in [*spans, (len(raw), len(raw))]:
                    digest.update(raw[at:a])
                    kept.append(raw[at:a])
                    at = b
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
                if with_text:
                    texts.append(b"".join(kept).decode("utf-8", "ignore"))
            out = batch.drop_columns(["text", *["cuts"] * has_cuts])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays([*out.columns, *columns], [*out.schema.names, *names])

    return remove


def _covered_once(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """covered(), as a table; what it was made from is deleted."""
    with scratch(docs.sparkSession):
        return stash(covered(docs, scheme), outer=True)


def remove_repeats(docs: DataFrame, with_text: bool = True, schemes: Sequence[Scheme] = (BYTES,)) -> DataFrame:
    """docs: doc_id, text, any more. What any of the schemes finds repeated goes; all are judged on the input. Returns doc_id, n_bytes, n_removed (bytes), n_spans,
    kept_sha256, with_text: the text that is left, and the others."""
    packed = pack(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("doc_id", "text"))
    slim = packed.select("doc_id", "key", "text")
    with scratch(docs.sparkSession):
        found = [_covered_once(slim.where(F.octet_length("text") >= s.least_bytes), s).withColumn("words", F.lit(s.words)) for s in schemes]
        cuts = stash(reduce(DataFrame.unionByName, found).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b", "words")).alias("cuts")), outer=True)
    shared = bitmap_of(cuts, "key")
    others = [c for c in packed.columns if c != "text"]
    made = fields(packed, *others, more="n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)
    rest = held(packed, shared, "key", inside=False, then=_cutter(with_text), schema=made)
    out = look_up(packed, cuts, shared, "left").mapInArrow(_cutter(with_text), made).unionByName(rest)
    return unpack(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT k, p, hash(b[p + 1 : p + 400]) AS h FROM (SELECT k, b, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
i AS (SELECT k, p, sum(CASE WHEN p <= last_p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY p) AS island FROM (SELECT k, p, coalesce(lag(p) OVER (PARTITION BY k ORDER BY p), -1000) AS last_p FROM r)),
s AS (SELECT k, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY k, island),
g AS (SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS z FROM s UNION ALL SELECT k, max(z), NULL FROM s GROUP BY k),
t AS (SELECT k, list(hex(b[g.a + 1 : coalesce(g.z, n)]) ORDER BY g.a) AS kept FROM g JOIN d USING (k) GROUP BY k),
c AS (SELECT k, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY k)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(list_aggregate(kept, 'string_agg', '')) END) AS kept_sha256
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
