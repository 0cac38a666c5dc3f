"""SimHash near-dedup over a byte-position inverted index with count filtering.

64-bit fingerprints of word shingles; two documents link if their fingerprints differ in `MAX_BITS` = 2 bits or fewer.
Documents with equal fingerprints are one class from the start, so exact copies never meet as pairs.

Two bits spoil two of the eight positional bytes at most: linked fingerprints share 6 bytes or more. The index
posts every class under its positional bytes, taken as 4 slots of 2 bytes; as at least two whole slots survive, each pair of slots
(6 of them) is one posting key. Pairs that meet are tallied by shared positional bytes, those below 6 are discarded, the rest is verified
by Hamming distance.

A posting list longer than `LIST_LIMIT` isn't paired: its members go through hubs, which is exact and linear. A hub is a fingerprint or one of its
64 one-bit changes; two fingerprints have a hub in common exactly if they differ in 2 bits or fewer, and a hub has 65 members at most.
Links then go through distributed connected components; neither links nor fingerprints reach the driver.

`deduplicate` with a similarity takes wider fingerprints' links from `byte_links`, verifies them on whole texts and has shingles.py search exactly for what fingerprints lose.

Defined cases: null text counts as empty; without words the fingerprint is zero and links like any other. A-Z only are lower-cased.
Repeated rows each get a result row. A null doc_id is no candidate for component_id unless its component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, cut, fields, held, look_up, pack, quoted, scratch, stash, table, unpack
from .graph import connected_components
from .shingles import similar_documents
from .words import bit_counts, majority

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
SHARED_BYTES = 8 - MAX_BITS
LIST_LIMIT = 64
#: Bits in which fingerprints of texts that are to be compared may differ, and the positional bytes that key their index: of any four positions three are a key.
NEAR_BITS = 4
TRIPLES = [t for t in combinations(range(8), 3) if tuple(sum(k // 3 == g for k in t) for g in range(3)) in {(3, 0, 0), (0, 3, 0), (2, 1, 0), (0, 2, 1), (1, 0, 2)}]
#: Texts are worked on in pieces of about so many bytes.
PIECE = 1 << 21
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words in runs from pieces of the text; each run starts with the last `overlap` words before it."""
    at, held = 0, []
    while at < len(text):
        cut_at = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut_at.end() if cut_at else len(text)
        words = held + text[at:end].split()
        at = end
        yield words
        held = words[-overlap:] if overlap else []


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for words in _word_runs(text.lower(), width - 1):
        held = words
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64)
        counts += bit_counts(hashes)
        n += len(hashes)
    if not n:
        return hashed(b" ".join(held), SEED) if held else 0
    return majority(counts, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text, to tell rows with one doc_id apart), fp (the bits as a signed long). One narrow stage."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints, fields(rows, "doc_id", more="text_hash long, fp long"))


def _slot_keys(fp: Column) -> Column:
    """The 6 posting keys: which two of the 4 two-byte slots, and their bytes."""
    slots = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.lit(k << 32) + slots[i] * F.lit(1 << 16) + slots[j] for k, (i, j) in enumerate(pairs)])


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: in how many of the 8 positions two fingerprints have the same byte."""
    different = a.bitwiseXOR(b)
    return sum(F.when(F.shiftrightunsigned(different, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(8))


def fingerprint_links(distinct: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """distinct: fp, all different. Edges (u, v) that connect exactly what links of MAX_BITS or fewer connect."""
    postings = distinct.select("fp", F.explode(_slot_keys(F.col("fp"))).alias("key"))
    lengths = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    busy = cut(postings.join(lengths, F.col("key") == F.col("k")).select("key", "fp", "n"))
    short = busy.where(F.col("n") <= list_limit)
    a, b = short.select("key", F.col("fp").alias("u")), short.select(F.col("key").alias("k"), F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    close = (u > v) & (shared_bytes(u, v) >= SHARED_BYTES) & (F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS)
    pairs = a.join(b, (F.col("key") == F.col("k")) & close).select("u", "v").distinct()

    hot = busy.where(F.col("n") > list_limit).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit((1 << k) if k < 63 else -(1 << 63)) for k in range(64)])
    hubs = hot.select("fp", F.explode(F.transform(flips, lambda flip: F.col("fp").bitwiseXOR(flip))).alias("hub"))
    members = hubs.groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = members.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v").distinct()
    return pairs.unionByName(stars).distinct()


def byte_links(classes: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """classes: fp (all different), bits (a fingerprint). Candidates (u, v), u > v: classes whose fingerprints differ in `NEAR_BITS` = 4 bits or fewer, so that
    four of the eight positional bytes are equal or more. Any four positions hold one of the `TRIPLES`, which are the posting keys. All pairs of a list of up to
    list_limit classes are tallied; of a longer one those with its least class: whoever asks must search on for the rest."""
    byte = lambda k: F.shiftrightunsigned("bits", 8 * k).bitwiseAND(F.lit(0xFF))
    keys = F.array(*[F.lit(n << 24) + byte(i) * F.lit(1 << 16) + byte(j) * F.lit(1 << 8) + byte(k) for n, (i, j, k) in enumerate(TRIPLES)])
    postings = classes.select("fp", "bits", F.explode(keys).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("leader")).where("n > 1").withColumnRenamed("key", "k")
    busy = stash(postings.join(lists, F.col("key") == F.col("k")).drop("k"))
    a = busy.where((F.col("n") <= list_limit) | (F.col("fp") == F.col("leader"))).select(F.col("key").alias("k"), F.col("fp").alias("v"), F.col("bits").alias("w"))
    met = busy.join(a, (F.col("key") == F.col("k")) & (F.col("fp") > F.col("v")))
    tallied = met.where((shared_bytes(F.col("bits"), F.col("w")) >= 8 - NEAR_BITS) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("w"))) <= NEAR_BITS))
    return tallied.select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, text_hash, fp, component_id, a row for each row."""
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    components = connected_components(fingerprint_links(classes.select("fp"), list_limit)).withColumnRenamed("u", "fp")
    labelled = classes.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", "text_hash", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """All columns of docs, for one row of each component: its least doc_id (of rows with that id, the one with the least text hash).
    Components of the fingerprints' links, or with a similarity those of documents whose sets of `width`-word shingles are so similar (Jaccard): fingerprints of
    these sets meet in the index of bytes and are verified on whole texts, and an exact search follows for what they lose."""
    if similarity is None and width != SHINGLE_WORDS:
        raise ValueError("fingerprints are of three words; give a similarity with another width")
    # only rows of components of two or more have a fate; all others stay where they are
    with scratch(docs.sparkSession):
        found = stash(near_duplicates(docs) if similarity is None else similar_documents(docs, width, similarity, candidates=byte_links))
        own = F.when(F.col("component_id").isNull(), F.col("fp"))
        groups = found.groupBy("component_id", own.alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
        groups = groups.withColumnsRenamed({"component_id": "c", "own": "o"})
        met = found.join(groups, F.col("component_id").eqNullSafe(F.col("c")) & own.eqNullSafe(F.col("o")))
        stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
        fates = stash(met.groupBy("doc_id", F.col("text_hash").alias("key")).agg(F.max(stays).alias("stays")), outer=True)
    shared = bitmap_of(fates, "key")
    packed = pack(docs, "doc_id", "text").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = look_up(packed, fates, shared, "left")
    one = chosen.where("stays").dropDuplicates(["doc_id", "key"])  # rows that are equal in doc_id and text
    rest = held(packed, shared, "key", inside=False).unionByName(chosen.where("stays IS NULL").drop("stays"))
    return unpack(rest.unionByName(one.drop("stays")), "doc_id", "text").select(*[quoted(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
