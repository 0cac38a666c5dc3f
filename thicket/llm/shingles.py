"""Near copies by what they say: documents link if the Jaccard similarity of their sets of word shingles is `similarity` or more.

Exact in all steps, up to equality of 64-bit hashes; nothing is sampled away:

1. Documents with equal sets are one class from the start, so exact copies never meet as pairs.
2. Prefixes. In one order of all shingles, two sets that are similar enough share one of the first n - ceil(similarity * n) + 1 of their n shingles;
   only those are posted. Any order will do. This one puts what is frequent last, by a table of fixed size made from a sample of the documents.
3. Postings are dealt by shingle once and read in the order of shingles: what has a list of its own goes, short lists give pairs. Pairs are tallied: with c shared
   shingles up to positions i and j, the sets can share c + min(n - i, m - j) - 1 at most; and c more than the larger one has beyond its prefix, as
   the prefix that ends first is compared as a whole. Pairs for which that is too few go; the others are verified on their whole texts.
4. Lists longer than `LIST_LIMIT`, as of a text with thousands of near copies, aren't paired, and those that the table knows to be long aren't even dealt by shingle.
   All members are compared with one of them, the one in most lists. 1 - Jaccard is a metric: members that link to the leader needn't meet each other,
   and nobody meets those at more than twice the limit from it. Those in between meet others by what sets them apart: with M the leader's shingles that a set lacks, E those that the leader lacks, and w = (1 - t) |M| + t |E|, t = similarity /
   (1 + similarity), two sets link exactly if they share w + w' - (1 - 2 t) * leader's size of these differences or more. So they are posted
   again, by prefixes of their differences, of which most are their own. `ROUNDS` times, as long as leaders find links enough; at last the rest is paired. A leader's text is dealt out in parts
   of `HEAD` members each.

Pairs that a caller's own index of the sets' SimHash finds (`candidates`) are verified beside these, a pair once.

Defined cases: null text counts as empty; documents without words are one class; a text of fewer words than a shingle is one shingle. A-Z only are lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, fields, look_up, partitions, scratch, stash
from .graph import connected_components
from .words import Words, bit_counts, majority

LIST_LIMIT = 64
ROUNDS = 4
#: Slots of the table of frequent shingles, and one in how many documents is counted for it.
SLOTS = 1 << 20
SAMPLE = 16
#: From this level of the table on (see frequency_table) a shingle is in some hundred documents.
LONG_LEVEL = 10
#: Rows whose sets a Python worker holds at once.
ROWS = 256
#: Rows with texts that it gets at once.
TEXTS = 2048
#: Pairs that one copy of a leader's text is for.
HEAD = 1024
EPSILON = 1e-9

_STEPS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, width: int, words: Words) -> np.ndarray:
    """The set of a text's shingles, as sorted 64-bit hashes. A shingle's hash is made of its words' hashes, each times a factor of its place."""
    hashed = words.hashes(text.lower())
    if not len(hashed):
        return hashed
    size = min(width, len(hashed))
    n = len(hashed) - size + 1
    h = hashed[:n] * _STEPS[0]
    for k in range(1, size):
        h += hashed[k : k + n] * _STEPS[k]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))).cast(pa.list_(pa.int64()))


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column(column).cast(pa.large_binary()))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _all(width: int):
    """text -> grams."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([_lists([shingles(t, width, words) for t in _texts(batch)])], ["grams"])

    return make


def _prefixes(width: int, similarity: float, table):
    """doc_id, text_hash, text -> doc_id, text_hash, fp (hash of the set), bits (its SimHash), n, prefix, frequent (how many of the prefix, at its end, the table knows to be in long lists)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in _few(batches):
            ids, bits, sizes, prefixes, frequent = [], [], [], [], []
            for text in _texts(batch):
                grams = shingles(text, width, words)
                n = len(grams)
                ids.append(xxhash.xxh64_intdigest(grams.tobytes()))
                bits.append(majority(bit_counts(grams), n))
                sizes.append(n)
                levels = table.value[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
                first = np.argsort(levels, kind="stable")[: n - int(np.ceil(similarity * n - EPSILON)) + 1 if n else 0]
                prefixes.append(grams[first])
                frequent.append(int((levels[first] >= LONG_LEVEL).sum()))
            made = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, bits)), pa.array(sizes, pa.int32()), _lists(prefixes), pa.array(frequent, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "fp", "bits", "n", "prefix", "frequent"])

    return make


def frequency_table(rows: DataFrame, width: int) -> np.ndarray:
    """For each slot of shingles twice the binary logarithm of the count of its most frequent one in the sample; 0 for counts under 3."""
    sample = rows.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text_hash", "text")
    grams = sample.dropDuplicates(["text_hash"]).mapInArrow(_all(width), "grams array<long>").select(F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 2")
    slots = counts.groupBy(F.col("gram").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.floor(2 * F.log2(F.max("c"))).cast("int").alias("level")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[slots.column("slot").to_numpy()] = slots.column("level").to_numpy()
    return out


def _pairs_of_lists(gram: np.ndarray, fp: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple]:
    """Whole lists, one after the other -> u, v, total, larger, left_u, left_v of all their pairs whose sizes let them be similar."""
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(gram)])
    for size in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        starts = first[sizes == size]
        for k in range(0, len(starts), max(1, (1 << 18) // len(a))):
            base = starts[k : k + max(1, (1 << 18) // len(a)), None]
            x, y = (base + a).ravel(), (base + b).ravel()
            swap = fp[x] < fp[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            fits = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - EPSILON
            x, y = x[fits], y[fits]
            yield fp[x], fp[y], n[x] + n[y], np.maximum(n[x], n[y]), n[x] - at[x], n[y] - at[y]


def _meeter(similarity: float, list_limit: int):
    """gram, fp, n, at in the order of gram -> u, v, total (n of both), larger, left_u, left_v (n - at) for each pair in a short list, and the
    members of longer ones as gram, u, total (n) with v null. A shingle with one text gives nothing."""

    def out(gram, u, v, total, larger, left_u, left_v) -> pa.RecordBatch:
        empty = np.zeros(len(u), bool)
        columns = [
            pa.array(empty if gram is None else gram, pa.int64(), mask=~empty if gram is None else None),
            pa.array(u, pa.int64()),
            pa.array(u if v is None else v, pa.int64(), mask=~empty if v is None else None),
            *(pa.array(x, pa.int32()) for x in (total, larger, left_u, left_v)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["gram", "u", "v", "total", "larger", "left_u", "left_v"])

    def member(gram, fp, n, at) -> pa.RecordBatch:
        return out(gram, fp, None, n, n, at, at)

    def lists(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, fp, n, at = columns
        if not len(gram):
            return
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]), len(gram)])
        long = np.repeat(sizes > list_limit, sizes)
        if long.any():
            yield member(gram[long], fp[long], n[long], at[long])
        for found in _pairs_of_lists(gram[~long], fp[~long], n[~long], at[~long], similarity):
            yield out(None, *found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_one = None, None  # the list that the last batch broke off in; a list that is known to be long
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("gram", "fp", "n", "at")]
            if not len(columns[0]):
                continue
            if long_one is not None:
                more = columns[0] == long_one
                if more.any():
                    yield member(*(c[more] for c in columns))
                    columns = [c[~more] for c in columns]
                if not len(columns[0]):
                    continue
                long_one = None
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            last = columns[0] == columns[0][-1]
            held = [c[last] for c in columns]
            yield from lists([c[~last] for c in columns])
            if len(held[0]) > list_limit:
                yield from lists(held)
                held, long_one = None, held[0][0]
        if held is not None:
            yield from lists(held)

    return meet


def _met(a: DataFrame, b: DataFrame, similarity: float, *more) -> DataFrame:
    """Pairs u, v of different sets from lists of a and of b (gram, fp, n, any more), if their sizes let them be similar."""
    left = a.select(F.col("gram").alias("g"), F.col("fp").alias("u"), F.col("n").alias("nu"), *[F.col(c).alias(f"{c}u") for c in more])
    right = b.select("gram", F.col("fp").alias("v"), F.col("n").alias("nv"), *[F.col(c).alias(f"{c}v") for c in more])
    alike = F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - EPSILON
    return left.join(right, (F.col("g") == F.col("gram")) & (F.col("u") != F.col("v")) & alike)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _pairs_of_sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """u, v, x, y (their texts) -> batches and the sets of both. Rows with one v or u mostly follow each other."""
    words, known = Words(), {}
    for batch in _few(batches):
        found = []
        for u, v, x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("x"), batch.column("y")):
            sets = []
            for key, text in ((u, x), (v, y)):
                if key not in known:
                    if len(known) >= 4:
                        known.pop(next(iter(known)))
                    known[key] = shingles(text.cast(pa.large_binary()).as_py(), width, words)
                sets.append(known[key])
            found.append(tuple(sets))
        yield batch, found


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - shared / max(1, len(a) + len(b) - shared)


def _distances(width: int):
    """u, v, x, y -> u, v, distance."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _pairs_of_sets(width, batches):
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array([_distance(*s) for s in sets], pa.float64())], ["u", "v", "distance"])

    return make


def _differences(width: int, similarity: float):
    """u (a leader), v, x, y -> u, v, distance, apart: what sets v apart from u, in an order that all v have in common, if it's at most twice the limit away; first: how
    many of these a set that links to v, though not both link to the leader, must share one of."""
    t = similarity / (1 + similarity)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _pairs_of_sets(width, batches):
            distances, apart, first = [], [], []
            for leader, other in sets:
                distances.append(_distance(leader, other))
                if distances[-1] > 2 * (1 - similarity + EPSILON):
                    apart.append(leader[:0])
                    first.append(0)
                    continue
                extra, lacking = np.setdiff1d(other, leader, assume_unique=True), np.setdiff1d(leader, other, assume_unique=True)
                apart.append(np.r_[extra, ~lacking])
                w = (1 - t) * len(lacking) + t * len(extra)
                first.append(max(0, len(apart[-1]) - int(w + EPSILON)))
            made = [pa.array(distances, pa.float64()), _lists(apart), pa.array(first, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *made], ["u", "v", "distance", "apart", "first"])

    return make


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v and their texts x, y (texts: fp, text, one that has the set). A u in very many pairs is dealt into parts."""
    many = pairs.groupBy("u").agg(F.count("*").alias("size")).where(F.col("size") > HEAD).select(F.col("u").alias("k"), F.ceil(F.col("size") / HEAD).cast("int").alias("parts"))
    dealt = stash(pairs.join(many, F.col("u") == F.col("k"), "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), "parts"), F.lit(0)).alias("part")))
    heads = dealt.select("u", "part").distinct().join(texts.select(F.col("fp").alias("k"), F.col("text").alias("x")).hint("merge"), F.col("u") == F.col("k")).select(F.col("u").alias("k"), F.col("part").alias("p"), "x")
    half = dealt.join(heads.hint("merge"), (F.col("u") == F.col("k")) & (F.col("part") == F.col("p"))).select("u", "v", "x")
    return half.join(texts.select(F.col("fp").alias("k"), F.col("text").alias("y")).hint("merge"), F.col("v") == F.col("k")).select("u", "v", "x", "y")


def _compare(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """u, v and their distance, 1 - Jaccard, from the whole texts."""
    return _with_texts(pairs, texts).mapInArrow(_distances(width), "u long, v long, distance double")


def _long_lists(lists: DataFrame, texts: DataFrame, width: int, similarity: float, list_limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """lists: gram, fp, n. Edges found by leaders, and the pairs that are left to be compared."""
    limit, edges, pairs, kept = 1 - similarity + EPSILON, [], [], ["gram", "fp", "n", "central"]
    # what others were copied from has the most shingles in common with them: it leads all lists that it's in
    central = lists.groupBy("fp").agg(F.count("*").alias("central")).withColumnRenamed("fp", "k")
    lists = stash(lists.join(central, F.col("fp") == F.col("k")).select(kept))
    for _ in range(ROUNDS):
        sizes = lists.groupBy("gram").agg(F.count("*").alias("size"), F.max(F.struct("central", "fp")).alias("first"))
        sizes = stash(sizes.select(F.col("gram").alias("k"), "size", F.col("first.fp").alias("leader")))
        led = stash(lists.join(sizes.where(F.col("size") > list_limit), F.col("gram") == F.col("k")).drop("k", "size"))
        if led.isEmpty():
            break
        to_leader = _with_texts(led.where("fp <> leader").select(F.col("leader").alias("u"), F.col("fp").alias("v")).distinct(), texts)
        found = stash(to_leader.mapInArrow(_differences(width, similarity), "u long, v long, distance double, apart array<long>, first int"), batch=ROWS)
        edges.append(found.where(F.col("distance") <= limit).select("u", "v"))
        far = stash(led.join(found.select("u", "v", "distance"), (F.col("leader") == F.col("u")) & (F.col("fp") == F.col("v"))).select("leader", "distance", *kept))
        middle = far.where((F.col("distance") > limit) & (F.col("distance") <= 2 * limit))
        beyond = far.where(F.col("distance") > 2 * limit)

        # sets near the leader and between, posted again by what sets them apart; once for a leader, in however many lists they met
        one = led.groupBy("leader", "fp").agg(F.first("n").alias("n"), F.first("central").alias("central")).withColumnsRenamed({"leader": "u", "fp": "v"})
        apart = found.where(F.col("distance") <= 2 * limit).join(one, ["u", "v"])
        apart = apart.select("u", F.col("v").alias("fp"), "n", "central", "distance", "first", F.posexplode("apart").alias("at", "element"))
        apart = stash(apart.withColumn("gram", F.xxhash64("u", "element")))
        near = apart.where((F.col("distance") <= limit) & (F.col("at") < F.col("first")))
        between = apart.where(F.col("distance") > limit)
        pairs.append(_ordered(_met(near, between, similarity)))
        pairs.append(_ordered(_met(middle, beyond, similarity, "distance").where(F.col("distancev") - F.col("distanceu") <= limit)))
        short = lists.join(sizes.where(F.col("size") <= list_limit), F.col("gram") == F.col("k")).select(kept)
        lists = stash(short.unionByName(beyond.select(kept)).unionByName(between.where("at < first").select(kept)))
        if found.where(F.col("distance") <= limit).count() < list_limit:  # its leaders had hardly anybody to lead: neither will the next ones
            break
    pairs.append(_ordered(_met(lists, lists, similarity).where("u > v")))
    return edges, pairs


def shingle_links(rows: DataFrame, classes: DataFrame, width: int, similarity: float, list_limit: int = LIST_LIMIT, candidates: Callable | None = None) -> DataFrame:
    """rows: doc_id, text_hash, text. classes: fp, doc_id and text_hash (of one row that has the set), bits, n, prefix, frequent. Edges (u, v) that
    connect exactly what the links between similar sets connect. candidates: from fp, bits to pairs (u, v), u > v, to verify as well."""
    rare = F.size("prefix") - F.col("frequent")
    postings = classes.select("fp", "n", F.posexplode(F.slice("prefix", F.lit(1), rare)).alias("at", "gram"))
    dealt = postings.select("gram", "fp", "n", "at").repartition(partitions(rows.sparkSession), "gram").sortWithinPartitions("gram")
    met = stash(dealt.mapInArrow(_meeter(similarity, list_limit), "gram long, u long, v long, total int, larger int, left_u int, left_v int"))
    known_long = classes.where("frequent > 0").select(F.explode(F.slice("prefix", rare + 1, F.col("frequent"))).alias("gram"), "fp", "n")
    long = stash(known_long.unionByName(met.where("v IS NULL").select("gram", F.col("u").alias("fp"), F.col("total").alias("n"))))

    # what two sets may share in long lists isn't tallied and counts as shared
    hidden = stash(long.groupBy("fp").agg(F.count("*").alias("hidden")))
    of = lambda side: hidden.select(F.col("fp").alias(f"_{side}"), F.col("hidden").alias(f"hidden_{side}"))
    once = [F.first(c).alias(c) for c in ("total", "larger")]
    tally = met.where("v IS NOT NULL").groupBy("u", "v").agg(F.count("*").alias("c"), F.min("left_u").alias("left_u"), F.min("left_v").alias("left_v"), *once)
    tally = tally.join(of("u"), F.col("u") == F.col("_u"), "left").join(of("v"), F.col("v") == F.col("_v"), "left")
    beyond = F.least(F.least("left_u", "left_v"), F.ceil(similarity * F.col("larger") - EPSILON)) - 1
    most = F.col("c") + F.least(F.coalesce("hidden_u", F.lit(0)), F.coalesce("hidden_v", F.lit(0))) + beyond
    pairs = stash(tally.where(most >= similarity / (1 + similarity) * F.col("total") - EPSILON).select("u", "v"))
    if candidates:
        pairs = stash(candidates(classes.select("fp", "bits"), list_limit).unionByName(pairs).distinct())

    members = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).unionByName(long.select("fp")).distinct()
    wanted = stash(classes.select("fp", "doc_id", F.col("text_hash").alias("key")).join(members, "fp", "left_semi"))
    keyed = rows.withColumnRenamed("text_hash", "key")
    texts = stash(look_up(keyed, wanted, bitmap_of(wanted, "key")).select("fp", "text").dropDuplicates(["fp"]))  # repeated rows

    edges, more = ([], []) if long.isEmpty() else _long_lists(long, texts, width, similarity, list_limit)
    for p in more:
        pairs = pairs.unionByName(p)
    links = _compare(pairs.distinct(), texts, width).where(F.col("distance") <= 1 - similarity + EPSILON).select("u", "v")
    for e in edges:
        links = links.unionByName(e.select("u", "v"))
    return stash(links.distinct(), batch=ROWS)


def similar_documents(docs: DataFrame, width: int, similarity: float, list_limit: int = LIST_LIMIT, candidates: Callable | None = None) -> DataFrame:
    """docs: doc_id, text; candidates: see shingle_links. Returns doc_id, text_hash, fp (of the set), component_id, a row for each row, like simhash.near_duplicates."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequency_table(rows, width))
    kind = fields(rows, "doc_id", more="text_hash long, fp long, bits long, n int, prefix array<long>, frequent int")
    found = stash(rows.mapInArrow(_prefixes(width, similarity, table), kind).withColumn("row", F.monotonically_increasing_id()), batch=TEXTS)
    classes = stash(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")))
    one = found.join(classes.select("row"), "row", "left_semi")
    with scratch(docs.sparkSession):
        components = connected_components(shingle_links(rows, one, width, similarity, list_limit, candidates)).withColumnRenamed("u", "fp")
    labelled = classes.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return found.select("doc_id", "text_hash", "fp").join(labelled.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component_id")
