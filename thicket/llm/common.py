"""What several operators share: shared storage, stable row keys, whole-table readers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..storage import scratch, shared_folder, stash

__all__ = ["EXTRA", "WORD", "Bitmap", "bitmap_of", "cut", "fields", "hashed_sample", "held", "look_up", "pack", "partitions", "quoted", "scratch", "shared_folder", "stash", "table", "unit_interval", "unpack", "without"]

#: Word separators of the fingerprint and mixing contracts, as a regular expression class body.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later steps survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_interval(*cols: Column) -> Column:
    """A reproducible pseudo-random number in (0, 1) from the given columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def hashed_sample(df: DataFrame, n: int, seed: int, *by: str) -> DataFrame:
    """At most n rows (about 10 fewer than n in 100 at times), chosen by a hash of the columns `by`: the same rows each time, and what
    reaches one place is bounded by n, however many partitions there are."""
    total = df.count()
    u = unit_interval(F.lit(seed), *by)
    share = 1.0 if total <= n else n / total
    return df.withColumn("__u", u).where(F.col("__u") < share).orderBy("__u", *by).limit(n).drop("__u")


def quoted(name: str) -> str:
    """A column's name as text in which nothing is read as an operator or a field."""
    return "`" + name.replace("`", "``") + "`"


#: Columns that an operator doesn't need travel in one struct, so that their names can't clash with its own.
EXTRA = "__extra"


def pack(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, and all others in the struct EXTRA (absent if there are none)."""
    others = [F.col(quoted(c)) for c in df.columns if c not in needed]
    return df.select(*needed, *([F.struct(*others).alias(EXTRA)] if others else []))


def unpack(df: DataFrame, *results: str) -> DataFrame:
    """The result columns, then the packed ones unless a result has the same name."""
    others, taken = [], {r.lower() for r in results}
    if EXTRA in df.columns:
        others = [F.col(EXTRA)[f.name].alias(f.name) for f in df.schema[EXTRA].dataType.fields if f.name.lower() not in taken]
    return df.select(*results, *others)


def fields(of: DataFrame | StructType, *names: str, more: str = "") -> StructType:
    """The named fields of a schema and those of a DDL string. Types and odd names are handed on as they are, never as text."""
    schema = of.schema if isinstance(of, DataFrame) else of
    added = _parse_datatype_string(more).fields if more else []
    return StructType([StructField(n, schema[n].dataType) for n in names] + added)


# -- which rows have a partner elsewhere ----------------------------------------------------------------------------------

#: Bits of a bitmap, from the least to the most; beyond some ten million keys it lets ever more through, and what lets all through costs a shuffle only.
LEAST_BITS, MOST_BITS = 20, 27
PROBES = 2


@dataclass(frozen=True)
class Bitmap:
    """A Bloom filter of mixed 64-bit keys."""

    words: np.ndarray
    bits: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each key False if it isn't among those of the bitmap, True if it may be."""
        keys, ok = keys.view(np.uint64), np.ones(len(keys), bool)
        for k in range(PROBES):
            bit = (keys >> np.uint64(32 * k)) & np.uint64((1 << self.bits) - 1)
            ok &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return ok


def bitmap_of(keys: DataFrame, column: str):
    """A broadcast Bitmap of the keys (a mixed long; a table that is cheap to read), 8 bits or more for each key, up to 2 ** MOST_BITS in all."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n - 1).bit_length()))
    places = F.array(*[F.shiftrightunsigned(F.col(column), 32 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(PROBES)])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    found = keys.select(F.explode(places).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found.column("w").to_numpy().astype(np.int64)] = found.column("v").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Bitmap(words, bits))


def held(rows: DataFrame, shared, key: str, inside: bool = True, then=None, schema: StructType | None = None) -> DataFrame:
    """The rows whose key a broadcast Bitmap may hold, or those whose key it doesn't hold. Narrow. Python gets the keys only, so that texts stay where they are.
    then: what to make of them in the same Python worker (a function for mapInArrow, which returns schema): a second one beside it would cost its memory."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(batch.column(key).to_numpy()) == inside))

    if then is None:

        def kept(keys: pa.Array) -> pa.Array:
            return pa.array(shared.value.holds(keys.to_numpy(zero_copy_only=False)) == inside)

        return rows.where(F.arrow_udf(kept, "boolean")(F.col(key)))
    return rows.mapInArrow(lambda batches: then(keep(batches)), schema)


def look_up(rows: DataFrame, wanted: DataFrame, shared, how: str = "inner") -> DataFrame:
    """rows (doc_id, key, ...) joined with wanted (unique doc_id, key, ...); rows that the Bitmap of wanted's keys rules out are left out before the shuffle.
    The join is the same at every size."""
    w = wanted.withColumnsRenamed({"doc_id": "_id", "key": "_key"}).hint("merge")
    maybe = held(rows, shared, "key")
    found = maybe.join(w, maybe["doc_id"].eqNullSafe(F.col("_id")) & (maybe["key"] == F.col("_key")), how)
    return found if how == "left_anti" else found.drop("_id", "_key")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (doc_id, key, ...) less those of gone (doc_id, key; a table that is cheap to read). Only rows that its Bitmap may hold are shuffled."""
    shared = bitmap_of(gone, "key")
    return held(rows, shared, "key", inside=False).unionByName(look_up(rows, gone, shared, "left_anti"))
