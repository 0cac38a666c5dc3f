"""Incremental ingest of changed files by Structured Streaming.

The state is a table of path, code, content_hash, version, analysis in `folder`, dealt into `buckets` by a hash of the path: the latest version of a path wins, and
files whose content hash is unchanged aren't analysed again. A micro-batch reads and rewrites only the buckets in which something changed, as the next generation,
and then a manifest that says which generation each bucket is of; a repeated batch writes the same again. Generations that neither
the newest manifest nor the one before names are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_ops import content_hash, normalize_path
from ..operators.analyze import ANALYSIS, analysis_of

STATE = "path string, code string, content_hash bigint, version bigint"
BUCKETS = 64


class IncrementalGraph:
    """folder must be on storage that all executors share. Generations have their batch's number. A folder keeps the number of buckets it was begun with."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _fs(self, below: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + below)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, below: str, mark: str = "") -> list[int]:
        fs, path = self._fs(below)
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in names if not mark or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, mark)))

    def generation(self, before: int | None = None) -> int | None:
        """The newest complete generation (below `before`)."""
        return max((n for n in self._numbers("/manifest", "_SUCCESS") if before is None or n < before), default=None)

    def _manifest(self, generation: int | None) -> dict[int, int]:
        """bucket -> the generation it is of. One entry a bucket."""
        if generation is None:
            return {}
        return {r.bucket: r.generation for r in self.spark.read.parquet(f"{self.folder}/manifest/{generation}").collect()}

    def _read(self, manifest: dict[int, int], only: Iterable[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{manifest[b]}/bucket={b}" for b in sorted(manifest if only is None else manifest.keys() & set(only))]
        schema = f"{STATE}, analysis {ANALYSIS}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def analyzed(self) -> DataFrame:
        return self._read(self._manifest(self.generation()))

    def files(self) -> DataFrame:
        return self.analyzed().drop("analysis")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """batch: path, code, version. Latest version a path, skipped if the content is the same as before."""
        last = self.generation(before=batch_id)
        manifest = self._manifest(last)
        new = batch.groupBy(normalize_path(F.col("path")).alias("path")).agg(F.max_by(F.struct("code", "version"), F.struct("version", "code")).alias("__new")).select("path", "__new.*")
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        new = new.select("path", "code", content_hash(F.col("code")).alias("content_hash"), F.col("version").cast("long"), bucket.alias("bucket"))
        target = f"{self.folder}/data/{batch_id}"
        # kept apart, so that a stream's batch isn't read and grouped for each step
        new.write.mode("overwrite").parquet(f"{self.folder}/incoming/{batch_id}")
        new = self.spark.read.parquet(f"{self.folder}/incoming/{batch_id}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        known = self._read(manifest, touched).select(F.col("path").alias("__p"), F.col("content_hash").alias("__h"), F.col("version").alias("__v"))
        met = new.join(known, new["path"] == F.col("__p"), "left")
        changed = met.where(F.col("__p").isNull() | ((F.col("content_hash") != F.col("__h")) & (F.col("version") >= F.col("__v")))).select(new.columns)
        rewritten = [r.bucket for r in changed.select("bucket").distinct().collect()]
        if rewritten:
            old = self._read(manifest, rewritten).withColumn("bucket", bucket)
            stays = old.join(changed.select("path"), "path", "left_anti")
            fresh = changed.withColumn("analysis", analysis_of(F.col("code")))
            stays.unionByName(fresh.select(stays.columns)).write.mode("overwrite").partitionBy("bucket").parquet(target)
        entries = sorted((manifest | dict.fromkeys(rewritten, batch_id)).items())
        self.spark.createDataFrame(entries, "bucket int, generation long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch_id}")
        self._delete_old(batch_id, set(dict(entries).values()) | set(manifest.values()))

    def _delete_old(self, batch_id: int, named: set[int]) -> None:
        """Keeps the newest manifest and the one before, and what they name."""
        manifests = self._numbers("/manifest")
        gone = [f"/manifest/{n}" for n in manifests if n < batch_id and n != max((m for m in manifests if m < batch_id), default=None)]
        gone += [f"/data/{n}" for n in self._numbers("/data") if n < batch_id and n not in named]
        gone += [f"/incoming/{n}" for n in self._numbers("/incoming") if n <= batch_id]
        for below in gone:
            fs, path = self._fs(below)
            fs.delete(path, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """stream: path, code, version. Returns the running query."""
        writer = stream.writeStream.foreachBatch(lambda df, k: self.upsert(df, k)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path, True)


def read_file_stream(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("js", "ts", "jsx", "tsx")) -> DataFrame:
    """New and changed files below root as a stream of path, code, version (modification time in ms)."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    return reader.load(root).select(path.alias("path"), F.col("value").alias("code"), F.unix_millis("_metadata.file_modification_time").alias("version"))
