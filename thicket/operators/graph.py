"""The project graph: analysed files, symbol lookup and import resolution as joins over tables keyed by normalized path."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_ops import content_hash, import_candidates, normalize_path
from .analyze import PARTS, analysis_of, unnest

FILE_SCHEMA = "path string, code string"


def latest_files(df: DataFrame, version: str | None = None) -> DataFrame:
    """path (normalized), code, content_hash: one row a path, the one of the highest version, ties to the greater code. Without a version column any repeated path counts so."""
    order = F.struct(*([F.col(version)] if version else []), F.col("code"))
    return df.groupBy(normalize_path(F.col("path")).alias("path")).agg(F.max_by("code", order).alias("code")).withColumn("content_hash", content_hash(F.col("code")))


def resolve_dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: path, seq, source, any more; files: path. Adds resolved_path: the first existing candidate; imports without one are dropped."""
    candidates = imports.select("*", F.posexplode(import_candidates(F.col("path"), F.col("source"))).alias("__rank", "__candidate"))
    known = files.select(F.col("path").alias("__candidate")).distinct()
    met = candidates.join(known, "__candidate")
    others = [c for c in imports.columns if c not in ("path", "seq")]
    best = met.groupBy("path", "seq").agg(F.min_by(F.struct("__candidate", *others), "__rank").alias("__best"))
    return best.select("path", "seq", *(F.col("__best")[c].alias(c) for c in others), F.col("__best.__candidate").alias("resolved_path"))


def find_symbols(analyzed: DataFrame, name: str | Column | None = None, kind: str | None = None) -> DataFrame:
    """path, seq, name, kind, ...: symbols, then exports that no symbol of the file and no earlier export equals in name and kind. name None: all.
    Both lists lie in the file's row, so nothing is shuffled and files are analysed once."""
    symbols, exports = F.col("analysis.symbols"), F.col("analysis.export_signatures")
    same = lambda a, b: (a["name"] == b["name"]) & (a["kind"] == b["kind"])
    new = F.filter(exports, lambda e, i: ~F.exists(symbols, lambda s: same(s, e)) & ~F.exists(F.slice(exports, F.lit(1), i), lambda x: same(x, e)))
    every = F.concat(symbols, new)
    if name is not None:
        every = F.filter(every, lambda s: s["name"] == name)
    if kind is not None:
        every = F.filter(every, lambda s: s["kind"] == kind)
    rows = analyzed.select("path", F.posexplode(every).alias("seq", "__s"))
    return rows.select("path", "seq", "__s.*")


class ProjectGraph:
    """Tables instead of locked maps: each add only notes what was added, and analysis runs when a query does."""

    def __init__(self, spark: SparkSession, files: DataFrame | None = None, mode: str = "cache"):
        self.spark, self.mode = spark, mode
        self._tables: list[DataFrame] = [] if files is None else [latest_files(files)]
        self._single: dict[str, tuple[int, str]] = {}  # files added one by one: path -> when, code

    def add_files(self, df: DataFrame) -> ProjectGraph:
        """Adds or replaces files (path, code), a row a path; equal content changes nothing."""
        if self._single:
            self._tables.append(self._singles())
            self._single = {}
        self._tables.append(latest_files(df))
        return self

    def add_file(self, path: str, code: str) -> ProjectGraph:
        self._single[path] = (len(self._single), code)
        return self

    def _singles(self) -> DataFrame:
        """The files added one by one, the latest of equal normalized paths."""
        rows = [(path, code, n) for path, (n, code) in self._single.items()]
        return latest_files(self.spark.createDataFrame(rows, FILE_SCHEMA + ", version int"), "version")

    def on_transform(self, path: str, code: str) -> ProjectGraph:
        """Build-time hook: adds the file in cache mode, nothing on demand."""
        return self.add_file(path, code) if self.mode == "cache" else self

    def clear(self) -> ProjectGraph:
        self._tables, self._single = [], {}
        return self

    @property
    def files(self) -> DataFrame:
        """path, code, content_hash. One aggregation over all that was added, however many the additions."""
        tables = self._tables + ([self._singles()] if self._single else [])
        if not tables:
            return self.spark.createDataFrame([], FILE_SCHEMA + ", content_hash bigint")
        if len(tables) == 1:
            return tables[0]
        numbered = [x.select("path", "code", F.lit(k).alias("version")) for k, x in enumerate(tables)]
        return latest_files(reduce(DataFrame.unionByName, numbered), "version")

    def list_files(self) -> DataFrame:
        return self.files.select("path").orderBy("path")

    def analyzed(self, parts: Iterable[str] = PARTS) -> DataFrame:
        return self.files.withColumn("analysis", analysis_of(F.col("code"), parts))

    def get_file_structure(self, path: str) -> DataFrame:
        wanted = normalize_path(F.lit(path))
        return self.files.where(F.col("path") == wanted).withColumn("analysis", analysis_of(F.col("code"))).select("path", "analysis")

    def get_symbol_details(self, name: str, kind: str | None = None) -> DataFrame:
        return find_symbols(self.analyzed(["symbols", "export_signatures"]), name, kind).orderBy("path", "seq")

    def analyze_dependencies(self, paths: list[str]) -> DataFrame:
        """A row for each requested path, in order: path and its resolved imports (empty for unknown paths)."""
        asked = self.spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "__n int, requested string").withColumn("path", normalize_path(F.col("requested")))
        found = resolve_dependencies(unnest(self.analyzed(["imports"]), "imports"), self.files)
        lists = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "resolved_path", "source", "kind", "specifiers", "is_type_only", "line", "column"))).alias("dependencies"))
        joined = asked.join(lists, "path", "left").orderBy("__n")
        return joined.select("requested", F.coalesce("dependencies", F.array().cast(lists.schema["dependencies"].dataType)).alias("dependencies"))


def initialize_graph(spark: SparkSession, mode: str | None = None) -> ProjectGraph:
    """mode is accepted and ignored, as the graph starts empty either way."""
    return ProjectGraph(spark)
