"""Source files as rows (path, code), and the sinks of scans."""

from __future__ import annotations

import os
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_EXTENSIONS = ("js", "ts", "jsx", "tsx")


def parse_extensions(value: str | None) -> list[str]:
    """Comma-separated; blanks and leading dots are ignored."""
    if value is None:
        return list(DEFAULT_EXTENSIONS)
    return [x for part in value.split(",") if (x := part.strip().lstrip("."))]


def read_files(spark: SparkSession, root: str, extensions: str | None = None, permissive: bool = False) -> DataFrame:
    """Every file below root with one of the extensions, a row each: path, code. A file that isn't UTF-8 is an error; permissive skips such files,
    and those that vanish or can't be read."""
    wanted = parse_extensions(extensions)
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(wanted) + "}")
    if permissive:
        reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    files = reader.load(root)
    if permissive:
        return files.where(F.is_valid_utf8("value")).select(path.alias("path"), F.col("value").alias("code"))
    return files.select(path.alias("path"), F.validate_utf8("value").alias("code"))


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "path string, code string")


def write_in_place(rewrites: DataFrame, dry_run: bool = False) -> None:
    """Writes changed files back: rows path, code, updated, modifications. One file a row, so a repeated task writes the same again."""
    if dry_run:
        return

    def write(rows) -> None:
        for row in rows:
            temporary = f"{row.path}.{os.getpid()}.tmp"
            with open(temporary, "w", encoding="utf-8", newline="") as f:
                f.write(row.updated)
            os.replace(temporary, row.path)
            folder, name = os.path.split(row.path)
            with suppress(FileNotFoundError):  # a checksum of the old content, if Hadoop wrote the file
                os.remove(os.path.join(folder, f".{name}.crc"))

    rewrites.where((F.col("modifications") > 0) & (F.col("updated") != F.col("code"))).select("path", "updated").foreachPartition(write)


def summary_json(summary: DataFrame) -> str:
    """A JSON array of path, matches and modifications (left out in dry runs), in path order: the CLI's output."""
    rows = summary.select("path", "matches", "modifications").orderBy("path").toLocalIterator()
    return "[" + ",".join(_row_json(r) for r in rows) + "]"


def _row_json(row) -> str:
    import json

    return json.dumps({k: v for k, v in row.asDict().items() if v is not None}, ensure_ascii=False, separators=(",", ":"))


def summary_text(summary: DataFrame) -> str:
    lines = []
    for r in summary.select("path", "matches", "modifications").orderBy("path").toLocalIterator():
        lines += [f"File: {r.path}", f"Matches: {r.matches}"] + ([f"Modifications: {r.modifications}"] if r.modifications is not None else [])
    return "\n".join(lines)
