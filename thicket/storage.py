"""The folder in which intermediate tables are kept: one that all executors and the driver share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables made in each scope that is open, from the outermost in.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one, which only a local master can share; on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stash(df: DataFrame, outer: bool = False, batch: int | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: what follows doesn't depend on executors that are lost, nor on inputs that change.
    It's deleted at the end of the scope that is open, or of the one around that. batch: rows that Python workers get at once while it is made, where rows are large."""
    spark = df.sparkSession
    path, usual = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, min(batch, int(usual)) if int(usual) > 0 else batch)
        df.write.parquet(path)
    finally:
        if batch:
            spark.conf.set(_BATCH, usual)
    scopes = _scopes.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside are deleted at the end: nothing that is returned may still read them."""
    tables: list[str] = []
    token = _scopes.set((*_scopes.get(), tables))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in tables:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        # Spark drops the shuffle files, broadcasts and compiled classes of plans that are done when the driver's collector finds them
        gc.collect()
        spark._jvm.java.lang.System.gc()
