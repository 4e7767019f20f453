"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_passing: list[list[str]] = []  # tables of the open ``working`` blocks, innermost last


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder of our own only where it is unset and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        shared = _own.setdefault(app, tempfile.mkdtemp(prefix="shopfloor-"))
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows while texts go to Python: 10,000 very long ones would not fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for lasting ones.

    What is read after the block must not need the others: its last step inside is a lasting table or an action.
    """
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps do not recompute it.

    Inside ``working``, a table that is not ``lasting`` goes at the block's end; outside, every table stays.
    """
    spark = df.sparkSession
    path = folder(spark)
    if _passing and not lasting:
        _passing[-1].append(path)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
