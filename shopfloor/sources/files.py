"""Readers and writers for the process files, and a manifest of them.

Rows of a file get their position where an order matters: Spark rows have none of their own.  Helper columns begin
with ``_sf_``, which is reserved; other names never clash.  Null values, empty files and empty tables are read and
written as they are; a file without rows has no positions.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import nan_to_null
from ..operators.ordered import with_position

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = _own.setdefault(app, tempfile.mkdtemp(prefix="shopfloor-"))
    path = f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete folders that ``shared_folder`` gave, all of this application's unless named; what reads them has to be done."""
    known = _made.get(spark.sparkContext.applicationId, [])
    gone = 0
    for path in list(known if paths is None else paths):
        fs, where = _file_system(spark, path)
        gone += bool(fs.delete(where, True))
        if path in known:
            known.remove(path)
    return gone


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read again: what several steps use is not built for each of them."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """A table of this session, stored in the shared folder by buckets of ``keys`` and sorted by them.

    Tables with equal keys and bucket numbers are joined, grouped and counted by these keys without an exchange.  A bucket
    is one task: their number is that of shuffle partitions unless given.
    """
    spark = df.sparkSession
    name, path = f"stored_{uuid.uuid4().hex}", shared_folder(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One file for each bucket, from the task that has it.
    dealt = df.repartition(n, *keys)
    dealt.write.format("parquet").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with one header row, names checked, NaN as missing."""
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST"))


def with_source_row(df: DataFrame, name: str = "source_row") -> DataFrame:
    """0-based position in reading order over all splits, before any sort (S4); ``df`` comes straight from files.

    The splits are the blocks of the scan: they are numbered in the order of file and offset (a table of one row per
    split), rows count in their split, and the splits' counts are carried on.  An old column ``name`` is replaced.
    """
    old = [c for c in df.columns if c != name]
    meta = {"_sf_file": F.col("_metadata.file_path"), "_sf_start": F.col("_metadata.file_block_start"), "_sf_at": F.monotonically_increasing_id()}
    marked = df.select(*[F.col(f"`{c}`") for c in old], *[v.alias(k) for k, v in meta.items()])
    parts = marked.groupBy("_sf_file", "_sf_start").agg(F.count(F.lit(1)).alias("_sf_rows"))
    numbered = parts.select("_sf_file", "_sf_start", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_sf_file", "_sf_start")) - 1).alias("_sf_split"))
    placed = with_position(marked.join(numbered, ["_sf_file", "_sf_start"]), [], "_sf_at", name, F.col("_sf_split"))
    return placed.select(*[F.col(f"`{c}`") for c in old], name)


def read_csv_two_header(spark: SparkSession, path: str, schema: str, name: str = "source_row") -> DataFrame:
    """CSV whose second header row names the columns (S2, S3); one record per line, position without headers.

    ``schema`` gives names, without blanks around them, and types; the file's second row has to name the same columns.
    """
    lines = with_source_row(spark.read.text(path), "_sf_line")
    head = lines.where("_sf_line = 1").first()
    own = spark.createDataFrame([], schema).columns
    found = [c.strip().strip('"').strip() for c in head["value"].lstrip("﻿").split(",")] if head else []
    if found != own:
        raise ValueError(f"columns are {found}, not {own}")
    rows = lines.where("_sf_line >= 2").select(F.from_csv("value", F.lit(schema), {"mode": "FAILFAST"}).alias("_sf_r"), (F.col("_sf_line") - 2).alias(name))
    return nan_to_null(rows.select("_sf_r.*", name))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, column_name, type)`` of every Parquet file at or below ``path``, from the files' own footers."""
    names = spark.createDataFrame([(f,) for f, _ in _listed(spark, [path])], "path string")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as f:
                    schema = pq.ParquetFile(f).schema_arrow
                rows += [(uri, field.name, str(field.type)) for field in schema]
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (a, b, c)], ["path", "column_name", "type"])

    return names.repartition(max(1, min(names.count(), 1000)), "path").mapInArrow(run, "path string, column_name string, type string")


# What a declared Spark type is called in a file.
STORED_TYPES = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "string": "string", "boolean": "bool", "date": "date32[day]", "binary": "binary", "timestamp_ntz": "timestamp[us]", "timestamp": "timestamp[us, tz=UTC]"}


def footer_problems(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """``(path, column_name, problem)``: columns that a file lacks, has besides the declared ones, or stores as another type."""
    found = footers(spark, path)
    wanted = spark.createDataFrame([(c, STORED_TYPES.get(t.split(" not null")[0], t.split(" not null")[0])) for c, t in columns.items()], "column_name string, wanted string")
    each = found.select("path").distinct().join(F.broadcast(wanted))  # files times declared columns: the rows of the result at most
    both = each.join(found, ["path", "column_name"], "full")
    problem = F.when(F.col("type").isNull(), "missing").when(F.col("wanted").isNull(), "not declared").when(F.col("type") != F.col("wanted"), F.concat(F.lit("stored as "), "type"))
    return both.withColumn("problem", problem).where("problem is not null").select("path", "column_name", "problem")


def read_table(spark: SparkSession, path: str, schema: StructType | str, checked: bool = False) -> DataFrame:
    """Parquet with a declared schema (S5); ``checked`` compares the files' footers with it first, and fails naming what differs.

    Unchecked, a column that a file lacks reads as missing values.
    """
    if checked:
        kinds = spark.createDataFrame([], schema).dtypes
        bad = footer_problems(spark, path, dict(kinds)).orderBy("path", "column_name").limit(20).collect()
        if bad:
            raise ValueError("; ".join(f"{r['path'].rsplit('/', 1)[-1]}: {r['column_name']} {r['problem']}" for r in bad))
    return nan_to_null(spark.read.schema(schema).parquet(path))


def write_table(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Parquet with the declared columns, in order and cast (S6); a type that ends in ``not null`` fails on a missing value."""
    made = []
    for c, t in columns.items():
        kind, strict = t.removesuffix(" not null"), t.endswith(" not null")
        value = F.col(f"`{c}`").cast(kind)
        message = F.raise_error(F.lit(f"missing value in {c}")).cast(kind)
        made.append((F.when(value.isNull(), message).otherwise(value) if strict else value).alias(c))
    df.select(*made).write.parquet(path)


FOLD_SCHEMA = "dataset string, scheme string, fold string, row_id string, role string, `order` string, episode_id string, run_id bigint"


def write_folds(df: DataFrame, path: str, rows: int = 5_000_000) -> None:
    """CSV of assignments with its eight columns (S7), compressed, as each record is repeated in every fold.

    A compressed file is read by one task: none has more than ``rows`` rows.
    """
    named = df.select("dataset", "scheme", "fold", "row_id", "role", "order", "episode_id", "run_id")
    named.write.options(header=True, compression="gzip", maxRecordsPerFile=rows).csv(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Assignments with fold, order and episode as text, whatever they look like."""
    return spark.read.schema(FOLD_SCHEMA).csv(path, header=True)


def write_fold_store(folds: DataFrame, path: str, files: int = 8) -> None:
    """Assignments by dataset, scheme and fold, each in up to ``files`` files, so that a reader opens one combination only."""
    part = F.pmod(F.xxhash64("row_id"), F.lit(files))
    columns = [c.split()[0].strip("`") for c in FOLD_SCHEMA.split(", ")]
    folds.select(*columns).repartition("dataset", "scheme", "fold", part).write.partitionBy("dataset", "scheme", "fold").parquet(path)


def read_fold_store(spark: SparkSession, path: str, dataset: str | None = None, scheme: str | None = None, fold: str | None = None) -> DataFrame:
    """Assignments of a store; what is named is a filter on partitions, so other files are not opened."""
    store = spark.read.schema(FOLD_SCHEMA).parquet(path)
    for c, v in (("dataset", dataset), ("scheme", scheme), ("fold", fold)):
        store = store if v is None else store.where(F.col(c) == v)
    return store


def chosen_folds(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The combinations ``wanted(dataset, scheme, fold)`` of a store, a short list; partitions are pruned when the list is known."""
    return store.join(F.broadcast(wanted.select("dataset", "scheme", "fold").distinct()), ["dataset", "scheme", "fold"])


BITMAP_SCHEMA = "dataset string, word int, row_id string, `order` string, episode_id string, run_id bigint, bits bigint"


def write_bitmap_store(bitmaps: DataFrame, combinations: DataFrame, path: str) -> None:
    """Assignments as bitmaps by dataset and word, a row for each record and 32 combinations, excluded ones too.

    A store grows with the records, not with records times folds, and nothing is shuffled to write it; a reader opens the
    words that its combinations are in, ``place div 32``.
    """
    last = combinations.groupBy("dataset").agg(F.expr("cast(max(place) div 32 as int)").alias("_sf_last"))  # one row for each dataset
    each = bitmaps.join(F.broadcast(last), "dataset").select("*", F.explode(F.expr("sequence(0, _sf_last)")).alias("word"))
    bits = F.coalesce(F.get("roles", F.col("word")), F.lit(0)).cast("bigint").alias("bits")
    each.select("dataset", "word", "row_id", "order", "episode_id", "run_id", bits).write.partitionBy("dataset", "word").parquet(path)


def read_bitmap_store(spark: SparkSession, path: str, dataset: str | None = None, place: int | None = None) -> DataFrame:
    """Bitmaps of a store; a dataset and place that are named are filters on partitions, so other files are not opened."""
    store = spark.read.schema(BITMAP_SCHEMA).parquet(path)
    store = store if dataset is None else store.where(F.col("dataset") == dataset)
    return store if place is None else store.where(F.col("word") == int(place) // 32)


def read_contract(spark: SparkSession, path: str) -> dict:
    """JSON contract: lists of column names."""
    return spark.read.json(path, multiLine=True).first().asDict(recursive=True)


CHUNK = 4 << 20  # bytes of a file that a task holds at once


def _listed(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """Path and length of each file at or directly below ``paths``, but for those that begin with ``_`` or ``.``; a missing path has none."""
    out = {}
    for path in paths:
        fs, where = _file_system(spark, path)
        if not fs.exists(where):
            continue
        for f in fs.listStatus(where):
            if f.isFile() and f.getPath().getName()[:1] not in ("_", "."):
                out[f.getPath().toString()] = f.getLen()
    return sorted(out.items())


def _opened(uri: str):
    """A file of a task's own file system: local paths directly, others through Arrow's file systems."""
    from urllib.parse import urlsplit
    from urllib.request import url2pathname

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(url2pathname(parts.path), "rb")
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_stream(path)


def file_digests(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """``(path, bytes, sha256)`` of files of any size: a task reads a file chunk by chunk and carries the digest's state on.

    Files are dealt to tasks one by one; no file is held as a value, so there is no limit of 2 GB.
    """
    listed = _listed(spark, paths)
    names = spark.createDataFrame(listed, "path string, bytes bigint").repartition(max(1, min(len(listed), 10_000)), "path")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            sums = []
            for uri in batch.column(0).to_pylist():
                state = hashlib.sha256()
                with _opened(uri) as f:
                    while part := f.read(chunk):
                        state.update(part)
                sums.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    return names.mapInArrow(run, "path string, bytes bigint, sha256 string")


def build_manifest(spark: SparkSession, paths: list[str], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(path, bytes, sha256)`` of files, and for tables ``(n_rows, n_columns, columns)``."""
    files = file_digests(spark, paths)
    files = files.withColumns({"n_rows": F.lit(None).cast("bigint"), "n_columns": F.lit(None).cast("bigint"), "columns": F.lit(None).cast("map<string,string>")})
    for path, df in (tables or {}).items():
        kinds = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(path).alias("path"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), kinds.alias("columns"))
        files = files.unionByName(row)
    return files


def verify_manifest(spark: SparkSession, manifest: DataFrame, paths: list[str]) -> DataFrame:
    """``(path, problem)`` of files that changed, are missing or are not listed."""
    now = file_digests(spark, paths).select("path", F.col("sha256").alias("now"))
    both = manifest.where("sha256 is not null").select("path", "sha256").join(now, "path", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("now") != F.col("sha256"), "changed")
    return both.withColumn("problem", problem).where("problem is not null").select("path", "problem")
