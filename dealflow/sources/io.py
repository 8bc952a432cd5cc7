"""Scans and sinks for the two input tables and the result tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.functions.names import snake_name, unique_names
from dealflow.operators.filters import DataQualityError
from dealflow.session import remove_path, shared_path

OPPORTUNITY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("opportunity_owner", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("created_date", T.DateType()),
    T.StructField("last_stage_change_date", T.DateType()),
    T.StructField("employees", T.IntegerType()),
    T.StructField("sold_price_per_registered_member", T.DoubleType()),
])

# Column types of the two inputs by cleaned name, applied after name cleaning
# when the source carries no types (CSV read as text).
OPPORTUNITY_TYPES = {f.name: f.dataType.simpleString() for f in OPPORTUNITY_SCHEMA.fields
                     if not isinstance(f.dataType, (T.StringType, T.DateType))}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, **options) -> DataFrame:
    """Parquet (schema from the files, or the given one) or CSV with header.

    CSV without a schema is read as text: no inference pass over the data;
    types are applied by name afterwards (``ingest(..., types=...)``).
    Filters and projections applied later reach the scan through Catalyst.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def read_opportunities(spark: SparkSession, path: str, fmt: str = "parquet",
                       schema: T.StructType | None = None) -> DataFrame:
    return read_table(spark, path, fmt, schema)


def read_rep_team(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType | None = None) -> DataFrame:
    return read_table(spark, path, fmt, schema)


def remove_empty(df: DataFrame, rows: bool = True, cols: bool = True) -> DataFrame:
    """Drop columns that are NULL everywhere and rows that are NULL everywhere.

    Column emptiness needs one aggregation pass (one row back to the driver:
    a non-null count per column); rows are filtered lazily.
    """
    keep = df.columns
    if cols:
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
        keep = [c for c in df.columns if counts[c] > 0]
        df = df.select(*keep)
    if rows and keep:
        df = df.na.drop(how="all")
    return df


REJECTED = "_rejected"  # the text of a record that does not fit the types


class TypedScan(NamedTuple):
    rows: DataFrame       # records that fit, with their declared types
    rejected: DataFrame   # (record, file) of those that do not
    n_rows: int
    n_rejected: int
    path: str             # the stored parse; ``remove_path`` deletes it


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                   multiline: bool = True, store: str | None = None, **options) -> TypedScan:
    """CSV with declared types, and a side table of the records that do not fit.

    A record is rejected as a whole, with its text, if a value does not convert
    to its column's type or if it has more or fewer values than there are
    columns. With a header, columns are found by their cleaned names in any order
    (columns that ``schema`` does not name stay text); without one, by position.
    The text is parsed once, into a stored table that both results read; the
    counts come from that write. Quoted line breaks need ``multiline``, which
    makes each file one task: switch it off for large files without them.
    """
    reader = spark.read.options(header=str(header).lower(), multiLine=str(multiline).lower(), quote='"', escape='"',
                                dateFormat="yyyy-MM-dd", **options)
    types = {f.name: f.dataType for f in schema.fields}
    names = schema.names
    if header:  # reads the first line only
        names = unique_names([snake_name(c) for c in reader.option("inferSchema", "false").csv(path).columns])
        missing = [c for c in types if c not in names]
        if missing:
            raise ValueError(f"columns not in the file: {', '.join(missing)}")
    full = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names]
                        + [T.StructField(REJECTED, T.StringType())])
    # Without column pruning every value of a record is checked, whatever is read later.
    parsed = reader.schema(full).options(mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED,
                                         columnPruning="false").csv(path)
    seen = Observation()
    store = store or shared_path(spark, "typed")
    parsed.withColumn("_file", F.input_file_name()).observe(
        seen, F.count(F.lit(1)).alias("all"), F.count(REJECTED).alias("bad")).write.parquet(store)
    stored = spark.read.schema(T.StructType([*full.fields, T.StructField("_file", T.StringType())])).parquet(store)
    return TypedScan(stored.where(F.col(REJECTED).isNull()).select(*schema.names, *[c for c in names if c not in types]),
                     stored.where(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("record"), F.col("_file").alias("file")),
                     seen.get["all"] - seen.get["bad"], seen.get["bad"], store)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def recover_table(spark: SparkSession, path: str) -> None:
    """Undo a swap that a crash cut in two: the former table goes back to its
    place. Staged tables and former tables that are left over are deleted."""
    path = path.rstrip("/")
    fs, make = _files(spark, path)
    if fs.exists(make(path)) or not fs.exists(make(path).getParent()):
        return
    kept = [x.getPath() for x in fs.globStatus(make(path + ".former-*")) or []]
    if kept:
        fs.rename(kept[0], make(path))


def replace_table(df: DataFrame, path: str, fmt: str = "parquet",
                  check: Callable[[], None] = lambda: None, **options) -> None:
    """Write ``df`` to ``path``, whatever was there before.

    The rows go to a folder beside it first; only when all are written, and
    ``check`` raises nothing, the two folders are swapped by renaming. Readers see
    the old table or the new one, never half of one; a failure before the swap
    leaves the old one, and one inside it is undone by :func:`recover_table`,
    which runs before each write. ``df`` may read ``path`` itself. Renaming is one
    step in HDFS and local file systems; on an object store without renames use
    a table format with commits of its own.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recover_table(spark, path)
    fs, make = _files(spark, path)
    tag = uuid.uuid4().hex[:12]
    staged, former = f"{path}.staged-{tag}", f"{path}.former-{tag}"
    try:
        df.write.format(fmt).options(**options).save(staged)
        check()
    except BaseException:
        remove_path(spark, staged)
        raise
    if fs.exists(make(path)) and not fs.rename(make(path), make(former)):
        remove_path(spark, staged)
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(make(staged), make(path)):
        fs.rename(make(former), make(path))
        raise OSError(f"cannot move the new table to {path}")
    remove_path(spark, former)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Replace ``path`` by ``df`` (see :func:`replace_table`) and return a reader
    over what was written."""
    replace_table(df, path, fmt, **({"header": "true"} if fmt == "csv" else {}))
    return read_table(df.sparkSession, path, fmt, df.schema if fmt == "csv" else None)


def write_checked(df: DataFrame, path: str, forbidden: Column, what: str = "rows", fmt: str = "parquet") -> DataFrame:
    """:func:`write_table` behind a data-quality gate without a pass of its own:
    the rows that ``forbidden`` holds for are counted by the job that writes, and
    the table is put in place only if there are none."""
    gate = Observation()

    def check() -> None:
        if gate.get["n"]:
            raise DataQualityError(f"expected no {what}, found {gate.get['n']}")

    counted = df.observe(gate, F.coalesce(F.sum(F.coalesce(forbidden, F.lit(False)).cast("long")), F.lit(0)).alias("n"))
    replace_table(counted, path, fmt, check, **({"header": "true"} if fmt == "csv" else {}))
    return read_table(df.sparkSession, path, fmt, df.schema if fmt == "csv" else None)


def export_tables(tables: dict[str, DataFrame], out_dir: str | None = None,
                  fmt: str = "parquet", parallel: int = 4) -> dict[str, DataFrame]:
    """Write each named result table under ``out_dir`` (default: a fresh
    folder below the shared checkpoint folder); return the read-back frames.

    The writes are submitted from up to ``parallel`` driver threads, so small
    result tables are computed and written side by side.
    """
    def one(item):
        name, df = item
        base = out_dir.rstrip("/") + "/" + name if out_dir else shared_path(df.sparkSession, name)
        return name, write_table(df, base, fmt)

    items = list(tables.items())
    if parallel <= 1 or len(items) <= 1:
        return dict(map(one, items))
    with ThreadPoolExecutor(max_workers=min(parallel, len(items))) as pool:
        return dict(pool.map(one, items))


def preview_head(df: DataFrame, order: str | list[str] = "id", n: int = 6) -> DataFrame:
    """First ``n`` rows in key order (a TopK, not a full sort)."""
    order = [order] if isinstance(order, str) else order
    return df.orderBy(*order).limit(n)
