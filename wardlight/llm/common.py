"""What the operators of this subpackage share: tables, the shared folder, word and byte rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read, small_batches

#: Java and Python pattern of what separates words; words are `[^\x20\x09-\x0D]+`.
BREAKS = r"[ \t-\r]+"
#: The same for bytes of UTF-8.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")
WORD_TEXT = re.compile("[^\x20\x09-\x0d]+")
#: A-Z only, unlike str.lower.
LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows handed on at once by the Arrow operators, so that long texts never pile up.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system; workers are kept, and others need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, a local one serves a local master; on a cluster that would lose data, so it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/wardlight-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named.rstrip("/")


#: Catalog database of the bucketed tables.
DATABASE = "wardlight_work"
#: What the innermost open scratch() of this thread or task has written: (session, path, table or None).
SCRATCH: ContextVar[list[tuple[SparkSession, str, str | None]] | None] = ContextVar("scratch", default=None)


def written(spark: SparkSession, path: str, name: str | None = None) -> None:
    if (own := SCRATCH.get()) is not None:
        own.append((spark, path, name))


def remove(held: list[tuple[SparkSession, str, str | None]]) -> None:
    for spark, path, name in held:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def results() -> Iterator[None]:
    """Operators' results that are written inside are removed at its end; without it they stay until the caller's folder goes."""
    token = SCRATCH.set(own := [])
    try:
        yield
    finally:
        SCRATCH.reset(token)
        remove(own)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is materialized inside is removed at its end, tables and folders.

    Yields keep(df, tag), which writes df so that it outlives this scratch; an outer one removes it.
    """
    outer, own = SCRATCH.get(), []
    token = SCRATCH.set(own)
    held: list[tuple[SparkSession, str, str | None]] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        found = materialize(df, tag)
        held.append(own.pop())
        return found

    try:
        yield keep
    finally:
        SCRATCH.reset(token)
        if outer is not None:
            outer.extend(held)
        remove(own)


#: Rows of a file where a table's size is known; files are costly to open, and some file systems start a process for each.
FILE_ROWS = 50_000


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends, ids given stay as they are.

    rows: about how many rows df has at most; few of them are written as a few files instead of one per partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    written(spark, path)
    if rows is not None and (parts := max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(parts)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, tag: str, key: str, parts: int) -> DataFrame:
    """As materialize, but bucketed by key into `parts`: what is grouped or joined by key later isn't shuffled again. For rows that are packed already."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    written(spark, path, f"{DATABASE}.{name}")
    df.write.bucketBy(parts, key).option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(f"{DATABASE}.{name}")
    return spark.table(f"{DATABASE}.{name}")


def parts_for(spark: SparkSession, size: int) -> int:
    """Partitions for `size` bytes of text: as many as shuffles have, more where these would exceed 64 MB."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))


def training_rest(id_col: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus))


def map_texts(df: DataFrame, text_col: str, keep: list[str], schema: str, fn: Callable, kind: str = "string") -> DataFrame:
    """One output row per input row: the columns `keep`, then what fn makes of the text, which replaces columns of the same names.

    Arrow batches are taken apart into small ones, so memory holds ROWS_AT_ONCE results and one
    batch of input. schema: DDL of fn's columns; kind: of what fn is given.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    made = _parse_datatype_string(schema)
    keep = [c for c in keep if c not in made.names]
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast(kind).alias("t"))
    out = StructType([*rows.schema.fields[:-1], *made.fields])
    arrow = to_arrow_schema(out)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS_AT_ONCE):
                batch = big.slice(at, ROWS_AT_ONCE)
                found = [fn(t.as_py()) for t in batch.column(n)]
                columns = [batch.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [pa.array(list(c), type=arrow.field(n + i).type) for i, c in enumerate(zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        tidy()

    return rows.mapInArrow(run, out).toDF(*keep, *made.names)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
