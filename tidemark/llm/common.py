"""Shared helpers of the training-data operators.

Tables written on the way are those of :mod:`tidemark.functions.shared`.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import LOCAL_SHARED, Scratch, hadoop_path, materialize, remove_path, shared_dir, shared_path

__all__ = ["BROADCAST_KEYS", "LOCAL_SHARED", "Scratch", "batches_of", "bounded", "fresh", "give_back_memory", "hadoop_path", "held_out", "materialize", "read_table", "remove_path", "shared_dir", "shared_path", "text_digest", "without_rows"]
#: Keys up to this many are broadcast to leave rows out (some 50 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Rows up to which Spark may choose to broadcast a table that grows with the input: it goes by the size of files, and a
#: megabyte of hashes in a file takes the driver many times that while it builds the table.
BROADCAST_ROWS = 100_000


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound the Arrow batches of the jobs run inside; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (a null id does not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names not among the columns of ``df``, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has so many rows: beyond ``BROADCAST_ROWS`` it is shuffled, whatever the size of its files."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as binary; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most ``BROADCAST_KEYS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def without_rows(docs: DataFrame, gone: DataFrame, again: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of ``gone``, and one row of each of those in ``again``.

    Both are written tables ``id long, digest binary``: an id (which may be
    null) with the :func:`text_digest` of its text.  So of rows that share an
    id only those with that very text are meant.  Few keys are broadcast, and
    no text moves; beyond the bound both sides are shuffled by key.
    """
    (digest,) = fresh(docs, "digest")
    rows = docs.withColumn(digest, text_digest(F.col(text_col)))
    same = lambda side: rows[id_col].cast("long").eqNullSafe(side["id"]) & (rows[digest] == side["digest"])
    gone = _small(gone)
    kept = rows.join(gone, same(gone), "left_anti")
    if again is None or again.isEmpty():
        return kept.select(*docs.columns)
    again = _small(again)
    once = kept.join(again, same(again), "left_semi").dropDuplicates([id_col, digest])
    return kept.join(again, same(again), "left_anti").unionByName(once).select(*docs.columns)


def give_back_memory() -> None:
    """Return what a task's Python has freed to the system: workers are reused and would hold their peak."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
