"""What the corpus operators share: the shared folder, tables in it, and text columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, working_folder

__all__ = [
    "batches_by_bytes",
    "documents",
    "free_prefix",
    "landed",
    "remove",
    "on_change",
    "set_columns",
    "task",
    "workspace",
]

# In a worker process: whose task ran last, and what to do when another operator's begins.
_owner: str | None = None
_on_change: list[Callable[[], None]] = []


def workspace(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new folder for one run, below ``folder`` or the session's shared one."""
    base = folder or working_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, path: str) -> DataFrame:
    """The rows written as Parquet and read again; cuts the lineage and survives lost executors."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_prefix(*tables: DataFrame) -> str:
    """What no column of the tables begins with, for columns that an operator adds for a while."""
    names = [c.lower() for rows in tables for c in rows.columns]
    prefix = "__"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def set_columns(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns; those of the input with the same name (in any case) give way."""
    taken = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in taken]
    return rows.select(*kept, *[c.alias(n) for n, c in new.items()])


def batches_by_bytes(batches: Iterator, column: str, limit: int = 1 << 23) -> Iterator:
    """Arrow batches cut so that a text column holds about ``limit`` bytes at most (or one row).

    A batch of very long texts then never meets its Python copies all at once.
    """
    for batch in batches:
        size = batch.column(column).nbytes
        if size <= limit or batch.num_rows < 2:
            yield batch
            continue
        step = max(1, batch.num_rows * limit // size)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def on_change(clear: Callable[[], None]) -> Callable[[], None]:
    """Has ``clear`` called whenever a worker process turns to another operator: workers are kept, and
    so are the tables of known words that an operator builds up in them."""
    _on_change.append(clear)
    return clear


def task(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that leaves its worker process small: tables of other operators go before it
    begins, and memory that is free goes back to the system when it ends."""

    def tidy(batches: Iterator) -> Iterator:
        _turn_to(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy


def _turn_to(owner: str) -> None:
    global _owner
    if _owner not in (None, owner):
        for clear in _on_change:
            clear()
        _give_back()
    _owner = owner


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
