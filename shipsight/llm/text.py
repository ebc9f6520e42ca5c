"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text table reach Python in batches; operators work on slices of about so many characters.
SLICE_CHARS = 4_000_000


def filled(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the decimal id leaves `rest`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many signs before it as keep it apart from the columns of `docs` in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole(docs: DataFrame) -> list[Column]:
    """The columns by name, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python take whole texts in batches of fewer rows, unless the session says how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about `chars` bytes of text each; a longer single row is a table of its own."""
    give_back()
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= chars:
                kept.append(batch.slice(at, i + 1 - at))
                yield pa.Table.from_batches(kept)
                kept, size, at = [], 0, i + 1
        if at < batch.num_rows:
            kept.append(batch.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


def texts(table: pa.Table | pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in table.column(column).to_pylist()]


def to_tasks(spark: SparkSession, thing) -> Broadcast:
    """Broadcast a bounded object with the classes of this package by value; `from_driver` gives it back in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def give_back() -> None:
    """Let this worker return freed arrays of 1 MB or more to the system at once; the workers share a tight memory limit."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of glibc; others have no such setting
        libc.malloc_trim(0)  # what earlier tasks of this worker left
    pa.set_memory_pool(pa.system_memory_pool())


def from_driver(sent: Broadcast):
    give_back()
    return pickle.loads(sent.value)
