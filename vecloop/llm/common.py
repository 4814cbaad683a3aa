"""Small helpers of the operators: columns, Arrow rows, files in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecloop.session import fresh_path

#: Characters that end a word: space and 0x09 to 0x0D. ``bytes.split()`` cuts at exactly these.
BLANKS = " \t\n\x0b\x0c\r"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: ``pick(docs, id="doc_id")``.

    Whatever else the table holds, and however it is called, can then clash with nothing.
    """
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield record_batch(held, schema)
            held = []
    if held:
        yield record_batch(held, schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, as a full URI that tasks can open with ``pyarrow.fs``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(fresh_path(spark, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_folder(uri: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:/"):  # Hadoop writes file:/x where others write file:///x
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands its memory back when the task ends.

    Spark keeps Python workers for later tasks. What their allocators hold on to counts against the
    executor while other stages run, so pools are emptied and free heap pages returned.
    """

    def run(parts: Iterator) -> Iterator:
        try:
            yield from kernel(parts)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run
