"""Shared pieces of the training-data operators: tables in the cluster's shared
folder, null handling, and hashing on numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import delete_at_exit, shared_dir

GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element, on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + GOLD
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


#: Narrow rows that a task writes at least, where their number is known.
FILE_ROWS = 100_000


def sized(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """No more partitions than `rows` need, `each` to a task, but one for each core:
    small tables become few files even where shuffles have many partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


class Workspace:
    """Tables and files of one run of an operator, in the folder that driver and
    executors share, until the application ends; or below `root`, where they stay.

    A written table cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and nothing depends on a disk of one machine.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.stays = spark, root is not None
        self.root = root.rstrip("/") if root else f"{shared_dir(spark)}/lattica-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        if not self.stays:
            path = self._path(self.root)
            self._files(path).mkdirs(path)
            delete_at_exit(spark, self.root)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, compression: str = "zstd", rows: int | None = None) -> DataFrame:
        """Write a table and read it again; `rows`, where known, sizes its files."""
        if rows is not None:
            df = sized(df, rows)
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables no later step reads, so that rounds don't fill the disk."""
        for name in names:
            path = self._path(self.path(name))
            self._files(path).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others have none


def give_back() -> None:
    """Hand memory that was freed back to the machine. A worker lives on for the tasks of
    other stages; without this it keeps the most that any of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; a worker gives freed memory back when a task is over."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[dict] | list[dict]], schema: str, size: int = 512) -> DataFrame:
    """mapInArrow over slices of `size` rows; `rows` turns a slice into dicts of
    columns. Memory is bounded by a slice and its results, whatever the input."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                for columns in rows(batch.slice(at, size)):
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in out], schema=out)

    return map_arrow(df, run, schema)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary array without nulls, and where each
    value starts; one offset more is the end."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many bytes of a column, or of one row."""
    _, offsets = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def binary_rows(blocks: list[np.ndarray]) -> pa.Array:
    """Numeric arrays as binary values, little-endian."""
    return pa.array([b.tobytes() for b in blocks], pa.binary())


def held_out(column: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_text(docs: DataFrame, keep: list[str], text: str) -> tuple[int, list[Column]]:
    """Columns `keep` for a worker and the place of the text among them, which is added
    only where `keep` doesn't have it as a string."""
    columns = [F.col(f"`{c}`") for c in keep]
    if text in keep and docs.schema[text].dataType.typeName() == "string":
        return keep.index(text), columns
    return len(keep), [*columns, F.col(f"`{text}`").cast("string").alias("_text")]
