"""What the operators of this subpackage share: inputs, intermediate tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.sources.shared import new_path, shared_dir, stored  # noqa: F401

#: Rows of an Arrow batch handed to Python; Spark also ends a batch at 64 MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trim() -> None:
    """Give freed memory back: Python workers outlive tasks, and share an executor's limit with it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Recent:
    """What was asked for last: two generations of about limit bytes each. As the young one is full, it takes the old one's
    place; what is asked for again comes back from there."""

    #: Bytes of a str, a bytes and their place in a dict, besides their contents.
    ENTRY = 230

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.young) * self.ENTRY > self.limit:
            self.young, self.old = {}, self.young

    def add(self, new: dict) -> None:
        self.young.update(new)

    def all(self, keys: list) -> tuple[list, list]:
        """(what is remembered of each key, None where nothing is; the keys of these). What is remembered is young from now on."""
        got = list(map(self.young.get, keys))
        if None not in got:
            return got, []
        missing = [k for k, g in zip(keys, got, strict=True) if g is None]
        back = dict(zip(missing, map(self.old.get, missing), strict=True))
        new = [k for k, x in back.items() if x is None]
        if len(new) < len(missing):
            for k in new:
                del back[k]
            self.young.update(back)
            got = [back.get(k) if g is None else g for k, g in zip(keys, got, strict=True)]
        return got, new


_memories: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """What a task of this kind remembers stays in its Python worker; what other kinds remember goes."""
    for other in [n for n in _memories if n != name]:
        _memories.pop(other)()
    if clear is not None:
        _memories[name] = clear


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that text operators read; a null text is an empty one."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fresh(names: list[str], taken: list[str]) -> list[str]:
    """names with underscores before them until none is among the taken ones, whatever their case."""
    low = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        out.append(n)
    return out


def list_array(values: pa.Array, lengths) -> pa.ListArray:
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
