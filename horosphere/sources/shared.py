"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given := tempfile.mkdtemp(prefix="horosphere-"))
    return given if "://" in given else f"file://{given}"


_written: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of the shared folder that nothing else has; release() deletes what is there."""
    _written.append(path := f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return path


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables and files of this process. Tables read from them, and not yet collected or written, are
    lost: for the end of a program or a long-lived session's idle time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written and reread, which cuts its lineage."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_arrow(path: str, columns: list[str], only: tuple[str, object] | None = None):
    """Columns of a stored table, or of the rows at which one column has a value, read by a task."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path)
    return ds.dataset(inside, filesystem=where, format="parquet", exclude_invalid_files=False).to_table(columns=columns, filter=None if only is None else ds.field(only[0]) == only[1])


def read_batches(path: str, columns: list[str], rows: int = 1 << 20):
    """The columns of a stored table as tuples of arrays, some rows at a time."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path)
    table = ds.dataset(inside, filesystem=where, format="parquet", exclude_invalid_files=False)
    for b in table.to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1):
        if len(b):
            yield tuple(b.column(c).to_numpy() for c in columns)
