"""Numbers, lags and running sums over a table in one total order, without gathering it in a task: rows lie in ranges of the
order, as many as shuffles have partitions, each range is worked by itself, and a row a range ties them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horosphere.sources.shared import stored

_RANGE, _BEFORE = "range__", "before__"


def ranged(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """df stored in ranges of by, whose rows must be distinct in it, with the range's number."""
    return stored(df.repartitionByRange(*by).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _with(x: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    """x with what is known of each range: a row a range, so that it may be broadcast."""
    return x.join(F.broadcast(x.sparkSession.createDataFrame(rows, f"{_RANGE} int, {_BEFORE} {kind}")), _RANGE)


def numbered(df: DataFrame, by: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """df with dense numbers from start in the order of by."""
    x, rows, total = ranged(df, by), [], start
    for r in x.groupBy(_RANGE).count().orderBy(_RANGE).collect():
        rows.append((r[0], total))
        total += r["count"]
    place = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*by)) - 1
    return _with(x, rows, "long").withColumn(name, F.col(_BEFORE) + place).drop(_RANGE, _BEFORE)


def before(df: DataFrame, by: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the value of the row before in a circular order: the first row's is the last one's."""
    x = ranged(df, by)
    ends = x.groupBy(_RANGE).agg(F.max_by(value, F.struct(*by)).alias("last")).orderBy(_RANGE).collect()
    rows = [(r[0], ends[i - 1].last) for i, r in enumerate(ends)]
    lag = F.lag(value).over(Window.partitionBy(_RANGE).orderBy(*by))
    return _with(x, rows, x.schema[value].dataType.simpleString()).withColumn(name, F.coalesce(lag, F.col(_BEFORE))).drop(_RANGE, _BEFORE)


def running(df: DataFrame, by: list[Column | str], value: str, name: str) -> tuple[DataFrame, float]:
    """(df with the sum of value up to each row, the whole sum)."""
    x, rows, total = ranged(df, by), [], 0.0
    for r in x.groupBy(_RANGE).agg(F.sum(value).alias("s")).orderBy(_RANGE).collect():
        rows.append((r[0], total))
        total += r.s
    part = F.sum(value).over(Window.partitionBy(_RANGE).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return _with(x, rows, "double").withColumn(name, F.col(_BEFORE) + part).drop(_RANGE, _BEFORE), total
