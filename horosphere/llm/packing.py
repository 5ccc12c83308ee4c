"""Documents into sequences of bounded length: sum-of-squares packing.

An open bin with residual gap g counts in N(g). Each piece goes where the sum of N(g) squared over all gaps becomes
smallest: into some open bin that it fits, or a new one; equal sums: the smallest gap that remains. Pieces of full
length fill a sequence each. Pieces are dealt into groups by a hash of their document, of about GROUP documents each, and
every group is packed by its own task, largest pieces first; what is not full then is taken apart once and placed anew,
each piece where it leaves least. A group so loses a sequence or two, whatever the number of documents.

Edge cases: a null or empty text is one piece, its end id; a null doc_id is packed like any other; repeated rows are
packed each for itself; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import map_arrow, small_batches, table, texts, trim
from horosphere.llm.simple8b import with_end

GROUP = 16384


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every piece, in the given order, and the number of bins."""
    n = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        leave = np.where(n[size:] > 0, 1 - 2 * n[size:], np.iinfo(np.int64).max // 2)  # by the gap before, from size up
        leave[-1] = 0  # a new bin leaves no other count
        enter = 2 * n[: capacity + 1 - size] + 1
        enter[0] = 0  # a full bin counts nowhere
        left = int(np.argmin(leave + enter))
        gap = left + size
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            n[gap] -= 1
            b = stacks[gap].pop()
        if left:
            n[left] += 1
            stacks[left].append(b)
        where[i], offset[i] = b, capacity - gap
    return where, offset, bins


def tightest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The same, each piece into the open bin that it leaves fullest."""
    n = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        first = int(np.argmax(n[size:] > 0))
        gap = size + first
        if n[gap]:
            n[gap] -= 1
            b = stacks[gap].pop()
        else:
            gap, b, bins = capacity, bins, bins + 1
        if gap > size:
            n[gap - size] += 1
            stacks[gap - size].append(b)
        where[i], offset[i] = b, capacity - gap
    return where, offset, bins


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece of 1 to capacity ids; bins are numbered from 0, offsets have no gaps."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    full = int((size == capacity).sum())
    where, offset = np.arange(len(size), dtype=np.int64), np.zeros(len(size), np.int64)
    if full < len(size):
        w, o, bins = sum_of_squares(size[full:], capacity)
        open_bins = np.bincount(w, size[full:], minlength=bins) < capacity
        if open_bins.sum() > 1:
            loose = np.flatnonzero(open_bins[w])
            again, at, fewer = tightest(size[full:][loose], capacity)
            if fewer < open_bins.sum():
                number = np.cumsum(~open_bins) - 1
                w, kept = number[w], int((~open_bins).sum())
                w[loose], o[loose] = kept + again, at
        where[full:], offset[full:] = full + w, o
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return where[back], offset[back]


def pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; of a longer document the first piece is what the full ones leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from horosphere.llm.tokens import encoder

        for b in batches:
            ids, n = with_end(*encoder(vocabulary).column(b.column(1)), end_id)
            first = np.where(n % capacity > 0, n % capacity, np.minimum(n, capacity))
            count = 1 + (n - first) // capacity
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(piece > 0, capacity, first[row])
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            at = (4 * (np.cumsum(length) - length)).tolist()
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[i : i + 4 * k]) for i, k in zip(at, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
            del ids, raw
            trim()  # a batch leaves more freed memory than the encoder remembers

    return map_arrow(texts(df), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(parts: DataFrame, capacity: int, groups: int) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = pack(group["length"].to_numpy(), capacity)
        first = group["part"][0].as_py() * (1 << 36)
        return group.drop_columns(["part"]).append_column("sequence_id", pa.array(first + where)).append_column("offset", pa.array(offset))

    small_batches(parts.sparkSession)
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    groups = max(1, round(docs.count() / GROUP))
    return place(pieces(docs, P.path("byte_bpe_50k.json"), 2, 1024), 1024, groups)
