"""Stupid-backoff language-model scores, each document's by the counts of all others.

Words are those of near-duplicate search. Texts are stored in chunks; a chunk's exploded one- and two-word sequences are
counted once per chunk, and the counts dealt to shards by hash. A shard sums the counts of each sequence over all chunks -
a table of counts, partitioned by hash - and joins them back to the chunks' sequences, in whose order it answers. There
each document's own counts are taken off and its words' scores summed: a pair's count over its first word's, where the pair
occurs in another document; else ALPHA times the second word's share of all words; a word that no other document holds
counts as ALPHA occurrences. A text's first word has no pair before it, so it is scored by its share alone.

Edge cases: a null or empty text has 0 words and a null score; a table's only document is scored against one imagined word;
repeated rows count as other documents to each other; a null doc_id is scored like any other; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import map_arrow, partitions, table, texts
from horosphere.llm.neardup import LOWER, _words, scrambled
from horosphere.llm.substrings import chunks, opened, rows_of, spread

ALPHA = 0.4


def sequences(bounds: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, n): for each document its words' keys, then its pairs' (one fewer); n: its number of words. Keys tell words from pairs."""
    out, n = [], []
    low = data.translate(LOWER)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        words = low[a:b].split()
        h = scrambled(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        n.append(len(h))
        out.append(h)
        if len(h) > 1:
            out.append(scrambled(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(n, np.int64)


def planes(values: np.ndarray) -> bytes:
    """Byte by byte of the values: the high ones, mostly 0, lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    n = len(data) // size
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def word_count(held: DataFrame) -> int:
    """The words of all texts."""

    def run(batches):
        for row in rows_of(batches):
            _, _, bounds, data = opened(row["uri"])
            bounds = bounds.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(data[a:b].split()) for a, b in zip(bounds, bounds[1:], strict=False))], pa.int64())], ["words"])

    return map_arrow(spread(held), run, "words long").agg(F.sum("words")).first()[0] or 0


def counted(held: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, keys, counts): a chunk's distinct sequences, ascending, and how often it holds each."""

    def run(batches):
        for row in rows_of(batches):
            _, _, bounds, data = opened(row["uri"])
            keys, counts = np.unique(sequences(bounds, data)[0], return_counts=True)
            shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            cut = np.searchsorted(shard, np.arange(shards + 1)).tolist()
            got = [(k, i, j) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in got], pa.int32()), pa.array([row["chunk"]] * len(got), pa.int64()),
                    pa.array([planes(np.diff(keys[i:j], prepend=np.uint64(0))) for _, i, j in got], pa.binary()),
                    pa.array([planes(counts[i:j].astype("<u4")) for _, i, j in got], pa.binary()),
                ],
                ["shard", "chunk", "keys", "counts"],
            )

    return map_arrow(spread(held), run, "shard int, chunk long, keys binary, counts binary")


def totals(counts: DataFrame) -> DataFrame:
    """(chunk, shard, totals): for each of a chunk's sequences, in its order, the count over all chunks."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unplaned(k, "<u8"), dtype=np.uint64) for k in group["keys"].to_pylist()]
        counts = np.concatenate([unplaned(c, "<u4") for c in group["counts"].to_pylist()])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts).astype("<u8")[place]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        return pa.table({"chunk": group["chunk"], "shard": group["shard"], "totals": pa.array([planes(total[i:j]) for i, j in zip([0, *ends], ends, strict=False)], pa.binary())})

    return counts.groupBy("shard").applyInArrow(run, "chunk long, shard int, totals binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score (the sum over the document's words; null without words)."""
    spark = docs.sparkSession
    held = chunks(texts(docs))
    everything = word_count(held)
    answers = totals(counted(held, 2 * partitions(spark)))
    by_chunk = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("answers"))  # a chunk's own sequences: bounded by its texts

    def run(batches):
        for row in rows_of(batches):
            ids, known, bounds, data = opened(row["uri"])
            keys, n = sequences(bounds, data)
            distinct, place = np.unique(keys, return_inverse=True)
            total = np.concatenate([unplaned(a["totals"], "<u8") for a in row["answers"]]).astype(np.float64) if row["answers"] else np.zeros(0)
            if len(total) != len(distinct):
                raise ValueError("a chunk's sequences and their counts differ")
            at, out = 0, []
            for k in n.tolist():
                if not k:
                    out.append(None)
                    continue
                mine = place[at : at + 2 * k - 1]
                at += 2 * k - 1
                _, where, own = np.unique(mine, return_inverse=True, return_counts=True)
                other = total[mine] - own[where]
                words, pairs = other[:k], other[k:]
                share = np.where(words > 0, words, ALPHA) / max(1, everything - k)
                s = share.copy()
                seen = pairs > 0
                s[1:] = np.where(seen, pairs / np.maximum(words[:-1], 1), ALPHA * share[1:])
                out.append(float(np.log(s).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([i if z else None for i, z in zip(ids.tolist(), known.tolist(), strict=True)], pa.int64()), pa.array(n), pa.array(out, pa.float64())], ["doc_id", "n_words", "log_score"])

    return map_arrow(spread(held.join(by_chunk.hint("merge"), "chunk", "left").select("answers", "uri")), run, "doc_id long, n_words long, log_score double")


def op5_lm(spark, sf_dir: str) -> DataFrame:
    x = score(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))


OP5_SQL = """
WITH w AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w,
         generate_subscripts(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), 1) AS i
  FROM documents),
p AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w), o1 AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY doc_id, w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w), o2 AS (SELECT doc_id, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY doc_id, v, w),
n AS (SELECT count(*) AS n FROM w), d AS (SELECT doc_id, count(*) AS k FROM w GROUP BY doc_id),
s AS (
  SELECT p.doc_id, CASE WHEN c2.c > o2.c THEN (c2.c - o2.c) / (cv.c - ov.c)::DOUBLE
         ELSE (CASE WHEN p.v IS NULL THEN 1.0 ELSE 0.4 END)::DOUBLE * (CASE WHEN c1.c > o1.c THEN (c1.c - o1.c)::DOUBLE ELSE 0.4::DOUBLE END) / greatest(1, n.n - d.k) END AS s
  FROM p JOIN c1 ON p.w = c1.w JOIN o1 ON p.w = o1.w AND p.doc_id = o1.doc_id JOIN d ON p.doc_id = d.doc_id CROSS JOIN n
  LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w LEFT JOIN o2 ON p.v = o2.v AND p.w = o2.w AND p.doc_id = o2.doc_id
  LEFT JOIN c1 AS cv ON p.v = cv.w LEFT JOIN o1 AS ov ON p.v = ov.w AND p.doc_id = ov.doc_id),
t AS (SELECT doc_id, count(*) AS n_words, sum(ln(s)) AS x FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, round(x, 4) AS log_score, round(x / n_words, 6) AS mean_log_score
FROM documents LEFT JOIN t ON documents.doc_id = t.doc_id
"""
