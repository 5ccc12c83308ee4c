"""Removal of byte strings that an earlier document holds, by external induced sorting of suffixes in shards.

Texts are first stored in chunks of some hundred documents. Every window of WINDOW bytes belongs to the anchor that its
bytes choose; a maximal run of windows with one anchor is a segment, so equal windows lie in segments of equal anchors, and
a shard - all segments whose anchors hash to it - decides its windows alone. Equal segments are one to the sort: a copy in a later document loses all its windows to the
first one, within a chunk at once and in the shard beyond. Where an anchor has several distinct segments, one copy of each
is fetched from the chunks, and the shard sorts the suffixes of all runs of windows whose hash it meets more than once by external
induced sorting, which yields them with their common prefixes; where these reach WINDOW bytes, neighbours begin with the same window, and its first document is known. The
spans go back to the chunks, which return what is left of each text. Chunks are files in the shared folder, read where they
are needed and not shuffled. There are as many shards as make each about SHARD bytes of text, up to LARGEST for very large
inputs: a shard's segments and suffixes lie in scratch files, and tasks hold what is known of segments (37 bytes each) only.

Equal segments are known by 128 bits: a hash of their anchor and two of their bytes. Windows of different segments are
compared by their bytes.

Edge cases: null and empty texts, and those under WINDOW bytes, keep all; a null doc_id neither gives nor loses bytes; rows
of equal doc_id do not remove each other's bytes; repeats within a document stay; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm import induced
from horosphere.llm.anchors import GRAM, WINDOW, _C, mixed, runs, window_hash, words_at
from horosphere.llm.common import claim, fresh, map_arrow, new_path, partitions, stored, table, texts
from horosphere.llm.simple8b import get, put

#: Bytes of text looked at at once; bytes of text for which there is a shard, at least and at most; shards beyond which these grow.
PIECE, SHARD, LARGEST, MANY = 2 << 20, 8 << 20, 256 << 20, 4096
#: Common prefixes are told apart up to this length.
PREFIX = 64
#: Windows looked at at once, and hashes of windows sorted at once (about).
AT_ONCE, SORTED = 1 << 18, 1 << 21
_SEGMENT = np.dtype([("anchor", "<u4"), ("bytes", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("row", "<u2"), ("first", "<u4"), ("more", "u1")])
_SPAN = np.dtype([("row", "<u2"), ("from", "<u4"), ("to", "<u4")])


def width(kind: np.dtype) -> int:
    return sum(kind[n].itemsize for n in kind.names)


def packed(a: np.ndarray) -> bytes:
    """Column by column, byte by byte of the values: what is alike lies together."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(a[n]).view(np.uint8).reshape(len(a), -1).T).tobytes() for n in a.dtype.names) if len(a) else b""


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // width(kind)
    out, at = np.zeros(n, kind), 0
    for name in kind.names if n else ():
        size = kind[name].itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind[name]).ravel()
        at += n * size
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of one or more rows as maximal ones, in order; touching ones are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["from"], spans["row"]))]
    row, lo, hi = spans["row"].astype(np.int64), spans["from"].astype(np.int64), spans["to"].astype(np.int64)
    base = row << 33
    reach = np.maximum.accumulate(base + hi)
    start = np.append(True, (base + lo)[1:] > reach[:-1])
    at = np.flatnonzero(start)
    out = spans[at].copy()
    out["to"] = (np.append(reach[at[1:] - 1], reach[-1]) - base[at]).astype(np.uint32)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as files in the shared folder, some hundred documents each, and a stored row (chunk, uri, size) for
    each file; size: the bytes of its texts."""
    import uuid

    folder = new_path(docs.sparkSession, "texts")

    def run(batches):
        import zstandard

        claim("chunks")
        for b in batches:
            ids = b.column(0)
            data = [t.encode() for t in b.column(1).to_pylist()]
            parts = (np.array([len(data)], "<i8"), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.array([len(d) for d in data], "<i8"))
            chunk = uuid.uuid4().int >> 65  # an attempt that is lost leaves a file that no row names
            put(uri := f"{folder}/{chunk:016x}", b"".join(x.tobytes() for x in parts) + zstandard.ZstdCompressor(level=1).compress(b"".join(data)))
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "uri": uri, "size": sum(map(len, data))}])

    return stored(map_arrow(docs, run, "chunk long, uri string, size long"), "chunks")


def shard_count(held: DataFrame, least: int | None = None) -> int:
    """Shards for the texts of the chunks: of SHARD bytes, of more beyond MANY shards, of LARGEST at most."""
    size, least = held.agg(F.sum("size")).first()[0] or 0, least or SHARD
    return max(1, -(-size // min(max(least, size // MANY), max(least, LARGEST))))


def spread(held: DataFrame) -> DataFrame:
    """The few rows dealt over tasks, as each stands for a file."""
    return held.repartition(2 * partitions(held.sparkSession))


def opened(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """A chunk's doc ids, which of them are not null, where each text starts, and the end, in the bytes."""
    import zstandard

    raw = get(uri)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    bounds = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 9 * n))]).astype(np.int64)
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n) > 0, bounds, zstandard.ZstdDecompressor().decompress(raw[8 + 17 * n :], max_output_size=max(1, int(bounds[-1])))


def rows_of(batches):
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def segments(ids: np.ndarray, known: np.ndarray, bounds: np.ndarray, data: bytes) -> np.ndarray:
    """All segments of a chunk's documents."""
    out, first = [], 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE, side="right")) - 1)
        base, end = int(bounds[first]), int(bounds[last])
        step = 1 << 24  # a long document in parts, each with the windows that start in it
        for lo in range(base, max(end, base + 1), step):
            hi = min(end, lo + step + WINDOW + GRAM) if end - base > step else end
            raw = np.frombuffer(data[lo:hi] + bytes(64), np.uint8)
            own = np.clip(bounds[first : last + 1] - lo, 0, hi - lo)
            anchor, a, b = runs(raw, own)
            if end - base > step and hi < end:
                keep = a < step
                anchor, a, b = anchor[keep], a[keep], np.minimum(b[keep], step - 1)
            if not len(a):
                continue
            s = np.empty(len(a), _SEGMENT)
            s["anchor"] = mixed(words_at(raw, anchor) * _C[0] + mixed(words_at(raw, anchor + 8) * _C[1] + mixed(words_at(raw, anchor + GRAM - 8) * _C[2]))) >> np.uint64(32)
            shape = mixed(window_hash(raw, b) + (b - a).astype(np.uint64) * np.uint64(64) + (anchor - a).astype(np.uint64))
            s["bytes"] = mixed(window_hash(raw, a) + shape)
            s["check"] = mixed(window_hash(raw, a, 3) ^ (shape * _C[4])) >> np.uint64(32)
            row = first + np.searchsorted(own, a, side="right") - 1
            s["row"], s["doc"], s["more"] = row, ids[row], b - a
            s["first"] = lo + a - bounds[row]
            out.append(s[known[row]])
        first = last
    return np.concatenate(out) if out else np.zeros(0, _SEGMENT)


def others(s: np.ndarray) -> np.ndarray:
    """Of ordered segments those that differ from the one before."""
    return np.append(True, (s["anchor"][1:] != s["anchor"][:-1]) | (s["bytes"][1:] != s["bytes"][:-1]) | (s["check"][1:] != s["check"][:-1]))[: len(s)]


def first_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s in order of (anchor, bytes, check, doc), and which of it are of their segment's first document."""
    s = s[np.lexsort((s["doc"], s["check"], s["bytes"], s["anchor"]))]
    new = others(s)
    least = s["doc"][np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    return s, s["doc"] == least


def listed(held: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, kind, payload): kind 0 holds segments for their shard; kind 1, by way of any shard, spans of segments
    that an earlier document of the same chunk holds."""

    def run(batches):
        for row in rows_of(batches):
            s = segments(*opened(row["uri"]))
            if not len(s):
                continue
            s, first = first_of(s)
            rest, s = s[~first], s[first]
            shard = (s["anchor"].astype(np.uint64) * np.uint64(shards)) >> np.uint64(32)  # s is in order of it
            cut = np.searchsorted(shard, np.arange(shards + 1))
            out = [(k, row["chunk"], 0, packed(s[i:j][np.lexsort((s["first"][i:j], s["row"][i:j]))])) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
            if len(rest):
                out.append((row["chunk"] % shards, row["chunk"], 1, packed(spans_of(rest))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "chunk", "kind", "payload"])

    return map_arrow(spread(held), run, "shard int, chunk long, kind int, payload binary")


def spans_of(s: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), _SPAN)
    out["row"], out["from"], out["to"] = s["row"], s["first"], s["first"] + s["more"] + WINDOW
    return merged(out)


def _gather(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's segments, and the chunk of each."""
    parts = [unpacked(p, _SEGMENT) for p in group["payload"].to_pylist()]
    return np.concatenate(parts), np.repeat(group["chunk"].to_numpy(), [len(p) for p in parts])


def wanted(segments_by_shard: DataFrame) -> DataFrame:
    """(shard, chunk, kind, payload) again. Kind 1: spans, of segments that an earlier document holds whole. Kind 2: places of
    one copy of each segment to be sorted, to be fetched from the chunk. Kind 3: all the first document's copies of these."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        kinds = group["kind"].to_numpy()
        out = [(shard, c, 1, p) for c, k, p in zip(group["chunk"].to_pylist(), kinds.tolist(), group["payload"].to_pylist(), strict=True) if k == 1]
        if (kinds == 0).any():
            s, chunk = _gather(group.filter(pa.array(kinds == 0)))
            order = np.lexsort((chunk, s["doc"], s["check"], s["bytes"], s["anchor"]))
            s, chunk = s[order], chunk[order]
            new_anchor, new = np.append(True, s["anchor"][1:] != s["anchor"][:-1]), others(s)
            first = s["doc"] == s["doc"][np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
            at = np.flatnonzero(new_anchor)
            apart = np.minimum.reduceat(np.where(new, s["doc"], np.iinfo(np.int64).max), at) != np.maximum.reduceat(np.where(new, s["doc"], np.iinfo(np.int64).min), at)
            apart = np.repeat(apart, np.diff(np.append(at, len(s))))  # distinct segments of distinct first documents
            for kind, which in ((1, ~first), (2, new & apart), (3, first & apart)):
                ss, cc = s[which], chunk[which]
                by = np.argsort(cc, kind="stable")
                ss, cc = ss[by], cc[by]
                cut = np.append(np.flatnonzero(np.append(True, cc[1:] != cc[:-1])[: len(cc)]), len(cc))
                out += [(shard, int(cc[i]), kind, packed(spans_of(ss[i:j])) if kind == 1 else packed(ss[i:j])) for i, j in zip(cut, cut[1:], strict=False)]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "chunk", "kind", "payload"])

    return segments_by_shard.groupBy("shard").applyInArrow(run, "shard int, chunk long, kind int, payload binary")


def fetched(held: DataFrame, places: DataFrame) -> DataFrame:
    """places (shard, chunk, payload) of kind 2 with the segments' bytes, as rows (shard, chunk, kind 4, payload)."""

    def run(batches):
        last: list = [None, None]
        for row in rows_of(batches):
            if last[0] != row["chunk"]:
                last[:] = row["chunk"], opened(row["uri"])
            _, _, bounds, data = last[1]
            s = unpacked(row["payload"], _SEGMENT)
            raw = np.frombuffer(data, np.uint8)
            size = s["more"].astype(np.int64) + WINDOW
            start = bounds[s["row"]] + s["first"]
            ends = np.cumsum(size)
            at = np.repeat(start - np.append(0, ends[:-1]), size) + np.arange(int(ends[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([4], pa.int32()), pa.array([len(s).to_bytes(8, "little") + packed(s) + raw[at].tobytes()], pa.binary())], ["shard", "chunk", "kind", "payload"])

    together = places.join(held, "chunk").repartition(2 * partitions(held.sparkSession), "chunk").sortWithinPartitions("chunk")
    return map_arrow(together.select("shard", "chunk", "payload", "uri"), run, "shard int, chunk long, kind int, payload binary")


def holders(text: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray, memory: int | None = None, spills: list[int] | None = None) -> Iterator[np.ndarray]:
    """For each window of segments of a text - from start on, of size bytes, a byte that is none of UTF-8 after each - the least
    document, by docs, that holds it: some windows at a time, in the order of the text."""
    memory = memory or induced.MEMORY
    base = np.cumsum(size - WINDOW + 1) - (size - WINDOW + 1)
    kind = np.dtype([("window", "<u4"), ("doc", "<i8")])

    def found() -> Iterator[np.ndarray]:
        kept_window, kept_doc, kept_group = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = 0
        for pos, lcp in induced.sorted_suffixes(text, memory, PREFIX, spills):
            owner = np.searchsorted(start, pos, side="right") - 1
            group = last + np.cumsum(lcp < WINDOW)
            last = int(group[-1])
            ok = pos - start[owner] + WINDOW <= size[owner]
            owner, group = owner[ok], np.append(kept_group, group[ok])
            window = np.append(kept_window, base[owner] + pos[ok] - start[owner])
            doc = np.append(kept_doc, docs[owner])
            ended = int(np.searchsorted(group, last))  # the last group may go on
            kept_window, kept_doc, kept_group = window[ended:], doc[ended:], group[ended:]
            if ended:
                yield least(window[:ended], doc[:ended], group[:ended])
        if len(kept_group):
            yield least(kept_window, kept_doc, kept_group)

    def least(window: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out = np.empty(len(window), kind)
        out["window"], out["doc"] = window, np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(doc))))
        return out

    for r in induced.in_order(found(), "window", int((size - WINDOW + 1).sum()), memory):
        yield r["doc"]


def holders_of_shared(text: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray) -> Iterator[np.ndarray]:
    """As holders(). Windows of a hash that no other window has are held by their own document alone, so only runs of the others
    are sorted; equal windows have equal hashes, so none of them is lost."""
    windows = size - WINDOW + 1
    base, total = np.cumsum(windows) - windows, int(windows.sum())

    def hashed() -> Iterator[np.ndarray]:
        for lo in range(0, total, AT_ONCE):
            at = np.arange(lo, min(total, lo + AT_ONCE))
            owner = np.searchsorted(base, at, side="right") - 1
            yield window_hash(text, start[owner] + at - base[owner])

    hashes, met, parts = induced.stored_array(hashed(), "<u8"), np.zeros(total, bool), -(-total // SORTED)
    for p in range(parts):  # those of a range of hashes at a time
        at = np.concatenate([lo + np.flatnonzero((hashes[lo : lo + AT_ONCE] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == p) for lo in range(0, total, AT_ONCE)])
        h = hashes[at]
        order = np.argsort(h)
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        met[at[order[same]]] = met[at[order[same + 1]]] = True
    first, length = [], []
    for lo in range(0, total, AT_ONCE):
        shared = np.append(met[lo : lo + AT_ONCE], False)
        opens = np.zeros(len(shared), bool)  # a segment's first window
        opens[base[np.searchsorted(base, lo) : np.searchsorted(base, lo + len(shared) - 1)] - lo] = True
        begin = shared & (opens | ~np.append(False, shared[:-1]))
        end = shared & np.append(~shared[1:] | opens[1:], True)
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        first.append(lo + a)
        length.append(b - a + 1)
    first, length = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, length))
    owner = np.searchsorted(base, first, side="right") - 1
    place, longer = start[owner] + first - base[owner], length + WINDOW

    def bytes_() -> Iterator[np.ndarray]:
        for lo in range(0, len(place), 1 << 12):
            n = longer[lo : lo + (1 << 12)]
            ends = np.cumsum(n)
            out = text[np.repeat(place[lo : lo + (1 << 12)] - (ends - n), n) + np.arange(int(ends[-1]))]
            out[ends - 1] = 0xFF
            yield out

    sorted_ = holders(induced.stored_array(bytes_(), "u1"), np.cumsum(longer) - longer, longer - 1, docs[owner]) if len(place) else iter(())
    have = np.zeros(0, np.int64)
    for lo in range(0, total, AT_ONCE):
        shared = np.flatnonzero(met[lo : lo + AT_ONCE])
        while len(have) < len(shared):
            have = np.append(have, next(sorted_))
        out = docs[np.searchsorted(base, np.arange(lo, min(total, lo + AT_ONCE)), side="right") - 1]
        out[shared], have = have[: len(shared)], have[len(shared) :]
        yield out


def decided(everything: DataFrame) -> DataFrame:
    """Rows of kinds 3 and 4, by shard, to (chunk, payload): spans to remove. A shard's rows are read one after another; its
    segments' bytes lie in a scratch file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, chunk, kept = [], [], []

        def texts_() -> Iterator[np.ndarray]:
            for b in batches:
                for i in range(len(b)):
                    c, kind, p = (b.column(b.schema.get_field_index(n))[i].as_py() for n in ("chunk", "kind", "payload"))
                    if kind == 3:
                        s = unpacked(p, _SEGMENT)
                        copies.append(s)
                        chunk.append(np.full(len(s), c))
                        continue
                    n = int.from_bytes(p[:8], "little")
                    end = 8 + n * width(_SEGMENT)
                    s = unpacked(p[8:end], _SEGMENT)
                    kept.append(s)
                    size = s["more"].astype(np.int64) + WINDOW + 1
                    out, inner = np.full(int(size.sum()), 0xFF, np.uint8), np.ones(int(size.sum()), bool)
                    inner[np.cumsum(size) - 1] = False
                    out[inner] = np.frombuffer(p, np.uint8, offset=end)
                    yield out

        text = induced.stored_array(texts_(), "u1")
        if kept:
            yield from spans(text, np.concatenate(kept), *(np.concatenate(x) for x in (copies, chunk)))

    def spans(text: np.ndarray, kept: np.ndarray, copies: np.ndarray, chunk: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = kept["more"].astype(np.int64) + WINDOW
        start = np.cumsum(size + 1) - (size + 1)
        by, order = np.lexsort((kept["check"], kept["bytes"], kept["anchor"])), np.lexsort((copies["check"], copies["bytes"], copies["anchor"]))
        segment = by[np.cumsum(others(copies[order])) - 1]  # kept has each of these once
        again = np.argsort(segment, kind="stable")
        segment, copies, chunk = segment[again], copies[order[again]], chunk[order[again]]
        windows = size - WINDOW + 1
        ends = np.cumsum(windows)
        out, where = [], []
        done, have = 0, np.zeros(0, np.int64)  # segments done; windows read of those that are not
        for doc in holders_of_shared(text, start, size, kept["doc"]):
            have = np.append(have, doc)
            first_window = ends[done - 1] if done else 0
            upto = int(np.searchsorted(ends, first_window + len(have), side="right"))
            if upto == done:
                continue
            a, b = np.searchsorted(segment, [done, upto])
            n = windows[segment[a:b]]
            copy = np.repeat(np.arange(a, b), n)
            step = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
            gone = have[(ends - windows)[segment[copy]] - first_window + step] < copies["doc"][copy]
            first = gone & np.append(True, ~gone[:-1] | (copy[1:] != copy[:-1]))[: len(gone)]
            last = gone & np.append(~gone[1:] | (copy[1:] != copy[:-1]), True)[: len(gone)]
            x = np.empty(int(first.sum()), _SPAN)
            c = copy[first]
            x["row"] = copies["row"][c]
            x["from"], x["to"] = copies["first"][c] + step[first], copies["first"][c] + step[last] + WINDOW
            out.append(x)
            where.append(chunk[c])
            have, done = have[ends[upto - 1] - first_window :], upto
        x, where = np.concatenate(out), np.concatenate(where)
        by = np.argsort(where, kind="stable")
        x, where = x[by], where[by]
        cut = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(where)]), len(where)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([int(where[i]) for i in cut[:-1]], pa.int64()), pa.array([packed(merged(x[i:j])) for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], ["chunk", "payload"])

    return everything.groupBy("shard").applyInArrow(run, "chunk long, payload binary")


def left_over(held: DataFrame, spans: DataFrame, changed: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (from, to of maximal removed runs), kept (the bytes that stay), text_hash (Spark's xxhash64 of the text), of every row of every chunk.
    changed: of rows that lose bytes only, and kept is a text, without characters that are not whole."""

    def run(batches):
        import xxhash

        for row in rows_of(batches):
            ids, known, bounds, data = opened(row["uri"])
            hashes = [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            parts = [unpacked(p, _SPAN) for p in row["payloads"] or []]
            gone = merged(np.concatenate(parts)) if parts else np.zeros(0, _SPAN)
            cut = np.searchsorted(gone["row"], np.arange(len(ids) + 1)).tolist()
            keep, found = [], []
            for k in range(len(ids)):
                text = data[bounds[k] : bounds[k + 1]]
                some = list(zip(gone["from"][cut[k] : cut[k + 1]].tolist(), gone["to"][cut[k] : cut[k + 1]].tolist(), strict=True))
                at, left = 0, []
                for a, b in some:
                    left.append(text[at:a])
                    at = b
                keep.append(b"".join(left) + text[at:])
                found.append([{"from": a, "to": b} for a, b in some])
            kept = pa.array([x.decode("utf-8", "ignore") if f else None for x, f in zip(keep, found, strict=True)], pa.string()) if changed else pa.array(keep, pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([i if z else None for i, z in zip(ids.tolist(), known.tolist(), strict=True)], pa.int64()), pa.array(np.diff(bounds)), pa.array(found, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), kept, pa.array(np.array(hashes, np.uint64).view(np.int64))], ["doc_id", "n_bytes", "spans", "kept", "text_hash"])
            yield out.filter(kept.is_valid()) if changed else out

    by_chunk = spans.groupBy("chunk").agg(F.collect_list("payload").alias("payloads"))  # a chunk's own spans: bounded by its texts
    return map_arrow(spread(held.join(by_chunk.hint("merge"), "chunk", "left").select("payloads", "uri")), run, f"doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept {'string' if changed else 'binary'}, text_hash long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, n_chars, further columns) with what dedup_substrings() keeps of each text; rows of which nothing
    stays go. What stays follows from doc_id and text alone, so rows that repeat both are changed alike."""
    doc, was, now = fresh(["doc", "was", "now"], docs.columns)
    changed = dedup_substrings(docs, changed=True).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(was), F.col("kept").alias(now)).dropDuplicates([doc, was])
    joined = docs.join(changed, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(was)), "left").where(f"{now} is null or {now} <> ''")
    new = {"text": F.coalesce(now, "text"), "n_chars": F.when(F.col(now).isNull(), F.col("n_chars")).otherwise(F.length(now)).cast("long")}
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def dedup_substrings(docs: DataFrame, changed: bool = False) -> DataFrame:
    """docs (doc_id, text) as left_over() returns it."""
    held = chunks(texts(docs))
    shards = shard_count(held)
    asked = stored(wanted(listed(held, shards)), "wanted")
    bytes_ = fetched(held, asked.where("kind = 2").select("shard", "chunk", "payload"))
    spans = decided(asked.where("kind = 3").unionByName(bytes_))
    return left_over(held, stored(spans.unionByName(asked.where("kind = 1").select("chunk", "payload")), "spans"), changed)


def op10_suffix(spark, sf_dir: str) -> DataFrame:
    x = dedup_substrings(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
