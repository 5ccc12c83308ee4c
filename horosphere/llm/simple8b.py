"""Token ids in word-aligned files: Simple-8b.

A 64-bit word is a selector (its high 4 bits) and a payload of 60 bits. Selectors 1 to 14 hold WIDTHS' counts of equally
wide ids; selector 0 escapes: the next word is one value of up to 64 bits. Ids are coded in blocks of BLOCK ids, each of
which starts a new word; the file keeps every block's first word and number of ids, so blocks decode on their own, all
words of a selector at once.

Edge cases: a null or empty text holds the end id alone; a null doc_id sorts first and is kept as null; equal doc_ids
keep their rows, ordered by a hash of the text; an empty table has no files and no rows; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import list_array, map_arrow, new_path, partitions, table, texts

#: Fixed values: (ids in a word, bits of each) by selector from 1.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
#: Ids after which a file ends, at the next batch's end.
FILE_IDS = 8 << 20
MAGIC = b"HS8B\x01\0\0\0"


#: For each number of bits the first place in WIDTHS that holds it; len(WIDTHS): an escape.
_CLASS = np.searchsorted([b for _, b in WIDTHS], np.arange(65)).astype(np.uint8)
_COUNTS, _BITS = (np.array([w[i] for w in WIDTHS], np.int64) for i in (0, 1))
#: Blocks coded at once; the first place in WIDTHS whose words hold NEAR ids at most.
TOGETHER, NEAR = 1024, int(np.argmax(_COUNTS <= 15))


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, the first word of each block) of unsigned values of up to 64 bits; some hundred blocks at a time."""
    words, firsts, n = [], [], 0
    for at in range(0, len(ids), TOGETHER * BLOCK):
        w, f = _encode(ids[at : at + TOGETHER * BLOCK])
        words.append(w)
        firsts.append(f + n)
        n += len(w)
    return (np.concatenate(words), np.concatenate(firsts)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _chosen(window: np.ndarray, first: int) -> np.ndarray:
    """For rows of classes the place in WIDTHS, from first on, of the most ids that fit; len(WIDTHS) where none does."""
    most = np.maximum.accumulate(window, axis=1)[:, _COUNTS[first:] - 1]
    fits = most <= np.arange(first, len(WIDTHS))
    return np.where(fits.any(axis=1), first + fits.argmax(axis=1), len(WIDTHS))


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All blocks step by step together, a word of each in a step."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, far = len(ids), int(_COUNTS[0])
    blocks = -(-n // BLOCK)
    high = (ids >> np.uint64(53)) > 0  # beyond what a float holds exactly: counted by their upper half
    bits = np.frexp(np.where(high, ids >> np.uint64(32), ids).astype(np.float64))[1] + np.where(high, 32, 0)
    classes = np.zeros((blocks, BLOCK + far), np.uint8)  # beyond a block's end any width does
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = _CLASS[bits]
    classes[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    end = np.minimum(n - row * BLOCK, BLOCK)
    starts, takes, codes = [], [], []
    near, wide = (sliding_window_view(classes, int(c), axis=1) for c in (_COUNTS[NEAR], far))
    while len(row):
        code = _chosen(near[row, at], NEAR)
        more = np.flatnonzero(code == NEAR)
        if len(more):
            code[more] = _chosen(wide[row[more], at[more]], 0)
        take = np.minimum(np.where(code < len(WIDTHS), _COUNTS[np.minimum(code, len(WIDTHS) - 1)], 1), end - at)
        starts.append(row * BLOCK + at)
        takes.append(take)
        codes.append(code)
        at = at + take
        on = at < end
        row, at, end = row[on], at[on], end[on]
    starts, takes, codes = (np.concatenate(x) for x in (starts, takes, codes))
    order = np.argsort(starts, kind="stable")
    starts, takes, codes = starts[order], takes[order], codes[order]
    escape = codes == len(WIDTHS)
    place = np.cumsum(1 + escape) - (1 + escape)
    words = np.zeros(int(len(codes) + escape.sum()), np.uint64)
    words[place[escape] + 1] = ids[starts[escape]]
    padded = np.append(ids, np.zeros(far, np.uint64))
    for c in np.unique(codes[~escape]).tolist():
        rows = np.flatnonzero(codes == c)
        count, bits_ = WIDTHS[c]
        value = padded[starts[rows][:, None] + np.arange(count)]
        short = np.flatnonzero(takes[rows] < count)  # a block's last word may hold fewer ids
        if len(short):
            value[short] = np.where(np.arange(count) < takes[rows][short][:, None], value[short], np.uint64(0))
        value <<= np.arange(count, dtype=np.uint64) * np.uint64(bits_)
        words[place[rows]] = np.bitwise_or.reduce(value, axis=1) | np.uint64((c + 1) << 60)
    return words, place[np.searchsorted(starts, np.arange(blocks) * BLOCK)]


def decode(words: np.ndarray, n: int, firsts: np.ndarray | None = None) -> np.ndarray:
    """The n ids of one block, or of several, whose first words firsts names."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in WIDTHS)], np.int64)
    at, heads = 0, np.ones(len(words), bool)
    for z in np.flatnonzero(sel == 0).tolist():  # the word after an escape is a value, and no escape whatever its high bits
        if z >= at:
            at = z + 2
            heads[z + 1] = False
    where = np.flatnonzero(heads)
    sel = sel[where]
    out_at = np.zeros(len(where) + 1, np.int64)
    np.cumsum(counts[sel], out=out_at[1:])
    out = np.zeros(out_at[-1], np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if not s:
            out[out_at[rows]] = words[where[rows] + 1]
            continue
        count, bits = WIDTHS[s - 1]
        shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[out_at[rows][:, None] + np.arange(count)] = (words[where[rows]][:, None] >> shift) & np.uint64((1 << bits) - 1)
    if firsts is not None and len(firsts) > 1:  # a block's last word may hold fewer ids than it has room for
        begin = out_at[np.searchsorted(where, firsts)].tolist()
        out = np.concatenate([out[k : k + BLOCK] for k in begin])
    return out[:n]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic; the numbers of documents, ids, blocks and words; for each document its id, whether that is null, and its number of ids; each block's first word; the words."""
    words, firsts = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(firsts), len(words)], "<u8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join(x.tobytes() for x in (np.frombuffer(MAGIC, np.uint8), head, keys, null, np.asarray(lengths, "<u8"), firsts.astype("<u8"), words.astype("<u8")))


def unpack(data: bytes, docs_at_once: int = 500) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, numbers of ids, ids) of so many documents at a time; only the blocks that hold them are decoded."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    docs, n, blocks, words = np.frombuffer(data, "<u8", 4, 8).astype(np.int64).tolist()
    at = 40
    keys = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
    firsts = np.append(np.frombuffer(data, "<u8", blocks, at := at + 8 * docs).astype(np.int64), words)
    stream = np.frombuffer(data, "<u8", words, at + 8 * blocks)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for d in range(0, docs, docs_at_once):
        e = min(d + docs_at_once, docs)
        lo, hi = int(ends[d]), int(ends[e])
        ids = np.zeros(0, np.uint64)
        if hi > lo:
            b, c = lo // BLOCK, -(-hi // BLOCK)
            ids = decode(stream[firsts[b] : firsts[c]], min(c * BLOCK, n) - b * BLOCK, firsts[b:c] - firsts[b])[lo - b * BLOCK : hi - b * BLOCK]
        yield [None if z else k for k, z in zip(keys[d:e].tolist(), null[d:e].tolist(), strict=True)], lengths[d:e], ids


def put(uri: str, data: bytes) -> None:
    """Written under another name first: an attempt that dies leaves no half file under this one."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(own, path)


def get(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with an end id after each text's, and their lengths."""
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def write(df: DataFrame, uri: str, vocabulary: str, end_id: int, shards: int, file_ids: int = FILE_IDS) -> list:
    """Encode and write all documents in ascending doc_id order, ranges of them by a task each, which ends a file after
    file_ids ids. Returns the files in order as rows (shard, part, uri, n_docs, n_ids): a row a file, whatever the number of
    documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from horosphere.llm.tokens import encoder

        shard, part = TaskContext.get().partitionId(), 0
        keys, lengths, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            put(at := f"{uri}/ids-{shard:06d}-{part:06d}.s8b", pack(keys, np.concatenate(lengths), np.concatenate(ids)))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "uri": at, "n_docs": len(keys), "n_ids": held}])

        for b in batches:
            x, n = with_end(*encoder(vocabulary).column(b.column(1)), end_id)
            keys += b.column(0).to_pylist()
            lengths.append(n)
            ids.append(x.astype(np.uint32))
            held += len(x)
            if held >= file_ids:
                yield flush()
                part += 1
                keys, lengths, ids, held = [], [], [], 0
        if keys:
            yield flush()

    # a document's place among equal doc_ids follows its text, and so do ranges: no key is too large for a task
    ranged = texts(df).withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return sorted(map_arrow(ranged.drop("h"), run, "shard long, part long, uri string, n_docs long, n_ids long").collect())


def read(spark, files: list, each=None, schema: str = "doc_id long, start long, ids array<long>") -> DataFrame:
    """doc_id, start, ids of every document in the files; or what each makes, as a record batch of schema, of some documents'
    (doc ids, starts, numbers of ids, ids one after another)."""

    def rows(keys: pa.Array, starts: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, starts, list_array(pa.array(ids.astype(np.int64)), lengths)], ["doc_id", "start", "ids"])

    make = each or rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                start = row["start"]
                for keys, lengths, ids in unpack(get(row["uri"])):
                    starts = start + np.concatenate([[0], np.cumsum(lengths)])
                    start = int(starts[-1])
                    yield make(pa.array(keys, pa.int64()), pa.array(starts[:-1]), lengths, ids)

    listed, start = [], 0
    for f in files:
        listed.append((f.uri, start))
        start += f.n_ids
    few = spark.createDataFrame(listed, "uri string, start long").repartition(max(1, len(listed)))
    return map_arrow(few, run, schema)


def checksums(keys: pa.Array, starts: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """doc_id, start, n_tokens, ids_crc32 of some documents."""
    raw, ends = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (4 * np.cumsum(lengths)).tolist()
    crc = [zlib.crc32(raw[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
    return pa.RecordBatch.from_arrays([keys, starts, pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_simple8b(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    files = write(table(spark, sf_dir, "documents"), new_path(spark, "ids"), P.path("byte_bpe_50k.json"), 2, partitions(spark))
    return read(spark, files, checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
