"""Near-duplicate documents by SetSketch.

A document's set holds its distinct shingles of WORDS words. Its sketch has REGISTERS exponentially spaced, truncated
minima: a register is floor(1 - log_BASE of the least of its exponential variates over the set), and two sketches merge by
the greater registers. Equal sets become one class, by a 128-bit fingerprint. Classes whose sketches agree in a band of
registers share a bucket; bands are as wide as lets two sets of the linking similarity share none with a probability of MISS
at most: 36 bands of 6 registers at 0.85, 43 of 5 at 0.80, both 4e-8. op8 links from PERCENT on, the pipeline from its own.

Every class of a bucket is compared to the bucket's least one, so that a bucket gives rows in proportion to its size. A
pair stays while the joint likelihood of its registers and known cardinalities still rises at a similarity SIGMAS standard
deviations below the threshold, and is then confirmed on the full sets, remade from the texts. What that leaves apart
within a bucket - links that do not pass the bucket's least class - is searched among the members that are not of one
component by then: in blocks of at most BLOCK members, first on sketches, and where these leave a chance, on full sets, of
which only links that join components are returned. No pair is dropped for being in a large bucket, and no group's pairs
are listed.

Edge cases: a null or empty text, or one of blanks only, has an empty set, no links, and is kept; ties go to the smaller
doc_id; rows of equal doc_id count as one document in links, each row is returned; a null doc_id takes no part in links
and is its own component (null); further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import claim, fresh, list_array, map_arrow, stored, table, texts
from horosphere.llm.components import components

#: A-Z to a-z, and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS, PERCENT = 5, 85
#: Registers of a sketch; base of the spacing, rate of the variates, greatest register.
REGISTERS, BASE, RATE, TOP = 216, 1.1, 20.0, 254
#: The probability at most that two sets of just the linking similarity share no band.
MISS = 5e-8
SIGMAS, BLOCK = 5.0, 512
_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_MUL = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2)


def scrambled(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    LIMIT = 60_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = WordHashes()


def shingles(text: str) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    k = min(WORDS, len(h))
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = scrambled(s + h[i : i + n] * _MIX[i])
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(REGISTERS, np.uint64(2**64 - 1))
    for lo in range(0, len(s), 512):
        part = s[lo : lo + 512, None] * _MUL[None, :] + _ADD[None, :]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def registers(low: np.ndarray) -> np.ndarray:
    """Registers of 64-bit minima: these are exponential variates of rate RATE by their logarithm."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)


def _p(x):
    """The probability that one of two registers is greater, at a difference x, and its derivative."""
    y = 1 - x * (BASE - 1) / BASE
    return -np.log(y) / np.log(BASE), (BASE - 1) / BASE / np.log(BASE) / y


def rising(more, less, same, nu, nv, j):
    """Whether the log-likelihood of the similarity of two sets of nu and nv elements rises at j, so that its only maximum
    is beyond; more, less, same: registers of the first sketch that are greater, smaller, equal."""
    u = nu / (nu + nv)
    v = 1 - u
    a, b = u - v * j, v - u * j
    possible = (a > 0) & (b > 0)  # else the cardinalities alone forbid j
    (pa_, da), (pb, db) = _p(np.maximum(a, 1e-12)), _p(np.maximum(b, 1e-12))
    slope = same * (v * da + u * db) / np.maximum(1 - pa_ - pb, 1e-12) - more * v * da / pa_ - less * u * db / pb
    return possible & (slope >= 0)


def similarity(a: np.ndarray, b: np.ndarray, nu: int, nv: int) -> float:
    """The most likely similarity of two sets by their sketches."""
    counts = [np.float64(x.sum()) for x in (a > b, a < b, a == b)]
    low, high = 0.0, min(nu, nv) / max(nu, nv)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if rising(*counts, float(nu), float(nv), mid) else (low, mid)
    return low


def band_width(percent: int) -> int:
    """Registers of a band: the most at which bands miss a link with a probability of MISS at most."""
    j = percent / 100
    return max((w for w in range(1, REGISTERS + 1) if (1 - j**w) ** (REGISTERS // w) <= MISS), default=1)


def floor_similarity(percent: int) -> float:
    j = percent / 100
    return j - SIGMAS * float(np.sqrt(j * (1 - j) / REGISTERS))


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (elements), fp_a and fp_b (the set's fingerprint), regs, bands, of every row."""
    width = band_width(percent)
    count = REGISTERS // width

    def run(batches):
        import xxhash

        claim("words", _words.clear)
        for batch in batches:
            n, fa, fb, regs, low = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                f = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                fa.append(int.from_bytes(f[:8], "little", signed=True))
                fb.append(int.from_bytes(f[8:], "little", signed=True))
                low.append(minima(s))
            r = registers(np.array(low).reshape(-1, REGISTERS))
            keys = np.zeros((len(r), count), np.uint64)
            wide = r[:, : count * width].reshape(len(r), count, width).astype(np.uint64)
            for k in range(width):
                keys = scrambled(keys * np.uint64(257) + wide[:, :, k] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(1 << 32))
            bands = list_array(pa.array(keys.ravel().view(np.int64)), np.full(len(r), count))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array([x.tobytes() for x in r], pa.binary()), bands], ["doc_id", "n", "fp_a", "fp_b", "regs", "bands"])

    return map_arrow(texts(docs), run, "doc_id long, n long, fp_a long, fp_b long, regs binary, bands array<long>")


def likely(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b, na, nb, ra, rb): those whose sketches leave a chance, as (a, b)."""

    def run(batches):
        for x in batches:
            if not len(x):
                continue
            ra, rb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (4, 5))
            ok = rising((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1), x.column(2).to_numpy().astype(float), x.column(3).to_numpy().astype(float), floor_similarity(percent))
            yield x.select(["a", "b"]).filter(pa.array(ok))

    return map_arrow(pairs.select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b) whose full sets are as similar as asked for; docs (doc_id, text), one row of an id."""

    def run(batches):
        for x in batches:
            last, keep = (None, None), []
            for a, ta, tb in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                if last[0] != a:
                    last = a, shingles(ta)
                sa, sb = last[1], shingles(tb)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb"), run, "a long, b long")


_KEY = "key long, i int, j int"


def hopeful(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members (key, i, j, rep, comp, n, regs): those with a member of another component within the block that their sketches
    do not exclude."""

    def run(group: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(group["regs"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        n, comp = group["n"].to_numpy().astype(float), group["comp"].to_numpy()
        hope = np.zeros(len(r), bool)
        for k in range(len(r)):
            other = np.flatnonzero((comp != comp[k]) & (np.arange(len(r)) > k))
            if len(other):
                ok = rising((r[k] > r[other]).sum(1), (r[k] < r[other]).sum(1), (r[k] == r[other]).sum(1), n[k], n[other], floor_similarity(percent))
                hope[k] |= ok.any()
                hope[other[ok]] = True
        return group.select(["key", "i", "j", "rep", "comp"]).filter(pa.array(hope))

    return members.groupBy("key", "i", "j").applyInArrow(run, f"{_KEY}, rep long, comp long")


def joining(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members (key, i, j, rep, comp, text): links (a, b), confirmed on full sets, that join components within a block."""

    def run(group: pa.Table) -> pa.Table:
        rep, comp = group["rep"].to_pylist(), group["comp"].to_pylist()
        sets = [shingles(t) for t in group["text"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        every, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(column) > 1
        place = np.cumsum(often) - 1
        row, column = row[often[column]], place[column[often[column]]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(often.sum()), 4096):  # so many shingles at a time
            a, b = np.searchsorted(column, [lo, lo + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], column[a:b] - lo] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        parent = {c: c for c in comp}

        def top(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for x, y in zip(*(q.tolist() for q in np.nonzero(np.triu(linked, 1))), strict=True):
            if (p := top(comp[x])) != (q := top(comp[y])):
                parent[p] = q
                out.append((rep[x], rep[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_shingles, component_id, kept; sets link from a similarity of percent in 100 on."""
    docs = texts(docs)
    all_rows = stored(sketches(docs, percent), "sketches")
    some = all_rows.where("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep")), "classes")
    ours = stored(some.join(classes, ["fp_a", "fp_b"]).where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "n", "regs", "bands"), "class-sketches")
    banded = ours.select(F.explode("bands").alias("key"), "rep")
    buckets = stored(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    filled = stored(banded.join(buckets, "key"), "bucket-members")
    # the class's text stands for all its copies'; rows of equal doc_id and different texts: the least fitting hash decides once
    words = docs.join(ours.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    stars = filled.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    side = ours.select("rep", "n", "regs")
    known = stars.join(side.toDF("b", "nb", "rb"), "b").join(side.toDF("a", "na", "ra"), "a")
    links = stored(confirmed(stored(likely(known, percent), "likely"), words, percent), "links")
    first = stored(components(links), "components")
    comp = F.coalesce("component", "rep")
    apart = filled.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "hub", "size", comp.alias("comp"))
    open_keys = apart.where("rep <> hub").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    spread = apart.where("rep <> hub").join(open_keys, "key", "left_semi").withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = spread.select("key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "rep", "comp")
    hope = stored(hopeful(dealt.join(side, "rep"), percent), "hopeful")
    more = joining(hope.join(words.withColumnRenamed("doc_id", "rep"), "rep").select("key", "i", "j", "rep", "comp", "text"), percent)
    final = components(links.unionByName(stored(more, "links-within")))
    member = some.select("doc_id", "fp_a", "fp_b").join(classes, ["fp_a", "fp_b"]).join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(comp).alias("component_id"))
    out = all_rows.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of each component's least doc_id; documents without links stay."""
    (name,) = fresh(["gone"], docs.columns)
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
