"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, at most SAMPLE of them (those of the least hash of
doc_id; the bound is a parameter). Their texts fall into FOLDS folds, copies and confirmed near-duplicates into one. From the
texts come, in one grouped count over their terms, the lexicons: words and word beginnings of 4 to 6 letters whose share of
toxic documents stands out; one of all folds, which scores the corpus, and one without each fold. Every text then becomes
COLUMNS numbers: densities of the lexicon, nearness to second-person words, and rates of capitals, punctuation and
obfuscation. A labelled text's numbers come from the lexicon without its fold, so that none was learnt from its own label.
Trees are grown on histograms of these features on the driver (the sample is bounded), their scores calibrated by isotonic
regression on scores by trees without the text's fold, and the model, of bounded size, goes with the tasks over all rows.

Edge cases: a null or empty text has features 0 and gets the score that these have; without labelled rows every score is
0.0, with labels of one kind every score is that label; label rows without a document, and null labels, count nowhere;
repeated labels of a document count once, both kinds of label one each; of rows of equal doc_id the least text is learnt
from; repeated documents are scored each for itself; a null doc_id is scored and not held out; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm import neardup
from horosphere.llm.common import claim, map_arrow, stored, table, texts

#: Bounds of sample and lexicon; the trees' number, depth, bins of a feature and learning rate; folds left out for calibration;
#: standard deviations by which a lexicon term's toxic documents exceed chance (a larger sample tries more terms, and asks for more).
SAMPLE, TERMS, TREES, DEPTH, BINS, RATE, FOLDS, SIGNS = 16000, 3000, 40, 3, 32, 0.25, 5, 2.9
#: Second-person words of the corpus's languages; what stands for a letter in disguised words.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os vuestro tus".split())
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
#: Words around a second-person word that count as near; terms counted in memory at once.
NEAR, HELD = 6, 200_000
COLUMNS = ("words", "hits", "hit_weight", "most", "kinds", "starts", "start_weight", "start_most", "near_second", "second", "capitals", "upper_words", "marks", "shouts", "asks", "disguised", "stretched")
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
_STRETCHED = re.compile(r"(.)\1\1")


def plain(token: str) -> tuple[str, bool]:
    """(the lower-case word in a token, whether it was disguised): signs within letters are read as the letters they stand for."""
    low = token.lower()
    word = low.strip(_TRIM)
    if word.isalpha():
        return word, False
    core = low.strip(".,;:?\"'()[]{}<>-–—…¡¿«»„“”‘’").rstrip("!")
    if any(c.isalpha() for c in core) and not core.isalpha():
        read = core.translate(DISGUISE)
        bare = "".join(c for c in read if c.isalpha())
        if len(bare) >= 3 and len(bare) >= 0.6 * len(core):
            return bare, True
    return word, False


def terms(text: str) -> set[str]:
    """A text's distinct words, and word beginnings, which ^ marks."""
    out = set()
    for token in set(text.split()):
        word, _ = plain(token)
        if 2 < len(word) <= 40:
            out.add(word)
            out.update("^" + word[:n] for n in (4, 5, 6) if len(word) > n)
    return out


class Featurizer:
    """Tokens are looked at once each and remembered as rows of numbers."""

    LIMIT = 120_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {"": 0}
        self.rows = np.zeros((1024, 10))

    def look(self, token: str) -> int:
        word, disguised = plain(token)
        weight = self.lexicon.get(word, 0.0)
        start = max((self.lexicon.get("^" + word[:n], 0.0) for n in (4, 5, 6)), default=0.0) if len(word) > 4 else 0.0
        k = len(self.code)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        letters = [c for c in token if c.isalpha()]
        self.rows[k] = (weight, start, word in SECOND, sum(c.isupper() for c in letters), len(letters) > 1 and all(c.isupper() for c in letters), sum(not c.isalnum() for c in token), token.count("!"), token.count("?"), disguised, bool(_STRETCHED.search(token)))
        self.code[token] = k
        return k

    def __call__(self, text: str) -> np.ndarray:
        if len(self.code) > self.LIMIT:
            self.reset()
        code, look = self.code, self.look
        tokens = text.split()
        out = np.zeros(len(COLUMNS))
        if not tokens:
            return out
        ids = np.array([code[t] if t in code else look(t) for t in tokens])
        x = self.rows[ids]
        n = len(tokens)
        hit, start, second = x[:, 0] > 0, x[:, 1] > 0, np.flatnonzero(x[:, 2])
        sums = x.sum(axis=0)
        found = np.flatnonzero(hit | start)
        near = 0
        if len(found) and len(second):
            at = np.searchsorted(second, found)
            gap = np.minimum(np.abs(found - second[np.minimum(at, len(second) - 1)]), np.abs(found - second[np.maximum(at - 1, 0)]))
            near = int((gap <= NEAR).sum())
        chars = max(1, len(text))
        out[:] = (np.log1p(n), hit.sum() / n, sums[0] / n, x[:, 0].max(), np.log1p(len(np.unique(ids[hit | start]))), start.sum() / n, sums[1] / n, x[:, 1].max(), near / n, sums[2] / n, sums[3] / chars, sums[4] / n, sums[5] / chars, sums[6] / n, sums[7] / n, sums[8] / n, sums[9] / n)
        return out


def grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> list[tuple]:
    """One tree over binned features, level by level: (feature, greatest bin on the left) for inner places, values for leaves."""
    n, k = codes.shape
    place, tree = np.zeros(n, np.int64), []
    flat = codes + np.arange(k) * BINS
    for level in range(depth):
        width = 1 << level
        g, h = np.zeros((width, k * BINS)), np.zeros((width, k * BINS))
        for f in range(k):
            index = place * BINS + codes[:, f]
            g[:, f * BINS : (f + 1) * BINS] = np.bincount(index, grad, minlength=width * BINS).reshape(width, BINS)
            h[:, f * BINS : (f + 1) * BINS] = np.bincount(index, hess, minlength=width * BINS).reshape(width, BINS)
        g, h = g.reshape(width, k, BINS).cumsum(2), h.reshape(width, k, BINS).cumsum(2)
        gt, ht = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
        gain[(h < 1) | (ht - h < 1)] = 0
        best = gain.reshape(width, -1).argmax(1)
        feature, cut = best // BINS, best % BINS
        cut = np.where(gain.reshape(width, -1).max(1) > 1e-9, cut, BINS)  # nothing gained: all go left
        tree.append((feature, cut))
        place = place * 2 + (codes[np.arange(n), feature[place]] > cut[place])
    gl, hl = np.bincount(place, grad, minlength=1 << depth), np.bincount(place, hess, minlength=1 << depth)
    tree.append((RATE * gl / (hl + 1),))
    return tree


def fall(tree: list[tuple], codes: np.ndarray) -> np.ndarray:
    place = np.zeros(len(codes), np.int64)
    for feature, cut in tree[:-1]:
        place = place * 2 + (codes[np.arange(len(codes)), feature[place]] > cut[place])
    return tree[-1][0][place]


class Trees:
    """Boosted trees of logistic loss over features cut at quantiles."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, f][x[:, f] != 0], np.linspace(0, 1, BINS - 1)[1:-1])) if (x[:, f] != 0).any() else np.zeros(0) for f in range(x.shape[1])]
        self.cuts = [np.unique(np.append(c, 0.0)) for c in self.cuts]
        codes, p = self.binned(x), min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = np.log(p / (1 - p)), []
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-raw))
            self.trees.append(grow(codes, y - q, q * (1 - q), DEPTH))
            raw += fall(self.trees[-1], codes)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes = self.binned(x)
        return self.base + sum(fall(t, codes) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score, probability) points of a step-wise rising curve, to be read off between them linearly."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, least and greatest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
    xs = np.array([p for b in blocks for p in (b[2], b[3])])
    ys = np.array([(b[0]) / (b[1]) for b in blocks for _ in "ab"])
    return xs, ys


class Model:
    """lexicon, trees and calibration; small whatever the corpus is. x, y, fold: features, labels and folds of the sample."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.constant = lexicon, None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.0
            return
        out = np.zeros(len(y))
        for k in np.unique(fold):
            rest = fold != k
            if rest.any():
                out[~rest] = Trees().fit(x[rest], y[rest]).raw(x[~rest])
        self.curve = isotonic(out, y)
        self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.raw(x), *self.curve), 0, 1)


def held_out(doc: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def grouped(rows: DataFrame) -> DataFrame:
    """rows (doc_id, toxic, text) of a bounded sample with component_id: equal for equal sets of shingles, and for sets that are
    confirmed near-duplicates of the least one in a bucket of sketches. Sketches and links of the sample are few enough for the
    driver; texts stay where they are."""
    spark = rows.sparkSession
    texts_ = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = sorted(map(tuple, neardup.sketches(texts_).where("n > 0").select("doc_id", "n", "fp_a", "fp_b", "regs", "bands").collect()))
    rep: dict[tuple[int, int], int] = {}
    for doc, _, fa, fb, _, _ in found:
        rep.setdefault((fa, fb), doc)
    own = [x for x in found if rep[x[2], x[3]] == x[0]]
    hub: dict[int, tuple] = {}
    pairs = {}
    for x in own:
        for key in x[5]:
            y = hub.setdefault(key, x)
            if y[0] != x[0]:
                pairs[y[0], x[0]] = (y[0], x[0], y[1], x[1], bytes(y[4]), bytes(x[4]))
    parent = {doc: rep[fa, fb] for doc, _, fa, fb, _, _ in found}
    if pairs:
        near = neardup.likely(spark.createDataFrame(list(pairs.values()), "a long, b long, na long, nb long, ra binary, rb binary"))
        for a, b in sorted(map(tuple, neardup.confirmed(near, texts_).collect())):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    for doc in sorted(parent):  # a parent is less than its child
        parent[doc] = parent[parent[doc]]
    known = spark.createDataFrame([(int(d), int(c)) for d, c in parent.items()], "doc_id long, component_id long")
    return rows.join(F.broadcast(known), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def single(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, toxic, text), the toxic and text of one of each label's equal texts and confirmed near-duplicates: of
    the least doc_id."""
    return least_of_each(grouped(rows)).select("toxic", "text")


def least_of_each(rows: DataFrame) -> DataFrame:
    exact = rows.groupBy("toxic", "text").agg(F.min(F.struct("doc_id", "component_id")).alias("x")).select("toxic", "text", "x.*")
    return exact.groupBy("toxic", "component_id").agg(F.min(F.struct("doc_id", "text")).alias("least")).select("toxic", "component_id", "least.text")


def lexicon(counted: DataFrame, nt: int, nc: int) -> dict[str, float]:
    """Weights of the terms of counted (term, t, c) that stand out in toxic documents: t of nt, and c of nc others, hold it."""
    by_chance = (F.col("t") + F.col("c")) * (nt / max(1, nt + nc))  # toxic documents that would hold the term if it told nothing
    weight = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
    apart = (F.col("t") - by_chance) >= (SIGNS + 0.5 * math.log(max(1, nt))) * F.sqrt(by_chance)
    return {r.term: r.w for r in counted.where("t >= 3").withColumn("w", weight).where("w >= 2").where(apart).orderBy(F.desc("w"), "term").limit(TERMS).select("term", "w").collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1)).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most sample rows are broadcast
    rows = stored(rows, "toxic-sample")
    rows = stored(grouped(rows).withColumn("fold", F.pmod(F.xxhash64("component_id"), F.lit(FOLDS)).cast("int")), "toxic-folds")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (label, fold), found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array([fold] * len(found), pa.int32()), pa.array([*found], pa.string()), pa.array([*found.values()], pa.int64())], ["toxic", "fold", "term", "n"])
            seen.clear()

        for b in batches:
            for label, fold, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen.setdefault((label, fold), Counter()).update(terms(text))
                if sum(map(len, seen.values())) > HELD:
                    yield from counted()
        yield from counted()

    different = stored(least_of_each(rows).withColumn("fold", F.pmod(F.xxhash64("component_id"), F.lit(FOLDS)).cast("int")), "toxic-single")
    size = {(r.toxic, r.fold): r["count"] for r in different.groupBy("toxic", "fold").count().collect()}
    by_fold = map_arrow(different.select("toxic", "fold", "text"), count, "toxic int, fold int, term string, n long")
    parts = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"{name}{k}") for y, name in ((1, "t"), (0, "c")) for k in range(FOLDS)]
    table_ = stored(by_fold.groupBy("term").agg(*parts).where(" + ".join(f"t{k}" for k in range(FOLDS)) + " >= 3"), "toxic-terms")

    def without(fold: int | None) -> dict[str, float]:
        used = [k for k in range(FOLDS) if k != fold]
        t, c = (F.expr(" + ".join(f"{name}{k}" for k in used)).alias(name) for name in "tc")
        return lexicon(table_.select("term", t, c), *(sum(size.get((y, k), 0) for k in used) for y in (1, 0)))

    lexicons = [without(k) for k in range(FOLDS)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("features")
        now, look = None, None
        for b in batches:
            out = []
            for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now:
                    now, look = k, Featurizer(lexicons[k])
                out.append(look(t).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    by_folds = rows.select("toxic", "fold", "text").sortWithinPartitions("fold")  # one lexicon's memory at a time
    got = sorted(map(tuple, map_arrow(by_folds, features, "toxic int, fold int, x array<double>").collect()), key=lambda r: (r[2], r[0], r[1]))  # of the bounded sample; the order of tasks plays no part
    x = np.array([r[2] for r in got]).reshape(len(got), len(COLUMNS))
    return Model(without(None), x, np.array([r[0] for r in got], float), np.array([r[1] for r in got], int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("features")
        f = Featurizer(model.lexicon)
        for b in batches:
            x = np.array([f(t) for t in b.column(1).to_pylist()]).reshape(len(b), len(COLUMNS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return map_arrow(texts(docs), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose score reaches limit."""
    schema = docs.schema
    text = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("features")
        f = Featurizer(model.lexicon)
        for b in batches:
            x = np.array([f(t or "") for t in b.column(text).to_pylist()]).reshape(len(b), len(COLUMNS))
            yield b.filter(pa.array(model.score(x) < limit))

    return map_arrow(docs, run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
