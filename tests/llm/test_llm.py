"""The training-data operators against libraries, brute force and round trips, odd rows included."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "a text without a number, which is of no use to anyone but still is here", "en", "a", 9),
    (4, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "b", 66),
    (4, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "b", 66),
    (5, "  odd \t blanks\n\n and \x1c signs 日本語 😀 " * 3, "xx", "", 1),
    (6, "long " + " ".join(f"w{i % 977}" for i in range(30_000)), "en", "c", 1),
    (7, "x" * 20_000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, ids string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def sf(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def lone(x):
    return [(r[0], r[1] or "") for r in x]


def test_transducer_equals_the_library():
    import tiktoken

    from horosphere.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, r = bpe.splitter(path, P.PATTERN), random.Random(1)
    some = ["", " ", "  ", "a  b", "a \n b", "a\n \n b \n", "\x1c a\x1fb", "x" * 3000, "é" * 400, "²³ ½ 12a", "it's we'LL", "<|endoftext|>", *(x[1] or "" for x in ROWS)]
    some += ["".join(r.choice("ab e  \n'st1²é😀.,!theing \x1d") for _ in range(r.randrange(60))) for _ in range(1500)]
    decoder = bpe.Utf8Decoder({i: b for b, i in ranks.items()})
    for t in some * 2:  # the second time from what is remembered
        ids = np.frombuffer(ours.encode(t), "<u4").tolist()
        assert ids == library.encode_ordinary(t), t
        k = r.randrange(len(ids) + 1)
        assert decoder.feed(ids[:k]) + decoder.feed(ids[k:]) + decoder.close() == t


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    from horosphere.llm.tokens import LibraryEncoder

    path, r = P.path("byte_bpe_50k.json"), random.Random(2)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    some = ["a\0 b", "\0", " the a", "<|endoftext|> b", *(x[1] or "" for x in ROWS)] + ["".join(r.choice("ab e  \n'st1²é😀.,theing \x1d\0") for _ in range(r.randrange(60))) for _ in range(1500)]
    got = LibraryEncoder(path).encode(some)
    for t, a, b in zip(some, got, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == b.ids, t


def expected_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]


def test_op3_on_odd_rows(spark, odd, none, tmp_path):
    from horosphere.llm.bpe import op3_bpe

    got = sorted(map(tuple, op3_bpe(spark, sf(spark, tmp_path, documents=odd)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    h = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((d, len(i), h(" ".join(map(str, i)).encode()), h((r[1] or "").encode())) for (d, i), r in zip(expected_ids(), ROWS, strict=True)), key=str)
    assert op3_bpe(spark, sf(spark, tmp_path / "none", documents=none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4097, 9000])
@pytest.mark.parametrize("high", [1, 50257, 2**63])
def test_simple8b_round_trip(n, high):
    from horosphere.llm import simple8b

    r = np.random.default_rng(n)
    x = r.integers(0, high, n, dtype=np.uint64, endpoint=True)
    if high == 2**63:
        x[::3], x[1::7] = 2**64 - 1, 3
    docs = [None, *range(n // 3)][: max(1, n // 3)] if n else []
    lengths = np.diff(np.concatenate([[0], np.sort(r.integers(0, n + 1, len(docs) - 1)), [n]])) if n else np.zeros(0, int)
    got = list(simple8b.unpack(simple8b.pack(docs, lengths, x), 37))
    assert [d for g in got for d in g[0]] == docs
    assert not n or (np.concatenate([g[2] for g in got]) == x).all()


def test_op6_on_odd_rows(spark, odd, none, tmp_path):
    from horosphere.llm.simple8b import op6_simple8b

    got = [tuple(r) for r in op6_simple8b(spark, sf(spark, tmp_path, documents=odd)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()]
    want, start = [], 0
    ordered = sorted(((d, i, r[1] or "") for (d, i), r in zip(expected_ids(), ROWS, strict=True)), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    for d, ids, _ in ordered:
        full = np.array([*ids, 2], "<u4")
        want.append((start, d, len(full), zlib.crc32(full.tobytes())))
        start += len(full)
    assert sorted(got) == want
    assert op6_simple8b(spark, sf(spark, tmp_path / "none", documents=none)).count() == 0


def test_packing_is_gapless_and_tight():
    from horosphere.llm.packing import pack

    r = np.random.default_rng(0)
    for n in (1, 7, 500, 4000):
        x = np.minimum(1024, 1 + r.lognormal(5.5, 1.2, n).astype(int))
        where, offset = pack(x, 1024)
        assert np.bincount(where, x).max() <= 1024
        order = np.lexsort((offset, where))
        new = np.append(True, where[order][1:] != where[order][:-1])
        ends = np.append(0, (offset + x)[order][:-1])
        assert (offset[order] == np.where(new, 0, ends)).all()
        assert where.max() + 1 <= -(-x.sum() // 1024) * 1.01 + 2


def test_op9_on_odd_rows(spark, odd, none, tmp_path):
    from horosphere.llm.packing import op9_packing

    got = op9_packing(spark, sf(spark, tmp_path, documents=odd)).collect()
    assert sum(r.length for r in got) == sum(len(i) + 1 for _, i in expected_ids())
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert op9_packing(spark, sf(spark, tmp_path / "none", documents=none)).count() == 0


def test_ogg_pages_round_trip_and_damage_shows():
    from horosphere.llm import ogg

    for n in (64, 4096, 61440, 65024, 300_032):
        payload = os.urandom(n)
        media = ogg.write(payload, n - 3)
        got = ogg.read(media)
        assert (got["payload"], got["n_bytes"]) == (payload, n - 3)
        assert got["seconds"] == n / ogg.RATE
        bad = bytearray(media)
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError, match="page"):
            ogg.read(bytes(bad))
        streams, damaged = ogg.scan(bytes(bad))
        assert damaged and len(streams) == 2


def test_op4_on_odd_rows(spark, odd, none, tmp_path):
    from horosphere.llm.ogg import op4_ogg

    got = sorted(((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in op4_ogg(spark, sf(spark, tmp_path, documents=odd)).collect()), key=str)
    want = []
    for d, t in lone(ROWS):
        raw = t.encode()
        p = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        want.append((d, len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=str)
    assert op4_ogg(spark, sf(spark, tmp_path / "none", documents=none)).count() == 0


def test_main_text():
    from horosphere.llm.html import main_text

    assert main_text("") == main_text("<p>") == ""
    page = "<nav><a href=x>Home</a></nav><div class=ad>Buy this now, it is so cheap and so good</div><article><h1>Head</h1><p>One &amp; two<br>three, and rather more of it here.<p>Short.</article><section id=comments><p>I like it a lot, thank you for this</section><footer>&copy; us</footer>"
    assert main_text(page) == "Head\n\nOne & two three, and rather more of it here.\n\nShort."
    plain = "<div id=main><h2>T</h2><p>Long text here, and a lot more of it, really, so much.<p>Short.</div><div class='comment-list'><p>Great post, I love it so very much</div><form><label>Mail</label></form><script>var x = '<p>no</p>'</script>"
    assert main_text(plain) == "T\n\nLong text here, and a lot more of it, really, so much.\n\nShort."


def test_op2_on_odd_rows(spark, tmp_path):
    from horosphere.llm.html import op2_html

    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "<article>" + "<p>some words are here</p>" * 3000, 1), (2, "u", "<b>x", 1), (None, None, "", 1)], "page_id long, url string, html string, text long")
    got = {(r.page_id, r.n_chars) for r in op2_html(spark, sf(spark, tmp_path, pages=pages)).collect()}
    assert {(1, 0), (2, 3000 * 19 + 2999 * 2), (None, 0)} <= got


def test_toxicity_finds_held_out_rows(spark):
    from horosphere.llm.toxicity import op7_toxicity

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test data")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = op7_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").selectExpr("avg(if(predicted = toxic, 1, 0)) AS right").first()
    assert r.right > 0.9


def test_op7_without_labels(spark, odd, none, tmp_path):
    from horosphere.llm.toxicity import op7_toxicity

    labels = spark.createDataFrame([(1, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = op7_toxicity(spark, sf(spark, tmp_path, documents=odd, labels=labels)).collect()
    assert len(got) == len(ROWS) and {r.score for r in got} == {0.0}
    assert op7_toxicity(spark, sf(spark, tmp_path / "none", documents=none, labels=labels)).count() == 0


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies():
    """Groups whose members are near the first, but often not near each other."""
    r, out = random.Random(3), []
    for g in range(3):
        base = [f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(220)]
        for k in range(25):
            w = list(base)
            for _ in range(k % 4 + 1):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            out.append((100 * (g + 1) + k, " ".join(w)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [512, 5])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    from horosphere.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [*near_copies(), *[(i + 1000, t) for i, t in lone(ROWS) if i]]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sketches_estimate_similarity():
    from horosphere.llm import neardup

    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2800], x[200:]
    ra, rb = (neardup.registers(neardup.minima(s)) for s in (a, b))
    assert abs(neardup.similarity(ra, rb, len(a), len(b)) - 2600 / 3000) < 0.1
    assert (np.maximum(ra, rb) == neardup.registers(neardup.minima(x))).all()


def test_op8_on_no_rows(spark, none):
    from horosphere.llm.neardup import near_duplicates

    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("memory", [1 << 26, 64])
def test_induced_sorting(memory):
    from horosphere.llm.induced import suffix_order

    r = np.random.default_rng(0)
    for n in (1, 2, 5, 60, 900):
        for high in (1, 2, 250):
            t = r.integers(0, high, n).astype(np.uint8)
            raw = t.tobytes()
            assert suffix_order(t, memory, 1 << 30).tolist() == sorted(range(n), key=lambda i: raw[i:])


def brute_removal(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = t.encode()
        mark, new = bytearray(len(b)), []
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                mark[p : p + 50] = b"\1" * 50
            else:
                new.append(b[p : p + 50])
        seen.update(new)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(1 for k in range(len(b)) if mark[k] and (not k or not mark[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("piece", "shard"), [(2 << 20, 3 << 20), (700, 200)])
def test_substring_removal_equals_brute_force(spark, tmp_path, piece, shard, monkeypatch):
    from horosphere.llm import substrings

    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "SHARD", shard)
    r = random.Random(4)
    some = [" ".join(f"w{r.randrange(50)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, "".join(r.choice([*some, "é" * r.randrange(80), "ab" * r.randrange(60), f"u{r.random()}" * 5]) for _ in range(r.randrange(1, 6)))) for i in range(80)]
    rows += [(200 + i, t) for i, t in rows[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, substrings.op10_suffix(spark, sf(spark, tmp_path, documents=df)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == brute_removal(rows)


def test_op10_on_odd_rows(spark, odd, none, tmp_path):
    from horosphere.llm.substrings import op10_suffix

    got = op10_suffix(spark, sf(spark, tmp_path, documents=odd)).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id == 4) == [(66, 66), (66, 66)]
    assert all(r.n_removed == 0 for r in got if r.doc_id != 4)
    assert op10_suffix(spark, sf(spark, tmp_path / "none", documents=none)).count() == 0


def test_ann_recall_and_exact_scores(spark):
    from horosphere.llm import ann

    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[300:700] = x[300]  # one vector that many rows hold
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0, 2.0]), (None, [1.0] * 16)]
    points = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = ann.search(ann.index(points, 3), points.where("id % 100 = 0"), 3, 10).collect()
    y, hit, by = x.astype(float), 0, collections.defaultdict(list)
    for g in got:
        by[g.query_id].append((g.rank, g.vec_id, g.score))
    assert sorted(by) == list(range(0, 1500, 100))
    for q, found in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
    assert hit / (10 * len(by)) >= 0.9


def test_op1_on_few_rows(spark, tmp_path):
    from horosphere.llm.ann import op1_ann

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in op1_ann(spark, sf(spark, tmp_path, embeddings=df)).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert op1_ann(spark, sf(spark, tmp_path / "none", embeddings=df.limit(0))).count() == 0


def test_lm_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from horosphere.llm.lm import OP5_SQL, op5_lm

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (op5_lm(spark, SF).toPandas(), con.execute(OP5_SQL).df()))
    for c in a.columns:
        assert (a[c].isna() & b[c].isna() | (a[c] == b[c])).all()


def test_op5_on_odd_rows(spark, odd, none):
    from horosphere.llm.lm import score

    got = score(odd).collect()
    assert len(got) == len(ROWS)
    assert all((r.log_score is None) == (r.n_words == 0) for r in got)
    assert score(none).count() == 0


def test_pipeline_keeps_clean_and_single(spark, tmp_path):
    import corpus_pipeline

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    from horosphere.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stored(stage(spark, now, SF), f"test-{name}")
        assert now.dtypes == docs.dtypes
        if name == "near_dedup":
            want = brute_components([(r.doc_id, r.text or "") for r in before.collect()])
            assert {r.doc_id for r in now.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "substring_dedup":
            removed = {i: n for i, _, n, _, _ in brute_removal([(r.doc_id, r.text or "") for r in before.collect()])}
            was = {r.doc_id: r.text for r in before.collect()}
            left = {r.doc_id: r.text for r in now.collect()}
            assert all(left[i] == was[i] for i, n in removed.items() if not n)
            assert all(len(left.get(i, "").encode()) <= len(was[i].encode()) - n for i, n in removed.items() if n)
        assert now.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()


def test_vocabulary_file_is_read_as_ranks():
    from horosphere.llm.bpe import read_ranks

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        first = f.readline().split()
    assert read_ranks(P.path("byte_bpe_50k.tiktoken"))[base64.b64decode(first[0])] == int(first[1])


def test_near_duplicates_link_from_what_is_asked_for(spark):
    """106 of 126 shingles in common: 0.84; 91 of 141: 0.65."""
    from horosphere.llm import neardup

    words = [f"w{i}" for i in range(120)]
    near = [w if i not in (30, 80) else f"x{i}" for i, w in enumerate(words)]
    far = [w if i not in (20, 50, 60, 70, 100) else f"y{i}" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id for r in neardup.keep_one(docs, 80).collect()} == {1, 3}
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == {1, 2, 3}


def test_bands_miss_no_more_at_a_lower_similarity():
    from horosphere.llm import neardup

    assert [neardup.band_width(x) for x in (85, 80)] == [6, 5]
    for x in (60, 80, 85, 90):
        w = neardup.band_width(x)
        assert (1 - (x / 100) ** w) ** (neardup.REGISTERS // w) <= neardup.MISS
    assert neardup.floor_similarity(80) < neardup.floor_similarity(85) < 0.85


@pytest.mark.parametrize("opened", ["<div class='site has-sidebar'>", "<main class='content with-sidebar'>", "<article class='post comments-open'>", "<div class='share-page'><article>", "<div id=social>", "<div class=related><main>"])
def test_names_do_not_bar_the_main_text(opened):
    from horosphere.llm.html import main_text

    p = "Long text here, and a lot more of it, really, so much that it counts."
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))
    page = f"<nav><a href=x>Home</a></nav>{opened}<p>{p}<p>{p}<section class=comments><p>Nice one</section>{ends}<footer>us</footer>"
    assert main_text(page) == f"{p}\n\n{p}"


def test_comments_longer_than_the_article_stay_out():
    from horosphere.llm.html import main_text

    p = "Long text here, and a lot more of it, really, so much that it counts."
    assert main_text(f"<article><p>{p}</p><section id=comments><p>{p}<p>{p}<p>{p}</section></article>") == p


def test_lexicon_counts_different_texts_of_a_common_phrase_each(spark):
    from horosphere.llm import toxicity

    phrase = " ".join(f"common{i}" for i in range(30))
    rows = [(k, 1, f"{phrase} " + " ".join(f"own{k}x{i}" for i in range(30))) for k in range(12)]
    rows += [(100, 1, rows[0][2]), (101, 0, rows[0][2]), (102, 1, ""), (103, 1, "")]
    long = " ".join(f"w{i}" for i in range(200))
    rows += [(200, 1, long), (201, 1, f"{long} more")]
    got = sorted(map(tuple, toxicity.single(spark.createDataFrame(rows, "doc_id long, toxic int, text string")).collect()))
    assert got == sorted((y, t) for k, y, t in rows if k not in (100, 103, 201))


def test_many_pretokens_go_through_the_transducer_as_one_by_one():
    from horosphere.llm import bpe

    ranks, r = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), random.Random(7)
    one, many = bpe.BpeTransducer(ranks), bpe.BpeTransducer(ranks)
    words = ["".join(r.choice("aeinrst thoé😀") for _ in range(r.randrange(1, 14))).encode() for _ in range(3000)] + [b"x" * 200, b"\xff\xfe"]
    for _ in range(3):  # more transitions are made each time
        assert many.encode_all(words) == [one.encode(w) for w in words]
    assert len(many.states) > 1


def test_incremental_utf8_holds_back_what_is_incomplete():
    from horosphere.llm import bpe

    decoder = bpe.Utf8Decoder({i: bytes([i]) for i in range(256)} | {300: b"ab", 301: "é".encode(), 302: "é".encode()[:1]})
    assert decoder.feed([300, 0xF0, 0x9F]) == "ab" and decoder.feed([0x98]) == "" and decoder.feed([0x80, 301, 302]) == "😀é"
    assert decoder.close_bytes() == "é".encode()[:1]


def test_columns_of_texts_equal_texts():
    import pyarrow as pa

    from horosphere.llm import pieces
    from horosphere.llm.tokens import LibraryEncoder

    library, r = LibraryEncoder(P.path("byte_bpe_50k.json")), random.Random(8)
    some = ["", "\n", "a\n", "\na b", "don't.'s x", "a.b,c !d", "end.\nNew, line\n\nx", "\x02 a", "a　 b", " ".join(["word,"] * 50)]
    some += ["".join(r.choice("abé .,'!\n\t1") for _ in range(r.randrange(40))) for _ in range(1500)]
    for part in (16 << 20, 30):  # in one part, and long texts in parts
        pieces.PART, was = part, pieces.PART
        try:
            ids, lengths = library.column(pa.array(some))
        finally:
            pieces.PART = was
        assert pieces.parted(ids, lengths) == [library.whole(t) for t in some]


def brute_common(raw, order):
    out = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        out.append(k)
    return out


@pytest.mark.parametrize(("memory", "taken"), [(1 << 26, 1 << 16), (64, 4), (1000, 16), (64, 1 << 16)])
def test_induced_sorting_carries_common_prefixes(memory, taken, monkeypatch):
    from horosphere.llm import induced

    monkeypatch.setattr(induced, "TAKEN", taken)
    r = np.random.default_rng(1)
    texts = [r.integers(0, high, n, dtype=np.uint8, endpoint=True) for n in (1, 2, 9, 250) for high in (1, 3, 250)]
    words = [bytes(r.integers(97, 123, 5, dtype=np.uint8)) for _ in range(9)]
    texts.append(np.frombuffer(b" ".join(words[i] for i in r.integers(0, 9, 120)), np.uint8))
    for t in texts:
        raw = t.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        got = list(induced.sorted_suffixes(t, memory))
        assert np.concatenate([p for p, _ in got]).tolist() == want
        assert np.concatenate([x for _, x in got]).tolist() == brute_common(raw, want)


def test_a_shard_larger_than_the_queues_goes_to_disk_and_stays_right():
    """At the memory of production: the tuples of 600 KB are several times as large."""
    from horosphere.llm import induced, substrings

    r = np.random.default_rng(2)
    segments = [bytes(r.integers(97, 101, 70, dtype=np.uint8)) for _ in range(8000)]
    segments += [segments[i][5:60] + b"zz" for i in range(500)]
    size, docs = np.array([len(s) for s in segments]), np.arange(len(segments))[::-1]
    text, spills = np.frombuffer(b"".join(s + b"\xff" for s in segments), np.uint8), [0]
    got = np.concatenate(list(substrings.holders(text, np.cumsum(size + 1) - size - 1, size, docs, spills=spills)))
    first: dict = {}
    windows = [(s[k : k + 50], d) for s, d in zip(segments, docs.tolist(), strict=True) for k in range(len(s) - 49)]
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    assert got.tolist() == [first[w] for w, _ in windows]
    assert len(text) * induced.TUPLE.itemsize > 2 * induced.MEMORY and spills[0] > 2


def test_only_windows_that_may_be_shared_are_sorted(monkeypatch):
    """before, every window of an anchor with several segments was."""
    from horosphere.llm import induced, substrings

    r = np.random.default_rng(3)
    segments = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in r.integers(50, 90, 4000).tolist()]
    segments += [s for i in range(0, 600, 2) for s in (segments[i][-60:] + b"q", b"z" + segments[i][:55], segments[i][:50])]
    size, docs = np.array([len(s) for s in segments]), r.permutation(len(segments))
    text, given = np.frombuffer(b"".join(s + b"\xff" for s in segments), np.uint8), []
    plain = induced.sorted_suffixes
    monkeypatch.setattr(induced, "sorted_suffixes", lambda t, *a: (given.append(len(t)), plain(t, *a))[1])
    monkeypatch.setattr(substrings, "AT_ONCE", 1000)  # runs cross blocks
    monkeypatch.setattr(substrings, "SORTED", 30_000)
    start = np.cumsum(size + 1) - size - 1
    got = np.concatenate(list(substrings.holders_of_shared(text, start, size, docs)))
    first: dict = {}
    windows = [(s[k : k + 50], d) for s, d in zip(segments, docs.tolist(), strict=True) for k in range(len(s) - 49)]
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    assert got.tolist() == [first[w] for w, _ in windows]
    assert given[0] < len(text) / 3
    alone = np.concatenate(list(substrings.holders_of_shared(text, start[:4000:2][300:], size[:4000:2][300:], docs[:4000:2][300:])))
    assert alone.tolist() == np.repeat(docs[:4000:2][300:], size[:4000:2][300:] - 49).tolist()


def test_memory_of_packing_within_the_pipeline(spark):
    """Text is cut a megabyte at a time, and the stage before needs one Python worker a task."""
    import pyarrow as pa

    from horosphere.llm import pieces, substrings

    taken = []

    def encode(some):
        taken.append(sum(map(len, some)))
        return [np.arange(1, dtype="<u4").tobytes()] * len(some)

    words = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(1000)]
    ids, n = pieces.by_pieces(pa.array(words), encode, lambda t: b"")
    assert (len(ids), n.tolist()) == (400_000, [400] * 1000)
    assert max(taken) <= 1 << 20 and sum(taken) > 2 << 20
    docs = spark.createDataFrame([(1, "a" * 70, 70), (2, "b" + "a" * 60 + "c", 62)], "doc_id long, text string, n_chars long")
    got = substrings.without_repeats(docs)
    assert sorted(map(tuple, got.collect())) == [(1, "a" * 70, 70), (2, "bc", 2)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1


def test_shards_follow_the_bytes(spark):
    from horosphere.llm import substrings

    held = lambda n: spark.createDataFrame([(n,)], "size long")
    assert substrings.shard_count(held(0)) == 1
    assert substrings.shard_count(held(80 << 20)) == 10
    assert substrings.shard_count(held(10**14)) == -(-(10**14) // (256 << 20))


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a <![foo[ x ]]> b</p>", "a b"), ("<!DOCTYPE html [ <!ENTITY a 'b'> ]><p>text</p>", "text"),
    ("<p>text here</p><!-- never ends <p>x", "text here"), ("<p>text</p><a href='x", "text"), ("<p>a &lt; b &amp;c &#233;</p>", "a < b &c é"),
])
def test_broken_markup(page, text):
    from horosphere.llm.html import main_text

    assert main_text(page) == text


LONG = "Long text here, and a lot more of it, really, so much that it counts."


def test_the_threshold_finds_the_region_without_names(monkeypatch):
    from horosphere.llm import html

    page = f"<div><div><a href=a>Home</a> <a href=b>About</a></div><div>Menu</div><div>Log in</div><div>Tags</div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>ok</p></div><div>Up</div><div>Copyright</div><div><a href=c>Up</a></div></div>"
    assert html.main_text(page) == f"T\n\n{LONG}\n\n{LONG}\n\nok"
    monkeypatch.setattr(html, "threshold", lambda values: min(values) - 1)
    assert html.main_text(page) != f"T\n\n{LONG}\n\n{LONG}\n\nok"


def test_regions_by_their_content():
    from horosphere.llm.html import main_text

    assert main_text(f"<div><p>{LONG}</p></div><div><p>second</p></div>") == f"{LONG}\n\nsecond"
    assert LONG in main_text(f"<article><p>Read on.</p></article><div class=story><p>{LONG}</p><p>{LONG}</p></div>")
    assert main_text(f"<div class='no-sidebar layout'><article><p>{LONG}</p></article></div>") == LONG
    assert main_text(f"<article><p>{LONG}</p><div class='related-work'><h2>Related work</h2><p>{LONG}</p></div></article>") == f"{LONG}\n\nRelated work\n\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p></article><div class=related><a href=x>More</a> <a href=y>Less</a></div>") == LONG


def test_op2_on_no_pages_clashes_and_a_long_page(spark, tmp_path):
    from horosphere.llm.html import op2_html

    big = "<article>" + f"<p>{LONG}</p>" * 130_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", big, "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert op2_html(spark, sf(spark, tmp_path, pages=pages)).first().n_chars == 130_000 * (len(LONG) + 2) - 2
    assert op2_html(spark, sf(spark, tmp_path / "none", pages=pages.limit(0))).count() == 0


def test_op2_finds_planted_articles(spark):
    """The pages of the test data hold their article in one element: its blocks, by a plain parser, are what must come out."""
    from html.parser import HTMLParser

    from horosphere.llm.html import main_text

    if not os.path.isdir(SF):
        pytest.skip("no test data")

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks, self.skip = 0, [""], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "main"):
                self.depth += 1
            if tag in ("p", "h1", "h2", "h3", "li", "div", "section", "blockquote"):
                self.blocks.append("")
            self.skip += tag in ("script", "style", "aside", "nav", "form", "footer", "header")

        def handle_endtag(self, tag):
            if tag in ("article", "main"):
                self.depth -= 1
            if tag in ("p", "h1", "h2", "h3", "li", "div", "section", "blockquote"):
                self.blocks.append("")
            self.skip -= tag in ("script", "style", "aside", "nav", "form", "footer", "header")

        def handle_data(self, data):
            if self.depth > 0 and not self.skip:
                self.blocks[-1] += data

    close = 0
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        a = Article()
        a.feed(r.html or "")
        want, got = {" ".join(b.split()) for b in a.blocks} - {""}, set(main_text(r.html or "").split("\n\n")) - {""}
        close += len(want & got) >= 0.8 * len(got) and got <= want if want else not got
    assert close >= 0.9 * len(rows)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y > 0].sum() - (y > 0).sum() * ((y > 0).sum() + 1) / 2) / ((y > 0).sum() * (y == 0).sum())


def test_toxicity_ranks_held_out_rows(spark):
    """A constant score has an AUC of 0.5 and finds no toxic row."""
    from horosphere.llm.toxicity import op7_toxicity

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = op7_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    assert auc(r.score.to_numpy(), r.toxic.to_numpy()) > 0.95
    assert r.predicted[r.toxic == 1].mean() > 0.8
    assert r.predicted[r.toxic == 0].mean() < 0.02


def test_toxicity_is_the_same_twice_and_knows_no_null(spark, tmp_path):
    from horosphere.llm.toxicity import op7_toxicity

    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["you", "vile", "scum", "day", "sun", "tree", f"w{i}"] if i % 3 else ["day", "sun", "tree", "sea", f"w{i}"]) for _ in range(30))) for i in range(150)]
    docs = spark.createDataFrame([*rows, (None, "you vile scum"), (7, "another text")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    path = sf(spark, tmp_path, documents=docs, labels=labels)
    one, two = (sorted(map(tuple, op7_toxicity(spark, path).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == 152
    assert [x[1] for x in one if x[0] is None] == [False]


def test_no_label_reaches_its_own_features(spark, tmp_path):
    """Random labels of texts whose every word is their own: a lexicon learnt from the scored rows would tell them apart."""
    from horosphere.llm import toxicity

    r = random.Random(10)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), r.randrange(2)) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"))
    p = [x.score for x in toxicity.score(docs, model).collect()]
    assert max(p) - min(p) < 0.5


def test_op9_pieces_equal_brute_force(spark, odd, tmp_path):
    from horosphere.llm.packing import op9_packing

    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in op9_packing(spark, sf(spark, tmp_path, documents=odd)).collect())
    want = collections.Counter()
    for d, ids in expected_ids():
        x = np.array([*ids, 2], "<u4")
        first = len(x) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(x), 1024)], [*range(first, len(x), 1024), len(x)], strict=True)):
            want[d, k, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert got == want


def test_op8_on_odd_and_clashing_rows(spark, odd):
    from horosphere.llm import neardup

    got = neardup.near_duplicates(odd.withColumn("component_id", odd.score).withColumn("gone", odd.score)).collect()
    assert len(got) == len(ROWS)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = neardup.keep_one(odd.withColumn("gone", odd.score), 85)
    assert kept.columns == [*odd.columns, "gone"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_substring_stage_with_clashing_columns(spark, odd):
    from horosphere.llm import substrings

    df = odd.selectExpr("*", "1 AS doc", "2 AS was", "3 AS now", "4 AS spans", "5 AS kept")
    got = substrings.without_repeats(df)
    assert got.dtypes == df.dtypes
    assert {r.doc_id for r in got.collect()} == {None, 1, 2, 3, 4, 5, 6, 7} - {4}


def test_op1_with_clashing_columns_and_a_null(spark, tmp_path):
    from horosphere.llm.ann import op1_ann

    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 2.0), (1, [1.0, 0.5], 1, 2.0), (None, [1.0, 0.0], 1, 2.0)], "vec_id long, embedding array<double>, rank int, score double")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in op1_ann(spark, sf(spark, tmp_path, embeddings=df)).collect()] == [(0, 1, 1, 0.5)]


def stage_tables(spark, odd, tmp_path, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    return sf(spark, tmp_path, documents=docs.limit(0) if empty else docs, labels=labels)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_and_on_no_rows(spark, odd, tmp_path, empty):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, stage_tables(spark, odd, tmp_path, empty))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= {*got.columns}
    assert empty == (not got.collect())


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() against the toxic stage's own scores, brute-force components and removal, and the library's ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from horosphere.llm import toxicity

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if score[r.doc_id] < 0.5]
    classes = brute_components(rows)
    rows = [(i, t) for i, t in rows if classes[i][1] == i]
    seen, left = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone, new = bytearray(len(b)), []
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
            else:
                new.append(b[p : p + 50])
        seen.update(new)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if kept or not t:
            left[i] = kept
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert got.keys() == left.keys()
    for i, t in left.items():
        x = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert sorted(got[i]) == [(a, n, zlib.crc32(x[a : a + n].tobytes())) for a, n, _ in sorted(got[i])]
        assert sum(n for _, n, _ in got[i]) == len(x)
