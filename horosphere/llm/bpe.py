"""Byte-level BPE by a lazily determinised finite-state transducer.

Two facts about BPE carry the construction. Every prefix of a pretoken has one encoding, and a sequence of tokens is an
encoding exactly if each pair of neighbours is. So the encoding of a prefix is that of a shorter prefix plus one token,
and all the encodings that can still grow form a tree whose leaves end within the longest token's length of the reading
head. What all living branches share is certain and is emitted; the rest - the bytes since the last certain boundary and
the token before it - is the state. States and their transitions are made when they have been asked for OFTEN times, and kept.

Many pretokens go through the transducer together, a byte of each in a step: along its transitions as far as these are made,
and from there on by all living branches of all of them at once, in NumPy.

Decoding is the inverse transducer over tokens: its state is that of an incremental UTF-8 machine.

Edge cases: a null or empty text has no tokens; ties and repeated rows are encoded alike, each for itself; columns other
than the two read are dropped by the thin query and kept by nothing else, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import Recent, list_array, map_arrow, texts
from horosphere.llm.pieces import _LETTER, BARE, by_pieces

#: Pairs and transitions remembered, and states kept, before each memory starts anew; bytes of a generation of the memory of
#: pretokens, and the length from which one is not remembered.
MEMO_ENTRIES, MAX_STATES, KNOWN, LONG = 1_000_000, 100_000, 32 << 20, 64
#: Times that a transition is missing until it is made; pretokens that go through together.
OFTEN, TOGETHER = 64, 32768


_LETTERS = re.compile(f"{BARE}?[{_LETTER}]+")


class IntMap:
    """Whole numbers from 0 to such, many at a time: open addressing."""

    def __init__(self, room: int = 1 << 10):
        self.clear(room)

    def clear(self, room: int = 1 << 10) -> None:
        self.size, self.mask = 0, room - 1
        self.keys, self.values = np.full(room, -1, np.int64), np.zeros(room, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((z >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where it has none."""
        out, at = np.full(len(keys), -1, np.int32), self.slots(keys)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are new and differ."""
        if 2 * (self.size + len(keys)) > self.mask:
            room = self.mask + 1
            while 2 * (self.size + len(keys)) > room:
                room *= 2
            had = self.keys >= 0
            keys, values = np.append(self.keys[had], keys), np.append(self.values[had], values)
            self.clear(room)
        self.size += len(keys)
        left, at = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[left[free]]  # of several at one place the last wins
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask


class BpeTransducer:
    """encode(pretoken) -> ids as little-endian uint32 bytes, in time linear in the pretoken."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: For each prefix of a token: 2 * (its own rank + 1, or 0), plus 1 if it may still grow.
        self.prefixes = {b[:n]: 0 for b in ranks for n in range(1, len(b))}
        self.prefixes = {p: 1 for p in self.prefixes} | {b: 2 * r + 2 + (b in self.prefixes) for b, r in ranks.items()}
        #: The same as a tree: child of (node, byte); of each node its token or -1, and whether it may still grow.
        numbers = {b"": 0} | {p: i for i, p in enumerate(self.prefixes, 1)}
        self.children = IntMap()
        self.children.add(np.array([numbers[q[:-1]] << 8 | q[-1] for q in self.prefixes], np.int64), np.array([numbers[q] for q in self.prefixes], np.int32))
        self.token_at = np.array([-1, *((x >> 1) - 1 for x in self.prefixes.values())], np.int32)
        self.grows = np.array([True, *(bool(x & 1) for x in self.prefixes.values())])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.fitting = IntMap()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        #: For each state: the last certain token; the bytes since; for each length of these the boundary before its last token and that token; the boundaries that a token may still grow from.
        self.states: list[tuple] = [(-1, b"", ((0, -1),), (0,))]
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        self.ends: list[bytes | None] = [b""]
        self.asked: Counter = Counter()  # how often transitions were missing
        self.table = IntMap()  # the number of each transition
        self.fresh: list[int] = []  # those that are not there yet
        self.emitted: list[bytes] = [b""]  # by transition's number
        self.target = [0]

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the token's last merge joins; None of a single byte."""
        if token not in self.halves:
            ranks, word = self.ranks, self.bytes_of[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand after a (-1: the pretoken's start): whether, as both are put together merge by merge, no
        pair over the boundary between them is ever due before the merges that make them."""
        if len(self.pairs) > MEMO_ENTRIES:
            self.pairs.clear()
        bound, left, right, ok = 1 << 60, a, b, True
        while a >= 0:
            due = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if due is not None and due < bound:
                ok = False
                break
            # undo the later of the two last merges: before it, the boundary's tokens were its halves
            x, y = self.last_merge(left), self.last_merge(right)
            if x and (not y or left > right):
                bound, left = left, x[1]
            elif y:
                bound, right = right + 1, y[0]
            else:
                break
        self.pairs[a, b] = ok
        return ok

    def step(self, data: bytes, n: int, before: int, tree, live) -> tuple[tuple[int, int], list[int]]:
        """One more byte, data[n - 1]: the boundary before the last token of data[:n] and that token, and what may still grow."""
        node, still, prefixes, pairs = None, [], self.prefixes, self.pairs
        for p in live:
            x = prefixes.get(data[p:n])
            if x is None:
                continue
            if x & 1:
                still.append(p)
            if x > 1 and node is None:
                last, token = tree[p][1] if p else before, (x >> 1) - 1
                known = pairs.get((last, token))
                if self.fits(last, token) if known is None else known:
                    node = (p, token)
        if node is None:
            raise ValueError("the vocabulary lacks a byte")
        return node, still

    def move(self, state: int, byte: int) -> tuple[int, bytes]:
        """Determinise one transition."""
        before, pending, tree, live = self.states[state]
        pending += bytes((byte,))
        n = base = len(pending)
        node, still = self.step(pending, n, before, tree, live)
        tree = (*tree, node)
        if still:  # where the living branches part
            meet = {n, *still}
            while len(meet) > 1:
                meet.remove(top := max(meet))
                meet.add(tree[top][0])
            (base,) = meet
        emitted = self.back(tree, base)
        if base:
            before = tree[base][1]
        key = (before, pending[base:])
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.states)
            rest = ((0, -1), *((p - base, t) for p, t in tree[base + 1 :])) if base else tree
            self.states.append((*key, rest, (*(p - base for p in still), n - base)))
            self.moves.append({})
            self.ends.append(None)
        out = self.moves[state][byte] = (target, emitted)
        self.fresh.append(state << 8 | byte)
        self.target.append(target)
        self.emitted.append(emitted)
        return out

    @staticmethod
    def back(tree, p: int) -> bytes:
        """The tokens from the last certain boundary to place p."""
        out = b""
        while p:
            p, token = tree[p]
            out = token.to_bytes(4, "little") + out
        return out

    def end(self, state: int) -> bytes:
        out = self.ends[state]
        if out is None:
            _, pending, tree, _ = self.states[state]
            out = self.ends[state] = self.back(tree, len(pending))
        return out

    def encode(self, word: bytes) -> bytes:
        """One pretoken, byte by byte, making all states on its way."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, out = 0, bytearray()
        for byte in word:
            state, emitted = self.moves[state].get(byte) or self.move(state, byte)
            out += emitted
        return bytes(out) + self.end(state)

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """Many pretokens. Long ones, which repeat themselves, go one by one."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) >= LONG or not w:
                out[i] = self.encode(w)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(words[i]))  # those of one length end together
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            for i, x in zip(some, self.together([words[i] for i in some]), strict=True):
                out[i] = x
        return out

    def together(self, words: list[bytes]) -> list[bytes]:
        if len(self.states) > MAX_STATES:
            self.reset()
        if self.fresh:
            self.table.add(np.array(self.fresh, np.int64), np.arange(len(self.target) - len(self.fresh), len(self.target), dtype=np.int32))
            self.fresh = []
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.zeros((len(words), int(size.max())), np.uint8)
        data[np.arange(data.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        state, taken = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        done: list[list[bytes]] = [[] for _ in words]
        target, emits, lanes, missing = np.array(self.target), np.array(list(map(bool, self.emitted))), np.arange(len(words)), []
        for n in range(data.shape[1]):
            lanes = lanes[size[lanes] > n]
            move = self.table.get(state[lanes] << 8 | data[lanes, n])
            lost = move < 0
            missing.append(state[lanes[lost]] << 8 | data[lanes[lost], n])
            lanes, move = lanes[~lost], move[~lost]
            state[lanes], taken[lanes] = target[move], n + 1
            some = emits[move]
            for i, k in zip(lanes[some].tolist(), move[some].tolist(), strict=True):
                done[i].append(self.emitted[k])
        open_ = np.flatnonzero(taken < size).tolist()
        for i in np.flatnonzero(taken == size).tolist():
            done[i].append(self.end(int(state[i])))
        if open_:
            at = [self.states[k] for k in state[open_].tolist()]
            for i, x in zip(open_, self.follow([s[0] for s in at], [s[1] + words[i][taken[i] :] for i, s in zip(open_, at, strict=True)]), strict=True):
                done[i].append(x)
            if len(self.asked) > 4 * MAX_STATES:
                self.asked.clear()
            keys, often = np.unique(np.concatenate(missing), return_counts=True)
            several = often > 1  # most are asked for once, and never again
            for key, k in zip(keys[several].tolist(), often[several].tolist(), strict=True):
                self.asked[key] += k
                if self.asked[key] >= OFTEN and key & 255 not in self.moves[key >> 8]:
                    self.move(key >> 8, key & 255)
                    del self.asked[key]
        return [b"".join(x) for x in done]

    def follow(self, before: list[int], data: list[bytes]) -> list[bytes]:
        """The tokens of each of data, strings that stand after a certain token (-1: none): all living branches of all strings,
        a byte in a step, without making states of the way."""
        size = np.fromiter(map(len, data), np.int64, len(data))
        width = int(size.max())
        text = np.zeros((len(data), width), np.uint8)
        text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        #: Of every prefix of every string its last token, and the boundary before that.
        token, start = np.full((len(data), width + 1), -1, np.int64), np.zeros((len(data), width + 1), np.int64)
        token[:, 0] = before
        known = np.zeros((len(data), width + 1), bool)  # of a prefix that ends within a token of all living branches there is none
        known[:, 0] = True
        lane, place, node = (np.zeros(0, np.int64) for _ in range(3))
        for n in range(1, width + 1):
            on = np.flatnonzero((size >= n) & known[:, n - 1])
            lane, place, node = np.append(lane, on), np.append(place, np.full(len(on), n - 1)), np.append(node, np.zeros(len(on), np.int64))
            child = self.children.get(node << 8 | text[lane, n - 1])
            alive = (child >= 0) & (size[lane] >= n)
            lane, place, node = lane[alive], place[alive], child[alive].astype(np.int64)
            ends = np.flatnonzero(self.token_at[node] >= 0)
            own, at, last = lane[ends], place[ends], self.token_at[node[ends]].astype(np.int64)
            ok = self.fit(token[own, at], last)
            token[own[ok], n], start[own[ok], n], known[own[ok], n] = last[ok], at[ok], True
            on_ = self.grows[node]
            lane, place, node = lane[on_], place[on_], node[on_]
        rows, p, back = np.arange(len(data)), size.copy(), []
        while len(rows):
            if not known[rows, p].all():
                raise ValueError("the vocabulary lacks a byte")
            back.append((rows, token[rows, p]))
            p = start[rows, p]
            rows, p = rows[p > 0], p[p > 0]
        who, ids = (np.concatenate([x[i] for x in back[::-1]]) for i in (0, 1))  # the last tokens were found first
        order = np.argsort(who, kind="stable")
        raw, cut = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(who, minlength=len(data)))).tolist()
        return [raw[i:j] for i, j in zip([0, *cut], cut, strict=False)]

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits() of many pairs."""
        keys = (a + 1) << 32 | b
        got = self.fitting.get(keys)
        new = np.unique(keys[got < 0])
        if len(new):
            if self.fitting.size > MEMO_ENTRIES:
                self.fitting.clear()
            self.fitting.add(new, np.array([self.fits((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()], np.int32))
            got = self.fitting.get(keys)
            if (got < 0).any():  # the memory was cleared
                return np.array([self.fits(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        return got > 0


class Splitter:
    """Texts to ids: their pretokens by pattern, through all(the pretokens' bytes), joined. For patterns of which no match crosses
    the cuts of pieces.py."""

    def __init__(self, pattern: str, all_):
        import regex

        self.find, self.all = regex.compile(pattern).findall, all_
        self.known = Recent(KNOWN)

    def pretokens(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct pretokens."""
        self.known.turn()
        got, new = self.known.all(words)
        if new:
            fresh = dict(zip(new, self.all([w.encode() for w in new]), strict=True))
            got = [fresh[w] if g is None else g for w, g in zip(words, got, strict=True)]
            self.known.add({w: x for w, x in fresh.items() if len(w) <= LONG})
        return got

    def some(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these distinct pieces; one of letters is one pretoken."""
        text = [p[1:] if p[:1] == BARE else " " + p for p in pieces]
        one = _LETTERS.fullmatch
        parts = {t: self.find(t) for p, t in zip(pieces, text, strict=True) if not one(p)}
        words = [*dict.fromkeys(t for t in text if t not in parts)]
        words = [*dict.fromkeys([*words, *(w for x in parts.values() for w in x)])]
        known = dict(zip(words, self.pretokens(words), strict=True))
        return [known[t] if t not in parts else b"".join([known[w] for w in parts[t]]) for t in text]

    def whole(self, text: str) -> bytes:
        words = self.find(text)
        different = list(dict.fromkeys(words))
        known = dict(zip(different, self.pretokens(different), strict=True))
        return b"".join([known[w] for w in words])

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each has)."""
        return by_pieces(texts, self.some, self.whole)

    def encode(self, text: str) -> bytes:
        return self.column(pa.array([text], pa.string()))[0].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_made: dict = {}


def splitter(path: str, pattern: str) -> Splitter:
    """One for each Python worker; the vocabulary file lies in an installed package, on every machine alike."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Splitter(pattern, BpeTransducer(read_ranks(path)).encode_all)
    return _made[path, pattern]


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """(bytes still due, least and greatest next byte) after one more byte; None: not UTF-8."""
    due, low, high = state
    if due:
        return None if not low <= byte <= high else (due - 1, 0x80, 0xBF) if due > 1 else (0, 0, 0)
    if byte < 0x80:
        return state
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class Utf8Decoder:
    """Ids in, text out, piece by piece: bytes of a character that its tokens have not completed wait in the state."""

    START = (0, 0, 0)

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.moves = bytes_of, {}
        self.whole = np.zeros(max(bytes_of, default=-1) + 1, bool)  # tokens that leave the start for the start
        for t in bytes_of:
            self.whole[t] = self.move(self.START, t) == (self.START, 0) and _valid(bytes_of[t])
        self.reset()

    def reset(self) -> None:
        self.state, self.waiting = self.START, b""

    def move(self, state, token: int):
        """The state after the token, and how many of its bytes, counted from the end, wait for more."""
        out = state
        wait = 0
        for byte in self.bytes_of[token]:
            new = utf8_step(out, byte)
            if new is None:
                new = utf8_step(self.START, byte) or self.START
                wait = 0
            wait = wait + 1 if new[0] else 0
            out = new
        if len(self.moves) > MEMO_ENTRIES:
            self.moves.clear()
        self.moves[state, token] = out, wait
        return out, wait

    def feed_bytes(self, ids) -> bytes:
        """The bytes of the characters that are complete after these tokens. Tokens that are whole characters by themselves pass
        as they are; the machine runs from a token that is not until it is back at its start."""
        ids = np.asarray(ids, np.int64)
        n, moves = len(ids), self.moves
        state, held, at = self.state, 0, 0
        broken = np.flatnonzero(~self.whole[ids])
        k = 0
        while at < n:
            if state == self.START:
                k += int(np.searchsorted(broken[k:], at))
                if k == len(broken):
                    at, held = n, 0
                    break
                at, held = int(broken[k]), 0
            t = int(ids[at])
            state, wait = moves.get((state, t)) or self.move(state, t)
            held = held + wait if wait == len(self.bytes_of[t]) else wait
            at += 1
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        held = min(held + len(self.waiting), len(data)) if held == len(data) - len(self.waiting) else held
        self.state, self.waiting = state, data[len(data) - held :]
        return data[: len(data) - held]

    def feed(self, ids) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def close_bytes(self) -> bytes:
        rest = self.waiting
        self.reset()
        return rest

    def close(self) -> str:
        return self.close_bytes().decode("utf-8", "replace")


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = splitter(path, pattern).column
        for b in batches:
            ids, lengths = column(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(pa.array(ids.astype(np.int32)), lengths)], ["doc_id", "ids"])

    return map_arrow(texts(df), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded (the bytes, by the UTF-8 machine), decoded_text (U+FFFD where they are no UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ("decoder", path) not in _made:
            _made["decoder", path] = Utf8Decoder({i: b for b, i in read_ranks(path).items()})
        machine = _made["decoder", path]
        for b in batches:
            flat, at = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_pylist()
            out = [machine.feed_bytes(flat[i:j]) + machine.close_bytes() for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    out = map_arrow(df.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")
    return out.withColumn("decoded_text", F.make_valid_utf8(F.col("decoded").cast("string")))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from horosphere.llm.common import table

    path = P.path("byte_bpe_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path, P.PATTERN), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
