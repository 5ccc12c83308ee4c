"""Columns of texts to token ids by way of their distinct pieces.

A text is cut where no match of the tokenizers' pattern can cross: before every blank that a word follows; between a letter
and a mark other than the apostrophe; around a line end between two signs. Arrow cuts a column and tells its pieces apart,
each distinct one is encoded once, and NumPy puts the ids together. Texts with blanks of any other kind are encoded whole; a
long text is taken in parts, cut at such blanks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once, and pieces whose ids are put together at once.
PART, PIECES = 1 << 20, 1 << 20
#: Stands before a piece that has no blank before it.
BARE = "\x02"
#: What keeps a text whole (RE2): a blank at either end or before another white-space sign, signs on which patterns differ, BARE.
UNEVEN = r"^ | \z| [\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\x{1c}-\x{1f}\x02]"
#: Letters below U+0250; ASCII marks without the apostrophe.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_CUTS = ((f"([{_LETTER}])([{_MARK}])", f"\\1 {BARE}\\2"), (f"([{_LETTER}{_MARK}])\\n([{_LETTER}])", f"\\1 {BARE}\n {BARE}\\2"))

Encode, Whole = Callable[[list[str]], list[bytes]], Callable[[str], bytes]


def by_pieces(texts: pa.Array, encode: Encode, whole: Whole) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after another; how many each has). encode: the ids of distinct pieces, of those that begin with
    BARE as they stand after it, of others with a blank before them; whole: those of a text; all as little-endian unsigned
    32-bit integers."""
    ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, side="right")))
        a, b = (_some if size[lo] <= PART else _long)(texts.slice(lo, hi - lo), encode, whole)
        ids.append(a)
        lengths.append(b)
        lo = hi
    return np.concatenate(ids), np.concatenate(lengths)


def _long(one: pa.Array, encode: Encode, whole: Whole) -> tuple[np.ndarray, np.ndarray]:
    text = one[0].as_py()
    if pc.match_substring_regex(one, UNEVEN)[0].as_py():
        out = np.frombuffer(whole(text), np.uint32)
        return out, np.array([len(out)])
    ids, at = [], 0
    while at < len(text):
        cut = text.find(" ", at + PART)
        cut = len(text) if cut < 0 else cut
        ids.append(_together(*_pieces(pa.array([text[at + 1 : cut] if at else BARE + text[:cut]]), encode)[:2])[0])  # a later part begins after its blank
        at = cut
    out = np.concatenate(ids)
    return out, np.array([len(out)])


def _pieces(texts: pa.Array, encode: Encode) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of pieces in order, the ids of each, where each text's pieces begin, and the end)."""
    for pattern, cut in _CUTS:
        texts = pc.replace_substring_regex(texts, pattern, cut)
    lists = pc.split_pattern(texts, " ")
    d = lists.values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), encode(d.dictionary.to_numpy(zero_copy_only=False).tolist()), lists.offsets.to_numpy().astype(np.int64)


def _some(texts: pa.Array, encode: Encode, whole: Whole) -> tuple[np.ndarray, np.ndarray]:
    odd = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    even = texts.filter(pa.array(~odd)) if odd.any() else texts
    codes, known, at = _pieces(pc.binary_join_element_wise(BARE, even, ""), encode)
    n = np.ones(len(texts), np.int64)
    n[~odd] = np.diff(at)
    start = np.cumsum(n) - n
    if odd.any():
        every, inner = np.empty(int(n.sum()), np.int64), np.ones(int(n.sum()), bool)
        inner[start[odd]] = False
        every[inner] = codes
        every[start[odd]] = len(known) + np.arange(int(odd.sum()))
        codes, known = every, known + [whole(x) for x in texts.filter(pa.array(odd)).to_pylist()]
    ids, per_piece = _together(codes, known)
    return ids, np.add.reduceat(per_piece, start) if len(start) else np.zeros(0, np.int64)


def _together(codes: np.ndarray, known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces that codes names, one after another, and how many each has."""
    flat = np.frombuffer(b"".join(known), np.uint32)
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    first = np.cumsum(size) - size
    n, out = size[codes], []
    for at in range(0, len(codes), PIECES):
        k, c = n[at : at + PIECES], codes[at : at + PIECES]
        ends = np.cumsum(k)
        out.append(flat[np.repeat(first[c] - (ends - k), k) + np.arange(int(ends[-1]))])
    return np.concatenate(out) if out else np.zeros(0, np.uint32), n


def parted(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    return [ids[i:j].tobytes() for i, j in _spans(lengths)]


def _spans(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(lengths).tolist()
    return zip([0, *ends], ends, strict=False)
