"""Whole texts to ids by the tokenizers library.

The library splits a text into pretokens and merges within each, so what it makes of a text is what it makes of the
text's pieces (see pieces.py). What is not remembered goes through the library, many pieces in one text.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from horosphere.llm.common import Recent, claim
from horosphere.llm.pieces import BARE, by_pieces, parted

_made: dict[str, LibraryEncoder] = {}
#: Bytes of one generation of the memory of pieces; pieces longer than LONG are not remembered; pieces of one text for the
#: library; texts in one call.
KNOWN, LONG, TOGETHER, CALL = 64 << 20, 64, 100, 50


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # what was seen is remembered here
        size = self.library.get_vocab_size()
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])  # as the library writes a blank
        (self.line_end,) = np.frombuffer(self.whole("\n"), np.uint32)
        self.forget()

    def forget(self) -> None:
        self.known = Recent(KNOWN)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def through(self, lead: str, new: list[str]) -> list[array]:
        """The library's ids of lead + piece + lead + piece + ..., TOGETHER pieces at a time."""
        out: list[array] = []
        for at in range(0, len(new), TOGETHER * CALL):
            some = [lead + lead.join(new[i : i + TOGETHER]) for i in range(at, min(at + TOGETHER * CALL, len(new)), TOGETHER)]
            out += [array("I", g.ids) for g in self.library.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def pieces(self, new: list[str]) -> list[bytes]:
        """The ids of each piece with the blank before it: tokens that begin with a blank begin a piece, since a piece holds no other."""
        out: list[bytes] = []
        for ids in self.through(" ", new):
            cut = (4 * np.append(np.flatnonzero(self.opens[np.frombuffer(ids, np.uint32)]), len(ids))).tolist()
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        return out

    def bare(self, new: list[str]) -> list[bytes]:
        """The ids of each of these pieces, which have no blank before them: line ends part them."""
        plain = [p for p in new if p.split() == [p]]
        out: dict[str, bytes] = {}
        at = iter(plain)
        for ids in self.through("\n", plain):
            cut = [*(4 * np.flatnonzero(np.frombuffer(ids, np.uint32) == self.line_end)).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            out.update((next(at), raw[i + 4 : j]) for i, j in zip(cut, cut[1:], strict=False))
        return [out[p] if p in out else self.whole(p) for p in new]

    def some(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these distinct pieces."""
        self.known.turn()
        got, new = self.known.all(pieces)
        if new:
            lead, bare = [p for p in new if p[:1] != BARE], [p for p in new if p[:1] == BARE]
            fresh = dict(zip(lead, self.pieces(lead), strict=True)) | dict(zip(bare, self.bare([p[1:] for p in bare]), strict=True))
            got = [fresh[p] if g is None else g for p, g in zip(pieces, got, strict=True)]
            self.known.add({p: x for p, x in fresh.items() if len(p) <= LONG})
        return got

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each has)."""
        return by_pieces(texts, self.some, self.whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        return parted(*self.column(pa.array(texts, pa.string())))


def _forget() -> None:
    for e in _made.values():
        e.forget()


def encoder(path: str) -> LibraryEncoder:
    claim("tokens", _forget)
    if path not in _made:
        _made[path] = LibraryEncoder(path)
    return _made[path]
