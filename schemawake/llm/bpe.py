"""Byte-level BPE ids of whole texts, with the tokenizers library.

Merges never cross the pieces of the splitting pattern, so each distinct piece
is encoded once by the library and its ids are put in place by numpy. Texts
holding a special token's string or a character whose class depends on the
Unicode version go through the library whole; results are the same either way.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from . import vectext

#: Distinct pieces remembered by a worker before it starts afresh.
REMEMBERED = 1_000_000
_LONG = 64


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as one printable character: itself if printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """ids(texts) equals [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint16)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        model, letters = self.tokenizer.model, _byte_letters()
        coded = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter((i for c in coded for i in c), np.uint16, int(lens.sum()))
        n, m = len(self.slot), len(self.slot) + len(hashes)
        if m > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros(m, np.int64)]) for x in (self.start, self.count))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(ids), np.uint16)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[n:m] = lens
        self.start[n:m] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.slot.update(zip(hashes, range(n, m)))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint16 ids per text (vocabularies of up to 65,536 ids)."""
        out: list[np.ndarray] = []
        for a, b in vectext.batches(texts):
            out += self._batch(texts[a:b])
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        arr, ends = vectext.code_points(texts)
        none = np.zeros(0, np.uint16)
        if not len(arr):
            return [none] * len(texts)
        start, whole = vectext.pretokens(arr, ends)
        end = np.r_[start[1:], len(arr)]
        text = np.searchsorted(ends, start, "right") - 1
        whole = set(whole.tolist()) | set(text[end - start > _LONG].tolist())
        whole |= {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if whole:
            keep = ~np.isin(text, list(whole))
            start, end, text = start[keep], end[keep], text[keep]
        uniq, at, back = np.unique(vectext.span_hashes(arr, start, end), return_index=True, return_inverse=True)
        if len(self.slot) + len(uniq) > REMEMBERED:
            self.forget()
        keys = uniq.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slot]
        if new:
            raw = arr.tobytes()
            self._learn([keys[i] for i in new], [raw[4 * start[at[i]] : 4 * end[at[i]]].decode("utf-32-le") for i in new])
        slots = np.fromiter((self.slot[h] for h in keys), np.int64, len(keys))[back]
        n = self.count[slots]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.start[slots] - (stop - n), n)]
        bounds = np.r_[0, np.cumsum(np.bincount(text, n, minlength=len(texts)))].astype(np.int64)
        out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint16)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
