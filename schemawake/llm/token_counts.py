"""Operator 12, token counts of whole texts without encoding most of them: the whole-token shortcut.

Before any text is read, `whole_tokens` proves for every vocabulary string that ends a word whether
the library encodes it, standing alone, as that one token. Tasks then cut texts into the pre-tokens of
the tokenizer with array operations: each distinct pre-token that is among the proven ones counts as one, by a
look-up of all of them at once; only the rest is merged, each distinct one once, and remembered up to
REMEMBERED. Sums by text give the counts, so no ids are made.

The shortcut is written for word-end BPE (NFC, lower case, no white space). Texts that it can't cut for
certain (not in NFC, with a capital sigma, a special token's string or a character whose class depends on the
Unicode version) are encoded whole by the library; so are all texts under any other tokenizer (.json: tokenizers,
.model: sentencepiece). The counts are those of the library in each case.

Cases: null and empty texts have 0 bytes and 0 tokens; rows with a null or repeated doc_id have a row of their own each;
columns other than those kept are not looked at, whatever they are called; texts of any length are counted whole (a text of
many millions of characters is one numpy batch of about 50 bytes a character); an empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import cache
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .bpe import REMEMBERED, _byte_letters
from .common import map_texts, text_of

#: The normalizer and the splitting pattern that the shortcut is written for (fixed values of the tokenizer file).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIGMA = "Σ"  # its lower case depends on what follows in Python, but not in the library


def whole_tokens(path: str) -> np.ndarray | None:
    """Sorted hashes of the strings that are one token when they stand alone; none where the tokenizer isn't a word-end BPE. Needs no text."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    fits = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and (told.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
    if not fits or split.get("pattern") != {"Regex": _PATTERN} or told.get("truncation") or told.get("padding"):
        return None
    bpe, back = _library(path).model, {c: b for b, c in _byte_letters().items()}
    proven = []
    for token in model["vocab"]:
        word = token.removesuffix("</w>")
        if word != token and word and [t.value for t in bpe.tokenize(word)] == [token]:
            try:
                proven.append(bytes(back[ord(c)] for c in word).decode())
            except (KeyError, UnicodeDecodeError):
                pass  # half a character is no pre-token
    arr, ends = vectext.code_points(proven)
    return np.unique(vectext.span_hashes(arr, ends[:-1], ends[1:]))


@cache
def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _library_count(path: str, text: str) -> int:
    found = _library(path)
    return len(found.encode(text) if path.endswith(".model") else found.encode(text, add_special_tokens=False).ids)


def pre_tokens(arr: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every pre-token of lower-case texts, and the numbers of the texts that hold a character of uncertain class."""
    cls = vectext.class_table()[arr]
    n = len(arr)
    first = np.zeros(n, bool)
    first[ends[:-1][ends[:-1] < n]] = True
    start = first | (cls == vectext._NUMBER)  # numbers stand alone
    start[1:] |= cls[1:] != cls[:-1]
    # an apostrophe that begins a run takes s, t, m, d, re, ve or ll from the letters behind it
    q = np.flatnonzero((arr == 39) & start)
    q = q[q + 1 < n]
    q = q[(cls[q + 1] == vectext._LETTER) & ~first[q + 1]]
    a, last = arr[q + 1], np.minimum(q + 2, n - 1)
    b = np.where((q + 2 < n) & ~first[last], arr[last], 0)
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    one = np.isin(a, [ord(c) for c in "stmd"])
    for hit, k in ((one, 2), (two, 3)):
        start[q[hit] + 1] = False
        to = q[hit] + k
        start[to[to < n]] = True
    at = np.flatnonzero(start)
    end = np.r_[at[1:], n]
    ink = cls[at] != vectext._SPACE
    unsure = np.unique(np.searchsorted(ends, np.flatnonzero(cls == vectext._RARE), "right") - 1)
    return at[ink], end[ink], unsure


class Counter:
    """counts(texts) equals the library's; `merged` tells how many distinct pre-tokens had to be merged so far."""

    def __init__(self, path: str, whole: np.ndarray | None) -> None:
        self.path, self.whole, self.known, self.merged = path, whole, {}, 0
        self.special = [] if whole is None else [t.content for t in _library(path).get_added_tokens_decoder().values()]
        self.letters = _byte_letters()

    def counts(self, texts: list[str]) -> np.ndarray:
        if self.whole is None:
            return np.fromiter((_library_count(self.path, t) for t in texts), np.int64, len(texts))
        return np.concatenate([np.zeros(0, np.int64), *(self._batch(texts[a:b]) for a, b in vectext.batches(texts))])

    def _batch(self, texts: list[str]) -> np.ndarray:
        odd = {i for i, t in enumerate(texts) if _SIGMA in t or not is_normalized("NFC", t) or any(s in t for s in self.special)}
        arr, ends = vectext.code_points(["" if i in odd else t.lower() for i, t in enumerate(texts)])
        out = np.zeros(len(texts), np.int64)
        if len(arr):
            start, end, unsure = pre_tokens(arr, ends)
            odd |= set(unsure.tolist())
            text = np.searchsorted(ends, start, "right") - 1
            uniq, at, back = np.unique(vectext.span_hashes(arr, start, end), return_index=True, return_inverse=True)
            many = np.ones(len(uniq), np.int64)
            spot = np.minimum(np.searchsorted(self.whole, uniq), max(len(self.whole) - 1, 0))
            rest = np.flatnonzero(self.whole[spot] != uniq) if len(self.whole) else np.arange(len(uniq))
            many[rest] = [self._merge(int(uniq[i]), arr[start[at[i]] : end[at[i]]]) for i in rest]
            out += np.bincount(text, many[back], len(texts)).astype(np.int64)
        for i in odd:
            out[i] = _library_count(self.path, texts[i])
        return out

    def _merge(self, key: int, piece: np.ndarray) -> int:
        n = self.known.get(key)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            word = piece.tobytes().decode("utf-32-le").encode().decode("latin-1").translate(self.letters)
            n = self.known[key] = len(_library(self.path).model.tokenize(word))
            self.merged += 1
        return n


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every document. One pass, no shuffle.

    What goes to the tasks besides the path is a hash for each vocabulary entry at most.
    """
    whole = whole_tokens(path)

    def run(texts: list[str]) -> dict:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path, whole))
        n = counter.counts(texts)
        return {"n_tokens": n, "over_limit": n > limit}

    rows = docs.select(*keep, "text", F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return map_texts(rows, [*keep, "n_bytes"], run, "n_tokens long, over_limit boolean")
