"""Operator 3, quality classifier: interpolated modified Kneser-Ney trigrams of trusted text.

Every word of the training text is a word of the model, known by its 64-bit hash
whose last 7 bits are its shape (case, digits, symbols, end mark, length). Words
the training text doesn't have are known by their shape alone: they share what
the word counts leave, as the words seen once share out over the shapes. A text
ends with an end mark, which is predicted like a word. Trusted documents are
those all of whose labels say quality 1. Half of them, by a hash of doc_id, train
the model; the other half, which it has not seen, sets the threshold of each
language: the QUANTILE of their bits per word. A document above its language's
threshold is rejected.

Every n-gram is kept. A position is a word w with the two before it, u and v; all positions
with the same v go to one shard, packed by batches of texts with a list of the words in
them. A first pass over the texts that train counts there: how many trigrams stand
once to four times, and each bigram's continuation count, from which Spark joins make
a table of bigrams with their last word's probability. Then all texts send their positions,
in PARTS rounds over ranges of shards, so that a round's scratch space is a part of the
whole. Positions of training texts say so, and the shard counts its trigrams
and contexts from them again: trigrams are never written. What v does not know of a
word, its probability alone, is a term of its own, which is added where the word is v.
So a text's score is a sum over shards; each shard answers a batch in one row, and
answers are summed by batch before they are told by text.

A word v with more than half a shard's positions is dealt over several shards by u, a pair u, v with
as many by w; the counts of such a pair are summed over its shards in the first pass. Which
they are is told by every SAMPLE-th text, and decides on nothing but the places of positions.

Cases: a null or empty text has no words, perplexity 1, and is kept; a language
with fewer than LEAST held-out documents, or null, takes the threshold of all of
them; with no held-out documents nothing is rejected; labels of unknown documents
are ignored; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext
from .common import discard, give_back, lean, saved, text_of

#: Words in a batch, which sends one row to a shard; positions in a shard, about; texts of which one is read to see what is frequent.
BATCH_WORDS, SHARD_WORDS, SAMPLE = 2_000_000, 1_200_000, 16
QUANTILE, LEAST = 0.99, 20
#: Places before a text's first word and after its last one; shapes of words.
START, END, SHAPES = 0, 128, 128
#: Rounds over ranges of shards; code points a word with its space has, about.
PARTS, WORD_CHARS = 4, 6
#: Tables with a row per word, language or trusted document are broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch from Spark to a task, about: a shard comes in several of them, as the JVM holds one and a copy outside its heap.
ARROW_BYTES = 2 << 20
#: What a discount is at least, so that every context leaves something to the lower order.
_LEAST_DISCOUNT = 0.1


# --- words ---------------------------------------------------------------------


def _flags() -> np.ndarray:
    """Per code point: 1 upper case, 2 digit, 4 symbol other than full stop and comma (or beyond the basic plane)."""
    out = np.full(0x110000, 4, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = c.isupper() | 2 * c.isdigit() | 4 * (not (c.isalnum() or c.isspace() or c in ".,"))
    return out


_kept: dict[str, np.ndarray] = {}


def shaped_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A batch's words (uint64 hashes, the last 7 bits their shapes) and each word's text index."""
    if "flags" not in _kept:
        _kept["flags"] = _flags()
    arr, ends = vectext.code_points(texts)
    word, text, start, size = vectext.words_of(arr, ends)
    if not len(word):
        return np.zeros(0, np.uint64), text
    flags = _kept["flags"][arr]
    any_ = np.bitwise_or.reduceat(flags, start)
    last = arr[start + size - 1]
    second = flags[np.minimum(start + 1, start + size - 1)]
    shape = (flags[start] & 1) | (second & 1) << 1 | (any_ & 6) << 1 | ((last == 46) | (last == 44)).astype(np.uint8) << 4
    shape = shape.astype(np.uint64) | (np.minimum((size - 1) // 4, 3) << 5).astype(np.uint64)
    return word.astype(np.uint64) & ~np.uint64(SHAPES - 1) | shape, text


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def gram_key(*words: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams, given as n columns of words: what Spark's xxhash64 gives for them, so that both sides of the join can make them."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    key = np.full(len(words[0]), 42, np.uint64)
    for w in words:
        key = (key + p[4] + np.uint64(8)) ^ _rotl(w.astype(np.uint64) * p[1], 31) * p[0]
        key = _rotl(key, 27) * p[0] + p[3]
        key = (key ^ key >> np.uint64(33)) * p[1]
        key = (key ^ key >> np.uint64(29)) * p[2]
        key ^= key >> np.uint64(32)
    return key


def ended(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end mark after each text that has words."""
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) if len(text) else np.zeros(0, int)
    return np.insert(words, last + 1, np.uint64(END)), np.insert(text, last + 1, text[last])


def _few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it is small; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


# --- training --------------------------------------------------------------------


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id and fold (0 trains, 1 is held out) of the documents all of whose labels are of quality 1."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    return good.select("doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit(1)).cast("int").alias("fold"))


def marked_texts(docs: DataFrame, mine: DataFrame) -> DataFrame:
    """hash, text and whether it trains."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("hash"), text_of().alias("text"))
    return rows.join(mine.select("doc_id", F.lit(True).alias("train")), "doc_id", "left").select("hash", "text", F.coalesce("train", F.lit(False)).alias("train"))


def discounts(of: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; half a count where those are missing."""
    n = [of.get(i, 0) for i in range(1, 5)]
    if not all(n):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], _LEAST_DISCOUNT), float(i)) for i in (1, 2, 3)]


def _less(c: Column, d: list[float]) -> Column:
    """What is taken off a count."""
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


# --- places ----------------------------------------------------------------------


@dataclass
class Layout:
    """How positions are dealt: words v (sorted) that have several shards, how many each, and keys of pairs (sorted) that are dealt by w too."""

    shards: int
    words: np.ndarray
    splits: np.ndarray
    pairs: np.ndarray

    def base_of(self, words: np.ndarray) -> np.ndarray:
        return ((gram_key(words) >> np.uint64(40)) % np.uint64(self.shards)).astype(np.int32)

    def reach(self, words: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether positions of v can be in shards low to high - 1."""
        base = self.base_of(words)
        return (low <= base) & (base < high) | ((low - base) % self.shards < self.splits_of(words))

    def of(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Shards of positions, given as places in words."""
        shard, splits = self.base_of(words)[v], self.splits_of(words)[v]
        hot = np.flatnonzero(splits > 1)
        key = gram_key(words[u[hot]], words[v[hot]])
        both = _places(self.pairs, key) >= 0
        key[both] = gram_key(*(words[x[hot[both]]] for x in (u, v, w)))
        shard[hot] = (shard[hot] + (key >> np.uint64(40)).astype(np.int64) % splits[hot]) % self.shards
        return shard

    def splits_of(self, words: np.ndarray) -> np.ndarray:
        at = _places(self.words, words)
        return np.where(at >= 0, np.r_[self.splits, 1][at], 1).astype(np.int32)

    def column(self, rows: DataFrame) -> DataFrame:
        """rows with each shard that positions of v can be in, given in how many they are as k."""
        rows = rows.withColumn("shard", F.shiftrightunsigned(F.xxhash64("v"), 40) % self.shards)
        if not len(self.words):
            return rows
        more = rows.where("k > 1").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        return rows.where("k = 1").unionByName(more.withColumn("shard", (F.col("shard") + F.col("_i")) % self.shards).drop("_i"))


def _places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where in known (sorted) each x is, or -1."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _distinct_words(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of all parts, sorted, and each word's place in them. There are far fewer than words, so they are found without sorting all."""
    coded = pa.chunked_array([pa.array(x) for x in parts], pa.uint64()).dictionary_encode().combine_chunks()
    known, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(known)
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    return known[order], rank[at]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, whose places take half the memory."""
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return key[new], at


def _positions(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, START first, and u, v and w of each position as places in them."""
    words, at = _distinct_words([np.array([START], np.uint64), words])
    w = at[1:]
    u, v = np.zeros_like(w), np.zeros_like(w)
    first = np.r_[True, text[1:] != text[:-1]][: len(text)]
    for x, before in ((v, w), (u, v)):
        x[1:] = before[:-1]
        x[first] = 0
    return words, u, v, w


def _batched(rows: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """words (ends marked), their texts, the texts' hashes and whether they train, of about BATCH_WORDS words."""
    held, size, many = [], 0, 0
    for rec in rows:
        hashes, texts, train = rec.column(0).to_numpy(), rec.column(1).to_pylist(), rec.column(2).to_numpy(zero_copy_only=False)
        for a, b in vectext.batches(texts):
            words, text = ended(*shaped_words(texts[a:b]))
            held.append((words, (text + many).astype(np.int32), hashes[a:b], train[a:b]))
            size, many = size + len(words), many + b - a
            if size > BATCH_WORDS:
                out, held, size, many = [np.concatenate(x) for x in zip(*held, strict=True)], [], 0, 0
                yield out
                del out
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def layout_of(texts: DataFrame, chars: int, parts: int, shard_words: int) -> Layout:
    """So many shards that each has about shard_words positions, a multiple of parts."""
    shards = parts * max(1, math.ceil(chars / WORD_CHARS / shard_words / parts))
    share = 0.5 / shards

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, text, *_ in _batched(rows):
            words, u, v, _ = _positions(words, text)
            many = np.bincount(v, minlength=len(words))
            own = np.flatnonzero(many >= share / 2 * len(v))
            hot = np.isin(v, own)
            pair, n = np.unique(gram_key(words[u[hot]], words[v[hot]]), return_counts=True)
            both = n >= share / 2 * len(v)
            kind = np.r_[0, np.full(len(own), 1), np.full(both.sum(), 2)]
            key = np.r_[np.uint64(0), words[own], pair[both]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(np.r_[len(v), many[own], n[both]])], ["kind", "key", "n"])

    some = texts.where(F.monotonically_increasing_id() % SAMPLE == 0).mapInArrow(run, "kind long, key long, n long")
    some = saved(some.groupBy("kind", "key").agg(F.sum("n").alias("n")), "frequent")
    total = some.where("kind = 0").agg(F.sum("n")).first()[0] or 1
    found = some.where(F.col("n") > share * total).where("kind > 0").collect()
    discard(some)
    of = lambda kind: np.array(sorted((r["key"], r["n"]) for r in found if r["kind"] == kind), np.int64).reshape(-1, 2)
    words, pairs = of(1), of(2)
    key = words[:, 0].copy().view(np.uint64)
    order = np.argsort(key)
    splits = np.minimum(np.ceil(words[order, 1] / total / share), shards).astype(np.int64)
    return Layout(shards, key[order], splits, np.sort(pairs[:, 0].copy().view(np.uint64)))


SENT = "shard long, batch long, n long, words binary, grams binary, places binary, train binary, hashes binary, sizes binary"


def sent_positions(texts: DataFrame, layout: Layout, low: int, high: int) -> DataFrame:
    """The positions of shards low to high - 1, a row a batch of texts and shard: its words, u, v and w as places in them, its text and whether that trains.

    One row of a batch also has the hashes of its texts and how many positions of the round each has.
    """

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, text, hashes, train = held
        held.clear()
        words, u, v, w = _positions(words, text)
        if high - low < layout.shards:
            near = layout.reach(words, low, high)[v]
            text, u, v, w = (x[near] for x in (text, u, v, w))
            del near
        shard = layout.of(words, u, v, w) - low
        at = np.flatnonzero((shard >= 0) & (shard < high - low)).astype(np.int32)
        shard = shard[at].astype(np.uint16 if high - low <= 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable").astype(np.int32)
        at, shard = at[order], shard[order]
        del order
        # equal batches have one number: their texts are the same, and count together
        batch = int(vectext.mix(hashes.view(np.uint64) + vectext.mix(np.arange(len(hashes)))).sum().view(np.int64)) if len(hashes) else 0
        sizes = np.bincount(text[at], minlength=len(hashes)).astype("<i8")
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
        for i, j in zip(cut, np.r_[cut[1:], len(shard)], strict=True):
            one = at[i:j]
            three = np.concatenate([u[one], v[one], w[one]])
            if len(three) * 32 > len(words):
                there = np.zeros(len(words), bool)
                there[three] = True
                own, three = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[three]
            else:
                own, three = np.unique(three, return_inverse=True)
            # a bit for each position and each step to the next text
            place = _rising_bytes(text[one] + np.arange(j - i))
            # the bytes of the words by their place, as the first ones of sorted words are nearly the same
            raw = [words[own].view(np.uint8).reshape(-1, 8).T, three.astype(_width(len(own))), np.packbits(train[text[one]])]
            raw = [x.tobytes() for x in raw]
            raw.insert(2, place)
            head = [hashes.tobytes(), sizes.tobytes()] if i == 0 else [None, None]
            yield pa.RecordBatch.from_arrays([*(pa.array([int(x)]) for x in (shard[i] + low, batch, j - i)), *(pa.array([x], pa.binary()) for x in (*raw, *head))], [f.split()[0] for f in SENT.split(", ")])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for held in _batched(rows):
            yield from packed(held)
            give_back()

    return texts.mapInArrow(run, SENT)


def _width(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _wide(raw: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(raw, _width(0) if len(raw) == 2 * n else "<u4")


def _rising_bytes(x: np.ndarray) -> bytes:
    """Rising numbers: a bit for each number up to the last, or the numbers themselves where that is shorter."""
    if int(x[-1]) // 8 + 1 < 2 * len(x):
        there = np.zeros(int(x[-1]) + 1, bool)
        there[x] = True
        return np.packbits(there).tobytes()
    return x.astype(_width(int(x[-1]) + 1)).tobytes()


def _rising(raw: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if len(raw) < 2 * n else _wide(raw, n)


class _Shard:
    """A shard's positions: words (distinct, sorted), u, v and w as places in them, train, text (numbered over the batches) and each row's first text; contexts u, v and trigrams, each once."""

    def __init__(self, sent: pa.Table, more: np.ndarray | None = None):
        many = sent.column("n").to_pylist()
        names = [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel() for x in sent.column("words")]
        self.words, at = _distinct_words(names if more is None else [*names, more])
        self.base = max(1, len(self.words))
        self.text, self.train, self.many = np.empty(sum(many), np.int32), np.empty(sum(many), np.uint8), [0]
        u, v, w = np.empty((3, sum(many)), np.int32)
        i = off = 0
        for n, own, grams, places, train in zip(many, map(len, names), *(sent.column(c) for c in ("grams", "places", "train")), strict=True):
            j = i + n
            u[i:j], v[i:j], w[i:j] = at[off : off + own][_wide(grams.as_buffer(), 3 * n).reshape(3, n)]
            self.text[i:j] = _rising(places.as_buffer(), n) - np.arange(n) + self.many[-1]
            self.train[i:j] = np.unpackbits(np.frombuffer(train.as_buffer(), np.uint8), count=n)
            self.many.append(int(self.text[j - 1]) + 1)
            i, off = j, off + own
        self.more = at[off:]
        del names, at
        key = u.astype(np.int64) * self.base
        del u
        key += v
        del v
        context, of = _distinct(key)
        self.u, self.v = ((x.astype(np.int32)) for x in np.divmod(context, self.base))
        del context
        np.multiply(of, self.base, out=key, dtype=np.int64)
        del of
        key += w
        del w
        gram, self.gram = _distinct(key)
        del key
        self.context, self.w = ((x.astype(np.int32)) for x in np.divmod(gram, self.base))
        self.count = np.bincount(self.gram, self.train, minlength=len(gram)).astype(np.int32)

    def sums(self) -> list[np.ndarray]:
        """By context: the sum of its counts, how many are 1, 2, and how many there are."""
        c = self.count
        return [np.bincount(self.context, x, minlength=len(self.u)) for x in (c, c == 1, c == 2, c > 0)]


def _counted(sent: pa.Table, layout: Layout) -> pa.Table:
    """kind, a, b, c: 0 trigrams that stand a = 1 to 4 times; k bigrams a, b with their continuation counts here, and each a with START and 0, where k shards count a's; -1 to -4 sums of the pairs that are dealt by w."""
    x = _Shard(sent)
    seen = x.count > 0
    bigram, n = np.unique(x.v[x.context[seen]].astype(np.int64) * x.base + x.w[seen], return_counts=True)
    v = x.words[bigram // x.base]
    v, w, n = np.r_[v, v[first := np.r_[True, v[1:] != v[:-1]][: len(v)]]], np.r_[x.words[bigram % x.base], np.full(first.sum(), START, np.uint64)], np.r_[n, np.zeros(first.sum(), n.dtype)]
    rows = [(0, np.arange(1, 5), np.zeros(4), np.bincount(np.minimum(x.count[seen], 5), minlength=6)[1:5]), (layout.splits_of(v), v.view(np.int64), w.view(np.int64), n)]
    at = _places(layout.pairs, gram_key(x.words[x.u], x.words[x.v]))
    rows += [(-1 - i, at[at >= 0], np.zeros((at >= 0).sum()), y[at >= 0]) for i, y in enumerate(x.sums())]
    kind = np.concatenate([np.broadcast_to(r[0], len(r[1])) for r in rows])
    return pa.table({"kind": kind.astype(np.int64)} | {k: np.concatenate([np.asarray(r[i], np.int64) for r in rows]) for i, k in ((1, "a"), (2, "b"), (3, "c"))})


@dataclass
class Model:
    """Discounts of trigrams and bigrams, sums of the pairs that are dealt by w, probabilities of unseen words by shape and of the end mark; bigrams: k, v, w, c and p1 of w, and p1 of v where w is START."""

    d3: list[float]
    d2: list[float]
    sums: np.ndarray
    unseen: np.ndarray
    end: float
    bigrams: DataFrame


def trained(texts: DataFrame, layout: Layout) -> Model:
    counted = sent_positions(texts, layout, 0, layout.shards).groupBy("shard").applyInArrow(lambda sent: lean(_counted, sent, layout), "kind long, a long, b long, c long")
    counted = saved(counted, "counts")
    few = counted.where("kind <= 0").groupBy("kind", "a").agg(F.sum("c").alias("c")).collect()
    d3 = discounts({r["a"]: r["c"] for r in few if r["kind"] == 0})
    sums = np.zeros((4, len(layout.pairs)))
    for r in few:
        if r["kind"] < 0:
            sums[-1 - r["kind"], r["a"]] = r["c"]
    two = counted.where("kind > 0").select(F.col("kind").alias("k"), F.col("a").alias("v"), F.col("b").alias("w"), "c")
    if len(layout.words):
        two = two.where("k = 1").unionByName(two.where("k > 1").groupBy("k", "v", "w").agg(F.sum("c").alias("c")))
    of = lambda rows: discounts({r["c"]: r["n"] for r in rows.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()})
    d2 = of(two)
    uni = saved(two.where(F.col("w") != START).groupBy("w").agg(F.count("*").alias("c")), "unigrams")
    d1 = of(uni)
    total, left = uni.agg(F.sum("c"), F.sum(_less(F.col("c"), d1))).first()
    once = np.ones(SHAPES)
    for r in uni.where("c = 1").groupBy(F.col("w").bitwiseAND(F.lit(SHAPES - 1)).alias("s")).agg(F.count("*").alias("n")).collect():
        once[r["s"]] += r["n"]
    unseen = (left / total if total else 1.0) * once / once.sum()
    p1 = uni.select("w", ((F.col("c") - _less(F.col("c"), d1)) / F.lit(float(total or 1))).cast("float").alias("p1"))
    end = p1.where(F.col("w") == END).first()
    # START has no probability, and its own row none either
    told = F.when(F.col("w") == START, F.col("v")).otherwise(F.col("w")).alias("of")
    rows = two.select("k", "v", "w", F.col("c").cast("int").alias("c"), told).join(_few(p1.withColumnRenamed("w", "of")), "of").select("k", "v", "w", "c", "p1")
    out = Model(d3, d2, sums, unseen, end["p1"] if end else float(unseen[END % SHAPES]), saved(rows, "bigrams"))
    discard(counted, uni)
    return out


# --- scoring ---------------------------------------------------------------------


def _back(d: list[float], total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share that a context leaves to the lower order; all, if it isn't known."""
    return np.where(total > 0, (n1 * d[0] + n2 * d[1] + (n - n1 - n2) * d[2]) / np.maximum(total, 1), 1.0)


def _off(c: np.ndarray, d: list[float]) -> np.ndarray:
    """A count without its discount."""
    return np.where(c > 0, c - np.array([0, *d])[np.minimum(c, 3)], 0.0)


ANSWER = "batch long, places binary, bits binary, hashes binary, sizes binary"


def _answered(sent: pa.Table, known: pa.Table, layout: Layout, model: tuple) -> pa.Table:
    """What the shard's positions add to the texts of each batch: a row for each that came."""
    d3, d2, pair_sums, unseen = model
    v, w, c, p1 = (known.column(k).to_numpy() for k in ("v", "w", "c", "p1"))
    x = _Shard(sent, np.r_[v, w].view(np.uint64))
    v, w = x.more[: len(v)].astype(np.int64), x.more[len(v) :]
    own = x.words[w] == START if len(w) else np.zeros(0, bool)
    alone = unseen[(x.words % np.uint64(SHAPES)).astype(np.int64)]
    alone[v[own]] = p1[own]
    alone[x.words == START] = 1.0  # it is not predicted
    v, w, c, p1 = (y[~own] for y in (v, w, c, p1))
    sums = [np.bincount(v, y, minlength=x.base) for y in (c, c == 1, c == 2, c > 0)]
    back2 = _back(d2, *sums)
    p2 = _off(c, d2) / sums[0][v] + back2[v] * p1
    key = v * x.base + w
    order = np.argsort(key)
    # by trigram: how many times p1 of its last word its probability is
    mid = x.v[x.context]
    at = _places(key[order], mid.astype(np.int64) * x.base + x.w)
    ratio, last = back2[mid], np.ones(len(mid), np.float32)
    if len(key):
        at = order[at[(hit := at >= 0)]]
        ratio[hit], last[hit] = p2[at] / p1[at], p1[at]
    del at, key, order, p2, p1, c, v, w, own, back2
    sums = x.sums()
    if len(layout.pairs):
        pair = _places(layout.pairs, gram_key(x.words[x.u], x.words[x.v]))
        for y, all_ in zip(sums, pair_sums, strict=True):
            y[pair >= 0] = all_[pair[pair >= 0]]
    ratio *= _back(d3, *sums)[x.context]
    bits = _off(x.count, d3)
    bits /= np.maximum(sums[0][x.context], 1)
    bits /= last
    bits += ratio
    np.log2(bits, out=bits)
    bits += np.log2(alone)[mid]
    del ratio, last, sums, alone, mid
    total, there = (np.bincount(x.text, y, minlength=x.many[-1]) for y in (bits[x.gram], None))
    rows = []
    for i, j in zip(x.many, x.many[1:]):
        place = np.flatnonzero(there[i:j])
        rows.append((_rising_bytes(place), total[i:j][place].astype("<f4").tobytes()))
    return pa.table([sent.column("batch"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), sent.column("hashes"), sent.column("sizes")], names=[f.split()[0] for f in ANSWER.split(", ")])


def _summed(answers: pa.Table) -> pa.Table:
    """hash, bits and n (positions) of a batch's texts, summed over its answers; equal batches count together."""
    heads = [(h, s) for h, s in zip(answers.column("hashes").to_pylist(), answers.column("sizes").to_pylist(), strict=True) if h is not None]
    hashes, n = np.frombuffer(heads[0][0], "<i8"), sum(np.frombuffer(s, "<i8") for _, s in heads)
    bits = np.zeros(len(hashes))
    for place, more in zip(answers.column("places").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        more = np.frombuffer(more, "<f4")
        bits[_rising(place, len(more))] += more
    return pa.table({"hash": hashes[n > 0], "bits": bits[n > 0], "n": n[n > 0]})


def score_texts(docs: DataFrame, labels: DataFrame, parts: int = PARTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, lang, hash, bits per word (the end mark counts as one) and number of words n of every document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    row = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64(text_of()).alias("hash"), F.length(text_of()).alias("size"))
    plain = saved(row, "plain")
    mine = saved(trusted_documents(labels).where("fold = 0").select("doc_id"), "trusted")
    texts = marked_texts(docs, _few(mine))
    layout = layout_of(docs.select(F.lit(0).cast("long"), text_of(), F.lit(False)), plain.agg(F.sum("size")).first()[0] or 0, parts, shard_words)
    model = trained(texts.where("train"), layout)
    small, sums = (model.d3, model.d2, model.sums, model.unseen), []
    for i in range(parts):
        low, high = (layout.shards * k // parts for k in (i, i + 1))
        known = layout.column(model.bigrams).where(F.col("shard").between(low, high - 1))
        got = sent_positions(texts, layout, low, high).groupBy("shard").cogroup(known.groupBy("shard"))
        per = got.applyInArrow(lambda sent, known: lean(_answered, sent, known, layout, small), ANSWER).groupBy("batch").applyInArrow(_summed, "hash long, bits double, n long")
        sums.append(saved(per, "sums"))
    more = _all(sums).groupBy("hash").agg(F.sum("bits").alias("more"), F.sum("n").alias("places"))
    # copies of a text are sent each, so their sums are shared out
    more = more.join(plain.groupBy("hash").agg(F.count("*").alias("copies")), "hash")
    more = more.select("hash", (F.col("places") / F.col("copies")).cast("long").alias("places"), (F.col("more") / F.col("copies")).alias("more"))
    total = -(F.col("more") + F.lit(math.log2(model.end)))
    out = plain.join(more, "hash", "left").select("doc_id", "lang", "hash", (F.coalesce("places", F.lit(1)) - 1).alias("n"), F.coalesce(total / F.col("places"), F.lit(0.0)).alias("bits"))
    out = saved(out, "scores")
    discard(plain, mine, model.bigrams, *sums)
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def thresholds(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, float]:
    """lang and line (bits per word) of the languages with enough held-out documents, and the line of all others."""
    held = scores.where("n > 0").join(_few(trusted_documents(labels).where("fold = 1").select("doc_id")), "doc_id", "left_semi")
    at = F.percentile_approx("bits", quantile, 10000).alias("line")
    per = saved(held.where("lang is not null").groupBy("lang").agg(at, F.count("*").alias("held")).where(F.col("held") >= LEAST).select("lang", "line"), "lines")
    whole = held.agg(at).first()["line"]
    return per, math.inf if whole is None else whole


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **how) -> DataFrame:
    """doc_id, lang, hash, n, bits and line of every document."""
    scores = score_texts(docs, labels, **how)
    per, other = thresholds(scores, labels, quantile)
    return scores.join(_few(per), "lang", "left").withColumn("line", F.coalesce("line", F.lit(other)))


def score_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold (as a perplexity) and kept of every document."""
    rows = judged(docs, labels, **how)
    power = lambda c: F.pow(F.lit(2.0), F.col(c))
    return rows.select("doc_id", "lang", F.col("n").alias("n_words"), power("bits").alias("perplexity"), power("line").alias("threshold"), (F.col("bits") <= F.col("line")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with all their columns. A score depends on text and language alone, so rejected ones are told by these."""
    lang = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    bad = judged(docs, labels, **how).where("bits > line").select(F.col("hash").alias("_hash"), lang(F.col("lang")).alias("_lang"), F.isnull("lang").alias("_none")).distinct()
    bad = _few(saved(bad, "rejected"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(text_of()).alias("_hash"), lang(F.col("lang")).alias("_lang"), F.isnull("lang").alias("_none"))
    return rows.join(bad, ["_hash", "_lang", "_none"], "left_anti").select("_row.*")
