"""Operator 11, ranked lexical search by bit-sliced Bloom signatures.

build_index() writes the documents as one table of blocks, in one pass and without a shuffle. A block holds documents of a task with
like numbers of distinct terms, at most BLOCK_DOCS and about BLOCK_CHARS characters (a longer text is a block of its own), and

* a matrix of bits, a row of documents for every slice: each term sets PROBES bits of its documents' columns, and so does
  each of its levels (the term occurs twice or more, four times or more, ...), so a slice tells of all documents of the block at once;
  the number of slices is SLICES_A_KEY times the most keys a document of the block has;
* the numbers of terms n of its documents, their ids, texts, and how many documents hold each of its terms.

search() first sums up N, L and the document frequencies of the terms asked for, then reads the blocks once more.
The slices of a term and level are intersected; as false presence is all that a Bloom signature can err by, the highest level
found bounds tf from above, and the weights times the saturation of that bound, summed over an item's terms, bound its score.
Each task keeps the best scores so far; in every block the best bounds are rescored exactly from the texts first, then all documents whose
bound is not below the score that is then the last of the `top` best. What is left out is proven not to be among the best, so
no result depends on the signatures' size. The best of all tasks are ranked by a grouped limit.

Scores: a term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), in doubles, and the rest 64-bit integers rounding down, see
`Ranking`. Terms are told apart by 64-bit hashes (of the terms asked for, a few thousand, none has met another so far).

Cases: null texts and texts without a term have no score and are not counted; an item without a term, or whose terms no document
holds, gives no rows; null or repeated document ids are rows of their own each; a repeated item counts once, two texts under one
item id get a list each; equal scores are ordered by doc_id, nulls first; of equal texts in one block only the `top` least ids can be among
the best and only they are indexed, all are counted; empty tables give no rows; other columns are not looked at.
Items are taken in blocks of about ITEMS and in these in groups of TERMS distinct terms at most, each with a pass of its own, so what is
sent to the driver and the tasks is bounded; one item of more terms is a group by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext
from .common import discard, saved

BLOCK_DOCS, BLOCK_CHARS = 512, 2_000_000
PROBES, SLICES_A_KEY, LEVELS = 3, 8, 6
#: Items in a block, about, and distinct terms of a group of items.
ITEMS, TERMS = 2048, 20_000
#: Cells of the arrays that one step works on.
_CELLS = 2_000_000

_INDEX = "n_docs int, n_held int, n_terms long, doc_id array<long>, n array<long>, texts array<string>, slices int, width int, bits binary, terms binary, holders binary"


def terms_of(arr: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term: longest runs of ASCII letters and digits and of whatever is not ASCII, A-Z in lower case."""
    if not len(arr):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    big = (arr >= 65) & (arr <= 90)
    ink = big | (arr >= 48) & (arr <= 57) | (arr >= 97) & (arr <= 122) | (arr >= 128)
    first = np.zeros(len(arr) + 1, bool)
    first[ends] = True
    start = ink & (first[:-1] | ~np.r_[False, ink[:-1]])
    stop = ink & (first[1:] | ~np.r_[ink[1:], False])
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return vectext.span_hashes(np.where(big, arr + 32, arr), start, stop), np.searchsorted(ends, start, "right") - 1


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term hash and tf of every term of every text, ordered by text and hash."""
    hashes, text = terms_of(*vectext.code_points(texts))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])][: len(hashes)])
    return text[new], hashes[new], np.diff(np.r_[new, len(hashes)])


def _probes(keys: np.ndarray, slices: int) -> np.ndarray:
    """(keys, PROBES) slice numbers."""
    low, step = keys.astype(np.uint64), vectext.mix(keys) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(slices) for i in range(PROBES)], 1).astype(np.int64)


def _at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    """The keys that say: tf is 2 ** level or more."""
    return hashes if not level else vectext.mix(hashes + np.uint64(level))


def _block(ids: list, texts: list[str], held: np.ndarray, counts: list[np.ndarray], n: np.ndarray) -> dict:
    """One row of the index. counts: text number, hash and tf; held: the texts that may be found, the others are only counted."""
    text, hashes, tf = counts
    uniq, at = np.unique(hashes, return_inverse=True)
    place = np.full(len(texts), -1, np.int64)
    place[held] = np.arange(len(held))
    sure = place[text] >= 0
    text, hashes, tf = place[text[sure]], hashes[sure], tf[sure]
    keys, cols = [hashes], [text]
    for level in range(1, LEVELS + 1):
        more = tf >= 1 << level
        keys.append(_at_level(hashes[more], level))
        cols.append(text[more])
    keys, cols = np.concatenate(keys), np.concatenate(cols)
    width = (len(held) + 7) // 8
    slices = SLICES_A_KEY * int(np.bincount(cols, minlength=1).max(initial=1)) + 1
    bits = np.zeros((slices, width * 8), bool)
    bits[_probes(keys, slices), cols[:, None]] = True
    return {
        "n_docs": int((n > 0).sum()), "n_held": len(held), "n_terms": int(n.sum()), "doc_id": [ids[i] for i in held], "n": n[held].tolist(), "texts": [texts[i] for i in held],
        "slices": slices, "width": width, "bits": np.packbits(bits, axis=1, bitorder="little").tobytes(), "terms": uniq.tobytes(), "holders": np.bincount(at, minlength=len(uniq)).astype("<i8").tobytes(),
    }


def _blocks(ids: list, texts: list[str], top: int) -> Iterator[dict]:
    """The blocks of a batch of documents."""
    text, hashes, tf = counted(texts)
    n = np.bincount(text, tf, len(texts)).astype(np.int64)
    distinct = np.bincount(text, minlength=len(texts))
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    # by number of distinct terms, so that a block's slices suit all its documents; equal texts are neighbours, least ids first
    order = sorted(np.flatnonzero(n).tolist(), key=lambda i: (distinct[i], texts[i], (ids[i] is not None, ids[i] or 0)))
    a = 0
    while a < len(order):
        z, size = a, 0
        while z < len(order) and z - a < BLOCK_DOCS and (z == a or size + len(texts[order[z]]) <= BLOCK_CHARS and distinct[order[z]] <= 2 * distinct[order[a]]):
            size += len(texts[order[z]])
            z += 1
        part = order[a:z]
        run, held = 0, []
        for k, i in enumerate(part):
            run = run + 1 if k and texts[part[k - 1]] == texts[i] else 0
            if run < top:
                held.append(k)
        spans = [slice(bounds[i], bounds[i + 1]) for i in part]
        counts = [np.repeat(np.arange(len(part)), [s.stop - s.start for s in spans]), *(np.concatenate([x[s] for s in spans]) for x in (hashes, tf))]
        yield _block([ids[i] for i in part], [texts[i] for i in part], np.array(held), counts, n[part])
        a = z


def build_index(docs: DataFrame, top: int = 20) -> DataFrame:
    """The table of blocks of docs (doc_id, text), written to the shared folder; serves lists of up to `top` documents."""
    schema = pa.schema([("n_docs", pa.int32()), ("n_held", pa.int32()), ("n_terms", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("slices", pa.int32()), ("width", pa.int32()), ("bits", pa.binary()), ("terms", pa.binary()), ("holders", pa.binary())])

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            for row in _blocks(ids, texts, top):
                yield pa.RecordBatch.from_pylist([row], schema)

        for part in parts:
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if t:
                    # batches of a few blocks' size, whatever the sizes of the texts
                    if texts and (size + len(t) > 4 * BLOCK_CHARS or len(texts) >= 8 * BLOCK_DOCS):
                        yield from cut()
                        ids, texts, size = [], [], 0
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
        yield from cut()

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _INDEX), "lexical-index")


class Ranking:
    """The statistics of a search and its items, as arrays: what every task needs."""

    def __init__(self, items: list[np.ndarray], terms: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.terms, self.n_docs, self.n_terms = terms, n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.counts = np.array([len(x) for x in items], np.int64)
        self.flat = np.searchsorted(terms, np.concatenate(items)) if items else np.zeros(0, np.int64)

    def saturation(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of tf occurrences in documents of n terms; grows with tf."""
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def sums(self, parts: np.ndarray) -> np.ndarray:
        """(items, documents) sums of (terms, documents) parts over every item's terms, repeats included."""
        out = np.zeros((len(self.counts), parts.shape[1]), np.int64)
        step, stops = max(1, _CELLS // max(1, parts.shape[1])), np.cumsum(self.counts)
        a = 0
        while a < len(self.counts):
            z = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + step, "right")))
            lo, hi = int(stops[a] - self.counts[a]), int(stops[z - 1])
            if hi > lo:
                full = np.flatnonzero(self.counts[a:z]) + a
                out[full] = np.add.reduceat(parts[self.flat[lo:hi]], (stops - self.counts)[full] - lo, axis=0)
            a = z
        return out

    def bounds(self, slices: int, width: int, bits: bytes, n: np.ndarray) -> np.ndarray:
        """(items, documents) upper bounds of the scores of a block's documents, from its slices alone."""
        matrix = np.frombuffer(bits, np.uint8).reshape(slices, width)
        parts = np.zeros((len(self.terms), len(n)), np.int64)
        rows = np.arange(len(self.terms))
        there = np.bitwise_and.reduce(matrix[_probes(self.terms, slices)], axis=1)
        for level in range(LEVELS + 1):
            live = there.any(1)
            rows, there = rows[live], there[live]
            if not len(rows):
                break
            at, col = np.nonzero(np.unpackbits(there, axis=1, bitorder="little")[:, : len(n)])
            most = np.minimum(n, (2 << level) - 1) if level < LEVELS else n  # not found at the next level: tf is below it
            parts[rows[at], col] = self.weight[rows[at]] * self.saturation(most, n)[col]
            if level < LEVELS:
                there = there & np.bitwise_and.reduce(matrix[_probes(_at_level(self.terms[rows], level + 1), slices)], axis=1)
        return self.sums(parts)

    def scores(self, texts: list[str], n: np.ndarray) -> np.ndarray:
        """(items, documents) exact scores."""
        text, hashes, tf = counted(texts)
        spot = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[spot] == hashes
        text, spot, tf = text[hit], spot[hit], tf[hit].astype(np.int64)
        parts = np.zeros((len(self.terms), len(texts)), np.int64)
        parts[spot, text] = self.weight[spot] * self.saturation(tf, n[text])
        return self.sums(parts)


class Best:
    """The `top` best (item, document) pairs of a task so far, and how many documents it rescored."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.rescored = top, 0
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = np.ones(items, np.int64)  # a score below it can't be among the best

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.r_[self.item, item], np.r_[self.score, score], np.r_[self.doc, doc]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.top - 1
        self.last[item[full]] = score[full]
        keep = place < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]

    def block(self, ranking: Ranking, row: dict) -> None:
        n = np.array(row["n"], np.int64)
        bound = ranking.bounds(row["slices"], row["width"], row["bits"], n)
        ids = np.array([np.iinfo(np.int64).min if i is None else i for i in row["doc_id"]], np.int64)
        todo = np.ones(len(n), bool)
        # the documents of the best bounds first; they raise the scores that the others are held against
        few = min(self.top, len(n))
        ahead = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        lead = np.take_along_axis(bound, ahead, 1) >= self.last[:, None]
        first = np.unique(ahead[lead])
        for docs in (first, None):
            if docs is None:
                docs = np.flatnonzero(todo & (bound >= self.last[:, None]).any(0))
            todo[docs] = False
            if len(docs):
                exact = ranking.scores([row["texts"][i] for i in docs], n[docs])
                self.rescored += len(docs)
                item, col = np.nonzero(exact >= self.last[:, None])
                self.add(item, exact[item, col], ids[docs[col]])


def _groups(items: list[tuple]) -> Iterator[list[tuple]]:
    part, seen = [], set()
    for row in items:
        new = seen | set(row[1].tolist())
        if part and len(new) > TERMS:
            yield part
            part, new = [], set(row[1].tolist())
        part.append(row)
        seen = new
    if part:
        yield part


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of the (sorted) terms."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for part in parts:
            for t, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own, held = np.frombuffer(t, np.uint64), np.frombuffer(h, "<i8")
                spot = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
                total += np.where(own[spot] == terms, held[spot], 0) if len(own) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "df"])

    df = np.zeros(len(terms), np.int64)
    found = index.select("terms", "holders").mapInArrow(each, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for part in found.toArrow().to_batches():  # a row for each term asked for at most
        df[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return df


def _search_group(index: DataFrame, group: list[tuple], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """number (the item's), doc_id, score and rescored (documents rescored by the task, at its first row) of the tasks' best."""
    terms = np.unique(np.concatenate([t for _, t in group]))
    ranking = Ranking([t for _, t in group], terms, _frequencies(index, terms), n_docs, n_terms)
    numbers = np.array([k for k, _ in group], np.int64)
    spark = index.sparkSession

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(numbers), top)
        for part in parts:
            for i in range(part.num_rows):
                best.block(ranking, part.slice(i, 1).to_pylist()[0])
        doc = pa.array(best.doc, pa.int64(), mask=best.doc == np.iinfo(np.int64).min)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.item]), doc, pa.array(best.score), pa.array(np.r_[best.rescored, np.zeros(max(len(best.item) - 1, 0), np.int64)][: len(best.item)])], ["number", "doc_id", "score", "rescored"])

    was = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    try:  # blocks are a few MB each; the job runs while these hold
        for k in was:
            spark.conf.set(k, 8)
        return saved(index.select("doc_id", "n", "texts", "slices", "width", "bits").mapInArrow(each, "number long, doc_id long, score long, rescored long"), "lexical-best")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and the hashes of its terms, with repeats, of the distinct items that have one; block deals them into parts of about ITEMS."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, text = terms_of(*vectext.code_points(part.column(1).to_pylist()))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["item_id", "terms"])

    out = saved(rows.mapInArrow(each, f"item_id {kind}, terms array<long>").where("size(terms) > 0"), "lexical-items")
    return out.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(1, math.ceil(out.count() / ITEMS)))))


def search(index: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `top` best documents of an index built for lists of `top` or more. items: item_id, text."""
    spark: SparkSession = index.sparkSession
    kind, asked = items.schema["item_id"].dataType.simpleString(), item_terms(items)
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = None
    for block in sorted(r[0] for r in asked.select("block").distinct().collect()) if total[0] else ():
        rows = asked.where(F.col("block") == block).orderBy("item_id", "terms").toArrow()
        ids, own = rows["item_id"].to_pylist(), [np.array(x, np.int64).view(np.uint64) for x in rows["terms"].to_pylist()]
        for group in _groups(list(enumerate(own))):
            names = spark.createDataFrame([(k, ids[k]) for k, _ in group], f"number long, item_id {kind}")
            part = _search_group(index, group, total[0], total[1], top).withColumn("block", F.lit(block)).join(F.broadcast(names), "number")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best = Window.partitionBy("block", "number").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """search() over an index of docs that is built for it and deleted afterwards."""
    index = build_index(docs, top)
    found = search(index, items, top)  # its jobs over the index have run
    discard(index)
    return found
