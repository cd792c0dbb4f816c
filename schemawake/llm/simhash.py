"""Operator 7, document fingerprints: SimHash and search within a Hamming radius.

A text's terms are its pairs of neighbouring words (its one word, if it has only
one). Each distinct term votes with the bits of its 64-bit hash, for 1 and
against 0, with weight 1 + log2(occurrences); the sign of each sum is the
fingerprint's bit, a sum of zero gives 0. Likeness of two fingerprints is the
share of equal bits.

Search: the 64 bits are cut into BLOCKS blocks. Two fingerprints within RADIUS
bits agree on at least BLOCKS - RADIUS whole blocks, so one table per choice of
that many blocks, keyed by their bits, finds every such pair; each pair counts
only in the first table that holds it.

Cases: a null text is an empty one, whose fingerprint is all zeros; equal texts
have equal fingerprints; documents are in order of doc_id, nulls first, then
a hash of the text; the last one's next is the first (itself, if it is the only one); an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext
from .common import in_ranges, map_texts, saved, text_of

BITS, BLOCKS, RADIUS = 64, 6, 3
_ROWS = 1 << 17


def fingerprints(texts: list[str]) -> np.ndarray:
    """One uint64 per text."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in vectext.batches(texts):
        out[a:b] = _fingerprints(texts[a:b])
    return out


def _fingerprints(texts: list[str]) -> np.ndarray:
    word, text, _, _ = vectext.words(texts)
    term, text = vectext.shingles(word, text, 2)
    votes = np.zeros((len(texts), BITS), np.float32)
    if len(term):
        order = np.lexsort((term, text))
        term, text = term[order], text[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (text[1:] != text[:-1])])
        weight = 1 + np.log2(np.diff(np.r_[first, len(term)])).astype(np.float32)
        term, text = term[first], text[first]
        for a in range(0, len(term), _ROWS):
            t, d = term[a : a + _ROWS], text[a : a + _ROWS]
            signs = np.unpackbits(t.astype(">u8").view(np.uint8)).reshape(-1, BITS).astype(np.float32) * 2 - 1
            signs *= weight[a : a + _ROWS, None]
            at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            votes[d[at]] += np.add.reduceat(signs, at, axis=0)
    return np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / BITS


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Two more columns on the first and the last document of a range, whose neighbour is in another one.
_ENDS = "range int, head string, tail string"


def _measured(rows: list[tuple]) -> list[pa.Array]:
    """The columns of documents given as (doc_id, text, next text)."""
    keys, texts, follows = zip(*rows, strict=True)
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, follows, strict=True)]
    own, other = fingerprints(list(texts)), fingerprints(edited)
    after = np.empty_like(own)
    after[:-1] = own[1:]
    apart = [i for i in range(len(rows)) if i == len(rows) - 1 or follows[i] is not texts[i + 1]]
    after[apart] = fingerprints([follows[i] for i in apart])
    return [
        pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([f"{x:016x}" for x in own.tolist()]), pa.array([f"{x:016x}" for x in other.tolist()]), pa.array(likeness(own, other)), pa.array(likeness(own, after)),
    ]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in order. A document is finished when the next one has come; the range's last one goes on as it is, with the range's first text."""
    held: list[tuple] = []
    chars, last, head = 0, None, None
    names = _names(f"{SCHEMA}, {_ENDS}")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([*_measured(rows), *none], names)

    for part in parts:
        for k, t in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
            if last is None:
                head = t
            else:
                held.append((*last, t))
                chars += len(last[1])
                if chars >= vectext.BATCH_CHARS:
                    yield flush(held)
                    held, chars = [], 0
            last = (k, t)
    if held:
        yield flush(held)
    if last:
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *blank, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([head]), pa.array([last[1]])], names)


def _finished(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last documents of ranges, with the first text of the range that follows."""
    for part in parts:
        for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays(_measured([row]), _names(SCHEMA))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last quarter taken from the next document's start), and how alike they and the next document's are.

    Documents are sorted in ranges; what a range's last one needs from the next range is brought to it by a second, small pass.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = in_ranges(rows, docs.count(), [F.asc_nulls_first("doc_id"), F.asc("h")], "text").select("doc_id", "text")
    out = saved(dealt.mapInArrow(_compared, f"{SCHEMA}, {_ENDS}"), "fingerprints")
    ends = out.where("range is not null").select("range", "doc_id", "head", "tail")
    # a number for each range, so one task finds what follows them; the last is followed by the first
    ring = ends.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.orderBy("range"))).alias("next"))
    then = ring.join(ends.select(F.col("range").alias("next"), F.col("head").alias("after")), "next")
    last = ends.join(then, "range").select("doc_id", "tail", "after").mapInArrow(_finished, SCHEMA)
    return out.where("range is null").select(*_names(SCHEMA)).unionByName(last)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long): one pass, no shuffle."""
    return map_texts(docs, ["doc_id"], lambda texts: {"fingerprint": fingerprints(texts).view(np.int64)}, "fingerprint long")


def _masks(blocks: int, radius: int) -> list[int]:
    cut = [round(i * BITS / blocks) for i in range(blocks + 1)]
    mask = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    return [sum(mask[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(df: DataFrame, col: str, masks: list[int]) -> DataFrame:
    """A row per fingerprint and table, with the bits that key it."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(col).bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    return df.select("*", F.explode(keys).alias("k")).select(*df.columns, "k.t", "k.bits")


def within_radius(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Both have a long column fingerprint. query, found and distance of every pair of distinct fingerprints within the radius.

    Work is done on distinct fingerprints, so copies cost nothing; join back on the fingerprint for documents.
    """
    masks = _masks(blocks, radius)
    q = _tables(queries.select(F.col("fingerprint").alias("query")).distinct(), "query", masks)
    t = _tables(table.select(F.col("fingerprint").alias("found")).distinct(), "found", masks)
    x: Column = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(True)
    for i, m in enumerate(masks):
        first = first & ((F.col("t") <= i) | (x.bitwiseAND(F.lit(_signed(m))) != 0))
    # sorted rather than broadcast: a side's rows are many times its fingerprints
    hits = q.hint("merge").join(t, ["t", "bits"]).where((F.col("query") != F.col("found")) & (F.bit_count(x) <= radius) & first)
    return hits.select("query", "found", F.bit_count(x).cast("int").alias("distance"))


def search_counts(compared: DataFrame, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """`edited_fingerprints` with n_within: for the query documents (doc_id divisible by `every`), how many documents with another fingerprint lie within the radius; null for the rest."""
    rows = saved(compared, "compared").withColumn("fp", F.conv("fingerprint", 16, -10).cast("long"))
    per = rows.groupBy(F.col("fp").alias("fingerprint")).agg(F.count("*").alias("n"))
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    asked = rows.where(is_query)
    hits = within_radius(asked.select(F.col("fp").alias("fingerprint")), per, radius).join(per.withColumnRenamed("fingerprint", "found"), "found").groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("n_within"))
    told = asked.join(hits, "fp", "left").withColumn("n_within", F.coalesce("n_within", F.lit(0)).cast("long"))
    return told.unionByName(rows.where(~is_query).withColumn("n_within", F.lit(None).cast("long"))).drop("fp")
