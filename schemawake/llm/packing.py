"""Operator 10, best-fit packing of documents into sequences of at most CAPACITY tokens.

Longer documents are cut so that every piece but the first is full; full pieces
are sequences of their own. The other pieces are dealt into groups of about
GROUP, each packed by one task: best-fit decreasing first, then local search.
The search takes the emptiest bin and tries, with the other underfull bins, to
move a piece out of it, to exchange one of its pieces for a smaller one, or to
exchange one for two or two for one of smaller sum, whenever that raises the sum
of the squared fills; an emptied bin is dropped. Pieces of bins that stay
underfull are dealt anew and packed across groups; a group keeps its old bins if
the new ones are not fewer.

With `ordered`, groups are runs of GROUP consecutive documents in the order of
docs (of its files, where it is read from files), and sequences are numbered by
run: the sequences of the first r runs hold the first r * GROUP documents, but for
bins that stayed underfull, which are packed with those of up to a few runs after
theirs and numbered with the first of these runs.

Cases: a null text is an empty one (one piece, the end id alone); repeated rows
are packed each; an empty table gives no pieces; a null doc_id stays null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import saved, text_of

CAPACITY = 1024
END_ID = 2
#: Pieces in a group, and the fill below which a bin is opened again in the second round.
GROUP = 2000
LOOSE = 0.99
#: Bits of a sequence's number below its run: one tells the second round, the rest number bins, or full pieces by document and piece.
RUN_BITS, PIECE_BITS = 36, 21


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the bin it fills best. A bit mask of the free spaces in use finds that bin."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = mask >> sizes[i]
        if fits:
            space = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_space[space - sizes[i]].append(b)
        mask |= 1 << (space - sizes[i])
    return bins


def _exchange(big: list[int], small: list[int], sizes: list[int], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """Of all moves and exchanges between a fuller bin with `room` left and an emptier one, the one that fills it most: (pieces out of big, pieces out of small)."""
    best, gain = None, 0
    ins = [((), 0)] + [((x,), sizes[x]) for x in big] + [((x, y), sizes[x] + sizes[y]) for i, x in enumerate(big) for y in big[:i]]
    outs = [((x,), sizes[x]) for x in small] + [((x, y), sizes[x] + sizes[y]) for i, x in enumerate(small) for y in small[:i]]
    for a, size_a in ins:
        for b, size_b in outs:
            if len(a) + len(b) <= 3 and gain < size_b - size_a <= room:
                best, gain = (a, b), size_b - size_a
                if gain == room:
                    return best
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Drain the emptiest bins into the other underfull ones; every step raises the sum of squared fills, so it ends."""
    fill = {i: sum(sizes[x] for x in b) for i, b in enumerate(bins)}
    open_ = sorted((i for i in fill if fill[i] < capacity), key=lambda i: (fill[i], i))
    while len(open_) > 1:
        b = open_.pop(0)
        for a in sorted(open_, key=lambda i: (-fill[i], i)):
            while bins[b] and fill[a] < capacity and fill[a] >= fill[b] and (step := _exchange(bins[a], bins[b], sizes, capacity - fill[a])):
                out_a, out_b = step
                moved = sum(sizes[x] for x in out_b) - sum(sizes[x] for x in out_a)
                bins[a] = [x for x in bins[a] if x not in out_a] + list(out_b)
                bins[b] = [x for x in bins[b] if x not in out_b] + list(out_a)
                fill[a] += moved
                fill[b] -= moved
            if not bins[b]:
                break
        open_ = [i for i in open_ if fill[i] < capacity]
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into sizes."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, a number that deals pieces out evenly, and the document's file (or partition) and row in it."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "file", "row"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in parts:
            texts = part.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(enc.ids(texts[a : a + 500])):
                    raw = np.append(ids, np.uint16(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    at = 0
                    for k, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        row.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(raw[4 * at : 4 * stop]))
                        at = stop
                deal = np.arange(len(row), dtype=np.int64) * 7919 + zlib.crc32(str(crc[:1]).encode())
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal), part.column(2).take(row), part.column(3).take(row)], columns
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text"), *_place(docs)).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long, file string, row long")


def _place(docs: DataFrame) -> list:
    """Columns file and row: where a document stands in docs. Rows read from files are in the order of the writer's partitions, whichever task reads them."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return [F.format_string("part-%010d", F.shiftright(at, 33)).alias("file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")]
    return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]


def _ranked(cut: DataFrame) -> DataFrame:
    """Pieces with their documents' rank in the order of docs; one row per file is numbered in one task."""
    files = cut.groupBy("file").agg((F.max("row") + 1).alias("n"))
    number = F.expr("coalesce(try_cast(regexp_extract(file, '^part-([0-9]+)', 1) as long), 0)")
    before = F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(files.select("file", before.alias("before"))), "file").withColumn("rank", F.col("before") + F.col("row")).drop("before", "file", "row")


def _packed(capacity: int, round_: int):
    """Packs one group; bin: the bin of the round before, or null."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_pylist()
        old = table["sequence_id"].to_pylist()
        bins = pack(sizes, capacity)
        if round_ and len(bins) >= len(set(old)):
            by: dict[int, list[int]] = {}
            for i in np.lexsort((table["offset"].to_numpy(), table["sequence_id"].to_numpy())).tolist():
                by.setdefault(old[i], []).append(i)
            bins = list(by.values())
        seq, offset, free = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        group = table["group"][0].as_py()
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], offset[i] = (2 * group + round_) << (RUN_BITS - 1) | k, at
                at += sizes[i]
            free[b] = capacity - at
        kept = table.drop_columns(["sequence_id", "offset", "free", "group"])
        for name, x in (("sequence_id", seq), ("offset", offset), ("free", free)):
            kept = kept.append_column(name, pa.array(x))
        return kept

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, ordered: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    cut = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    cut = _ranked(cut) if ordered else cut.drop("file", "row").withColumn("rank", F.lit(None).cast("long"))
    run = F.floor(F.col("rank") / group).cast("long")
    number = F.shiftleft(run, RUN_BITS).bitwiseOR(F.shiftleft(F.col("rank") % group + 1, PIECE_BITS)).bitwiseOR(F.col("piece").cast("long"))
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", number if ordered else -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long, rank long, sequence_id long, offset long, free long"

    def dealt(df: DataFrame, key) -> DataFrame:
        n = max(1, math.ceil(df.count() / group))
        return df.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(n)))

    none = F.lit(None).cast("long")
    # all pieces of a document but the first are full, so a run has at most `group` pieces to pack
    first = rest.withColumn("group", run) if ordered else dealt(rest, ["doc_id", "deal", "ids_crc32"])
    first = first.withColumns({"sequence_id": none, "offset": none, "free": none})
    first = saved(first.groupBy("group").applyInArrow(_packed(capacity, 0), schema), "packed")
    loose = F.col("free") > (1 - LOOSE) * capacity
    second = first.where(loose)
    if ordered:
        runs = max(1, first.count() // max(1, second.count()))
        second = second.withColumn("group", run - run % runs)
    else:
        second = dealt(second, ["sequence_id"])
    second = second.groupBy("group").applyInArrow(_packed(capacity, 1), schema)
    return full.select(out).unionByName(first.where(~loose).select(out)).unionByName(second.select(out))
