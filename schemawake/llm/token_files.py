"""Operator 5, token ids as binary files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the corpus (rank 0: the most frequent), so
most take one byte. The code keeps control bytes apart from data: a control byte
holds four 2-bit lengths (1 to 4 bytes less one), the data bytes follow
little-endian. Decoding looks a control byte up in a table of its four lengths
and gathers all values of a block with numpy.

File format: a Parquet dataset `<name>-<id>` of binary blocks, so that any store
Spark reaches can hold it. Columns: chunk, block, tokens_before (in the chunk),
n_docs, n_tokens, ids (doc ids, 8 bytes each, little-endian), nulls (one byte a
document: is its id null?), lens (tokens per document, 4 bytes each), control,
data. A chunk is a range of documents that one task writes: chunks ascend by
doc_id, blocks within a chunk too, and there are as many as the documents need.
The rank table is a second dataset of rows (rank, id).

The texts are encoded once, into a scratch table of 2-byte ids that also carries
each task's token counts; ranking reads only those counts.

Cases: a null text is an empty one (its ids are the end id alone); a null
doc_id comes before all others; equal doc_ids are ordered by length, then by their ids'
bytes, and many of them go to several chunks; an empty table makes no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import discard, in_ranges, saved, text_of

#: A block ends with the document that reaches this many tokens.
BLOCK_TOKENS = 1 << 18
END_ID = 2
_LENS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.int64) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values; the last control byte is padded with zero lengths that have no data."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values back as uint32."""
    size = _LENS[np.frombuffer(control, np.uint8)].ravel()[:n]
    end = np.cumsum(size)
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = end - size
    out = d[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, d[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass
class TokenFiles:
    blocks: DataFrame
    ranks: DataFrame


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (2-byte) of every document; per task one more row, of its token counts as 8-byte (id, count) pairs."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u2").tobytes()
        counts = np.zeros(1 << 16, np.int64)
        for part in parts:
            texts = part.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                ids = enc.ids(texts[a : a + 500])
                counts += np.bincount(np.concatenate(ids), minlength=1 << 16)
                counts[end_id] += len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, len(ids)), pa.array([x.astype("<u2").tobytes() + end for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], schema=schema)
        used = np.flatnonzero(counts)
        pairs = np.stack([used, counts[used]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def _pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for raw in part.column(0).to_pylist():
            x = np.frombuffer(raw, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["id", "n"])


def _block(chunk: int, block: int, before: int, docs: list) -> pa.RecordBatch:
    keys, counts, controls, datas = zip(*docs, strict=True)
    values = np.concatenate([decode_values(c, d, n) for c, d, n in zip(controls, datas, counts, strict=True)])
    control, data = encode_values(values)
    row = {
        "chunk": pa.array([chunk], pa.int32()), "block": pa.array([block], pa.int32()), "tokens_before": pa.array([before], pa.int64()),
        "n_docs": pa.array([len(docs)], pa.int32()), "n_tokens": pa.array([len(values)], pa.int64()),
        "ids": pa.array([np.array([k or 0 for k in keys], "<i8").tobytes()], pa.binary()), "nulls": pa.array([bytes(k is None for k in keys)], pa.binary()),
        "lens": pa.array([np.array(counts, "<u4").tobytes()], pa.binary()), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


_BLOCKS = "chunk int, block int, tokens_before long, n_docs int, n_tokens long, ids binary, nulls binary, lens binary, control binary, data binary"


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by doc_id; the task's range is a chunk."""
    held, size, chunk, block, before = [], 0, TaskContext.get().partitionId(), 0, 0
    for part in parts:
        for row in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= BLOCK_TOKENS:
                yield _block(chunk, block, before, held)
                block, before, held, size = block + 1, before + size, [], 0
            held.append(row)
            size += row[1]
    if held:
        yield _block(chunk, block, before, held)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> TokenFiles:
    """Encode all texts and write them as blocks in ascending doc_id order, with the rank table."""
    coded = saved(_encoded(docs, tokenizer, end_id), "token-ids")
    totals = coded.where("counts is not null").select("counts").mapInArrow(_pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row per vocabulary entry
    ranks = saved(totals.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id"), "token-ranks")
    rank_of = np.zeros(1 << 16, np.uint32)
    for r in ranks.collect():
        rank_of[r["id"]] = r["rank"]

    def ranked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [rank_of[np.frombuffer(x, "<u2")] for x in part.column(1).to_pylist()]
            made = [encode_values(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(v) for v in values], pa.int32()), pa.array([c for c, _ in made], pa.binary()), pa.array([d for _, d in made], pa.binary())],
                ["doc_id", "n", "control", "data"],
            )

    coded_docs = coded.where("counts is null").select("doc_id", "ids")
    # lengths tell most equal doc_ids apart for the ranges, so that one key's rows are spread
    dealt = in_ranges(coded_docs.withColumn("h", F.octet_length("ids")), docs.count(), [F.asc_nulls_first("doc_id"), F.asc("h")], "ids").select("doc_id", "ids")
    blocks = saved(dealt.mapInArrow(ranked, "doc_id long, n int, control binary, data binary").mapInArrow(_blocks, _BLOCKS), "token-files", "none")
    discard(coded)
    return TokenFiles(blocks, ranks)


def read_token_files(files: TokenFiles, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (little-endian unsigned 32-bit) of every document."""
    id_of = np.zeros(1 << 16, np.uint32)
    for r in files.ranks.collect():
        id_of[r["rank"]] = r["id"]
    chunks = files.blocks.groupBy("chunk").agg(F.sum("n_tokens").alias("n"))
    # a row for each task that wrote, so one task numbers them and all tasks get them
    starts = chunks.select("chunk", F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chunk_start"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, before, n, keys, nulls, lens, control, data in zip(*(part.column(i).to_pylist() for i in range(8)), strict=True):
                ids = id_of[decode_values(control, data, n)].astype("<u4")
                lens = np.frombuffer(lens, "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                raw = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
                cols = [pa.array(np.frombuffer(keys, "<i8"), mask=np.frombuffer(nulls, bool)), pa.array(start + before + ends - lens), pa.array(lens), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                cols += [pa.array(raw, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    columns = ("chunk_start", "tokens_before", "n_tokens", "ids", "nulls", "lens", "control", "data")
    return files.blocks.join(F.broadcast(starts), "chunk").select(*columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
