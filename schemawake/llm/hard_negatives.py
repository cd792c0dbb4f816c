"""Operator 13, hard-negative mining over an inverted multi-index.

file_rows() splits every vector in two halves, each with a codebook of its own (k-means on a sample of about SAMPLE rows; the index itself
holds every row). A pair of codewords is a cell; about sqrt(rows / CELL_ROWS) codewords a half, 256 at most, so the directory of cells
(rows, and the largest distance of a row's halves from their codewords) has 65,536 entries at most and goes to all tasks. Rows of a cell lie in
chunks of about CHUNK_ROWS, so a cell with a third of all rows is as many chunks as it takes.

For an anchor a half's codeword bounds the half score of its rows: the product with the codeword, plus the half's norm times the codeword's
radius. The multi-sequence heap visits cells by falling sum of both halves' bounds. mine() does so in rounds for all anchors at once:
each anchor asks for the next cells of its heap, until these hold FIRST rows (GROWTH times as many in every further
round); the cells' own radii leave out those that can hold nothing it still looks for. Requests meet the chunks in a grouping by chunk,
are scored exactly there, and each chunk gives back at most the wanted number of rows that are not below what the anchor has. An
anchor's positives are certified when the heap's next bound is below the last of them; then the windows of its negatives are known and the heap
starts anew, leaving out cells that lie above all windows, too. It ends when the next bound is below every window's last
score, or below every window that isn't full. So results are exact whatever the codebooks are; on vectors without clusters
the bounds leave little out and nearly all cells are visited.

Cases: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part, nor do vectors whose integer
vector is 2 ** 31 long or longer (their products could leave 64 bits) or whose number of components is not the most frequent one (ties:
the larger); equal scores are ordered by vec_id; a row that is there twice is two rows, each the other's possible positive, and two
anchors if it is one; an anchor without a positive, or with empty windows (negative positive scores), gives no rows; a positive without
negatives gives none; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

SAMPLE, CELL_ROWS, CHUNK_ROWS, CODEWORDS, LLOYD = 16_384, 512, 4096, 256, 8
FIRST, GROWTH = 4096, 16
#: Anchors that meet one copy of a chunk, about, and scores that are looked at together.
ANCHORS, _SCORES = 65_536, 2_000_000
_NONE = np.iinfo(np.int64).min

_FOUND = "array<struct<win:int,score:long,id:long,row:long>>"
_STATE = f"row long, vec_id long, label long, v binary, phase int, round int, seen long, done boolean, positives {_FOUND}, found {_FOUND}"
_PLAN = f"{_STATE}, low array<long>, high array<long>, least array<long>, chunks array<long>"


def whole_vectors(rows: DataFrame, vector: str, times: float = 256.0) -> Column:
    """floor(times * component) of every component, as long."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(times) * x))


def usable(rows: DataFrame, vector: str = "embedding", times: float = 256.0) -> DataFrame:
    """row (a number of its own), vec_id, label, v (longs), anchor (as it was) of the rows that take part, written once. rows: vec_id, label, anchor and the vector."""
    doubles = F.col(vector).cast("array<double>")
    fine = rows.where("vec_id is not null and label is not null").where((F.size(vector) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = fine.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole_vectors(fine, vector, times).alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    out = scaled.withColumn("square", size).where(F.col("square") < 2.0**62)
    return saved(out.withColumn("row", F.monotonically_increasing_id()), "vectors")


def codebook(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means of the sample: (k or fewer, dimensions) codewords."""
    if not sample.shape[1]:  # vectors of one component have an empty half
        return np.zeros((1, 0))
    distinct = np.unique(sample, axis=0)
    words = distinct[np.random.default_rng(k).permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(LLOYD):
        at = _nearest(sample, words)
        count = np.bincount(at, minlength=len(words))
        sums = np.stack([np.bincount(at, sample[:, i], len(words)) for i in range(sample.shape[1])], 1)
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return words


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((words**2).sum(1) - 2 * (x[a : a + 4096] @ words.T), axis=1) for a in range(0, max(len(x), 1), 4096)])


class Directory:
    """Codebooks and, by cell (first codeword * codewords of the second + second), rows and radii."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray]) -> None:
        self.words, self.cut = words, words[0].shape[1]
        n = len(words[0]) * len(words[1])
        self.rows, self.chunks, self.radius = np.zeros(n, np.int64), np.zeros(n, np.int64), (np.zeros(n), np.zeros(n))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and both halves' distances from their codewords."""
        halves = (x[:, : self.cut], x[:, self.cut :])
        at = [_nearest(h, w) for h, w in zip(halves, self.words, strict=True)]
        far = [np.sqrt(((h - w[i]) ** 2).sum(1)) * (1 + 1e-9) for h, w, i in zip(halves, self.words, at, strict=True)]
        return at[0] * len(self.words[1]) + at[1], far[0], far[1]

    def fill(self, cells: list[tuple]) -> None:
        for cell, n, a, b in cells:
            self.rows[cell], self.chunks[cell], self.radius[0][cell], self.radius[1][cell] = n, -(-n // CHUNK_ROWS), a, b
        shape = (len(self.words[0]), len(self.words[1]))
        self.reach = (self.radius[0].reshape(shape).max(1), self.radius[1].reshape(shape).max(0))

    def visit(self, x: np.ndarray) -> Iterator[tuple[float, float, float, int]]:
        """The multi-sequence heap: (bound by codewords, which falls; upper and lower bound by the cell's own radii; cell) of the cells that hold rows."""
        halves = (x[: self.cut], x[self.cut :])
        dots, norm = [w @ h for w, h in zip(self.words, halves, strict=True)], [math.sqrt(float(h @ h)) for h in halves]
        slack = 1e-6 + 1e-9 * sum(n * math.sqrt(float((w**2).sum(1).max())) for n, w in zip(norm, self.words, strict=True))  # for rounding
        upper = [d + n * r for d, n, r in zip(dots, norm, self.reach, strict=True)]
        order = [np.argsort(-u, kind="stable") for u in upper]
        first, second = (upper[i][order[i]].tolist() for i in (0, 1))
        heap, width = [(-(first[0] + second[0]), 0, 0)], len(second)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < width:
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            a, b = int(order[0][i]), int(order[1][j])
            cell = a * width + b
            if self.rows[cell]:
                middle, reach = dots[0][a] + dots[1][b], norm[0] * self.radius[0][cell] + norm[1] * self.radius[1][cell]
                yield -bound + slack, middle + reach + slack, middle - reach - slack, cell


def _bytes(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, "<i4").tobytes()


def file_rows(rows: DataFrame) -> tuple[Directory, DataFrame, DataFrame] | None:
    """The directory; the chunks (chunk, size, ids, rows, labels, vectors as bytes, ordered by vec_id); the anchors (row, vec_id, label, v as bytes). rows as from usable()."""
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths
    rows = rows.where(F.size("v") == d)
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE)
    x = np.array([r[0] for r in sample.toLocalIterator()], np.float64).reshape(-1, d)
    if not len(x):
        x = np.array([rows.first()["v"]], np.float64)
    k = min(CODEWORDS, max(1, round(math.sqrt(n / CELL_ROWS))))
    directory = Directory((codebook(x[:, : d // 2], k), codebook(x[:, d // 2 :], k)))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = part.column(3).flatten().to_numpy().reshape(-1, d)
            cell, a, b = directory.place(v.astype(np.float64))
            packed = pa.array([_bytes(r) for r in v], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 2, 4)), packed, pa.array(cell), pa.array(a), pa.array(b)], ["row", "vec_id", "label", "anchor", "v", "cell", "far_a", "far_b"])

    placed = saved(rows.select("row", "vec_id", "label", "v", "anchor").mapInArrow(each, "row long, vec_id long, label long, anchor boolean, v binary, cell long, far_a double, far_b double"), "placed")
    directory.fill([tuple(r) for r in placed.groupBy("cell").agg(F.count("*"), F.max("far_a"), F.max("far_b")).collect()])  # CODEWORDS ** 2 at most
    parts = directory.chunks.tolist()
    chunks = rows.sparkSession.createDataFrame([(c, n) for c, n in enumerate(parts) if n], "cell long, parts long")
    chunk = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts"))
    dealt = placed.join(F.broadcast(chunks), "cell").select(chunk.alias("chunk"), "row", "vec_id", "label", "v")

    def pack(own: pa.Table) -> pa.Table:
        own = own.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        column = lambda c: own[c].to_numpy().astype("<i8").tobytes()
        return pa.table({"chunk": own["chunk"][:1], "size": pa.array([own.num_rows]), "ids": pa.array([column("vec_id")]), "rows": pa.array([column("row")]), "labels": pa.array([column("label")]), "vectors": pa.array([b"".join(own["v"].to_pylist())])})

    packed = saved(dealt.groupBy("chunk").applyInArrow(pack, "chunk long, size long, ids binary, rows binary, labels binary, vectors binary"), "chunks")
    anchors = saved(placed.where("anchor").select("row", "vec_id", "label", "v"), "anchors")
    discard(placed)
    return directory, packed, anchors


def windows(positives: list[dict], low: int, high: int) -> tuple[list[int], list[int]]:
    """Least and largest score of each positive's negatives: low * positive <= 100 * negative <= high * positive."""
    return [-(-low * p["score"] // 100) for p in positives], [high * p["score"] // 100 for p in positives]


def _plan(directory: Directory, state: dict, n_positives: int, n_negatives: int, low: int, high: int) -> dict:
    """state with what its anchor asks for next; done, and nothing asked for, where all is certified."""
    x = np.frombuffer(state["v"], "<i4").astype(np.float64)
    while not state["done"]:
        found, lows, highs = state["found"], [], []
        if state["phase"] == 0:
            least = [found[-1]["score"] if len(found) == n_positives else _NONE]
            highs = [np.iinfo(np.int64).max]
        else:
            lows, highs = windows(state["positives"], low, high)
            own = [[f["score"] for f in found if f["win"] == w] for w in range(len(lows))]
            least = [s[-1] if len(s) == n_negatives else lo for s, lo in zip(own, lows, strict=True)]
            kept = [i for i, (lo, hi) in enumerate(zip(lows, highs, strict=True)) if lo <= hi]
            if not kept:
                return state | {"done": True, "low": [], "high": [], "least": [], "chunks": []}
        wanted = [(t, h) for t, h in zip(least, highs, strict=True) if t <= h]
        bottom = min((t for t, _ in wanted), default=np.iinfo(np.int64).max)
        asked, seen, budget, certified = [], 0, FIRST * GROWTH ** state["round"], True
        for bound, upper, lower, cell in directory.visit(x):
            if bound < bottom:
                break
            seen += 1
            if seen <= state["seen"]:
                continue
            if budget <= 0:
                certified, seen = False, seen - 1
                break
            if any(upper >= t and lower <= h for t, h in wanted):
                asked += [(cell << 32) + i for i in range(directory.chunks[cell])]
                budget -= int(directory.rows[cell])
        if asked:
            return state | {"seen": seen, "round": state["round"] + 1, "low": lows, "high": highs, "least": least, "chunks": asked}
        if not certified:
            state = state | {"seen": seen}
        elif state["phase"] == 0 and found:
            state = state | {"phase": 1, "round": 0, "seen": 0, "positives": found, "found": []}
        else:
            state = state | {"done": True}
    return state | {"low": [], "high": [], "least": [], "chunks": []}


def _best(mask: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores under the mask, ties by column."""
    at, col = np.nonzero(mask)
    order = np.lexsort((col, -scores[at, col], at))
    at, col = at[order], col[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], col[keep]


def _score(asked: pa.Table, chunk: pa.Table, exact: bool, n_positives: int, n_negatives: int) -> pa.Table:
    """What a chunk has for the anchors that ask for it: anchor (row), win, score, id, row."""
    out = {k: [np.zeros(0, np.int64)] for k in ("anchor", "win", "score", "id", "row")}
    if asked.num_rows and chunk.num_rows:
        ids, rows, labels = (np.frombuffer(chunk[c][0].as_py(), "<i8") for c in ("ids", "rows", "labels"))
        kind = np.float64 if exact else np.int64  # products below 2 ** 53 are exact in doubles
        v = np.frombuffer(chunk["vectors"][0].as_py(), "<i4").reshape(len(ids), -1).astype(kind).T.copy()
        step = max(1, _SCORES // len(ids))
        for a in range(0, asked.num_rows, step):
            part = asked.slice(a, step)
            own, label, phase = (part[c].to_numpy() for c in ("row", "label", "phase"))
            x = np.frombuffer(b"".join(part["v"].to_pylist()), "<i4").reshape(part.num_rows, -1).astype(kind)
            s = (x @ v).astype(np.int64)
            same, least = label[:, None] == labels, part["least"].to_pylist()
            lows, highs = part["low"].to_pylist(), part["high"].to_pylist()
            for win in range(max(map(len, least), default=0)):
                t = np.array([x[win] if len(x) > win else np.iinfo(np.int64).max for x in least], np.int64)
                h = np.array([x[win] if len(x) > win else _NONE for x in highs], np.int64)
                for turn, fits, k in ((0, same & (rows != own[:, None]), n_positives), (1, ~same, n_negatives)):
                    mine = np.flatnonzero((phase == turn) & (t <= h))
                    if len(mine):
                        at, col = _best(fits[mine] & (s[mine] >= t[mine, None]) & (s[mine] <= h[mine, None]), s[mine], k)
                        at = mine[at]
                        for c, x_ in (("anchor", own[at]), ("win", np.full(len(at), win)), ("score", s[at, col]), ("id", ids[col]), ("row", rows[col])):
                            out[c].append(x_)
    return pa.table({k: pa.array(np.concatenate(x), pa.int32() if k == "win" else pa.int64()) for k, x in out.items()})


def mine(rows: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows as from usable().

    An anchor's positives are its n_positives best other rows of its label; each of them has the n_negatives best rows of other labels whose
    score is `low` to `high` hundredths of its own.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    filed = file_rows(rows)
    if filed is None:
        return empty
    directory, chunks, anchors = filed
    exact = (rows.agg(F.max("square")).first()[0] or 0.0) < 2.0**52
    n = anchors.count()
    parts = max(1, math.ceil(n / ANCHORS))
    copies = chunks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_plan(directory, r, n_positives, n_negatives, low, high) for r in batch.to_pylist()], schema=_plan_schema())

    none = F.array().cast(_FOUND)
    state, last, done = anchors.select("row", "vec_id", "label", "v", F.lit(0).alias("phase"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("seen"), F.lit(False).alias("done"), none.alias("positives"), none.alias("found")), anchors, []
    while True:
        planned = saved(state.mapInArrow(plan, _PLAN), "planned")
        done.append(saved(planned.where("done and size(positives) > 0").select("row", "vec_id", "positives", "found"), "mined"))
        going = planned.where("not done")
        if going.isEmpty():
            break
        asked = going.select("row", "label", "phase", "v", "low", "high", "least", F.explode("chunks").alias("chunk")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
        hits = asked.groupBy("chunk", "part").cogroup(copies.groupBy("chunk", "part")).applyInArrow(lambda a, c: _score(a, c, exact, n_positives, n_negatives), "anchor long, win int, score long, id long, row long")
        state = saved(_merged(going, hits, n_positives, n_negatives), "anchors")
        discard(last, planned)
        last = state
    discard(last, planned, chunks)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    each = found.select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("_anchor"), F.posexplode("positives").alias("win", "p"), "found")
    negatives = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(F.filter("found", lambda f: f["win"] == F.col("win"))).alias("place", "f"))
    return negatives.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, vector: str = "embedding", **how: int) -> DataFrame:
    """mine() over the usable rows of vectors (vec_id, label, anchor and the vector)."""
    rows = usable(vectors, vector)
    found = mine(rows, **how)  # its jobs have run
    discard(rows)
    return found


def _plan_schema() -> pa.Schema:
    found = pa.list_(pa.struct([("win", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]))
    longs = pa.list_(pa.int64())
    return pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("phase", pa.int32()), ("round", pa.int32()), ("seen", pa.int64()), ("done", pa.bool_()), ("positives", found), ("found", found), ("low", longs), ("high", longs), ("least", longs), ("chunks", longs)])


def _merged(going: DataFrame, hits: DataFrame, n_positives: int, n_negatives: int) -> DataFrame:
    """The anchors' states with the hits among what they have found: the best of each window, by falling score, vec_id, row."""
    best = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id", "row")
    most = max(n_positives, n_negatives)
    top = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    lists = top.groupBy("anchor").agg(F.collect_list(F.struct("win", "score", "id", "row")).alias("more"))
    j = going.join(lists, F.col("row") == F.col("anchor"), "left").drop("anchor")
    both = F.array_sort(F.transform(F.concat("found", F.coalesce("more", F.array().cast(_FOUND))), lambda f: F.struct(f["win"].alias("win"), (-f["score"]).alias("less"), f["id"].alias("id"), f["row"].alias("row"))))
    j = j.withColumn("both", both)
    k = F.when(F.col("phase") == 0, n_positives).otherwise(n_negatives)
    firsts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_positives - 1)), lambda w: F.slice(F.filter("both", lambda f: f["win"] == w), F.lit(1), k)))
    found = F.transform(firsts, lambda f: F.struct(f["win"].alias("win"), (-f["less"]).alias("score"), f["id"].alias("id"), f["row"].alias("row")))
    return j.select("row", "vec_id", "label", "v", "phase", "round", "seen", "done", "positives", found.cast(_FOUND).alias("found"))
