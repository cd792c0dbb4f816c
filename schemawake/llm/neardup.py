"""Operator 4, near-duplicates: consistent weighted sampling over TF-IDF shingles.

Terms are shingles of five words. A shingle's weight is its count in the text
times its idf, ln(1 + N / df). Document frequencies of the shingles found in at
least RARE of all N documents are counted exactly; all rarer ones share the
weight of df = RARE * N. Such frequent shingles number at most (mean distinct
shingles of a document) / RARE, whatever the corpus' size. They are found in two
passes: a shingle as frequent as that in the corpus is so in some batch of
documents, so the first pass names what is frequent in a batch, the second counts
those over all documents.

Improved consistent weighted sampling: sample k of a text is the shingle x (and
level t) of least a_k(x) = c / (y e^r), with t = floor(ln w / r + b) and
y = e^(r (t - b)); r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from a table of 2**16
draws that a hash of x and k points into. For sampling alone, weights are rounded
to a geometric grid (STEP). Two texts agree in a sample with the probability of
their weighted Jaccard similarity. ROWS samples make a band, BANDS bands a
signature.

Candidates share two bands of the even or of the odd ones: a bucket is such a
pair of bands, so the loosely related texts of a large family, which share a band
here and there, hardly ever meet. In
each bucket all texts are first compared with one leader, the one that shares most
bands with others, and what is similar becomes a class. Buckets that still hold
several classes go on: members of the smallest classes, in each round 16 times
as many, are compared with the members of other classes and then leave the bucket,
until each bucket is down to one class. Left out are pairs that cannot be near:
those that the triangle inequality of the Jaccard distance rules out by their
distances to the leader, and those of which one text has too much that no other
text still asked about has at all. So every candidate pair is compared,
ruled out, or in one class already. Pairs count as near-duplicates if the weighted Jaccard similarity
of their exact weights is THRESHOLD or more; classes are the connected components.
At similarity 0.8 two texts are candidates with probability 0.999.

Equal texts are one node (64-bit hash) from the signatures on; a batch samples
each of its distinct texts once.

Cases: a null text is an empty one; texts without words are near-duplicates of
each other only if equal; a text of one to four words has one shingle; null
doc_ids sort last when the kept document (least doc_id, then source) is chosen;
repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext
from .common import discard, map_texts, saved, text_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
RARE = 1e-2
STEP = 0.15
_LEVELS = 128
_LOW = -0.6
#: Members of a bucket that are compared with all others of other classes in the first round; 16 times as many in each later one.
ASKERS = 16
#: Documents a task takes on at least, and shingles it holds, before it names the frequent ones among them.
BATCH_DOCS, HELD_SHINGLES = 4096, 2_000_000
#: Shingles named in the first pass up to which all tasks get the list (8 bytes each); beyond it all shingles are counted by shuffling.
NAMED = 4_000_000
#: Node lists up to this length (8 bytes each) are broadcast, longer ones joined by shuffling.
BROADCAST_ROWS = 1_000_000


def node_of(text: Column) -> Column:
    return F.xxhash64(text)


# --- idf -------------------------------------------------------------------------


def _distinct_shingles(texts: list[str], n: int = SHINGLE) -> np.ndarray:
    """Every text's distinct shingles, one after the other."""
    found = [np.zeros(0, np.uint64)]
    for a, b in vectext.batches(texts):
        word, text, _, _ = vectext.words(texts[a:b])
        term, owner = vectext.shingles(word, text, n)
        term = term[np.lexsort((term, owner))]
        owner = np.sort(owner)
        found.append(term[np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]] if len(term) else term)
    return np.concatenate(found)


def shingle_counts(docs: DataFrame, least: float) -> DataFrame:
    """term and n, a row for each batch of documents and shingle that at least `least` of the batch's documents hold."""

    def emit(held: list[np.ndarray], many: int) -> Iterator[pa.RecordBatch]:
        term, n = np.unique(np.concatenate(held), return_counts=True)
        term, n = term[n >= least * many], n[n >= least * many]
        for i in range(0, len(term), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(term[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["term", "n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, many = [], 0, 0
        for part in parts:
            held.append(_distinct_shingles([t or "" for t in part.column(0).to_pylist()]))
            size, many = size + len(held[-1]), many + part.num_rows
            if size > HELD_SHINGLES and many > BATCH_DOCS:
                yield from emit(held, many)
                held, size, many = [], 0, 0
        if size:
            yield from emit(held, many)

    return docs.select("text").mapInArrow(run, "term long, n long")


def _hits(docs: DataFrame, named: np.ndarray) -> DataFrame:
    """term and n: in how many documents of a task each of the named shingles stands."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(named), np.int64)
        for part in parts:
            term = _distinct_shingles([t or "" for t in part.column(0).to_pylist()])
            at = np.minimum(np.searchsorted(named, term), len(named) - 1)
            total += np.bincount(at[named[at] == term], minlength=len(named))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(named[at].view(np.int64)), pa.array(total[at])], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long")


def frequent_shingles(docs: DataFrame, n_docs: int, rare: float = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and idf of the shingles found in at least `rare` of all documents, counted exactly."""
    tasks = max(1, -(-n_docs // BATCH_DOCS))
    named = saved(shingle_counts(docs.coalesce(tasks), rare).select("term").distinct(), "named")
    if (many := named.count()) <= NAMED:
        terms = np.sort(named.toArrow().column("term").to_numpy().view(np.uint64))
        counts = _hits(docs, terms) if many else None
    else:
        counts = shingle_counts(docs, 0.0)
    discard(named)
    if counts is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    # at most (mean distinct shingles of a document) / rare rows
    top = counts.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= rare * n_docs).toArrow()
    term = top.column("term").to_numpy().view(np.uint64)
    order = np.argsort(term)
    return term[order], np.log1p(n_docs / top.column("n").to_numpy()[order])


# --- weighted shingles -------------------------------------------------------------


def weighted_shingles(texts: list[str], terms: np.ndarray, idf: np.ndarray, rare: float = RARE, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a batch, sorted by text and hash: hash, text index, weight."""
    word, text, _, _ = vectext.words(texts)
    if not len(word):
        return word, text, np.zeros(0)
    term, owner = vectext.shingles(word, text, n)
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])])
    tf = np.diff(np.r_[at, len(term)])
    term, owner = term[at], owner[at]
    value = np.full(len(term), np.log1p(1 / rare))
    if len(terms):
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        hit = terms[at] == term
        value[hit] = np.minimum(idf[at[hit]], value[hit])
    return term, owner, tf * value


def levels_of(weight: np.ndarray) -> np.ndarray:
    """Places of weights on the grid that sampling uses."""
    return np.clip(np.rint((np.log(weight) - _LOW) / STEP), 0, _LEVELS - 1).astype(np.uint64)


def level_weights() -> np.ndarray:
    return np.exp(_LOW + STEP * np.arange(_LEVELS))


@cache
def _sampling_table() -> np.ndarray:
    """For each weight level and each of 2**16 draws, ln a as a uint32 that sorts alike."""
    rng = np.random.default_rng(20240)
    r, c = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16)
    b = rng.random(1 << 16)
    lnw = np.log(level_weights())[:, None]
    t = np.floor(lnw / r + b)
    bits = (np.log(c) - r * (t - b) - r).astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).ravel()


@cache
def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: list[str], terms: np.ndarray, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS, rare: float = RARE) -> np.ndarray:
    """(texts, bands) band keys; those of a text without words are 0, no other key is."""
    out = np.zeros((len(texts), bands), np.uint64)
    for a, b in vectext.batches(texts):
        term, owner, weight = weighted_shingles(texts[a:b], terms, idf, rare)
        if not len(term):
            continue
        table, mult = _sampling_table(), _multipliers(bands * rows)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        base, low = levels_of(weight) << np.uint64(16), term & np.uint64(0xFFFFFFFF)
        keys = np.zeros((len(first), bands), np.uint64)
        for k in range(bands * rows):
            slot = base | ((term * mult[k]) >> np.uint64(48))
            sample = np.minimum.reduceat(table[slot].astype(np.uint64) << np.uint64(32) | low, first)
            j = k // rows
            keys[:, j] = vectext.mix(keys[:, j] + sample + np.uint64(k + 1))
        out[a + owner[first]] = keys | np.uint64(1)
    return out


def _distinct_signatures(texts: list[str], *how) -> np.ndarray:
    """signatures of a batch, each distinct text sampled once."""
    place: dict[str, int] = {}
    at = [place.setdefault(t, len(place)) for t in texts]
    return signatures(list(place), *how)[at]


def _lists(keys: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))


# --- linking -----------------------------------------------------------------------


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, label: the least node of each connected component of the edges (u, v); only nodes with an edge are in it.

    Labels spread to neighbours and then jump to their labels' labels, so the rounds grow with the logarithm of a
    component's diameter. A hub's rows in these joins are split by adaptive execution.
    """
    both = saved(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), name)
    while True:
        told = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy("v").agg(F.min("label").alias("told"))
        near = saved(labels.join(told, labels["node"] == told["v"]).select("node", F.least("label", "told").alias("label"), F.col("label").alias("old")), name)
        discard(labels)
        if near.where("label <> old").isEmpty():
            discard(both)
            return near
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = saved(near.select("node", "label").join(far, "label").select("node", F.least("label", "far").alias("label")), name)
        discard(near)


def _vectors(docs: DataFrame, wanted: DataFrame, terms: np.ndarray, idf: np.ndarray, rare: float) -> DataFrame:
    """node, terms (sorted 8-byte hashes) and weights (4-byte floats) of the wanted nodes' texts, one row each."""
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(node_of(text_of()).alias("node"), text_of().alias("text"))
    texts = texts.join(F.broadcast(wanted), "node", "left_semi").dropDuplicates(["node"]) if few else texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi")

    def run(batch: list[str]) -> dict:
        names, weights = [b""] * len(batch), [b""] * len(batch)
        for a, b in vectext.batches(batch):
            term, owner, weight = weighted_shingles(batch[a:b], terms, idf, rare)
            at = np.searchsorted(owner, np.arange(b - a + 1))
            for i in range(b - a):
                one = slice(at[i], at[i + 1])
                names[a + i], weights[a + i] = term[one].tobytes(), weight[one].astype("<f4").tobytes()
        return {"terms": names, "weights": weights}

    return saved(map_texts(texts, ["node"], run, "terms binary, weights binary"), "vectors")


def weighted_jaccard(terms_a: bytes, weights_a: bytes, terms_b: bytes, weights_b: bytes) -> float:
    a, b = np.frombuffer(terms_a, "<u8"), np.frombuffer(terms_b, "<u8")
    wa, wb = np.frombuffer(weights_a, "<f4").astype(float), np.frombuffer(weights_b, "<f4").astype(float)
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    least = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def _compared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """u, v, s: the weighted Jaccard similarity of every pair."""
    side = lambda x: vectors.select(F.col("node").alias(x), F.col("terms").alias(f"t{x}"), F.col("weights").alias(f"w{x}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s = [weighted_jaccard(*x) for x in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64())], ["u", "v", "s"])

    return saved(both.select("u", "v", "tu", "wu", "tv", "wv").mapInArrow(run, "u long, v long, s double"), "similar")


def band_pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket, half, node, leader of texts that share two bands of one half with another text, and node, half, k: the bands of a half that each text shares with any. bands: node and keys, 0 for texts without words."""
    members = saved(bands.dropDuplicates(["node"]).select("node", F.posexplode("keys").alias("band", "key")).where("key <> 0").select(F.xxhash64("band", "key").alias("key"), (F.col("band") % 2).cast("int").alias("half"), "node"), "bands")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # at most BANDS keys a node
    own = saved(members.join(shared, "key").groupBy("node", "half").agg(F.array_sort(F.collect_list("key")).alias("k")).where("size(k) > 1"), "own-bands")
    discard(members)
    two = "flatten(transform(sequence(1, size(k) - 1), i -> transform(slice(k, i + 1, size(k) - i), x -> xxhash64(k[i - 1], x))))"
    pairs = saved(own.select("node", "half", F.size("k").alias("bands"), F.explode(F.expr(two)).alias("bucket")), "band-pairs")
    several = pairs.groupBy("bucket").agg(F.count("*").alias("count"), F.max(F.struct("bands", "node"))["node"].alias("leader")).where("count > 1")
    out = saved(pairs.join(several, "bucket").select("bucket", "half", "node", "leader"), "active")
    discard(pairs)
    return out, own


def links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rare: float = RARE) -> DataFrame:
    """node, label of all texts that share two bands with another text; texts of one class have one label."""
    spark = docs.sparkSession
    terms, idf = frequent_shingles(docs, docs.count(), rare)
    keys = map_texts(docs.select(node_of(text_of()).alias("node"), "text"), ["node"], lambda t: {"keys": _lists(_distinct_signatures(t, terms, idf, bands, rows, rare))}, "keys array<long>")
    first, own = band_pairs(keys)
    if first.isEmpty():
        return spark.createDataFrame([], "node long, label long")
    nodes = saved(first.select("node").distinct(), "candidates")
    vectors = _vectors(docs, nodes, terms, idf, rare)
    done = _compared(first.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), vectors)
    labels = _merged(nodes.select("node", F.col("node").alias("label")), done.where(F.col("s") >= threshold).select("u", "v"))
    led = first.where("node <> leader").join(done.select(F.col("u").alias("leader"), F.col("v").alias("node"), "s"), ["leader", "node"])
    active = _unsettled(led.select("bucket", "half", "node", "s"), labels)
    discard(first, done)
    many = ASKERS
    while not active.isEmpty():
        if many == ASKERS:
            active = _with_room(active, vectors, own)
        askers = saved(_askers(active, many), "askers")
        side = lambda df, x: df.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "s", "weight", "common", "k", "other")))
        least = F.least("common_u", "common_v")
        may = (F.col("label_u") != F.col("label_v")) & (F.abs(F.col("s_u") - F.col("s_v")) <= 1 - threshold + 1e-9)
        may &= least * (1 + threshold) >= (F.col("weight_u") + F.col("weight_v")) * threshold - 1e-3
        # of the buckets that two texts share, they are compared in the first: that of their first two bands of the even half, if they share so many
        both = F.array_intersect("k_u", "k_v")
        may &= (F.xxhash64(F.get(both, F.lit(0)), F.get(both, F.lit(1))) == F.col("bucket")) & (F.size(F.array_intersect("other_u", "other_v")) < 2)
        asked = side(askers, "u").join(side(active, "v"), "bucket").where(may).select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
        many *= 16
        similar = _compared(asked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), vectors)
        merged = _merged(labels, similar.where(F.col("s") >= threshold).select("u", "v"))
        rest = _unsettled(active.drop("label").join(askers.select("bucket", "node"), ["bucket", "node"], "left_anti"), merged)
        discard(askers, similar, active, *([labels] if merged is not labels else []))
        labels, active = merged, rest
    discard(active, vectors, own)
    return labels


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels after joining the classes that the found pairs link; works on classes, so it is small once most links are known."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = found.join(side("u"), "u").join(side("v"), "v").where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct()
    between = saved(between, "between")
    if between.isEmpty():
        discard(between)
        return labels
    joined = components(between)
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = saved(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    discard(between, joined)
    return out


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (bucket, node and others) with label, of the buckets whose members are not all in one class."""
    rows = saved(members.join(labels, "node"), "rest")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    out = saved(rows.join(mixed, "bucket").select(*members.columns, "label"), "active")
    discard(rows)
    return out


def _with_room(active: DataFrame, vectors: DataFrame, own: DataFrame) -> DataFrame:
    """active with each node's weight and how much of it is in common with any other node of active (no pair has more in common than the lesser of the two), its bands k of the bucket's half, and those of the even half if that is the other one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for node, terms, weights in zip(*(c.to_pylist() for c in part.columns), strict=True):
                term, weight = np.frombuffer(terms, np.int64), np.frombuffer(weights, "<f4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), node, np.int64)), pa.array(term), pa.array(weight)], ["node", "term", "weight"])

    mine = vectors.join(active.select("node").distinct(), "node", "left_semi").select("node", "terms", "weights")
    terms = mine.mapInArrow(run, "node long, term long, weight float")
    alone = terms.groupBy("term").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("weight").alias("alone")).where("n = 1").groupBy("node").agg(F.sum("alone").alias("alone"))
    whole = terms.groupBy("node").agg(F.sum("weight").alias("weight"))
    room = whole.join(alone, "node", "left").select("node", "weight", (F.col("weight") - F.coalesce("alone", F.lit(0.0))).alias("common"))
    even = own.where("half = 0").select("node", F.lit(1).alias("half"), F.col("k").alias("other"))
    none = F.array().cast("array<bigint>")
    bands = own.join(even, ["node", "half"], "left").select("node", "half", "k", F.coalesce("other", none).alias("other"))
    out = saved(active.join(room, "node").join(bands, ["node", "half"]), "active")
    discard(active)
    return out


def _askers(active: DataFrame, many: int = ASKERS) -> DataFrame:
    """Up to `many` members of each bucket, those of its smallest classes first, found in parts so that a large bucket is spread."""
    size = F.count("*").over(Window.partitionBy("bucket", "label"))
    rows = active.withColumns({"size": size, "part": F.pmod(F.xxhash64("node"), F.lit(32))})
    order = [F.col("size"), F.col("label"), F.col("node")]
    for keys in (["bucket", "part"], ["bucket"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= many)
    return rows.select(*active.columns)


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept, of every document.

    `kept` is true for the least doc_id's row; repeated rows with that doc_id and text share it.
    """
    rows = saved(docs.select("doc_id", node_of(text_of()).alias("node")), "nodes")
    per = _class_of_nodes(rows, links(docs, **how))
    out = rows.join(per, "node")
    return out.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper"))).alias("kept"))


def _class_of_nodes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """node, class_id, class_size, keeper: the node of the class's kept document."""
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    nodes = saved(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    least = F.min(F.struct(F.col("low").isNull(), "low", "node"))
    per = nodes.groupBy("label").agg(least.alias("least"), F.sum("n").alias("class_size"))
    joined = nodes.select("node", "label").join(per, "label")
    return joined.select("node", F.col("least.low").alias("class_id"), "class_size", F.col("least.node").alias("keeper"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with all its columns: the least doc_id's; of repeated rows with that doc_id and text, one."""
    rows = saved(docs.select("doc_id", node_of(text_of()).alias("node")), "nodes")
    keep = _class_of_nodes(rows, links(docs, **how)).where("node = keeper").select(F.col("keeper").alias("_node"), F.col("class_id").alias("_id"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", node_of(text_of()).alias("_node"))
    # joined on node and doc_id together, so copies of one text are spread by their doc_ids
    kept = packed.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (packed["_node"] == keep["_node"]), "left_semi")
    if not rows.groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_node"])
    return kept.select("_row.*")
