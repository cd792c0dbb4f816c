"""Operators 11 to 13 against plain Python and the libraries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from schemawake.llm import hard_negatives, lexical, token_counts, vectext
from schemawake.llm.queries import tokenizer_path

from .helpers import corpus, docs, none, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(rows, items, top=20):
    """item_id, rank, doc_id, score by scoring every pair."""
    counts = [(d, Counter(plain_terms(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, (d is not None, d or 0), d))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1)]
    return out


def test_terms():
    texts = ["Ab-c1 É_é\nx", "", "ÄÖ ü!Z9", "a\x00b\x7fc", "日本 x", "K ſ"]
    hashes, text = lexical.terms_of(*vectext.code_points(texts))
    want = [(i, t) for i, x in enumerate(texts) for t in plain_terms(x)]
    alone = [lexical.terms_of(*vectext.code_points([t]))[0] for _, t in want]
    assert text.tolist() == [i for i, _ in want]
    assert hashes.tolist() == [int(a[0]) for a in alone]


@pytest.mark.parametrize("top", [1, 3, 20])
def test_ranked_search(spark, monkeypatch, top):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    rows = [(d, t) for d, t, *_ in corpus()]
    rows += [(1000 + i, "alpha betas " * (i % 5 + 1) + prose(i, 5)) for i in range(40)] + [(2000 + i, "the same text, alpha") for i in range(60)]
    items = [(1, "Alpha beta gamma"), (2, None), (3, "...!"), (4, "unknownterm"), (5, "alpha alpha same"), (5, "alpha alpha same"), (None, "word"), (6, prose(1000, 300))]
    got = lexical.ranked_search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), top)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_search(rows, items, top)))


def test_search_in_groups_and_no_input(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 6)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    rows = [(d, t) for d, t, *_ in corpus(30)]
    items = [(i, prose(i, 5)) for i in range(12)]
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, lexical.ranked_search(docs(spark, 30), asked).collect()), key=str) == sorted(plain_search(rows, items), key=str)
    assert lexical.ranked_search(none(spark), asked).isEmpty()
    assert lexical.ranked_search(docs(spark, 30), asked.limit(0)).isEmpty()


def test_bounds_hold_and_exclude():
    """Every bound is at least the score, and most documents of a larger corpus are never rescored."""
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(400_000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    rows = list(lexical._blocks(list(range(len(texts))), texts, 5))
    # with fewer holders than the list is long, documents of the frequent words alone are among the best, and no bound tells these apart
    some = sorted(w for w, n in Counter(words).items() if 50 <= n < 400)
    own = [lexical.terms_of(*vectext.code_points([" ".join(r.sample(some, 4)) + " w1 w2"]))[0] for _ in range(8)]
    terms = np.unique(np.concatenate(own))
    _, hashes, _ = lexical.counted(texts)
    df = Counter(hashes.tolist())
    ranking = lexical.Ranking(own, terms, np.array([df[t] for t in terms.tolist()]), 4000, 400_000)
    best = lexical.Best(len(own), 5)
    for row in rows:
        n = np.array(row["n"])
        assert (ranking.bounds(row["slices"], row["width"], row["bits"], n) >= ranking.scores(row["texts"], n)).all()
        best.block(ranking, row)
    assert best.rescored < len(texts) / 2


ODD = ["I'm don't we'll 's 'll they've'd x''s  a  b\n\n c \t d", "", " ", "<|endoftext|> hi <|STARTOFTEXT|>", "1st ½ x² 123", "日本語 テスト 😀", "x" * 300, "A'S a 's b", "a\r\n b\x1cx", "ΣΑΣ ΟΔΟΣ", "é café", "İstanbul ǅ", "l'", "'"]


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_whole_tokens_are_proven(word_bpe):
    path = tokenizer_path("word_bpe_49k.json")
    whole = set(token_counts.whole_tokens(path).tolist())
    assert len(whole) > 30_000
    words = ["the", "hello", "!", "ñ", "qqzzxxvv"]
    arr, ends = vectext.code_points(words)
    hashes = vectext.span_hashes(arr, ends[:-1], ends[1:]).tolist()
    for w, h in zip(words, hashes, strict=True):
        assert (h in whole) == (len(word_bpe.encode(w, add_special_tokens=False).ids) == 1)
    assert token_counts.whole_tokens(tokenizer_path()) is None and token_counts.whole_tokens(tokenizer_path("piece_bpe_32k.model")) is None


def test_counter_equals_the_library(word_bpe):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("ab'srelv dmtTS \n\t.1é½Σ!") for _ in range(60)) for _ in range(2000)]
    path = tokenizer_path("word_bpe_49k.json")
    counter = token_counts.Counter(path, token_counts.whole_tokens(path))
    assert counter.counts(texts).tolist() == [len(e.ids) for e in word_bpe.encode_batch(texts, add_special_tokens=False)]
    plain = token_counts.Counter(path, token_counts.whole_tokens(path))
    plain.counts(["the cat and the dog"] * 50)
    assert plain.merged == 0  # all by the shortcut


def test_token_counts(spark, word_bpe):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = token_counts.count_tokens(docs(spark), tokenizer_path(name), limit=100).collect()
        count = lambda t: token_counts._library_count(tokenizer_path(name), t)  # noqa: B023, E731
        want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 100) for d, t, *_ in corpus()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(none(spark), tokenizer_path("word_bpe_49k.json")).isEmpty()


def plain_negatives(rows, n_positives=5, n_negatives=3, low=50, high=95):
    """rows: vec_id, label, whole vector, anchor."""
    out = []
    for i, (a, label, v, anchor) in enumerate(rows):
        if anchor:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, lab) for j, (b, lab, w, _) in enumerate(rows) if j != i)
            for p, pid, _ in [s for s in scored if s[2] == label][:n_positives]:
                fits = [(n, b) for n, b, lab in scored if lab != label and -low * p <= -100 * n <= -high * p]
                out += [(a, pid, r, b, -p, -n) for r, (n, b) in enumerate(fits[:n_negatives], 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, anchor boolean, row string, chunk string").repartition(3)


def whole(rows):
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    return [(r[0], r[1], [math.floor(256 * float(np.float32(x))) for x in r[2]], bool(r[3])) for r in fine]


@pytest.mark.parametrize("dims", [1, 2, 7])
def test_hard_negatives(spark, monkeypatch, dims):
    """Cells, chunks and rounds of a few rows each; ties, copies, odd rows."""
    for name, value in (("CELL_ROWS", 4), ("CHUNK_ROWS", 5), ("FIRST", 8), ("GROWTH", 2), ("ANCHORS", 9)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(dims)
    middles = r.normal(size=(6, dims))
    rows = [(i, int(i % 6) % 4, (middles[i % 6] + 0.3 * r.normal(size=dims)).tolist(), i % 5 == 0, "r", "c") for i in range(160)]
    rows += [(200 + i, 1, rows[1][2], i % 2 == 0, None, None) for i in range(30)] + [rows[0], rows[5]]  # a common vector, repeated rows
    odd = [(900, None, [1.0] * dims, True, "", ""), (901, 1, None, True, "", ""), (902, 1, [None] * dims, True, "", ""), (903, 2, [float("nan")] * dims, False, "", ""), (904, 2, [float("inf")] * dims, False, "", ""), (905, 2, [], True, "", ""), (None, 2, [1.0] * dims, True, "", "")]
    got = hard_negatives.hard_negatives(vectors(spark, rows + odd))
    want = plain_negatives(whole(rows))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.hard_negatives(vectors(spark, []).limit(0)).isEmpty()
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0, 2.0], True, "", "")])).isEmpty()
    large = [(i, i % 2, [float(np.float32(x * 9e5)) for x in v], True, "", "") for i, v in enumerate(np.random.default_rng(1).normal(size=(12, 3)))]  # products beyond 2 ** 53
    assert sorted(map(tuple, hard_negatives.hard_negatives(vectors(spark, large)).collect())) == sorted(plain_negatives(whole(large)))
    other = vectors(spark, [(i, i % 2, [1.0] * (2 if i else 3), True, "", "") for i in range(4)])  # another length takes no part
    assert {r["anchor_id"] for r in hard_negatives.hard_negatives(other, low=0, high=100).collect()} == {1, 3}


def test_the_heap_falls_and_bounds_hold():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(400, 8)))
    found = hard_negatives.Directory((hard_negatives.codebook(x[:, :4], 5), hard_negatives.codebook(x[:, 4:], 5)))
    cell, a, b = found.place(x)
    found.fill([(c, (cell == c).sum(), a[cell == c].max(), b[cell == c].max()) for c in np.unique(cell).tolist()])
    seen = list(found.visit(x[3]))
    assert [s[0] for s in seen] == sorted((s[0] for s in seen), reverse=True) and sorted(s[3] for s in seen) == np.unique(cell).tolist()
    for bound, upper, lower, c in seen:
        s = x[cell == c] @ x[3]
        assert lower <= s.min() and s.max() <= upper and s.max() <= bound


def test_greedy_search_reaches_every_cluster():
    """A shard of 8,000 vectors in 200 tight clusters, as one of a million rows would be: recall, and the share of vectors scored."""
    from schemawake.llm import graph

    r, n, k = np.random.default_rng(1), 8000, 24
    middles = r.normal(size=(200, 64))
    v = middles[r.integers(0, 200, n)] + 0.3 * r.normal(size=(n, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    around = np.argsort(-s, axis=1)[:, :k].astype(np.int64)
    start = graph.leaders(around)
    reached = np.zeros(n, bool)
    reached[start] = True
    reached[around[start].ravel()] = True
    assert reached.all() and len(start) < n / 6
    q = v[::40]
    ids, _ = graph.greedy_search(v, around, q, start, 160)
    true = np.argsort(-(q @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) >= 0.95
