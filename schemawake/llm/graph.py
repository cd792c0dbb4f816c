"""Numpy parts of the neighbour graph: comparing neighbours of neighbours, and greedy search.

Nodes of a shard are numbered 0 to n - 1; `vectors` holds their rows as float32.
"""

from __future__ import annotations

import numpy as np

#: Rows compared at a time.
_BLOCK = 512


def leaders(around: np.ndarray) -> np.ndarray:
    """Nodes such that every node is one of them or a neighbour of one: each node in turn that no leader before it has for a neighbour."""
    covered, out = np.zeros(len(around), bool), []
    for i in range(len(around)):
        if not covered[i]:
            out.append(i)
            near = around[i]
            covered[near[near >= 0]] = True
    return np.array(out, np.int64)


def local_join(vectors: np.ndarray, around: np.ndarray, new: np.ndarray, worst: np.ndarray, emit: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare the neighbours of every node with each other.

    around: (n, m) neighbours in either direction, -1 for none; new: which of them have not been compared before;
    worst: each node's k-th best score so far. Gives (node, other, score) of the pairs that better node's list, of each list the `emit` best.
    """
    owners, others, scores = [], [], []
    for a in range(0, len(around), _BLOCK):
        ids, fresh = around[a : a + _BLOCK], new[a : a + _BLOCK]
        there = ids >= 0
        v = vectors[np.maximum(ids, 0)]
        s = np.matmul(v, v.transpose(0, 2, 1))
        ok = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
        ok &= s > worst[np.maximum(ids, 0)][:, :, None]
        s = np.where(ok, s, -np.inf)
        if emit < s.shape[2]:
            top = np.argpartition(-s, emit, axis=2)[:, :, :emit]
            s = np.take_along_axis(s, top, 2)
        else:
            top = np.broadcast_to(np.arange(s.shape[2]), s.shape)
        i, j, k = np.nonzero(s > -np.inf)
        owner, other, score = ids[i, j], ids[i, top[i, j, k]], s[i, j, k]
        key = owner.astype(np.int64) * len(vectors) + other
        _, first = np.unique(key, return_index=True)
        owners.append(owner[first])
        others.append(other[first])
        scores.append(score[first])
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(owners), np.concatenate(others), np.concatenate(scores)


def greedy_search(vectors: np.ndarray, around: np.ndarray, queries: np.ndarray, seeds: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search from the best of the seeds, for all queries at once: (queries, beam) node numbers, best first, and scores.

    Each step expands the `wide` best nodes of each beam that have not been expanded; a query ends when its whole beam has been.
    """
    n, q = len(vectors), len(queries)
    beam = min(beam, n)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    first = queries @ vectors[seeds].T
    top = np.argsort(-first, axis=1)[:, :beam]
    ids = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf, np.float32)
    ids[:, : top.shape[1]] = seeds[top]
    score[:, : top.shape[1]] = np.take_along_axis(first, top, 1)
    seen[:, seeds] = True
    open_ = ids >= 0
    while True:
        live = rows[open_.any(1)]
        if not len(live):
            return ids, score
        pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :wide]  # beams are sorted, so these are the best open ones
        valid = np.take_along_axis(open_[live], pick, 1)
        node = np.where(valid, np.take_along_axis(ids[live], pick, 1), -1)
        open_[live[:, None], pick] = False
        near = np.where((node >= 0)[:, :, None], around[np.maximum(node, 0)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        width = int(fresh.sum(1).max(initial=0))
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        at, col = np.nonzero(fresh)
        seen[live[at], near[at, col]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[at, col] = np.einsum("ij,ij->i", queries[live[at]], vectors[near[at, col]])
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_s = np.concatenate([score[live], s], 1)
        all_open = np.concatenate([open_[live], fresh], 1)
        order = np.lexsort((all_ids, -all_s))[:, :beam]  # equal scores: lower numbers first
        ids[live], score[live], open_[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_s, all_open))
