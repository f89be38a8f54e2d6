"""Robust-pruned directed graphs over vectors, in arrays: building and beam search.

A graph has ``degree`` edges a node, or a third more.  Nodes join in batches: a greedy
beam search on the graph so far proposes the nodes it went through as
neighbours, and relaxed pruning keeps the nearest one, drops what is nearer to
it by the factor ``alpha`` than to the node itself, and goes on with the rest,
so that edges point in different directions and some are long.  Edges are made
both ways, and nodes that get too many are pruned again.  A second pass repeats
this for all nodes on the whole graph.

The largest inner product is the least distance once every vector has one more
component that brings all to one length; searches run in that space, in single
precision, and are decided by inner products in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes a query expands at a time, queries and nodes that are worked on together.
WIDTH, BLOCK = 4, 256
#: Nodes that a search starts from, far from one another.
ENTRIES = 16
#: Proposals that pruning compares with each other.
PROPOSALS = 160


@dataclass
class Graph:
    points: np.ndarray  # float32 (nodes, dimensions + 1)
    links: np.ndarray  # int32 (nodes, degree), -1 where there is none
    entries: np.ndarray  # int32


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors (double) by the greatest length, with the component that brings all to it."""
    top = np.abs(vectors).max(initial=0) or 1.0
    x = vectors / top
    square = (x * x).sum(1)
    most = np.sqrt(square.max(initial=0)) or 1.0
    x = x / most
    rest = np.sqrt(np.maximum(1.0 - (x * x).sum(1), 0.0))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def asked(vectors: np.ndarray) -> np.ndarray:
    """Queries (double) in the space of ``lifted``: any length gives the same order."""
    x = vectors / np.maximum(np.abs(vectors).max(1, initial=0), 1e-300)[:, None]
    x = x / np.sqrt((x * x).sum(1))[:, None]
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def search(graph: Graph, queries: np.ndarray, beam: int, trace: bool = False):
    """(nodes, nearness) of the best *beam* found, nearest first, -1 where there are fewer; with *trace* all nodes that were expanded.

    Nearness is the inner product of the lifted vectors.
    """
    q, n = len(queries), len(graph.points)
    mark = np.zeros((q, n), np.int32)
    ids, near = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    went: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merge(rows: np.ndarray, r: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        """Into the beams of *rows* the nodes v of near s, of the rows numbered r (in order)."""
        count = np.bincount(r, minlength=len(rows))
        wide = int(count.max(initial=0))
        if not wide:
            return
        at = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        new_ids, new_near = np.full((len(rows), wide), -1, np.int32), np.full((len(rows), wide), -np.inf, np.float32)
        new_ids[r, at], new_near[r, at] = v, s
        all_near = np.concatenate([near[rows], new_near], 1)
        best = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_near, best, 1), 1, kind="stable"), 1)
        near[rows] = np.take_along_axis(all_near, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_ids], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], new_ids < 0], 1), best, 1)

    every = np.arange(q)
    start = queries @ graph.points[graph.entries].T
    mark[:, graph.entries] = 1
    merge(every, np.repeat(every, len(graph.entries)), np.tile(graph.entries, q), start.ravel())
    step = 1
    while len(rows := np.flatnonzero(~done.all(1))):
        open_ = ~done[rows]
        take = open_ & (np.cumsum(open_, 1) <= WIDTH)
        r, c = np.nonzero(take)
        nodes = ids[rows[r], c]
        if trace:
            went.append((rows[r], nodes, near[rows[r], c]))
        done[rows] |= take
        v = graph.links[nodes]
        r = np.repeat(r, v.shape[1])
        v = v.ravel()
        ok = v >= 0
        r, v = r[ok], v[ok]
        # a node is looked at once a query: the first of several mentions
        fresh = mark[rows[r], v] == 0
        r, v = r[fresh], v[fresh]
        tag = np.arange(step, step + len(r), dtype=np.int32)
        step += len(r)
        mark[rows[r], v] = tag
        once = mark[rows[r], v] == tag
        r, v = r[once], v[once]
        merge(rows, r, v, np.einsum("ij,ij->i", queries[rows[r]], graph.points[v]))
    if not trace:
        return ids, near
    row, node, s = (np.concatenate(x) for x in zip(*went, strict=True))
    order = np.lexsort((-s, row))
    row, node, s = row[order], node[order], s[order]
    count = np.bincount(row, minlength=q)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    wide = min(int(count.max()), PROPOSALS)
    row, node, s, at = (x[at < wide] for x in (row, node, s, at))
    ids, near = np.full((q, wide), -1, np.int32), np.full((q, wide), -np.inf, np.float32)
    ids[row, at], near[row, at] = node, s
    return ids, near


def pruned(points: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of the nodes *own*, from their proposals *ids* (-1: none, in any order, repeats allowed)."""
    out = np.full((len(own), degree), -1, np.int32)
    for lo in range(0, len(own), BLOCK):
        me, c = own[lo : lo + BLOCK], ids[lo : lo + BLOCK]
        x = points[c]
        length = (x * x).sum(2)
        p = points[me]
        far = np.maximum(length + (p * p).sum(1)[:, None] - 2 * np.einsum("bcd,bd->bc", x, p), 0)
        far[(c < 0) | (c == me[:, None])] = np.inf
        order = np.argsort(far, 1, kind="stable")
        far, c, length = (np.take_along_axis(y, order, 1) for y in (far, c, length))
        x = np.take_along_axis(x, order[:, :, None], 1)
        each = np.arange(len(me))
        alive = np.isfinite(far)
        for k in range(degree):
            first = alive.argmax(1)
            has = alive[each, first]
            if not has.any():
                break
            out[lo + each[has], k] = c[each[has], first[has]]
            y = x[each, first]
            apart = np.maximum(length + length[each, first][:, None] - 2 * np.einsum("bcd,bd->bc", x, y), 0)
            # what is one node is gone as well
            alive &= (alpha * alpha * apart > far) & (c != c[each, first][:, None])
            alive[~has] = False
    return out


def _join(points: np.ndarray, links: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to *nodes* from their neighbours; those with more than there is room for are pruned to *degree*."""
    to = links[nodes]
    r, c = np.nonzero(to >= 0)
    source, target = nodes[r], to[r, c]
    known = (links[target] == source[:, None]).any(1)
    source, target = source[~known], target[~known]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    node, first, count = np.unique(target, return_index=True, return_counts=True)
    have = (links[node] >= 0).sum(1)
    fits = have + count <= links.shape[1]
    at = np.arange(len(target)) - np.repeat(first, count)
    easy = np.repeat(fits, count)
    links[target[easy], (np.repeat(have, count) + at)[easy]] = source[easy]
    hard = np.flatnonzero(~fits)
    hard = hard[np.argsort(count[hard], kind="stable")]
    for lo in range(0, len(hard), BLOCK):
        k = hard[lo : lo + BLOCK]
        wide = int(count[k].max())
        more = np.full((len(k), wide), -1, np.int32)
        which = np.repeat(np.arange(len(k)), count[k])
        place = np.arange(len(which)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
        more[which, place] = source[np.repeat(first[k], count[k]) + place]
        if wide > PROPOSALS:  # of very many the nearest are proposed
            s = np.einsum("bcd,bd->bc", points[more], points[node[k]])
            s[more < 0] = -np.inf
            more = np.take_along_axis(more, np.argpartition(-s, PROPOSALS, 1)[:, :PROPOSALS], 1)
        _put(links, node[k], pruned(points, node[k], np.concatenate([links[node[k]], more], 1), degree, alpha))


def _put(links: np.ndarray, nodes: np.ndarray, edges: np.ndarray) -> None:
    links[nodes] = -1
    links[nodes, : edges.shape[1]] = edges


def _entries(points: np.ndarray) -> np.ndarray:
    """The node nearest the middle, and each time the one farthest from those taken."""
    out = [int((points @ points.mean(0)).argmax())]
    near = points @ points[out[0]]
    while len(out) < min(ENTRIES, len(points)):
        out.append(int(near.argmin()))
        near = np.maximum(near, points @ points[out[-1]])
    return np.unique(np.array(out, np.int32))


def unreached(graph: Graph) -> np.ndarray:
    """Nodes that no path from an entry leads to."""
    seen = np.zeros(len(graph.points), bool)
    front = graph.entries
    while len(front):
        seen[front] = True
        after = np.unique(graph.links[front])
        front = after[(after >= 0) & ~seen[after]]
    return np.flatnonzero(~seen).astype(np.int32)


def build(points: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> Graph:
    """The graph of *points* (``lifted``, no two alike)."""
    n = len(points)
    # room for some edges more, so that few nodes are pruned each time
    links = np.full((n, degree + degree // 3), -1, np.int32)
    graph = Graph(points, links, _entries(points))
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([graph.entries, order[~np.isin(order, graph.entries)]])
    # the entries know each other; what is in the graph grows by half of itself at most
    k = len(graph.entries)
    _put(links, order[:k], pruned(points, order[:k], np.tile(order[:k], (k, 1)), degree, alpha))
    while k < n:
        nodes = order[k : k + max(1, min(k // 2, 2 * BLOCK))]
        ids, _ = search(graph, points[nodes], beam, trace=True)
        _put(links, nodes, pruned(points, nodes, ids, degree, alpha))
        _join(points, links, nodes, degree, alpha)
        k += len(nodes)
    for lo in range(0, n, 2 * BLOCK):
        nodes = order[lo : lo + 2 * BLOCK]
        ids, _ = search(graph, points[nodes], beam, trace=True)
        _put(links, nodes, pruned(points, nodes, np.concatenate([ids, links[nodes]], 1), degree, alpha))
        _join(points, links, nodes, degree, alpha)
    # a node without a way to it is a start of its own
    while len(alone := unreached(graph)):
        graph.entries = np.append(graph.entries, alone[:1])
    return graph
