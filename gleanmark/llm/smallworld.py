"""Navigable small-world graphs over unit vectors, searched by beams, many queries at once in numpy."""

from __future__ import annotations

import pickle

import numpy as np

#: Nearest nodes that each node is linked to (and by), and links to nodes far away.
LINKS, FAR = 6, 2
BEAM = 8
#: Open nodes of a beam that are expanded at once.
EXPANDED = 4
#: Share of the true neighbours above the floor that a beam must find on the tuning queries.
RECALL = 0.99
TUNING_QUERIES = 24
#: Rows of a block of similarities, and queries searched at once.
BLOCK = 1_024


class Graph:
    """One shard: every node is linked to its nearest nodes, in both directions, and to a few far ones.

    Nodes belong to cells (``cell`` of each membership, ``at`` its node); a query that knows its cells starts there.
    """

    def __init__(self, vectors: np.ndarray, cells: np.ndarray | None = None, at: np.ndarray | None = None, links: int = LINKS, beam: int = BEAM):
        self.x, self.beam, n = np.ascontiguousarray(vectors, dtype=np.float32), beam, len(vectors)
        order = np.argsort(cells, kind="stable") if cells is not None else np.zeros(0, np.int64)
        self.cells = cells[order] if cells is not None else np.zeros(0, np.int64)
        self.at = at[order].astype(np.int32) if at is not None else np.zeros(0, np.int32)
        self.near = self._linked(links) if n else np.zeros((0, 2 * links + FAR + 1), np.int32)

    def _linked(self, links: int) -> np.ndarray:
        n = len(self.x)
        own = np.full((n, links), -1, dtype=np.int32)
        for first in range(0, n, BLOCK):
            sims = self.x[first : first + BLOCK] @ self.x.T
            sims[np.arange(len(sims)), np.arange(first, first + len(sims))] = -2
            rows = np.arange(len(sims))
            for k in range(min(links, n - 1)):
                best = own[first : first + BLOCK, k] = sims.argmax(axis=1)
                sims[rows, best] = -2
        # Links back, as many as there is room for.
        back = np.full((n, links), -1, dtype=np.int32)
        source, target = np.repeat(np.arange(n, dtype=np.int32), links), own.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        fits = place < links
        back[target[fits], place[fits]] = source[fits]
        far = np.random.default_rng(n).integers(0, n, (n, FAR), dtype=np.int32)
        # A chain through all nodes, so that each can be reached even among equal vectors.
        return np.concatenate([own, back, far, ((np.arange(n, dtype=np.int32) + 1) % n)[:, None]], axis=1)

    def members(self, cells: list[np.ndarray], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of the nodes of each query's cells; of a cell at most ``most``, spread over it."""
        query, flat = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells) if len(cells) else np.zeros(0, np.int64)
        first = np.searchsorted(self.cells, flat)
        size = np.searchsorted(self.cells, flat, side="right") - first
        take = size if most is None else np.minimum(size, most)
        pair = np.repeat(np.arange(len(flat)), take)
        place = np.arange(len(pair)) - (np.cumsum(take) - take)[pair]
        if most is not None:
            place = place * (size - 1)[pair] // np.maximum(take - 1, 1)[pair]
        return query[pair], self.at[first[pair] + place].astype(np.int64)

    def starts(self, cells: list[np.ndarray], most: int = 12) -> np.ndarray:
        """Nodes to start from: some of each query's cells, and some that are spread over the graph."""
        n = len(self.x)
        spread = np.unique(np.linspace(0, n - 1, min(n, 4)).astype(np.int32))
        out = np.full((len(cells), most + len(spread)), -1, dtype=np.int32)
        out[:, most:] = spread
        query, node = self.members(cells, most)
        step = np.maximum(1, np.bincount(query, minlength=len(cells)) // most)
        met = np.unique(query * n + node)
        query, node = met // n, met % n
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = (place % step[query] == 0) & (place // step[query] < most)
        out[query[kept], (place // step[query])[kept]] = node[kept]
        return out

    def search(self, queries: np.ndarray, beam: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes met for each query (-1 where there are fewer) and their similarities."""
        if starts is None:
            starts = self.starts([np.zeros(0, np.int64)] * len(queries))
        return Joined([self]).search(queries, np.zeros(len(queries), np.int64), beam, starts)

    def tune(self, floor: float) -> int:
        """Widens the beam until it finds what an exhaustive search finds above ``floor``, on spread-out queries."""
        Joined([self]).tune(floor)
        return self.beam

    def above(self, queries: np.ndarray, floor: float, cells: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of similarity at least ``floor``. A beam that is full of such nodes is widened, so none is capped."""
        return Joined([self]).above([queries], floor, [cells])[0]

    def packed(self) -> bytes:
        """The graph as it is stored; vectors as signed bytes."""
        scaled = np.clip(np.round(self.x * 127), -127, 127).astype(np.int8)
        return pickle.dumps((scaled, self.near.astype(np.int16 if len(self.x) < 1 << 15 else np.int32), self.cells, self.at, self.beam), protocol=5)

    @classmethod
    def unpacked(cls, stored: bytes) -> Graph:
        graph = cls.__new__(cls)
        scaled, near, graph.cells, graph.at, graph.beam = pickle.loads(stored)
        graph.x, graph.near = unit(scaled), near.astype(np.int32)
        return graph


class Joined:
    """Several graphs side by side, whose queries are searched together: each stays in its own graph."""

    def __init__(self, graphs: list[Graph]):
        self.graphs, self.sizes = graphs, np.array([len(g.x) for g in graphs], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.x = np.concatenate([g.x for g in graphs])
        # A missing link leads to the node itself.
        self.near = np.concatenate([np.where(g.near < 0, np.arange(len(g.x))[:, None], g.near) + first for g, first in zip(graphs, self.first)])

    def starts(self, cells: list[list[np.ndarray] | None], asking: list[int]) -> np.ndarray:
        """Nodes to start from: of each graph's queries by their cells, or of as many as are ``asking`` without any."""
        own = [g.starts(c if c is not None else [np.zeros(0, np.int64)] * n) for g, c, n in zip(self.graphs, cells, asking)]
        out = np.full((sum(asking), max((o.shape[1] for o in own), default=0)), -1, dtype=np.int32)
        at = 0
        for o, first in zip(own, self.first):
            out[at : at + len(o), : o.shape[1]] = np.where(o < 0, -1, o + first)
            at += len(o)
        return out

    def search(self, queries: np.ndarray, of: np.ndarray, beam: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes met for each query in the graph ``of`` it (-1 where there are fewer) and their similarities."""
        if len(queries) > BLOCK:
            parts = [self.search(queries[a : a + BLOCK], of[a : a + BLOCK], beam, starts[a : a + BLOCK]) for a in range(0, len(queries), BLOCK)]
            width = max(p[0].shape[1] for p in parts)
            wide = lambda a, none: np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=none)
            return np.concatenate([wide(p[0], -1) for p in parts]), np.concatenate([wide(p[1], -2.0) for p in parts])
        n, q = int(self.sizes[of].max(initial=0)), len(queries)
        width = min(beam, n)
        rows, own = np.arange(q), np.arange(q) * n - self.first[of]
        # Cells of a query and a node of its graph: whether they met, and the last place of the node in what was looked at.
        seen, last = np.zeros(q * n, dtype=bool), np.empty(q * n, dtype=np.int32)
        ids, sims, done = np.full((q, width), -1, np.int32), np.full((q, width), -2.0, np.float32), np.ones((q, width), bool)

        def met(asking: np.ndarray, nodes: np.ndarray) -> None:
            """Keeps the best of what is known and of ``nodes``, some for each query in ``asking``, each node once."""
            cell = (own[asking][:, None] + nodes).ravel()
            fresh = np.flatnonzero(~seen[cell])
            cell = cell[fresh]
            place = np.arange(len(cell), dtype=np.int32)
            last[cell] = place
            once = last[cell] == place
            cell, r = cell[once], asking[fresh[once] // nodes.shape[1]]
            seen[cell] = True
            nodes = cell - own[r]
            values = np.einsum("ij,ij->i", self.x[nodes], queries[r])
            better = values > sims.min(axis=1)[r]
            nodes, r, values = nodes[better], r[better], values[better]
            if not len(r):
                return
            count = np.bincount(r, minlength=q)
            some = np.flatnonzero(count)
            to, place = (np.cumsum(count > 0) - 1)[r], width + np.arange(len(r)) - (np.cumsum(count) - count)[r]
            more = ((0, 0), (0, int(count.max())))
            all_ids, all_sims, all_done = np.pad(ids[some], more, constant_values=-1), np.pad(sims[some], more, constant_values=-2.0), np.pad(done[some], more, constant_values=True)
            all_ids[to, place], all_sims[to, place], all_done[to, place] = nodes, values, False
            best = np.argpartition(all_sims, -width, axis=1)[:, -width:]
            ids[some], sims[some], done[some] = (np.take_along_axis(v, best, axis=1) for v in (all_ids, all_sims, all_done))

        r, c = np.nonzero(starts >= 0)
        met(r, starts[r, c][:, None])
        active = rows
        while True:
            todo = np.where(done[active], -3.0, sims[active])
            still = todo.max(axis=1, initial=-3.0) > -2.5
            if not still.any():
                return ids, sims
            # The best few open nodes of each query are expanded at once.
            active, todo = active[still], todo[still]
            few = min(EXPANDED, width)
            pick = np.argpartition(todo, -few, axis=1)[:, -few:]
            opened = np.take_along_axis(todo, pick, axis=1) > -2.5
            nodes = ids[active[:, None], pick]
            done[active[:, None], pick] = True
            r, c = np.nonzero(opened)
            met(active[r], self.near[nodes[r, c]])

    def tune(self, floor: float) -> None:
        """Widens the beam of each graph until it finds what an exhaustive search finds above ``floor``, on spread-out queries."""
        own = [np.unique(np.linspace(0, n - 1, min(n, TUNING_QUERIES)).astype(np.int64)) if n else np.zeros(0, np.int64) for n in self.sizes.tolist()]
        exact = np.array([(g.x[k] @ g.x.T >= floor).sum() for g, k in zip(self.graphs, own)])
        cells = [[g.cells[g.at == k] for k in ks] if len(g.at) else None for g, ks in zip(self.graphs, own)]
        of = np.repeat(np.arange(len(own)), [len(k) for k in own])
        starts, queries = self.starts(cells, [len(k) for k in own]), self.x[np.concatenate(own) + self.first[of]] if own else self.x
        open_ones = {k for k, g in enumerate(self.graphs) if g.beam < len(g.x)}
        while open_ones:
            beam = min(self.graphs[k].beam for k in open_ones)
            tried = np.array(sorted(k for k in open_ones if self.graphs[k].beam == beam))
            asked = np.isin(of, tried)
            ids, sims = self.search(queries[asked], of[asked], beam, starts[asked])
            found = np.bincount(of[asked], ((ids >= 0) & (sims >= floor - 1e-6)).sum(axis=1), len(own))
            for k in tried.tolist():
                if found[k] < RECALL * exact[k]:
                    self.graphs[k].beam *= 2
                if found[k] >= RECALL * exact[k] or self.graphs[k].beam >= len(self.graphs[k].x):
                    open_ones.discard(k)

    def above(self, queries: list[np.ndarray], floor: float, cells: list[list[np.ndarray] | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each graph, the pairs (query, node) of its queries and nodes of similarity at least ``floor``. A beam that is
        full of such nodes is widened, so none is capped."""
        asking = [len(q) for q in queries]
        of, before = np.repeat(np.arange(len(asking)), asking), np.cumsum(asking) - asking
        every, starts = np.concatenate(queries), self.starts(cells, asking)
        beams = np.array([g.beam for g in self.graphs], dtype=np.int64)[of]
        todo, found = np.arange(len(of))[self.sizes[of] > 0], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(todo):
            beam = int(beams[todo].min())
            now = todo[beams[todo] == beam]
            ids, sims = self.search(every[now], of[now], beam, starts[now])
            hit = (ids >= 0) & (sims >= floor)
            full = (hit.sum(axis=1) >= beam) & (beam < self.sizes[of[now]])
            q, k = np.nonzero(hit & ~full[:, None])
            found.append((now[q], ids[q, k].astype(np.int64)))
            beams[now[full]] *= 2
            todo = np.setdiff1d(todo, now[~full])
        q, n = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(of[q], kind="stable")
        q, n = q[order], n[order]
        cuts = np.searchsorted(of[q], np.arange(1, len(asking)))
        return [(a - at, b - first) for a, b, at, first in zip(np.split(q, cuts), np.split(n, cuts), before, self.first)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = vectors.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
