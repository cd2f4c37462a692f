"""A hierarchical navigable small-world graph in flat neighbour arrays; many points are inserted or searched at once."""

from __future__ import annotations

import numpy as np

NONE = -1
EXPAND = 4


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


class HNSW:
    """Cosine nearness. links[k] has each node's neighbours in layer k, padded with -1; layer 0 has twice as many places."""

    def __init__(self, vectors: np.ndarray, m: int = 16, ef: int = 80, seed: int = 7, links: list[np.ndarray] | None = None, levels: np.ndarray | None = None):
        self.x, self.m, self.ef = _unit(vectors), m, ef
        n = len(vectors)
        if links is not None:
            self.links, self.levels = links, levels
            self.entry = int(levels.argmax()) if n else NONE
            return
        u = np.random.default_rng(seed).random(n)
        self.levels = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(np.int64)
        self.levels[:1] = self.levels.max(initial=0)  # the first point is the entry
        self.links = [np.full((n, 2 * m if k == 0 else m), NONE, np.int32) for k in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = 0 if n else NONE
        done = min(n, 1)
        while done < n:
            size = min(256, max(8, done // 2), n - done)
            self._insert(np.arange(done, done + size))
            done += size

    def _layer(self, q: np.ndarray, start: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The `ef` nearest found for each query from its start nodes, best first; ids are padded with -1."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column belongs to -1
        seen[rows, start] = True
        ids = np.full((n, ef), NONE, np.int64)
        sims = np.full((n, ef), -np.inf, np.float32)
        w = min(ef, start.shape[1])
        s = np.where(start >= 0, np.einsum("qmd,qd->qm", self.x[start], q), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, :w]
        ids[:, :w], sims[:, :w] = np.take_along_axis(start, order, 1), np.take_along_axis(s, order, 1)
        done = ids < 0
        live = np.arange(n)
        while len(live):
            wait = np.where(done[live], -np.inf, sims[live])
            best = np.argsort(-wait, axis=1, kind="stable")[:, :EXPAND]
            go = np.take_along_axis(wait, best, 1) > -np.inf
            on = go[:, 0]
            live, best, go = live[on], best[on], go[on]
            if not len(live):
                break
            node = np.where(go, ids[live[:, None], best], NONE)
            mark = done[live]
            np.put_along_axis(mark, best, np.take_along_axis(mark, best, 1) | go, 1)
            near = np.where(node[:, :, None] >= 0, self.links[k][node], NONE).reshape(len(live), -1).astype(np.int64)
            # a node reached twice at once counts once
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = NONE
            near[seen[live[:, None], near]] = NONE
            seen[live[:, None], near] = True
            s = np.einsum("qmd,qd->qm", self.x[near], q[live])
            s[near < 0] = -np.inf
            every, value, flag = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1), np.concatenate([mark, near < 0], 1)
            top = np.argpartition(-value, ef - 1, axis=1)[:, :ef]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (every, value, flag))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Of candidates, best first, at most m that are nearer to the query than to one chosen before; then the best of the rest."""
        n, c = ids.shape
        x = self.x[ids]
        pair = np.einsum("qad,qbd->qab", x, x)
        kept, count, nearest = np.zeros((n, c), bool), np.zeros(n, np.int64), np.full((n, c), -np.inf, np.float32)
        for k in range(c):
            take = (ids[:, k] >= 0) & (count < m) & (sims[:, k] > nearest[:, k])
            kept[:, k] = take
            count += take
            nearest[take] = np.maximum(nearest[take], pair[take, k])
        rank = np.where(ids < 0, 3 * c, np.where(kept, 0, c) + np.arange(c))
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(ids, order, 1)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry, np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        for k in range(len(self.links) - 1, -1, -1):
            here = np.flatnonzero(self.levels[new] >= k)
            above = np.flatnonzero(self.levels[new] < k)
            found = np.full((len(new), self.ef), NONE, np.int64)
            if len(above):
                found[above, :1] = self._layer(q[above], start[above], k, 4)[0][:, :1]
            if len(here):
                ids, sims = self._layer(q[here], start[here], k, self.ef)
                found[here] = ids
                # the other new points of this layer are candidates too
                mates = min(self.m, len(here) - 1)
                if mates:
                    own = among[np.ix_(here, here)]
                    top = np.argsort(-own, axis=1, kind="stable")[:, :mates]
                    ids, sims = np.concatenate([ids, new[here][top]], 1), np.concatenate([sims, np.take_along_axis(own, top, 1)], 1)
                    order = np.argsort(-sims, axis=1, kind="stable")[:, : self.ef]
                    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                chosen = self._chosen(ids, sims, self.m)
                self.links[k][new[here], : chosen.shape[1]] = chosen
                self._back(np.repeat(new[here], chosen.shape[1]), chosen.reshape(-1), k)
            start = found[:, : max(1, min(4, found.shape[1]))]
            start = np.where(start >= 0, start, start[:, :1])

    def _back(self, a: np.ndarray, b: np.ndarray, k: int) -> None:
        """Links from b to a; a node with too many keeps a chosen part of them."""
        a, b = a[b >= 0], b[b >= 0]
        if not len(a):
            return
        links = self.links[k]
        width = links.shape[1]
        sim = np.einsum("nd,nd->n", self.x[a], self.x[b])
        order = np.lexsort((-sim, b))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(head, np.diff(np.append(head, len(b))))
        a, row, rank = a[rank < width], (np.cumsum(np.concatenate([[True], b[1:] != b[:-1]])) - 1)[rank < width], rank[rank < width]
        target = b[head]
        ids = np.full((len(target), 2 * width), NONE, np.int64)
        ids[:, :width] = links[target]
        ids[row, width + rank] = a
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = NONE
        count = (ids >= 0).sum(1)
        few = count <= width
        some = -np.sort(-ids[few], axis=1)[:, :width]
        links[target[few]] = some
        many = np.flatnonzero(~few)
        for i in range(0, len(many), 256):
            t = many[i : i + 256]
            sims = np.einsum("qmd,qd->qm", self.x[ids[t]], self.x[target[t]])
            sims[ids[t] < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            links[target[t]] = self._chosen(np.take_along_axis(ids[t], order, 1), np.take_along_axis(sims, order, 1), width)

    def search(self, queries: np.ndarray, k: int, ef: int = 160) -> np.ndarray:
        """The k nearest nodes found for each query, best first, padded with -1."""
        out = np.full((len(queries), k), NONE, np.int64)
        if self.entry == NONE:
            return out
        for i in range(0, len(queries), 256):
            q = _unit(queries[i : i + 256])
            start = np.full((len(q), 1), self.entry, np.int64)
            for layer in range(len(self.links) - 1, 0, -1):
                start = self._layer(q, start, layer, 4)[0][:, :1]
            ids = self._layer(q, start, 0, max(ef, k))[0]
            out[i : i + 256] = ids[:, :k]
        return out
