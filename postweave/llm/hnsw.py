"""Hierarchical navigable small-world graph of one shard, built and searched in batches."""

from __future__ import annotations

import numpy as np

LINKS = 16  # per node on upper layers, twice as many on the lowest
BUILD_BEAM = 64
BATCH = 256
EXTRA = 4  # places per node for links that pruning must not take
NONE = np.float32(-2)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares are finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Graph:
    """Layers of links between unit vectors; node numbers are rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        """Nodes enter in batches: each finds its neighbours among those before it
        by beam search and among its batch by a product, and is linked both ways.
        """
        n = len(vectors)
        vectors = np.ascontiguousarray(vectors, np.float32)
        draw = np.random.default_rng(seed).random(n)
        levels = np.floor(-np.log(1 - draw) / np.log(LINKS)).astype(int)
        top = int(levels.max()) if n else 0
        levels[0] = top  # the first node is the entry on every layer
        layers = [
            np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)
        ]
        graph = cls(vectors, layers, 0)
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + max(1, min(BATCH, done))))
            graph._insert(new, levels)
            done = new[-1] + 1
        graph._join_up()
        return graph

    def _join_up(self) -> None:
        """Every node can be reached on the lowest layer.

        Pruning may leave a node without a link to it, most of all in a dense
        group. Such a node is linked from the nearest node that is reached and
        has one of the extra places free.
        """
        n = len(self.vectors)
        links = np.hstack([self.layers[0], np.full((n, EXTRA), -1, np.int32)])
        used = np.zeros(n, int)
        reached = np.zeros(n, bool)
        front = np.array([self.entry])[:n]
        while True:
            while len(front):
                reached[front] = True
                front = np.unique(links[front])
                front = front[(front >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            node = lost[0]
            free = np.flatnonzero(reached & (used < EXTRA))
            near = free[np.argmax(self.vectors[free] @ self.vectors[node])]
            links[near, self.layers[0].shape[1] + used[near]] = node
            used[near] += 1
            front = np.array([node])
        self.layers[0] = links[:, : self.layers[0].shape[1] + int(used.max(initial=0))]

    def _insert(self, new: np.ndarray, levels: np.ndarray) -> None:
        queries = self.vectors[new]
        among = queries @ queries.T
        np.fill_diagonal(among, NONE)
        entries = np.full((len(new), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            ids, sims = self.search_layer(queries, layer, entries, BUILD_BEAM if layer == 0 else LINKS)
            entries = ids[:, :4]
            own = np.flatnonzero(levels[new] >= layer)
            if not len(own):
                continue
            mates = np.where(levels[new][None, :] >= layer, among[own], NONE)
            near = np.argsort(-mates, axis=1)[:, : 2 * LINKS]
            mate_sims = np.take_along_axis(mates, near, 1)
            mate_ids = np.where(mate_sims > NONE, new[near], -1)
            self._link(new[own], np.hstack([ids[own], mate_ids]), np.hstack([sims[own], mate_sims]), layer)

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        links[nodes] = self._chosen(ids, sims, links.shape[1])
        # The other way: all links that now end at a node, with those it had.
        ends = links[nodes].ravel()
        froms = np.repeat(nodes, links.shape[1])[ends >= 0]
        ends = ends[ends >= 0]
        value = np.einsum("ij,ij->i", self.vectors[ends], self.vectors[froms])
        order = np.lexsort((-value, ends))
        ends, froms, value = ends[order], froms[order], value[order]
        first = np.r_[True, ends[1:] != ends[:-1]]
        at = np.arange(len(ends)) - np.maximum.accumulate(np.where(first, np.arange(len(ends)), 0))
        fits = at < links.shape[1]
        targets = ends[first]
        row = (np.cumsum(first) - 1)[fits]
        more = np.full((len(targets), links.shape[1]), -1, np.int32)
        more_sims = np.full(more.shape, NONE, np.float32)
        more[row, at[fits]], more_sims[row, at[fits]] = froms[fits], value[fits]
        for a in range(0, len(targets), BATCH):
            part = targets[a : a + BATCH]
            old = links[part]
            old_sims = np.einsum("ikj,ij->ik", self.vectors[old], self.vectors[part])
            old_sims = np.where(old >= 0, old_sims, NONE)
            both = np.hstack([old, more[a : a + BATCH]])
            both_sims = np.hstack([old_sims, more_sims[a : a + BATCH]])
            # A mate may have linked back already.
            sort = np.argsort(both, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(both, sort, 1)
            twice = np.zeros(both.shape, bool)
            np.put_along_axis(twice, sort[:, 1:], (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0), 1)
            both_sims = np.where(twice | (both < 0), NONE, both_sims)
            links[part] = self._chosen(np.where(both_sims > NONE, both, -1), both_sims, links.shape[1])

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the diverse ones, then the nearest of the rest.

        A candidate is diverse if no chosen one is more similar to it than the
        node is. Rows that have room take all.
        """
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = ids[:, :most].astype(np.int32)
        full = np.flatnonzero((ids[:, most:] >= 0).any(axis=1)) if ids.shape[1] > most else []
        if len(full):
            ids, sims = ids[full], sims[full]
            near = self.vectors[ids]
            mutual = np.matmul(near, near.transpose(0, 2, 1))
            count = np.zeros(len(full), int)
            width = ids.shape[1]
            chosen = np.zeros(ids.shape, bool)
            closest = np.full(ids.shape, NONE, np.float32)
            for c in range(width):
                # Half of the places go to diverse neighbours at most.
                take = (closest[:, c] < sims[:, c]) & (ids[:, c] >= 0) & (count < most // 2)
                chosen[:, c] = take
                count += take
                at = np.flatnonzero(take)
                if len(at):
                    closest[at, c + 1 :] = np.maximum(closest[at, c + 1 :], mutual[at, c, c + 1 :])
            rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
            best = np.argsort(rank, axis=1)[:, :most]
            out[full] = np.take_along_axis(ids, best, 1)
        return out

    def search_layer(
        self, queries: np.ndarray, layer: int, entries: np.ndarray, beam: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, nearest first; -1 where fewer."""
        links, n, rows = self.layers[layer], len(self.vectors), len(queries)
        seen = np.zeros((rows, n), bool)
        ids = np.full((rows, beam), -1, np.int32)
        sims = np.full((rows, beam), NONE, np.float32)
        open_ = np.zeros((rows, beam), bool)
        found, active = entries, np.arange(rows)
        while len(active):
            found = np.sort(found, axis=1)
            fresh = found >= 0
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            fresh &= ~seen[active[:, None], found]
            at, column = np.nonzero(fresh)
            nodes = found[at, column]
            seen[active[at], nodes] = True
            value = np.full(found.shape, NONE, np.float32)
            value[at, column] = np.einsum("ij,ij->i", queries[active[at]], self.vectors[nodes])
            all_ids = np.hstack([ids[active], np.where(fresh, found, -1)])
            all_sims = np.hstack([sims[active], value])
            all_open = np.hstack([open_[active], fresh])
            best = np.argsort(-all_sims, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            still = np.take_along_axis(all_open, best, 1)
            # The best few that are open are followed next, more of a wide beam.
            next_ = np.argsort(~still, axis=1, kind="stable")[:, : max(4, beam // 16)]
            follow = np.take_along_axis(still, next_, 1)
            nodes = np.where(follow, np.take_along_axis(ids[active], next_, 1), -1)
            np.put_along_axis(still, next_, False, 1)
            open_[active] = still
            going = follow.any(axis=1)
            nodes, active = nodes[going], active[going]
            found = np.where(nodes[:, :, None] >= 0, links[nodes], -1)
            found = found.reshape(len(active), nodes.shape[1] * links.shape[1])
        return ids, sims

    def search(
        self, queries: np.ndarray, beam: int, own: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers, then the lowest one; ``own``: nodes at which to begin as well."""
        entries = np.full((len(queries), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            entries = self.search_layer(queries, layer, entries, 8)[0]
        if own is not None:
            entries = np.hstack([entries, own[:, None].astype(np.int32)])
        return self.search_layer(queries, 0, entries, beam)

    def within(
        self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of at least ``least``; beams that fill up are widened."""
        queries = np.ascontiguousarray(queries, np.float32)
        out = []
        todo = np.arange(len(queries))
        while len(todo):
            again = []
            size = max(8, min(BATCH, (1 << 16) // beam))
            for a in range(0, len(todo), size):
                part = todo[a : a + size]
                ids, sims = self.search(queries[part], beam, None if own is None else own[part])
                near = (sims >= least) & (ids >= 0)
                wide = (near.sum(axis=1) > beam // 2) & (beam < len(self.vectors))
                again.append(part[wide])
                row, column = np.nonzero(near & ~wide[:, None])
                out.append((part[row], ids[row, column]))
            todo = np.concatenate(again)
            beam *= 4
        rows = np.concatenate([r for r, _ in out]) if out else np.zeros(0, int)
        nodes = np.concatenate([c for _, c in out]) if out else np.zeros(0, int)
        return rows, nodes

    def audited(
        self, queries: np.ndarray, least: float, beam: int, target: float, sample: int,
        own: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, int, float]:
        """``within`` with a beam wide enough for an audit: pairs, beam and recall.

        Evenly spaced queries are compared with all vectors; while the search
        finds less than ``target`` of their pairs, all beams are widened.
        """
        checked = np.unique(np.linspace(0, len(queries) - 1, min(sample, len(queries))).astype(int))
        exact = queries[checked].astype(np.float32) @ self.vectors.T >= least
        true = int(exact.sum())
        while True:
            rows, nodes = self.within(queries, least, beam, own)
            place = np.searchsorted(checked, rows)
            place[place == len(checked)] = 0
            audited = checked[place] == rows
            hit = int(exact[place[audited], nodes[audited]].sum())
            recall = hit / true if true else 1.0
            if recall >= target or beam >= len(self.vectors):
                return rows, nodes, beam, recall
            beam *= 4
