"""Navigable small-world graphs over the vectors of a shard, built and searched many vectors at a time.

Vectors are numbered by falling level, so a layer holds the first ones of the numbering; layers are built from the top, in
batches that double. A vector within RADIUS of one that is in the graph already joins its ball instead, so a group of near
copies is one node, however large. Used inside Spark tasks on bounded shards only.
"""

from __future__ import annotations

import numpy as np

M, BEAM, BATCH = 16, 64, 256
#: Beam a search starts with, vectors of a shard that are audited, and the share of their links that must be found.
FIRST_BEAM, AUDITED, LEAST_RECALL = 24, 128, 0.98
_FAR = np.float32(-2)


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k most similar, in falling order."""
    if sims.shape[1] > 2 * k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)


def _ranks(rows: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal ascending values."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


class Graph:
    """Balls of a shard's vectors and a layered graph over their centres.

    vectors: one row each, in double precision, of length 1. threshold: the cosine from which two vectors link.
    """

    def __init__(self, vectors: np.ndarray, threshold: float, seed: int = 1) -> None:
        n = len(vectors)
        self.angle = float(np.arccos(threshold))
        self.threshold, self.radius = threshold, self.angle / 8
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        self.exact = vectors[self.order]
        self.x = self.exact.astype(np.float32)
        level = level[self.order]
        self.ball = np.full(n, -1, np.int64)
        self.layers: list[np.ndarray] = []
        for l in range(int(level[0]), -1, -1):
            self._layer(int((level >= l).sum()), 2 * M if l == 0 else M)
        self.members = np.argsort(self.ball, kind="stable")
        self.first = np.searchsorted(self.ball[self.members], np.arange(n + 1))
        self.reach = np.zeros(n)
        cosine = np.einsum("ij,ij->i", self.exact, self.exact[self.ball])
        np.maximum.at(self.reach, self.ball, np.where(self.ball == np.arange(n), 0, np.arccos(np.clip(cosine, -1, 1)) + 1e-7))
        self.beam = FIRST_BEAM

    # ---- building

    def _layer(self, n: int, width: int) -> None:
        """Adds a layer of the first n vectors; those that joined a ball in a layer above are in none below."""
        adjacent = np.full((n, width), -1, np.int32)
        self.layers.append(adjacent)
        todo = np.flatnonzero(np.where(self.ball[:n] < 0, True, self.ball[:n] == np.arange(n)))
        close, i = np.float32(np.cos(self.radius)), 0
        while i < len(todo):
            batch = todo[i : i + min(BATCH, max(1, i))]
            i += len(batch)
            new = batch[self.ball[batch] < 0]
            ids, sims = self._descend(self.x[batch], BEAM) if batch[0] != todo[0] else (np.full((1, 1), -1), np.full((1, 1), _FAR))
            among = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(among, _FAR)
            if len(new):
                joined = (self.ball[batch] < 0) & (sims[:, 0] >= close)
                self.ball[batch[joined]] = ids[joined, 0]
                near = among >= close
                for k in np.flatnonzero(near.any(1)).tolist():
                    if self.ball[batch[k]] in (-1, batch[k]):
                        self.ball[batch[k]] = batch[k]
                        self.ball[batch[near[k] & (self.ball[batch] < 0)]] = batch[k]
                alone = self.ball[batch] < 0
                self.ball[batch[alone]] = batch[alone]
            stays = self.ball[batch] == batch
            batch, ids, sims, among = batch[stays], ids[stays], sims[stays], among[np.ix_(stays, stays)]
            if not len(batch):
                continue
            ids = np.concatenate([ids, np.broadcast_to(batch, among.shape)], 1)
            chosen = self._diverse(batch, *_top(ids, np.concatenate([sims, among], 1), BEAM), width)
            adjacent[batch, : chosen.shape[1]] = chosen
            self._link_back(adjacent, batch, chosen)

    def _diverse(self, of: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of falling candidates those that are nearer to the vector than to any chosen before; others fill what is left."""
        ids = np.where(sims > _FAR, ids, -1)
        own = self.x[np.where(ids < 0, 0, ids)]
        between = own @ own.transpose(0, 2, 1)
        nearest, count = np.full(ids.shape, _FAR), np.zeros(len(ids), np.int64)
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            take = (ids[:, k] >= 0) & (count < width) & (nearest[:, k] < sims[:, k])
            taken[:, k] = take
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, :, k]), nearest)
        rank = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, rank, 1)

    def _link_back(self, adjacent: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen to the batch; lists that are too long keep diverse ones."""
        width = adjacent.shape[1]
        source, k = np.nonzero(chosen >= 0)
        target, source = chosen[source, k], batch[source]
        fresh = ~(adjacent[target] == source[:, None]).any(1)
        target, source = target[fresh], source[fresh]
        if not len(target):
            return
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[target], self.x[source]), target))
        target, source = target[order], source[order]
        rank = _ranks(target)
        target, source, rank = target[rank < width], source[rank < width], rank[rank < width]
        nodes, row = np.unique(target, return_inverse=True)
        ids = np.full((len(nodes), 2 * width), -1, np.int64)
        ids[:, :width] = adjacent[nodes]
        ids[row, width + rank] = source
        for a in range(0, len(nodes), BATCH):
            own, here = ids[a : a + BATCH], nodes[a : a + BATCH]
            sims = np.where(own >= 0, np.einsum("ij,ikj->ik", self.x[here], self.x[np.where(own < 0, 0, own)]), _FAR)
            adjacent[here] = self._diverse(here, *_top(own, sims, 2 * width), width)

    # ---- searching

    def _descend(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to `beam` near vectors of the lowest layer that there is, falling; the ways down take a single one each."""
        start = np.zeros((len(queries), 1), np.int64)
        for k, adjacent in enumerate(self.layers):
            ids, sims = self._walk(adjacent, queries, start, beam if k == len(self.layers) - 1 else 4)
            start = ids[:, :4]
        return ids, sims

    def _walk(self, adjacent: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(queries), len(adjacent)
        seen = np.zeros((b, n), bool)
        rows, k = np.nonzero(start >= 0)
        new = start[rows, k]
        ids, sims, done = np.full((b, beam), -1, np.int64), np.full((b, beam), _FAR), np.zeros((b, beam), bool)
        while len(rows):
            seen[rows, new] = True
            here = np.einsum("ij,ij->i", queries[rows], self.x[new])
            width = int(np.bincount(rows).max())
            more, more_sims = np.full((b, width), -1, np.int64), np.full((b, width), _FAR)
            rank = _ranks(rows)
            more[rows, rank], more_sims[rows, rank] = new, here
            sims = np.concatenate([sims, more_sims], 1)
            at = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            sims = np.take_along_axis(sims, at, 1)
            ids = np.take_along_axis(np.concatenate([ids, more], 1), at, 1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(more.shape, bool)], 1), at, 1)
            open_ = ~done & (ids >= 0)
            step = open_ & (np.cumsum(open_, 1) <= max(2, beam // 16))
            done |= step
            rows, k = np.nonzero(step)
            reached = adjacent[ids[rows, k]].astype(np.int64)
            rows, new = np.repeat(rows, reached.shape[1]), reached.ravel()
            fresh = new >= 0
            rows, new = rows[fresh], new[fresh]
            fresh = ~seen[rows, new]
            key = np.unique(rows[fresh] * n + new[fresh])
            rows, new = key // n, key % n
        return ids, sims

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of the query, centre) of the centres whose balls may hold a link; beams that are full of them are widened."""
        cosine = np.cos(min(np.pi, self.angle + self.reach.max() + 1e-6))
        todo, found_rows, found = np.arange(len(queries)), [], []
        while len(todo):
            full = []
            for a in range(0, len(todo), BATCH):
                own = todo[a : a + BATCH]
                ids, sims = self._descend(queries[own].astype(np.float32), beam)
                inside = sims >= cosine - 1e-5
                over = inside[:, -1] & (beam < len(self.x))
                full.append(own[over])
                rows, k = np.nonzero(inside & ~over[:, None])
                found_rows.append(own[rows])
                found.append(ids[rows, k])
            todo, beam = np.concatenate(full), min(2 * beam, len(self.x))
        return np.concatenate(found_rows), np.concatenate(found)

    def links(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, whole): whole balls by their centre where the angles alone tell, else single vectors, verified.

        queries have length 1 in double precision; own: the node that a query is, or -1: its ball is looked at in any case.
        """
        rows, centre = self.near(queries, beam)
        if own is not None:
            mine = np.flatnonzero(own >= 0)
            key = np.unique(np.concatenate([rows * len(self.x) + centre, mine * len(self.x) + self.ball[own[mine]]]))
            rows, centre = key // len(self.x), key % len(self.x)
        apart = np.arccos(np.clip(np.einsum("ij,ij->i", queries[rows], self.exact[centre]), -1, 1))
        single = self.first[centre + 1] - self.first[centre] == 1
        whole = ~single & (apart + self.reach[centre] < self.angle - 1e-7)
        open_ = ~whole & (apart - self.reach[centre] < self.angle + 1e-6)
        size = (self.first[centre + 1] - self.first[centre])[open_]
        ends = np.cumsum(size)
        at = np.repeat(self.first[centre[open_]] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        query, node = np.repeat(rows[open_], size), self.members[at]
        linked = np.zeros(len(node), bool)
        for a in range(0, len(node), 65_536):
            b = slice(a, a + 65_536)
            linked[b] = np.einsum("ij,ij->i", queries[query[b]], self.exact[node[b]]) >= self.threshold
        query, node = query[linked], node[linked]
        return np.concatenate([rows[whole], query]), np.concatenate([centre[whole], node]), np.concatenate([np.ones(int(whole.sum()), bool), np.zeros(len(query), bool)])

    # ---- auditing

    def audit(self) -> float:
        """Widens the beam until the links of audited vectors are found; the recall that was reached.

        Audited are AUDITED vectors spread over the shard, each moved to just inside the threshold, against all vectors.
        """
        rng, d = np.random.default_rng(7), self.exact.shape[1]
        some = self.exact[np.unique(np.linspace(0, len(self.exact) - 1, AUDITED).astype(np.int64))]
        if d > 1:
            aside = rng.standard_normal(some.shape)
            aside -= np.einsum("ij,ij->i", aside, some)[:, None] * some
            aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
            turn = self.angle * rng.uniform(0.3, 0.98, (len(some), 1))
            some = np.cos(turn) * some + np.sin(turn) * aside
        size = np.diff(self.first)
        true = sum(int((some @ self.exact[a : a + 4096].T >= self.threshold).sum()) for a in range(0, len(self.exact), 4096))
        while True:
            query, node, whole = self.links(some, self.beam)
            recall = (int(size[node[whole]].sum()) + int((~whole).sum())) / max(true, 1) if true else 1.0
            if recall >= LEAST_RECALL or self.beam >= len(self.x):
                return recall
            self.beam = min(2 * self.beam, len(self.x))
