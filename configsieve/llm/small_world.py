"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Searches and insertions run for many vectors side by side: each step opens the
best unopened node of every beam.
"""

from __future__ import annotations

import numpy as np

#: Links that a new node makes in a layer; a node keeps twice as many at the bottom.
LINKS = 16
BUILD_BEAM = 48
#: Vectors inserted, or searched for, side by side.
SIDE_BY_SIDE = 512
#: Bytes of vectors gathered, or compared with each other, at once, and places of all beams at once, about.
ROOM = 16 << 20
PLACES = 1 << 18


class SmallWorld:
    """`layers` (top first) hold the links of each node, -1 where there are none; `order` begins with
    the members of the top layer, then those of the next, and so on."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None, order: np.ndarray | None = None):
        self.unit = np.ascontiguousarray(unit, dtype=np.float32)
        if layers is not None:
            self.layers, self.order = layers, order
            return
        n = len(unit)
        draws = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")
        self.layers = []
        above = 0
        for height in range(int(level.max(initial=0)), -1, -1):
            members = int((level >= height).sum())
            self._add_layer(members, above, 2 * LINKS if height == 0 else LINKS)
            above = members

    def members_only(self) -> list[np.ndarray]:
        """The layers without the rows of nodes that are not in them."""
        levels = np.array([(links >= 0).any(1) for links in self.layers])[:, self.order]
        return [links[self.order[: int(np.flatnonzero(level)[-1]) + 1 if level.any() else 0]] for links, level in zip(self.layers, levels)]

    @staticmethod
    def whole_layers(members: list[np.ndarray], order: np.ndarray) -> list[np.ndarray]:
        """The layers that `members_only` was made of."""
        layers = [np.full((len(order), links.shape[1]), -1, np.int32) for links in members]
        for layer, links in zip(layers, members):
            layer[order[: len(links)]] = links
        return layers

    def _add_layer(self, members: int, above: int, width: int) -> None:
        """Insert the members of a layer, those of the layers above first."""
        links = np.full((len(self.unit), width), -1, np.int32)
        done = 0
        while done < members:
            new = self.order[done : done + min(SIDE_BY_SIDE, max(64, done // 2), members - done)]
            sims_new = self.unit[new] @ self.unit[new].T
            np.fill_diagonal(sims_new, -np.inf)
            few = min(BUILD_BEAM // 2, len(new))
            near = np.argpartition(-sims_new, few - 1, axis=1)[:, :few]
            ids, sims = new[near], np.take_along_axis(sims_new, near, 1)
            if done:
                entry = self._descended(self.unit[new]) if done >= above else np.full(len(new), self.order[0])
                old, old_sims = self._beam(self.unit[new], entry, BUILD_BEAM, links)
                ids, sims = np.hstack([ids, old]), np.hstack([sims, old_sims])
            ids = np.where(np.isfinite(sims), ids, -1)
            links[new, :LINKS] = self._diverse(ids, sims, LINKS)
            self._link_back(new, links)
            done += len(new)
        self.layers.append(links)

    def _descended(self, q: np.ndarray, bottom: int | None = None) -> np.ndarray:
        """The closest node found by going down the layers, up to layer `bottom`."""
        at = np.full(len(q), self.order[0])
        for links in self.layers[:bottom]:
            at = self._beam(q, at, 1, links)[0][:, 0]
        return at

    def _at_once(self, width: int) -> int:
        """How many rows of `width` nodes each fit the room, by the vectors gathered and the pairs compared."""
        return max(1, ROOM // (4 * width * max(width, self.unit.shape[1])))

    def _similar(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The similarity of each row of nodes to the row's vector."""
        out, step = np.empty(ids.shape, np.float32), self._at_once(ids.shape[1])
        for lo in range(0, len(ids), step):
            out[lo : lo + step] = (self.unit[ids[lo : lo + step]] @ q[lo : lo + step, :, None])[:, :, 0]
        return out

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates, those closer to the row's vector than to one chosen before; the rest fills up."""
        step = self._at_once(min(ids.shape[1], BUILD_BEAM + LINKS))
        parts = [self._diverse_rows(ids[lo : lo + step], sims[lo : lo + step], width) for lo in range(0, len(ids), step)]
        return np.concatenate(parts)

    def _diverse_rows(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        order = np.argsort(-sims, axis=1, kind="stable")[:, : BUILD_BEAM + LINKS]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        own = self.unit[ids]
        between = own @ own.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            closest = np.where(chosen, between[:, k], -np.inf).max(1)
            chosen[:, k] = (ids[:, k] >= 0) & (closest < sims[:, k]) & (chosen.sum(1) < width)
        first = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, first, 1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _link_back(self, new: np.ndarray, links: np.ndarray) -> None:
        """Offer the new nodes to the nodes they link to, which choose again among all they have."""
        source = np.repeat(new, LINKS)
        target = links[new, :LINKS].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        sims = (self.unit[source] * self.unit[target]).sum(1)
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        most = min(int(count.max()), links.shape[1])
        extra = np.full((len(nodes), most), -1, np.int64)
        row, place = np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(start, count)
        fits = place < most
        extra[row[fits], place[fits]] = source[fits]
        ids = np.hstack([links[nodes], extra])
        step = self._at_once(ids.shape[1])
        for lo in range(0, len(ids), step):
            few = ids[lo : lo + step]
            repeated = (few[:, None, :] == few[:, :, None]) & np.tri(few.shape[1], k=-1, dtype=bool)
            few[repeated.any(2)] = -1
        sims = self._similar(ids, self.unit[nodes])
        sims[ids < 0] = -np.inf
        links[nodes] = self._diverse(ids, sims, links.shape[1])

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` closest nodes found for each vector, and their similarities; -1 and -inf where fewer."""
        n = len(q)
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.unit)), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = entry, (q * self.unit[entry]).sum(1), False
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while True:
            waiting = np.where(opened[active], -np.inf, sims[active])
            best = waiting.argmax(1)
            more = np.isfinite(waiting[np.arange(len(active)), best])
            active, best = active[more], best[more]
            if not len(active):
                return ids, sims
            near = links[ids[active, best]]
            opened[active, best] = True
            rows = np.repeat(active[:, None], near.shape[1], 1)
            fresh = (near >= 0) & ~seen[rows, near]
            seen[rows[fresh], near[fresh]] = True
            found = self._similar(near, q[active])
            found[~fresh] = -np.inf
            all_sims = np.hstack([sims[active], found])
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, 1)
            ids[active] = np.take_along_axis(np.hstack([ids[active], near]), top, 1)
            opened[active] = np.take_along_axis(np.hstack([opened[active], ~fresh]), top, 1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, node) pairs found with a similarity of `least` or more.

        A beam that ends with nodes all that close may have left some out; it is
        widened until it ends with others, or holds every node.
        """
        out_rows, out_ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(q), SIDE_BY_SIDE):
            rows, width = np.arange(lo, min(lo + SIDE_BY_SIDE, len(q))), beam
            entry = self._descended(q[rows], -1)
            while len(rows):
                width = min(width, len(self.unit))
                wider, step = [], max(1, PLACES // width)
                for at in range(0, len(rows), step):
                    few = slice(at, at + step)
                    ids, sims = self._beam(q[rows[few]], entry[few], width, self.layers[-1])
                    full = (sims >= least).all(1) & (width < len(self.unit))
                    hit = (sims >= least) & ~full[:, None]
                    out_rows.append(rows[few][np.nonzero(hit)[0]])
                    out_ids.append(ids[hit])
                    wider.append(full)
                full = np.concatenate(wider)
                rows, entry, width = rows[full], entry[full], 4 * width
        return np.concatenate(out_rows), np.concatenate(out_ids)
