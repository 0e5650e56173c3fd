"""Chinese-restaurant seating of many dishes at once, sampled by Gibbs.

A cell is a dish of a restaurant with ``n`` customers at ``t`` tables. A step
takes one customer of each cell from their table and seats them again, given
everybody else: at a table by its customers less the discount, or at a new one
by its strength, (theta + discount * tables of the restaurant) * the parent's
probability of the dish. Cells are seated side by side, under totals and
parents' probabilities that hold for the whole sweep.

A sweep takes as many customers of a cell as the cell has. Those of a cell of
more than ``ONE_BY_ONE`` are taken in that many groups, which any customer joins
by the same chance; a group is seated given all others, its members side by side.
"""

from __future__ import annotations

import numpy as np

#: Customers that are seated one by one at first, and size of the cells whose customers sweeps take one by one; others come and are taken in groups.
ONE_BY_ONE = 64
#: Tables of a cell that are looked at one after another; further ones are found in sums.
SCAN = 8


class Seats:
    """Tables of cells: cell k has ``t[k]`` tables, of size[ptr[k] : ptr[k] + t[k]] customers. Cells that outgrow their room move to the end."""

    def __init__(self, n: np.ndarray, t: np.ndarray, sizes: np.ndarray) -> None:
        self.n, self.t = n.astype(np.int64), t.astype(np.int64)
        self._lay_out(np.minimum(self.n, 2 * self.t + 2), sizes)

    def _lay_out(self, room: np.ndarray, sizes: np.ndarray) -> None:
        self.room = room
        self.ptr = np.cumsum(room) - room
        self.used = int(room.sum())
        self.size = np.zeros(self.used, np.int64)
        self.size[self._taken()] = sizes

    def _taken(self) -> np.ndarray:
        first = np.cumsum(self.t) - self.t
        return np.repeat(self.ptr - first, self.t) + np.arange(int(self.t.sum()))

    def sizes(self) -> np.ndarray:
        return self.size[self._taken()]

    @staticmethod
    def first(n: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> Seats:
        """Customers come in one by one."""
        s = Seats(n, np.ones(len(n), np.int64), np.ones(len(n), np.int64))
        i, live = 1, np.flatnonzero(s.n > 1)
        while len(live) and i < ONE_BY_ONE:
            s._sit(live, np.full(len(live), i), strength[live], discount, rng)
            i += 1
            live = live[s.n[live] > i]
        while len(live):  # a few per cent at a time: those who open tables, and others in proportion
            m = np.minimum(max(1, i // 16), s.n[live] - i)
            opened = rng.binomial(m, strength[live] / (i - discount * s.t[live] + strength[live]))
            k = np.repeat(np.arange(len(live)), s.t[live])
            at = s.ptr[live][k] + np.arange(len(k)) - np.repeat(np.cumsum(s.t[live]) - s.t[live], s.t[live])
            share = (m - opened)[k] * s.size[at] // i
            s.size[at] += share
            s.size[s.ptr[live]] += m - opened - np.bincount(k, share, len(live)).astype(np.int64)
            s._open(live, opened)
            i += max(1, i // 16)
            live = live[s.n[live] > i]
        return s

    def _move(self, cells: np.ndarray, room: np.ndarray) -> None:
        """Cells get more room, behind all others."""
        lens = self.t[cells]
        step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        old, new = self.ptr[cells], self.used + np.cumsum(room) - room
        self.used += int(room.sum())
        if self.used > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(self.used + self.used // 8 - len(self.size), np.int64)])
        self.size[np.repeat(new, lens) + step] = self.size[np.repeat(old, lens) + step]
        self.ptr[cells], self.room[cells] = new, room

    def _open(self, cells: np.ndarray, tables: np.ndarray) -> None:
        """So many more tables of one customer each."""
        full = self.t[cells] + tables > self.room[cells]
        if full.any():
            self._move(cells[full], 2 * (self.t[cells] + tables)[full])
        at = np.repeat(self.ptr[cells] + self.t[cells] - np.cumsum(tables) + tables, tables) + np.arange(int(tables.sum()))
        self.size[at] = 1
        self.t[cells] += tables

    def _find(self, cells: np.ndarray, x: np.ndarray, less: float) -> np.ndarray:
        """The place of each cell's table at x, where a table is as wide as its customers less the discount."""
        at, end = self.ptr[cells], self.ptr[cells] + self.t[cells] - 1
        live = np.arange(len(cells))
        for _ in range(SCAN):
            own = self.size[at[live]] - less
            on = (x[live] >= own) & (at[live] < end[live])
            live, own = live[on], own[on]
            if not len(live):
                return at
            x[live] -= own
            at[live] += 1
        # what is left of cells with many tables, in one row
        lens = end[live] - at[live] + 1
        first = np.cumsum(lens) - lens
        width = np.cumsum(self.size[np.repeat(at[live] - first, lens) + np.arange(int(lens.sum()))] - less)
        before = np.concatenate([[0.0], width])[first]
        at[live] += np.clip(np.searchsorted(width, before + x[live], "right") - first, 0, lens - 1)
        return at

    def _sit(self, cells: np.ndarray, others: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One more customer for each cell, besides so many others."""
        old = others - discount * self.t[cells]
        u = rng.random(len(cells)) * (old + strength)
        new = (u < strength) | (self.t[cells] == 0)
        self._open(cells[new], np.ones(int(new.sum()), np.int64))
        joining = cells[~new]
        self.size[self._find(joining, (u - strength)[~new], discount)] += 1

    def sweep(self, strength: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Takes customers from their tables, of each cell as many as it has, and seats them again."""
        live, step = np.flatnonzero((self.n > 1) & (self.n <= ONE_BY_ONE)), 0
        while len(live):
            at = self._find(live, rng.random(len(live)) * self.n[live], 0.0)
            self.size[at] -= 1
            gone = self.size[at] == 0
            last = self.ptr[live[gone]] + self.t[live[gone]] - 1
            self.size[at[gone]] = self.size[last]
            self.size[last] = 0
            self.t[live[gone]] -= 1
            self._sit(live, self.n[live] - 1, strength[live], discount, rng)
            step += 1
            live = live[self.n[live] > step]
        self._sweep_large(strength, discount, rng)

    def _sweep_large(self, strength: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        large = self.n > ONE_BY_ONE
        if not large.any():
            return
        sizes, of_large = self.sizes(), np.repeat(large, self.t)
        own = Seats(self.n[large], self.t[large], sizes[of_large])
        for _ in range(ONE_BY_ONE):
            own._regroup(strength[large], discount, rng)
        rest = sizes[~of_large]
        self.t[large] = own.t
        of_large = np.repeat(large, self.t)
        sizes = np.empty(len(of_large), np.int64)
        sizes[of_large], sizes[~of_large] = own.sizes(), rest
        self._lay_out(np.maximum(self.room, np.minimum(self.n, 2 * self.t + 2)), sizes)

    def _regroup(self, strength: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One group of each cell's customers taken and seated again."""
        sizes, t = self.sizes(), self.t
        cell = np.repeat(np.arange(len(t)), t)
        taken = rng.binomial(sizes, 1 / ONE_BY_ONE)
        sizes = sizes - taken
        m = np.bincount(cell, taken, len(t)).astype(np.int64)
        cell, sizes = cell[sizes > 0], sizes[sizes > 0]
        width = sizes - discount
        wide = np.bincount(cell, width, len(t))
        opened = rng.binomial(m, strength / (wide + strength))
        end = np.cumsum(width)
        first = np.searchsorted(cell, np.arange(len(t)))
        last = np.searchsorted(cell, np.arange(len(t)), "right") - 1
        who = np.repeat(np.arange(len(t)), m - opened)
        x = end[first[who]] - width[first[who]] + rng.random(len(who)) * wide[who]
        sizes = sizes + np.bincount(np.clip(np.searchsorted(end, x, "right"), first[who], last[who]), minlength=len(sizes))
        cell = np.concatenate([cell, np.repeat(np.arange(len(t)), opened)])
        sizes = np.concatenate([sizes, np.ones(int(opened.sum()), np.int64)])[np.argsort(cell, kind="stable")]
        self.t = np.bincount(cell, minlength=len(t))
        self._lay_out(np.minimum(self.n, 2 * self.t + 2), sizes)
