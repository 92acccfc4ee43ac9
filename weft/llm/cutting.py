"""Cutting stock by column generation: which lengths share a sequence. Works on a histogram of lengths, so on capacity numbers at most.

The linear program: minimise the sum of cost_j x_j + slack_l s_l, so that the pieces of length l in all patterns, plus s_l, are as many as there are.
A pattern is a bag of lengths that fills a sequence; its cost is its padding (none if its total is the capacity; SHORT for
a smaller power of two, which isn't padded either but is a short sequence). s_l pieces of length l are left to be cut, at cut_cost * l / capacity
each, as a sequence of cut pieces takes one cut. Slacks alone are a first solution, and zero is a lower bound of the total cost.

Columns are priced by a bounded knapsack over the exact totals 0..capacity: of each length no more pieces than there are. One table
gives the best pattern with each length in it; all that still improve enter one after another. The simplex keeps the inverse of the basis.
It ends when no pattern improves, when the cost is below gap times that of cutting all, or after MAX_PIVOTS pivots: every step is a whole solution.

Rounding: patterns in the order of their number, floors first, then one more where the lengths suffice. What is left is solved again, up to ROUNDS times.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

GAP, ROUNDS, TABLES = 1e-3, 6, 24
EPS = 1e-9


def costs(capacity: int, cut_cost: float) -> np.ndarray:
    """The cost of a sequence by its total."""
    t = np.arange(capacity + 1)
    out = (capacity - t).astype(np.float64)
    out[[1 << i for i in range(capacity.bit_length()) if 1 << i <= capacity]] = cut_cost / 2
    out[capacity], out[0] = 0.0, np.inf
    return out


class Knapsack:
    """Best bags of lengths by exact total: value[t], and the items they are made of."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int):
        items = []
        for i in np.flatnonzero(prices > EPS):
            left, k = min(int(counts[i]), capacity // int(lengths[i])), 1
            while left > 0:
                k = min(k, left)
                items.append((int(i), k))
                left, k = left - k, 2 * k
        self.lengths, self.counts, self.capacity = lengths, counts, capacity
        self.items = items
        self.value = np.full(capacity + 1, -np.inf)
        self.value[0] = 0.0
        self.taken = np.zeros((len(items), capacity + 1), bool)
        for row, (i, k) in enumerate(items):
            w = int(lengths[i]) * k
            better = self.value[:-w] + prices[i] * k
            np.greater(better, self.value[w:], out=self.taken[row, w:])
            np.maximum(self.value[w:], better, out=self.value[w:])

    def bag(self, total: int, item: int = -1) -> dict[int, int] | None:
        """The best bag of this total, besides one piece of item; None if there are too few of it."""
        out = {item: 1} if item >= 0 else {}
        row = len(self.items)
        while total > 0:
            row -= 1 + int(self.taken[:row, total][::-1].argmax())
            i, k = self.items[row]
            out[i] = out.get(i, 0) + k
            total -= int(self.lengths[i]) * k
        return out if item < 0 or out[item] <= self.counts[item] else None


class Basis:
    """A basic solution: the inverse of the basis, the numbers x of its columns, the prices y of lengths. It begins with the slacks."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, cut_cost: float):
        self.lengths, self.by_total = lengths, costs(capacity, cut_cost)
        self.cost = cut_cost * lengths / capacity
        self.inverse, self.x, self.y = np.eye(len(lengths)), counts.astype(np.float64), self.cost.copy()
        self.bags: list[dict[int, int] | None] = [None] * len(lengths)
        self.pivots = 0

    def total(self) -> float:
        return float(self.cost @ self.x)

    def enter(self, bag: dict[int, int], improving: bool = True) -> bool:
        """Takes a pattern into the basis if it improves (or at all events), in place of the column that first runs out."""
        ix, a = np.array(list(bag)), np.array(list(bag.values()), np.float64)
        price = float(self.by_total[int(self.lengths[ix] @ a)])
        reduced = price - float(self.y[ix] @ a)
        if improving and reduced > -EPS:
            return False
        column = self.inverse[:, ix] @ a
        up = np.flatnonzero(column > 1e-7)
        if not len(up):
            return False
        ratio = self.x[up] / column[up]
        ties = up[ratio <= ratio.min() + 1e-12]
        r = int(ties[np.argmax(column[ties])])
        step = max(0.0, self.x[r] / column[r])
        self.x = np.maximum(self.x - step * column, 0.0)
        self.x[r] = step
        row = self.inverse[r] / column[r]
        self.y = self.y + reduced * row
        rows, cols = np.flatnonzero(np.abs(column) > 1e-12), np.flatnonzero(row)
        if len(rows) * len(cols) * 8 < self.inverse.size:
            self.inverse[np.ix_(rows, cols)] -= np.outer(column[rows], row[cols])
        else:
            self.inverse[rows] -= np.outer(column[rows], row)
        self.inverse[r] = row
        self.bags[r], self.cost[r] = bag, price
        self.pivots += 1
        return True


def first_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, most_cost: float) -> Iterator[dict[int, int]]:
    """Patterns to begin with: the longest piece left, then what fills the rest exactly or else the longest that fits, taken until a length runs out."""
    by_total, left, open_ = costs(capacity, most_cost), counts.astype(np.float64), list(range(len(lengths)))
    where = {int(x): i for i, x in enumerate(lengths)}
    while open_:
        bag, rest = {open_[-1]: 1}, capacity - int(lengths[open_[-1]])
        while rest > 0:
            i = where.get(rest, -1)
            if i < 0 or left[i] <= EPS or bag.get(i, 0) >= counts[i]:
                at = bisect_right(open_, rest, key=lambda j: int(lengths[j])) - 1
                while at >= 0 and bag.get(open_[at], 0) >= counts[open_[at]]:
                    at -= 1
                if at < 0:
                    break
                i = open_[at]
            bag[i] = bag.get(i, 0) + 1
            rest -= int(lengths[i])
        if by_total[capacity - rest] > most_cost:
            open_.pop()  # no cheap pattern begins with it
            continue
        yield bag
        ix, a = np.array(list(bag)), np.array(list(bag.values()), np.float64)
        left[ix] -= a * (left[ix] / a).min()
        open_ = [i for i in open_ if i not in bag or left[i] > EPS]


def relax(lengths: np.ndarray, counts: np.ndarray, capacity: int, cut_cost: float, gap: float = GAP, tables: int = TABLES) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns (index of length -> pieces) with their fractional numbers, and the cost reached."""
    basis, by_total = Basis(lengths, counts, capacity, cut_cost), costs(capacity, cut_cost)
    goal, totals = gap * basis.total(), np.flatnonzero(by_total <= cut_cost)
    for bag in first_patterns(lengths, counts, capacity, cut_cost):
        basis.enter(bag)
    for _ in range(tables):
        if basis.total() <= goal:
            break
        sack, before = Knapsack(lengths, counts, basis.y, capacity), basis.pivots
        found = [(sack.value[t] - by_total[t], int(t), -1) for t in totals]
        for i in range(len(lengths)):
            rest = totals[totals >= lengths[i]]
            value = sack.value[rest - lengths[i]] - by_total[rest] + basis.y[i]
            found.append((value.max(initial=-np.inf), int(rest[value.argmax()] - lengths[i]) if len(rest) else 0, i))
        for value, total, i in sorted(found, reverse=True):
            if value <= EPS or basis.total() <= goal:
                break
            bag = sack.bag(total, i)
            if bag is not None:
                basis.enter(bag)
        if basis.pivots == before:
            break
    return [(bag, float(n)) for bag, n in zip(basis.bags, basis.x, strict=True) if bag is not None and n > EPS], basis.total()


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, cut_cost: float) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Patterns (length -> pieces) with whole numbers of sequences, and how many pieces of each length are left to be cut."""
    left, made = counts.astype(np.int64).copy(), {}

    def apply(bag: dict[int, int], most: int) -> int:
        n = min(most, *(int(left[i]) // a for i, a in bag.items()))
        if n > 0:
            key = tuple(sorted(bag.items()))
            made[key] = made.get(key, 0) + n
            for i, a in bag.items():
                left[i] -= n * a
        return max(n, 0)

    for _ in range(ROUNDS):
        some = np.flatnonzero(left)
        if not len(some) or int(lengths[some] @ left[some]) < capacity:
            break
        bags, _ = relax(lengths[some], left[some], capacity, cut_cost)
        bags = [({int(some[i]): a for i, a in bag.items()}, n) for bag, n in bags]
        done = sum(apply(bag, int(n + EPS)) for bag, n in sorted(bags, key=lambda b: -b[1]))
        done += sum(apply(bag, 1) for bag, n in sorted(bags, key=lambda b: int(b[1] + EPS) - b[1]))
        if not done:
            break
    return [({int(lengths[i]): a for i, a in key}, n) for key, n in made.items()], left
