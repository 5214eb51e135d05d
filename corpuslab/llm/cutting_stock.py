"""Cutting stock by column generation, over a histogram of piece lengths.

A pattern says how many pieces of which lengths share a sequence. A sequence costs its size,
padding included, and one token more, so that of two equal ways the one with fewer sequences
wins; a sequence whose fill is a power of two needs no padding. The linear program asks for
the cheapest patterns that use up the histogram. It starts from patterns that fill sequences
largest piece first; then the simplex multipliers price the lengths, a knapsack dynamic
program finds the best pattern of every fill for these prices, and patterns that cost less
than their pieces are worth enter the basis. It ends when the bound that the prices prove is
within TOLERANCE of the cost, or within one sequence.

Everything here depends on the number of lengths, at most the sequence size, and not on how
many pieces there are: it is the part of packing that one process can do.
"""
from collections import Counter
from typing import NamedTuple

import numpy as np

TOLERANCE = 1e-4

#: Below this, amounts and prices count as zero.
TINY = 1e-9

#: Patterns that enter the basis at most, in case of a crawl among equal costs. The plan stays complete.
PIVOTS = 600

#: Smaller elements of a column don't become pivots.
LEAST_PIVOT = 1e-6

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def padded(fill: int, size: int) -> int:
    """What a sequence of `fill` tokens takes."""
    return fill if fill & (fill - 1) == 0 else size


def fill_of(pattern: Pattern) -> int:
    return sum(length * copies for length, copies in pattern)


def cost(pattern: Pattern, size: int) -> int:
    return padded(fill_of(pattern), size) + 1


def fullest(amounts: dict[int, float], size: int) -> Pattern:
    """The longest piece and those that, with it, fill a sequence best: subset sums as bits of a number."""
    first = max(amounts)
    room = size - first
    left = {length: int(np.ceil(a - TINY)) - (length == first) for length, a in amounts.items()}
    if left.get(room, 0) > 0:
        return _pattern([first, room])
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in amounts if x <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            more = sums | (sums << length) & mask
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, [first]
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return _pattern(chosen)


def _pattern(lengths: list[int]) -> Pattern:
    return tuple(sorted(Counter(lengths).items(), reverse=True))


def greedy(amounts: dict[int, float], size: int, whole: bool) -> list[tuple[Pattern, float]]:
    """Patterns with how often to use them, until nothing is left; in whole numbers if `whole`."""
    left, found = {length: a for length, a in amounts.items() if a > TINY}, []
    while left:
        pattern = fullest(left, size)
        times = min(left[length] / copies for length, copies in pattern)
        if whole:
            times = int(times + TINY)
        found.append((pattern, times))
        for length, copies in pattern:
            left[length] -= times * copies
            if left[length] <= TINY:
                del left[length]
    return found


class Prices:
    """The best value of pieces with exactly each fill, for given values of the lengths."""

    def __init__(self, values: np.ndarray, size: int):
        # values[k] is that of length k; what has no value is left out.
        self.best = np.full(size + 1, -np.inf)
        self.last = np.zeros(size + 1, np.int64)
        self.best[0] = 0.0
        use = np.where(values > TINY, values, -np.inf)
        for fill in range(1, size + 1):
            # Lengths 1..fill as the last piece, with the best of what is left.
            top = min(fill, len(use) - 1)
            sums = use[1 : top + 1] + self.best[fill - 1 :: -1][:top]
            self.last[fill] = at = int(np.argmax(sums)) + 1 if top else 0
            if top:
                self.best[fill] = sums[at - 1]

    def pattern(self, fill: int, *more: int) -> Pattern:
        chosen = list(more)
        while fill:
            chosen.append(int(self.last[fill]))
            fill -= chosen[-1]
        return _pattern(chosen)


class Plan(NamedTuple):
    used: list[tuple[Pattern, float]]
    cost: float
    bound: float
    pivots: int


def _start(amounts: dict[int, float], size: int) -> tuple[list[Pattern], list[float], list[int]]:
    """A first basis: greedy patterns, each of which uses up a length, and unused ones for lengths that end together.

    A pattern holds no length that an earlier one has used up, so in this order the basis is triangular."""
    patterns, amount, ended, left = [], [], [], dict(amounts)
    for pattern, times in greedy(amounts, size, whole=False):
        for length, copies in pattern:
            left[length] -= times * copies
        now = [length for length, _ in pattern if left[length] <= TINY]
        patterns += [pattern, *(((length, 1),) for length in now[1:])]
        amount += [times, *[0.0] * (len(now) - 1)]
        ended += now
    return patterns, amount, ended


def _triangular_inverse(patterns: list[Pattern], spot: dict[int, int]) -> np.ndarray:
    """Inverse of a basis whose k-th pattern holds the k-th length and later ones. Entries are few, so rows are added one by one."""
    m = len(patterns)
    out = np.eye(m)
    for k, pattern in enumerate(patterns):
        copies = {spot[length]: n for length, n in pattern}
        out[k] /= copies.pop(k)
        for later, n in copies.items():
            out[later] -= n * out[k]
    return out


def solve(demand: dict[int, int], size: int, tolerance: float = TOLERANCE) -> Plan:
    """The linear program's patterns with their amounts, their cost and a proven lower bound."""
    lengths = sorted(length for length, d in demand.items() if d > 0)
    tokens = sum(length * demand[length] for length in lengths)
    material = tokens + tokens / size
    if not lengths:
        return Plan([], 0.0, 0.0, 0)
    patterns, first, lengths = _start({length: float(demand[length]) for length in lengths}, size)
    spot = {length: k for k, length in enumerate(lengths)}
    costs, x = np.array([cost(p, size) for p in patterns], float), np.array(first)
    if costs @ x <= max(material * (1 + tolerance), material + size):
        return Plan(_used(patterns, x), float(costs @ x), material, 0)

    # Sums of few columns, not matrix products: these would start threads in the driver.
    inverse = _triangular_inverse(patterns, spot)
    d = np.array([demand[length] for length in lengths], float)
    y, bound, pivots = (costs[:, None] * inverse).sum(axis=0), material, 0
    while True:
        values = np.zeros(size + 1)
        values[lengths] = y
        prices = Prices(values, size)
        sizes = np.array([padded(fill, size) + 1 for fill in range(1, size + 1)])
        worth = np.maximum(prices.best[1:], 0.0)
        # Prices divided by the best worth for its cost can't be beaten by any pattern: a lower bound.
        bound = max(bound, float(np.maximum(y, 0.0) @ d) / max(1.0, float((worth / sizes).max())))
        if costs @ x <= max(bound * (1 + tolerance), bound + size):
            break
        # Each fill's best pattern, and for each length the best full sequence that holds it.
        gains = np.concatenate([worth - sizes, [y[spot[k]] + prices.best[size - k] - size - 1 for k in lengths]])
        entered = 0
        for k in np.argsort(-gains)[: 4 + len(lengths) // 8]:
            if gains[k] <= TINY * size:
                break
            pattern = prices.pattern(k + 1) if k < size else prices.pattern(size - lengths[k - size], lengths[k - size])
            rows, copies = [spot[length] for length, _ in pattern], np.array([n for _, n in pattern], float)
            price = cost(pattern, size)
            gain = float(y[rows] @ copies) - price
            if gain <= TINY * size:
                continue  # earlier ones have changed the prices
            step = (inverse[:, rows] * copies).sum(axis=1)
            able = step > LEAST_PIVOT
            if not able.any():
                continue
            ratios = np.where(able, x / np.where(able, step, 1.0), np.inf)
            by = ratios.min()
            # Of patterns that end together, the one with the largest element keeps the basis well conditioned.
            out = int(np.argmax(np.where(ratios <= by + TINY, step, 0.0)))
            by = ratios[out]
            x -= by * step
            x[out] = by
            np.maximum(x, 0.0, out=x)
            patterns[out], costs[out] = pattern, price
            row = inverse[out] / step[out]
            step[out] = 0.0
            inverse -= np.outer(step, row)
            inverse[out] = row
            y -= gain * row
            pivots += 1
            entered += 1
        if not entered or pivots >= PIVOTS:
            break  # the bound says how good the plan is
    return Plan(_used(patterns, x), float(costs @ x), bound, pivots)


def _used(patterns: list[Pattern], x: np.ndarray) -> list[tuple[Pattern, float]]:
    return [(p, float(a)) for p, a in zip(patterns, x) if a > TINY]


def whole_patterns(demand: dict[int, int], size: int) -> tuple[list[tuple[Pattern, int]], Plan]:
    """Patterns in whole numbers that use up `demand`, and the linear program's plan behind them.

    The plan's amounts are rounded down. What is left is at most one sequence for each of its
    patterns, however many pieces there are, and is packed largest piece first."""
    plan = solve(demand, size)
    left, found = dict(demand), Counter()
    for pattern, amount in plan.used:
        times = min(int(amount + 1e-6), *(left[length] // copies for length, copies in pattern))
        if times > 0:
            found[pattern] += times
            for length, copies in pattern:
                left[length] -= times * copies
    for pattern, times in greedy({k: n for k, n in left.items() if n}, size, whole=True):
        found[pattern] += times
    return sorted(found.items(), reverse=True), plan
