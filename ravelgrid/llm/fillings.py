"""The configuration linear program of packing, on the driver, over a length histogram.

A *filling* is a multiset of lengths that fits one sequence.  The program has
one variable per filling, its number of sequences, and one row per length: all
pieces of that length must be covered; the sum of the variables is minimal.

``relax`` solves it by multiplicative weights.  A piece's price is multiplied
up by ``SLACK`` for each round by which its length is in arrears, and a knapsack dynamic programme gives the value of every room
at these prices.  A round buys, for each length in arrears, a filling around it
whose value is within ``SLACK`` of the best, and no more than the round's share
of any length; the last round covers what is left whatever its value.  Prices
over the best value are feasible in the dual, so every round also gives a lower
bound on the optimum; the best one is returned.

``solve`` rounds: whole parts of the variables, then one more sequence of the
fillings with the largest fractions while the pieces are there, then fillings
around the lengths left, from the bound's prices and made of pieces that are
there.  Only pieces that no near-best filling takes go to best fit decreasing;
``left_over`` counts them.  Work depends on the number of lengths (at most the
capacity), not on how many pieces there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

Filling = dict[int, int]
SLACK = 0.02
ROUNDS = (16, 200)  # fewer where there are many lengths, as a round's work grows with them


class Relaxed(NamedTuple):
    fillings: dict[tuple, float]  # (length, how many) pairs -> sequences
    value: float  # sequences, each length covered
    bound: float  # no packing has fewer
    prices: np.ndarray  # by length, of the round that gave the bound


class Solved(NamedTuple):
    fillings: list[tuple[Filling, int]]
    relaxed: Relaxed | None
    left_over: int  # pieces placed by best fit decreasing


class Knapsack:
    """Best value of every room at given prices (0 where there is no such length), and fillings of that value."""

    def __init__(self, prices: np.ndarray, capacity: int):
        self.prices, self.capacity = prices, capacity
        lengths = np.flatnonzero(prices > 0)
        self.least = int(lengths[0])
        worth = np.where(prices > 0, prices, -1.0)
        back = np.zeros(capacity + 1)  # back[capacity - room]: value of the room
        for room in range(self.least, capacity + 1):
            best = (back[capacity - room + self.least :] + worth[self.least : room + 1]).max()
            back[capacity - room] = max(best, back[capacity - room + 1])
        self.value = back[::-1].copy()
        self.best = float(self.value[capacity])
        self.able: dict[int, list[int]] = {}

    def _choices(self, room: int, there: np.ndarray) -> list[int]:
        """Some lengths that may come next in ``room`` without loss of value, the longest last."""
        worth = self.value[room - self.least :: -1] + self.prices[self.least : room + 1]
        fit = (worth >= self.value[room] - 1e-9) & there[self.least : room + 1]
        return (np.flatnonzero(fit)[-32:] + self.least).tolist()

    def around(self, length: int, left: list[float], there: np.ndarray, whole: bool) -> tuple[Filling, float]:
        """A filling with ``length`` in it, of lengths that are ``there`` (``left`` above 0), and its value.

        ``whole``: no more of a length than is left.  Lengths do not come back once they have run out.
        """
        filling, room, value = {length: 1}, self.capacity - length, float(self.prices[length])
        while room >= self.least:
            able, k = self.able.get(room), 0
            while able and left[able[-1]] <= 0:
                able.pop()
            if not able:
                able = self.able[room] = self._choices(room, there)
            if able:
                k = able[-1]
                if whole and left[k] <= filling.get(k, 0):
                    k = next((j for j in reversed(able) if left[j] > filling.get(j, 0)), 0)
            if not k:
                may = there[self.least : room + 1].copy()
                if whole:
                    for j, n in filling.items():
                        if j <= room and left[j] <= n:
                            may[j - self.least] = False
                if not may.any():
                    break
                worth = np.where(may, self.value[room - self.least :: -1] + self.prices[self.least : room + 1], -1.0)
                k = int(worth.argmax()) + self.least
            filling[k] = filling.get(k, 0) + 1
            room -= k
            value += float(self.prices[k])
        return filling, value


def _dense(counts: dict[int, int], capacity: int) -> np.ndarray:
    need = np.zeros(capacity + 1)
    need[list(counts)] = list(counts.values())
    return need


def first_prices(need: np.ndarray) -> np.ndarray:
    """Prices to start from: lengths as shares of the capacity, those above ``capacity - a`` as whole sequences.

    Lengths below ``a`` are then (nearly) free.  Such prices are feasible in the
    dual for any ``a`` up to half the capacity; the best is taken.
    """
    capacity = len(need) - 1
    size = np.arange(capacity + 1)
    volume = np.concatenate([[0.0], np.cumsum((need * size)[1:])]) / capacity
    many = np.concatenate([[0.0], np.cumsum(need[1:])])
    a = np.arange(capacity // 2 + 1)
    bound = many[-1] - many[capacity - a] + volume[capacity - a] - volume[np.maximum(a - 1, 0)]
    a = int(bound.argmax())
    prices = np.where(size > capacity - a, 1.0, np.where(size >= a, size / capacity, 1e-3 * size / capacity))
    return np.where(need > 0, prices, 0.0)


def relax(counts: dict[int, int], capacity: int, rounds: int | None = None) -> Relaxed:
    """The linear program by multiplicative weights."""
    rounds = rounds or min(max(ROUNDS[0], 32_000 // len(counts)), ROUNDS[1])
    need = _dense(counts, capacity)
    lengths = np.flatnonzero(need)
    done = np.zeros(capacity + 1)
    bought: dict[tuple, float] = {}
    bound, kept, start = 0.0, None, first_prices(need)
    for t in range(1, rounds + rounds // 4 + 2):
        share = min(t, rounds) / rounds
        arrears = np.zeros(capacity + 1)
        arrears[lengths] = share - done[lengths] / need[lengths]
        if t > rounds and arrears.max() < 1e-6:
            break
        least_value = 0.0 if t > rounds + rounds // 4 else 1 - SLACK  # the last round covers what is uncovered yet
        prices = start * np.exp(SLACK * rounds * arrears)
        sack = Knapsack(prices, capacity)
        if (low := float(need @ prices) / sack.best) > bound:
            bound, kept = low, prices / sack.best
        due = np.maximum(share * need - done, 0.0)
        due[due < 1e-6 * need] = 0.0
        there, left, floor = due > 0, due.tolist(), (1e-6 * need).tolist()
        for length in lengths[::-1].tolist():
            while left[length] > 0:
                filling, value = sack.around(length, left, there, False)
                if value < least_value * sack.best:
                    break
                much = min(left[k] / n for k, n in filling.items())
                for k, n in filling.items():
                    left[k] -= much * n
                    done[k] += much * n
                    if left[k] <= floor[k]:
                        left[k], there[k] = 0.0, False
                key = tuple(sorted(filling.items()))
                bought[key] = bought.get(key, 0.0) + much
    scale = 1 / (1 - 1e-6)  # shares too small to buy
    return Relaxed(bought, scale * sum(bought.values()), bound, kept)


def solve(counts: dict[int, int], capacity: int, rounds: int | None = None) -> Solved:
    """Fillings with whole multiplicities that hold exactly ``counts``."""
    rest = {int(k): int(v) for k, v in counts.items() if v > 0}
    if any(k < 1 or k > capacity for k in rest):
        raise ValueError(f"lengths are 1 to {capacity}")
    out: list[tuple[Filling, int]] = []
    if full := rest.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    if not rest:
        return Solved(out, None, 0)
    relaxed = relax(rest, capacity, rounds)
    left = [0] * (capacity + 1)
    for k, n in rest.items():
        left[k] = n

    def use(filling: Filling, most: int) -> None:
        if (times := min(most, *(left[k] // n for k, n in filling.items()))) > 0:
            out.append((filling, times))
            for k, n in filling.items():
                left[k] -= n * times

    # whole parts first, then one more sequence of a filling, the largest fractions first
    most_bought = sorted(relaxed.fillings.items(), key=lambda x: (-x[1], x[0]))
    for key, much in most_bought:
        use(dict(key), int(much))
    sack = Knapsack(relaxed.prices, capacity)
    for key, _ in sorted(most_bought, key=lambda x: (-(x[1] % 1), x[0])):
        if sum(n * relaxed.prices[k] for k, n in key) >= (1 - SLACK / 4) * sack.best:
            use(dict(key), 1)
    for slack in (SLACK / 4, SLACK, 4 * SLACK):
        sack.able.clear()
        there = np.array(left) > 0
        for length in sorted(rest, reverse=True):
            while left[length] > 0:
                filling, value = sack.around(length, left, there, True)
                if value < (1 - slack) * sack.best:
                    break
                use(filling, left[length])
                for k in filling:
                    there[k] = left[k] > 0
    tail = {k: n for k, n in enumerate(left) if n}
    return Solved(out + best_fit_decreasing(tail, capacity), relaxed, sum(tail.values()))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing on a histogram: sequences alike are filled together."""
    groups: dict[tuple, int] = {}  # (room, filling) -> how many
    by_room: list[dict[tuple, int]] = [dict() for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        room = length
        while left > 0 and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            filling, n = next(iter(by_room[room].items()))
            fit = room // length
            full, part = divmod(left, fit)
            used = min(n, full)
            if used:
                k = fit
            else:
                used, k = 1, part
            del by_room[room][filling]
            if n > used:
                by_room[room][filling] = n - used
            now = (*filling, (length, k))
            by_room[room - k * length][now] = by_room[room - k * length].get(now, 0) + used
            left -= used * k
        if left:
            fit = capacity // length
            full, part = divmod(left, fit)
            for n, k in ((full, fit), (1 if part else 0, part)):
                if n and k:
                    now = ((length, k),)
                    rest = by_room[capacity - k * length]
                    rest[now] = rest.get(now, 0) + n
    for rooms in by_room:
        for filling, n in rooms.items():
            groups[filling] = groups.get(filling, 0) + n
    return [(dict(f), n) for f, n in groups.items()]
