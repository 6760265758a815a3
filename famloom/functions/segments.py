"""Rules on aligned segments, free of Spark: chains of them, and what cuts make of one.

A segment lies at [x0, x1] on an element and at [y0, y1] on its partner.  Where
the two run in opposite directions the partner is mirrored (y becomes -y), so
every rule here knows one direction alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Segment(NamedTuple):
    x0: int
    x1: int
    y0: int
    y1: int
    iden: float = 0.0


def facing(lb: int, rb: int, p_lb: int, p_rb: int, direction: int, iden: float = 0.0) -> Segment:
    """An image and its partner as a segment."""
    return Segment(lb, rb, p_lb, p_rb, iden) if direction == 1 else Segment(lb, rb, -p_rb, -p_lb, iden)


def partner_ends(s: Segment, direction: int) -> tuple[int, int]:
    """The partner's own lb and rb."""
    return (s.y0, s.y1) if direction == 1 else (-s.y1, -s.y0)


# --- cutting ----------------------------------------------------------------------


def cut(s: Segment, score: int, cuts: list[int], short: int) -> tuple[list[tuple[Segment, int]], tuple[Segment, int] | None]:
    """(copies, rest) of a segment at sorted positions, each with its share of the score.

    A cut within ``short`` of an end trims it; any other takes what lies before
    it off as a copy, and the rest begins behind it.  The partner loses as much at
    the end that answers.  Copies that are short themselves are left out; so is
    the rest (None) if it, or what its partner has left, is short.
    """
    copies: list[tuple[Segment, int]] = []
    x0, x1, y0, y1, iden = s
    for at in cuts:
        if not x0 < at < x1:
            continue
        head, tail, whole = at - x0, x1 - at, x1 - x0 + 1.0
        before = int((head + 1.0) / whole * score)
        if head <= short:
            score = int((tail + 1.0) / whole * score)
            x0, y0 = at, y0 + head
        elif tail <= short:
            score = before
            x1, y1 = at, y1 - tail
        else:
            copies.append((Segment(x0, at, y0, y1 - tail, iden), before))
            score -= before
            x0, y0 = at + 1, y0 + head + 1
    kept = x1 - x0 > short and y1 - y0 > short
    return copies, (Segment(x0, x1, y0, y1, iden), score) if kept else None


# --- chains -----------------------------------------------------------------------

#: States and successors that are remembered; beyond, they are forgotten and worked out again.
REMEMBERED = 1 << 20


class Order:
    """Which segment of a list can follow which: it begins later on both sides and overlaps on neither.

    ``loose`` is the share of either segment from which an overlap counts.  Unless
    a segment has no length, what follows a follower follows too: an overlap below
    that share on both steps leaves a gap between first and last.  So the branches
    of the consistency tree below a segment are its nearest followers, whatever
    path leads there, and the tree need not be held.
    """

    def __init__(self, segments: list[Segment], loose: np.float32):
        self.n, self.loose = len(segments), loose
        self.x0, self.x1, self.y0, self.y1 = (np.array([s[i] for s in segments], dtype=np.int64) for i in range(4))
        #: The least y0 from each place on.
        self.low = np.minimum.accumulate(self.y0[::-1])[::-1]
        self.transitive = bool(((self.x1 > self.x0) & (self.y1 > self.y0)).all())
        #: The same as plain numbers, for one pair at a time.
        self._plain = segments
        self._low = self.low.tolist()
        self._nearest: dict[int, list[int]] = {}
        self._held = 0

    def _apart(self, lo: np.ndarray, hi: np.ndarray, a: int, k: slice | int) -> np.ndarray:
        shared = np.minimum(hi[a], hi[k]) - np.maximum(lo[a], lo[k])
        out = np.ones_like(shared, dtype=bool)
        for n in (hi[a] - lo[a], hi[k] - lo[k]):
            with np.errstate(divide="ignore", invalid="ignore"):
                out &= ~((n != 0) & ((shared / n).astype(np.float32) >= self.loose))
        return out

    def follows(self, a: int, k: slice | int) -> np.ndarray:
        """Whether ``k`` (places after ``a``) can follow ``a``."""
        return (self.x0[k] > self.x0[a]) & (self.y0[k] > self.y0[a]) & self._apart(self.x0, self.x1, a, k) & self._apart(self.y0, self.y1, a, k)

    def follows_one(self, a: int, k: int) -> bool:
        p, q = self._plain[a], self._plain[k]
        if q.x0 <= p.x0 or q.y0 <= p.y0:
            return False
        for shared, n, m in ((min(p.x1, q.x1) - q.x0, p.x1 - p.x0, q.x1 - q.x0), (min(p.y1, q.y1) - q.y0, p.y1 - p.y0, q.y1 - q.y0)):
            if shared > 0 and any(d and np.float32(shared / d) >= self.loose for d in (n, m)):
                return False
        return True

    def nearest(self, a: int | None, among: np.ndarray | None = None) -> list[int]:
        """Followers of ``a`` (None: all segments) that follow no other of them; ``among``: a mask to choose from."""
        if among is None and (a if a is not None else -1) in self._nearest:
            return self._nearest[a if a is not None else -1]
        out: list[int] = []
        at, step = (0 if a is None else a + 1), 4
        while at < self.n:
            # All from here on follow one that is found already.
            x, y = self._plain[at].x0 - (not self.transitive), self._low[at] - (not self.transitive)
            if any(self._plain[c].x1 <= x and self._plain[c].y1 <= y for c in out):
                break
            end = min(at + step, self.n)
            if among is None and step < 32:
                good = [k for k in range(at, end) if a is None or self.follows_one(a, k)]
            else:
                mask = np.ones(end - at, dtype=bool) if a is None else self.follows(a, slice(at, end))
                good = (np.flatnonzero(mask if among is None else mask & among[at:end]) + at).tolist()
            for k in good:
                if not any(self.follows_one(c, k) for c in out):
                    out.append(k)
            at, step = end, min(2 * step, 4096)
        if among is None:
            self._held += len(out) + 1
            if self._held > REMEMBERED:
                self._nearest, self._held = {}, len(out) + 1
            self._nearest[a if a is not None else -1] = out
        return out

    def branches(self, a: int | None, among: np.ndarray | None) -> tuple[list[int], np.ndarray | None]:
        """The branches below ``a``, and the mask for theirs (None where order alone decides)."""
        if self.transitive:
            return self.nearest(a), None
        mask = np.ones(self.n, dtype=bool) if among is None else among.copy()
        if a is not None:
            mask[: a + 1] = False
            mask[a + 1 :] &= self.follows(a, slice(a + 1, self.n))
        return self.nearest(a, mask), mask


def tree(segments: list[Segment], loose: np.float32) -> Iterator[tuple[int, int]]:
    """(depth, place) of the consistency tree's nodes, depth first; one path is held at a time."""
    order = Order(segments, loose)
    todo = [(0, k, m) for ks, m in [order.branches(None, None)] for k in reversed(ks)]
    while todo:
        depth, k, among = todo.pop()
        yield depth, k
        below, mask = order.branches(k, among)
        todo += [(depth + 1, j, mask) for j in reversed(below)]


class Chain(NamedTuple):
    found: bool
    score: int
    marked: set[int]


class _Rules(NamedTuple):
    """When a chain spans a side: what it covers is over ``full`` of what it covers and misses, and on one side it misses less than ``shortfall``."""

    box: tuple[int, int, int, int]
    full: float
    gap: int
    shortfall: int

    def missed(self, x: int, y: int, x2: int, y2: int) -> tuple[int, int]:
        dx, dy = x2 - x, y2 - y
        return (dx, dy) if dx > self.gap and dy > self.gap else (0, 0)

    def spans(self, a: int, b: int, miss_a: int, miss_b: int) -> bool:
        share = any(n + m and n / (n + m) > self.full for n, m in ((a, miss_a), (b, miss_b)))
        return share and min(miss_a, miss_b) < self.shortfall


def best_chain(segments: list[Segment], box: tuple[int, int, int, int], loose: np.float32, full: float, gap: int, shortfall: int) -> Chain:
    """The best score of chains that span one side of ``box`` (x0, x1, y0, y1), and the places of all segments in such chains.

    ``segments`` are sorted by x0.  A chain is a path from root to leaf of the
    tree.  It covers the lengths of its segments, and misses a stretch before,
    between or behind them where both sides skip more than ``gap``.
    """
    rules = _Rules(box, full, gap, shortfall)
    if len(segments) == 1 and segments[0].x1 > segments[0].x0 and segments[0].y1 > segments[0].y0:
        return _alone(segments[0], rules)
    order = Order(segments, loose)
    return _Frontier(order, segments, rules).best() if order.transitive else _by_paths(order, segments, rules)


def _alone(s: Segment, rules: _Rules) -> Chain:
    """The chain of one segment that has a length, by the sums of _Frontier: most pairs have no more."""
    x0, x1, y0, y1 = rules.box
    before, behind = rules.missed(x0, y0, s.x0, s.y0), rules.missed(s.x1, s.y1, x1, y1)
    size, missed = (s.x1 - s.x0, s.y1 - s.y0), (before[0] + behind[0], before[1] + behind[1])
    p, q = float(rules.full).as_integer_ratio()
    if min(missed) >= rules.shortfall or not any(n * (q - p) > m * p for n, m in zip(size, missed, strict=True)):
        return Chain(False, 0, set())
    return Chain(True, 2 * (int(s.iden) * sum(size) // 2) // sum(size), {0})


class _Frontier:
    """Chains by the sums that paths can have at each segment, instead of by paths.

    A chain spans if for a side whose share counts and a side whose misses count
    (four choices) the gain of the first is positive and the second misses less
    than the shortfall.  The gain is what is covered and missed, weighted so that
    it is positive where the share is over ``full``: a sum, in whole numbers.  A
    path needs no more than its misses (few whole numbers below the shortfall) and
    for each the greatest gain; sums from the roots and sums to the leaves tell
    which segments lie in a chain that spans.

    For the score, which is a mean, chains of more than a given one are looked
    for: a path then has a second sum, how far it is above that score, and a
    segment holds the undominated pairs of both that can still reach a leaf;
    gains beyond what any rest of a chain can lose count as one.
    """

    CHOICES = ((0, 0), (0, 1), (1, 0), (1, 1))

    def __init__(self, order: Order, segments: list[Segment], rules: _Rules):
        self.n, self.rules = len(segments), rules
        self.below = [order.nearest(k) for k in range(self.n)]
        self.roots = order.nearest(None)
        p, q = float(rules.full).as_integer_ratio()
        self.keep, self.lose = q - p, p
        self.size = [(s.x1 - s.x0, s.y1 - s.y0) for s in segments]
        self.worth = [int(s.iden) * (n + m) // 2 for s, (n, m) in zip(segments, self.size, strict=True)]
        x0, x1, y0, y1 = rules.box
        self.first = {k: rules.missed(x0, y0, segments[k].x0, segments[k].y0) for k in self.roots}
        self.last = {k: rules.missed(s.x1, s.y1, x1, y1) for k, s in enumerate(segments) if not self.below[k]}
        self.between = [[rules.missed(s.x1, s.y1, segments[j].x0, segments[j].y0) for j in js] for s, js in zip(segments, self.below, strict=True)]

    def _from_roots(self, share: int, miss: int) -> list[dict[int, tuple[int, int, int]]]:
        """For each segment, by what has been missed: the greatest gain of a path that ends there, with its worth and length."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(self.n)]

        def reach(k: int, gain: int, worth: int, length: int, missed: int, d: tuple[int, int]) -> None:
            missed += d[miss]
            if missed < self.rules.shortfall:
                size = self.size[k]
                now = (gain + size[share] * self.keep - d[share] * self.lose, worth + self.worth[k], length + sum(size))
                if missed not in out[k] or out[k][missed] < now:
                    out[k][missed] = now

        for k in self.roots:
            reach(k, 0, 0, 0, 0, self.first[k])
        for k in range(self.n):
            for missed, (gain, worth, length) in out[k].items():
                for j, d in zip(self.below[k], self.between[k], strict=True):
                    reach(j, gain, worth, length, missed, d)
        return out

    def _to_leaves(self, miss: int, value, cost) -> list[dict[int, int]]:
        """For each segment, by what is missed behind it: the greatest sum of ``value`` of the segments and less ``cost`` of the gaps behind it."""
        out: list[dict[int, int]] = [{} for _ in range(self.n)]
        for k in reversed(range(self.n)):
            if not self.below[k]:
                d = self.last[k]
                if d[miss] < self.rules.shortfall:
                    out[k][d[miss]] = -cost(d)
            for j, d in zip(self.below[k], self.between[k], strict=True):
                more = value(j) - cost(d)
                for missed, v in out[j].items():
                    m = missed + d[miss]
                    if m < self.rules.shortfall and out[k].get(m, v + more - 1) < v + more:
                        out[k][m] = v + more
        return out

    def _most(self, behind: dict[int, int], missed: int) -> int | None:
        """The greatest sum behind a segment before which ``missed`` was missed."""
        return max((v for m, v in behind.items() if m + missed < self.rules.shortfall), default=None)

    def best(self) -> Chain:
        marked, score, gains = set(), 0, {}
        for share, miss in self.CHOICES:
            before = self._from_roots(share, miss)
            behind = self._to_leaves(miss, lambda k, s=share: self.size[k][s] * self.keep, lambda d, s=share: d[s] * self.lose)
            least = self._to_leaves(miss, lambda k, s=share: -self.size[k][s] * self.keep, lambda d, s=share: -d[s] * self.lose)
            gains[share, miss] = behind, least
            for k in range(self.n):
                good = [(m, x) for m, x in before[k].items() if (v := self._most(behind[k], m)) is not None and x[0] + v > 0]
                if good:
                    marked.add(k)
                for m, (gain, worth, length) in good if k in self.last else ():
                    if gain + self._most(behind[k], m) > 0:
                        score = max(score, 2 * worth // max(length, 1))
        while marked and (more := self._above(score + 1, gains)) is not None:
            score = more
        return Chain(bool(marked), score, marked)

    def _above(self, score: int, gains: dict) -> int | None:
        """The score of a chain that spans and has at least ``score``, if there is one."""
        height = [2 * w - score * sum(size) for w, size in zip(self.worth, self.size, strict=True)]
        for miss in (0, 1):
            behind = self._to_leaves(miss, height.__getitem__, lambda d: 0)
            if all((v := self._most(behind[k], self.first[k][miss])) is None or v + height[k] < 0 for k in self.roots):
                continue
            for share in (0, 1):
                got = self._highest(share, miss, height, behind, gains[share, miss])
                if got is not None:
                    return got
        return None

    def _highest(self, share: int, miss: int, height: list[int], heights: list[dict[int, int]], gains: tuple) -> int | None:
        gains, losses = gains
        held: list[dict[int, list[tuple[int, int, int, int]]]] = [{} for _ in range(self.n)]
        best = None

        def reach(k: int, gain: int, high: int, worth: int, length: int, missed: int, d: tuple[int, int]) -> None:
            missed += d[miss]
            size = self.size[k]
            gain, high = gain + size[share] * self.keep - d[share] * self.lose, high + height[k]
            g, h = self._most(gains[k], missed), self._most(heights[k], missed)
            if g is None or gain + g <= 0 or high + h < 0:
                return
            # A path whose gain stays positive whatever follows needs no more of it.
            enough = self._most(losses[k], missed) + 1
            held[k].setdefault(missed, []).append((min(gain, enough), high, worth + self.worth[k], length + sum(size)))

        for k in self.roots:
            reach(k, 0, 0, 0, 0, 0, self.first[k])
        for k in range(self.n):
            for missed, sums in held[k].items():
                # By gain, the highest first: what is not above all before it is dominated.
                sums.sort(reverse=True)
                top = None
                for gain, high, worth, length in sums:
                    if top is not None and high <= top:
                        continue
                    top = high
                    if k in self.last:
                        if gain - self.last[k][share] * self.lose > 0 and high >= 0:
                            best = max(best or 0, 2 * worth // max(length, 1))
                    for j, d in zip(self.below[k], self.between[k], strict=True):
                        reach(j, gain, high, worth, length, missed, d)
            held[k] = {}
        return best


def _by_paths(order: Order, segments: list[Segment], rules: _Rules) -> Chain:
    """The same where some segments have no length, so that what can follow depends on the path: a search that holds one path.

    What is missed only grows, so a path that misses too much on both sides is
    left at once.
    """
    best, marked, last = 0, set(), len(segments)
    roots, mask = order.branches(None, None)
    # A frame: place (``last`` for the root), its branches yet to come, their mask, sums so far, score, whether a chain through it spans.
    path: list[list] = [[last, list(roots), mask, (0, 0, 0, 0), 0, False]]
    while True:
        frame = path[-1]
        place, branches, mask, sums, score, _ = frame
        if branches:
            k = branches.pop()
            s = segments[k]
            x, y = (rules.box[0], rules.box[2]) if place == last else (segments[place].x1, segments[place].y1)
            dx, dy = rules.missed(x, y, s.x0, s.y0)
            n, m = s.x1 - s.x0, s.y1 - s.y0
            now = (sums[0] + n, sums[1] + m, sums[2] + dx, sums[3] + dy)
            if min(now[2:]) >= rules.shortfall:
                continue
            total = score + int(s.iden) * (n + m) // 2
            below, inner = order.branches(k, mask)
            found = False
            if not below:
                dx, dy = rules.missed(s.x1, s.y1, rules.box[1], rules.box[3])
                if found := rules.spans(now[0], now[1], now[2] + dx, now[3] + dy):
                    best = max(best, total * 2 // max(now[0] + now[1], 1))
            path.append([k, list(below), inner, now, total, found])
            continue
        path.pop()
        found = frame[5]
        if found and place != last:
            marked.add(place)
        if not path:
            return Chain(found, best, marked)
        path[-1][5] |= found
