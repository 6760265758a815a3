"""Stage 2 on the objects of one task: boundaries are voted on, elements split and clustered again, and the element graph built.

``Refiner`` holds some of the elements and what lies between them; ``rounds`` deals
them out and decides which elements it may come to.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np

from famloom.config import Config
from famloom.functions.segments import Segment, best_chain, cut, facing, partner_ends
from famloom.operators.boundaries import cluster_points, merge_points
from famloom.operators.elements import recluster


@dataclass(eq=False)
class Alignment:
    """Both sides of an alignment; index 0 is the query."""

    number: int
    iden: float
    direction: int
    score: int
    lb: list[int]
    rb: list[int]
    home: list[Element] = field(default_factory=list)
    primary: bool = False

    def length(self, side: int) -> int:
        return self.rb[side] - self.lb[side]

    def seen_from(self, side: int) -> Segment:
        return facing(self.lb[side], self.rb[side], self.lb[1 - side], self.rb[1 - side], self.direction, self.iden)

    def moved(self, side: int, to: Segment) -> tuple[list[int], list[int]]:
        """lb and rb of both sides where ``side`` sees ``to``."""
        p_lb, p_rb = partner_ends(to, self.direction)
        return ([to.x0, p_lb], [to.x1, p_rb]) if side == 0 else ([p_lb, to.x0], [p_rb, to.x1])


#: One side of an alignment.
Image = tuple[Alignment, int]


def _extent(i: Image) -> tuple[int, int]:
    return i[0].lb[i[1]], i[0].rb[i[1]]


def _partner(i: Image) -> Element:
    return i[0].home[1 - i[1]]


@dataclass(eq=False)
class Edge:
    number: int
    one: Element
    two: Element
    kind: str
    score: int
    direction: int

    def across(self, element: Element) -> Element:
        return self.two if element is self.one else self.one


@dataclass(eq=False)
class Element:
    """stat: z new, t has edges, v done, w to be looked at again, X gone."""

    number: int
    seq: object
    lb: int
    rb: int
    stat: str = "z"
    images: list[Image] = field(default_factory=list)
    edges: dict[int, Edge] = field(default_factory=dict)
    votes: list[tuple[int, Element]] = field(default_factory=list)
    children: list[Element] = field(default_factory=list)
    #: Boundaries (position, support) at which the element was split.
    cuts: list[tuple[int, int]] = field(default_factory=list)
    every_partner: bool = False
    birth: tuple | None = None
    fate: str | None = None
    #: Whether the order of ``images`` counts; if not, they are taken by number.
    ordered: bool = False
    #: Whether it has images that are not at hand here.
    elsewhere: bool = False
    #: The given element that it goes back to.
    origin: int = 0

    def length(self) -> int:
        return self.rb - self.lb

    def listed(self) -> list[Image]:
        if not self.ordered:
            self.images.sort(key=lambda i: 2 * i[0].number + i[1])
            self.ordered = True
        return self.images

    def line(self) -> Iterator[Element]:
        """The last of its line: itself, or those of its children in turn."""
        todo = [self]
        while todo:
            e = todo.pop()
            if e.children:
                todo += reversed(e.children)
            else:
                yield e

    def everyone(self) -> Iterator[Element]:
        """Itself and all that came of it."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += e.children


def box(e: Element, other: Element, direction: int) -> tuple[int, int, int, int]:
    """Both elements' extents as a segment's ends."""
    return facing(e.lb, e.rb, other.lb, other.rb, direction)[:4]


class Refiner:
    def __init__(self, config: Config = Config()):  # noqa: B008
        self.config = config
        self.elements: list[Element] = []
        self.next_alignment = self.next_edge = 0
        self.round = 0
        self.seed: Element | None = None
        self.born = 0
        #: Elements that were done and are to be looked at again.
        self.woken: list[Element] = []
        self.full = np.float32(config.full_length)
        self.loose = np.float32(1.0 - float(self.full))

    def is_full(self, image: Image) -> bool:
        a, side = image
        e, (lb, rb) = a.home[side], _extent(image)
        near = lb - e.lb < self.config.slack and rb - e.rb > -self.config.slack
        return near and e.length() != 0 and np.float32((rb - lb) / e.length()) > self.full

    # --- edges and votes --------------------------------------------------------

    def chain(self, group: list[Image], owner: Element) -> tuple[bool, int, int]:
        """Whether a chain of partial images spans its elements, and the best score and its direction; marks the images of all such chains.

        ``group``: images of one pair, sorted by direction and place.  Of equal scores direction 1 wins.
        """
        found, best, way = False, 0, 0
        for direction in (1, -1):
            images = [i for i in group if i[0].direction == direction]
            if not images:
                continue
            got = best_chain([a.seen_from(s) for a, s in images], box(owner, _partner(images[0]), direction), self.loose, float(self.full), self.config.chain_gap, self.config.chain_shortfall)
            for k in got.marked:
                images[k][0].primary = True
            found |= got.found
            if got.score > best:
                best, way = got.score, direction
        return found, best, way

    def connect(self, e: Element) -> None:
        """An edge, and votes of primary images, for each partner that is due."""
        due = [i for i in e.listed() if (o := _partner(i)) is not e and (e.every_partner or o.stat == "z")]
        due.sort(key=lambda i: (_partner(i).number, i[0].direction, *_extent(i)))
        for _, group in groupby(due, key=lambda i: _partner(i).number):
            self._link(e, list(group))
        e.every_partner, e.stat = False, "t"

    def _link(self, e: Element, group: list[Image]) -> None:
        other, winner, score, direction, waiting = _partner(group[0]), None, 0, 0, []
        for a, s in group:
            if (self.is_full((a, s)) or self.is_full((a, 1 - s))) and a.iden > score:
                winner, score, direction = a, int(a.iden), a.direction
            if winner is None:
                waiting.append((a, s))
        if found := winner is not None:
            winner.primary = True
        else:
            found, score, direction = self.chain(waiting, e)
        edge = Edge(self.next_edge, e, other, "p" if found else "s", score if found else 0, direction if found else 0)
        self.next_edge += 1
        e.edges[edge.number] = other.edges[edge.number] = edge
        for a, s in group if found else ():
            if a.primary:
                for to, by, side in ((e, other, s), (other, e, 1 - s)):
                    to.votes += [(a.lb[side], by), (a.rb[side], by)]

    # --- redefinition -----------------------------------------------------------

    def boundaries(self, e: Element) -> list[tuple[int, int]]:
        c, out = self.config, []
        for bd, support in cluster_points(sorted(v for v, _ in e.votes), c.vote_width, c.vote_step):
            over = sum(lb <= bd - c.min_overlap and rb > bd + c.min_overlap for lb, rb in map(_extent, e.images))
            if support >= c.span_factor * over:
                out.append((bd, support))
        return merge_points(sorted(out, key=lambda x: x[0]), c.merge_distance)

    def redefine(self, first: Element) -> None:
        """Snap the ends of an element to its boundaries, or split it there and go on with its children, depth first."""
        todo, given = [first], True
        while todo:
            e = todo.pop()
            if not given:  # a child: it has no edges yet
                if not e.images:
                    e.fate = e.fate or "combo"
                    continue
                self.connect(e)
                if not e.votes:
                    e.stat = "v"
                    continue
            given = False
            e.listed().sort(key=_extent)
            cuts, near = self.boundaries(e), self.config.merge_distance
            if any(b - e.lb > near and b - e.rb < -near for b, _ in cuts):
                e.cuts = cuts
                self.split(e, [b for b, _ in cuts])
                e.children = self.divide(e) if e.images else []
                self.dismiss(e, "combo" if e.children else "obsolete")
                for c in e.children:
                    c.every_partner = True
                todo += reversed(e.children)
                continue
            for b, _ in cuts:
                if b - e.lb <= near:
                    e.lb = b
                elif b - e.rb >= -near:
                    e.rb = b
            if e.images:
                e.stat = "v"
            else:
                self.dismiss(e, "obsolete")

    def split(self, e: Element, cuts: list[int]) -> None:
        """Cut all images of ``e`` (and their partners with them); new alignments go before the others, those too short go."""
        short, gone, fresh = self.config.too_short, set(), {}
        touched = {e: None}
        for a, s in e.images:
            if a in gone:
                continue
            copies, rest = cut(a.seen_from(s), a.score, cuts, short)
            for segment, score in copies:
                new = Alignment(self.next_alignment, a.iden, a.direction, score, *a.moved(s, segment), list(a.home))
                self.next_alignment += 1
                for side in (s, 1 - s):
                    fresh.setdefault(a.home[side], []).append((new, side))
            if rest is not None:
                (a.lb, a.rb), a.score = a.moved(s, rest[0]), rest[1]
            else:
                gone.add(a)
                touched |= dict.fromkeys(a.home)
        for home in touched | fresh:
            kept = [i for i in home.images if i[0] not in gone] if home in touched else home.images
            home.images = fresh.get(home, [])[::-1] + kept

    def divide(self, e: Element) -> list[Element]:
        """Children of a split element, last made first."""
        e.images.sort(key=_extent)
        rows, out = list(map(_extent, e.images)), []
        for places in recluster(rows, self.config.recluster, self.config.min_overlap):
            child = Element(self.elements[-1].number + 1, e.seq, rows[places[0]][0], max(rows[k][1] for k in places), birth=(self.round, self.seed, self.born), origin=e.origin)
            self.born += 1
            child.images, child.ordered = [e.images[k] for k in reversed(places)], True
            for a, s in child.images:
                a.home[s] = child
            self.elements.append(child)
            out.append(child)
        e.images = []
        return out[::-1]

    def dismiss(self, e: Element, fate: str) -> None:
        """Take an element out of the graph; its finished neighbours are to be looked at again."""
        e.stat, e.fate = "X", fate
        for edge in e.edges.values():
            other = edge.across(e)
            if other.stat == "v":
                other.stat = "w"
                self.woken.append(other)
            other.votes = [v for v in other.votes if v[1] is not e]
            other.edges.pop(edge.number, None)
        e.edges, e.votes = {}, []

    # --- neighbourhoods ---------------------------------------------------------

    def neighbourhood(self, seed: Element) -> dict[Element, int]:
        """Elements around ``seed`` in breadth-first order, with their hops from it (from 1).

        Elements within ``clan_depth`` hops hand on to their neighbours, new ones
        once they have their edges; finished elements count as at the rim.
        """
        rim, hops, queue = self.config.clan_depth, {seed: 1}, deque([seed])
        while queue:
            e = queue.popleft()
            if hops[e] > rim:
                continue
            if e.stat == "z":
                self.connect(e)
            for _, edge in sorted(e.edges.items()):
                other = edge.across(e)
                if other not in hops:
                    hops[other] = max(hops[e] + 1, rim) if other.stat == "v" else hops[e] + 1
                    queue.append(other)
        return hops

    def settle(self, members: list[Element]) -> bool:
        """One pass over all that is left of ``members``; whether any was redefined."""
        moved = False
        for e in (x for m in members for x in list(m.line())):
            if e.stat in "vX":
                continue
            if e.votes:
                moved = True
                self.redefine(e)
            else:
                e.stat = "v"
        return moved

    def visit(self, seed: Element) -> None:
        """Settle what lies around an element."""
        hops = self.neighbourhood(seed)
        inside = [e for e, n in hops.items() if n <= self.config.clan_depth]
        while self.settle(inside):
            pass
        for e in (x for h in hops for x in h.everyone()):
            e.ordered = False
            if e.stat != "X" and not e.images and not e.elsewhere:
                e.stat, e.fate = "X", "combo" if e.children else "obsolete"

    def turn(self, e: Element) -> None:
        """What happens when an element that is not done is come to in a round."""
        self.seed, self.born = e, 0
        if e.images or e.elsewhere:
            self.visit(e)
        else:
            self.dismiss(e, "obsolete")

    def run(self) -> None:
        """Rounds over all elements by number, new ones too, until one finds nothing to do."""
        busy = True
        while busy:
            busy = False
            self.round += 1
            for e in self.elements:  # grows on the way
                if e.stat not in "zwt":
                    continue
                busy = True
                self.turn(e)


def birth_keys(elements: list[Element]) -> dict[Element, str]:
    """Sorts elements as one run over everything would number them: given ones by id, then new ones by round, seed and order."""
    keys: dict[Element, str] = {}
    for e in elements:  # a seed comes before those born around it
        if e.birth is None:
            keys[e] = f"0{e.number:019d}"
        else:
            turn, seed, order = e.birth
            keys[e] = f"1{turn:06d}({keys[seed]}){order:09d}"
    return keys
