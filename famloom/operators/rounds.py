"""Stage 2 in rounds over tables.

The rules of stage 2 depend on the order in which elements are come to (their
turns: a round's number and an element's key), but a turn reads and changes only
what lies within ``clan_depth`` hops of its element.  So a round of jobs runs turns
of which none can see another that is due before it:

* a connected part of up to ``largest`` alignments is one task, which runs all its
  turns;
* of a larger part the next turns are taken, as many as ``largest`` alignments go
  with, and all within ``clan_depth`` hops of them is claimed.  What is claimed
  falls into connected regions, a task each.  A task runs its turns in order and
  stops at the first whose surroundings reach beyond its region; what is left is
  due in the next round.

Where a large part is long and thin, as its elements are like others near them by
number only, strips of it are tried first, a task each (see ``stripped``): strips
overlap, and what two neighbours say of all turns at the border between them must
be equal, which proves both.

Turns that a region wakes may be due before turns that another region has run by
then.  Each given element knows the last turn that reached it, so a turn that comes
too late is noticed; its part then starts anew with one region a round, where no
turn can come late.

The state is a table of elements, alignments, edges and votes; a round reads the one
before and writes its own.  Where rounds are kept in a folder, a run that failed goes
on behind the last one that was written.  Keys sort elements, alignments and edges as
one run over everything would number them.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from functools import reduce
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from famloom.config import Config
from famloom.operators.graph import components, forget, least_ancestors, numbered, running, written
from famloom.operators.refine import Alignment, Edge, Element, Refiner

#: Alignments that a task may hold, but for what one turn alone reaches; it needs some 250 MB for each 100,000.
LARGEST = 700_000

#: Alignments of a strip, about; given elements whose numbers differ in the last SHIFT bits alone are a range, the unit of strips.
STRIP, SHIFT = 60_000, 7
#: Hops from the beginning of a strip to its first border, and from a border to the end of the strip before: how far what is cut off there may be felt.
AHEAD, BEHIND = 72, 12

#: One row a thing; o1 and o2 are the given elements that its one or two elements go back to.
_COLUMNS = {
    "kind": "string", "part": "long", "o1": "long", "o2": "long", "key": "string", "ele": "string", "ele2": "string", "stat": "string", "turn": "string", "touched": "string", "fate": "string",
    "seq": None, "lb": "int", "rb": "int", "lb2": "int", "rb2": "int", "direction": "int", "score": "int", "iden": "float", "done": "boolean", "strict": "boolean",
}

_PENDING = "kind = 'element' and stat in ('z', 'w', 't')"


def _row(kind_of_seq: str, /, **columns: Column | str) -> list[Column]:
    return [F.lit(columns[n]).alias(n) if isinstance(columns.get(n), str) else columns.get(n, F.lit(None)).cast(t or kind_of_seq).alias(n) for n, t in _COLUMNS.items()]


def given_key(number: Column) -> Column:
    return F.concat(F.lit("0"), F.lpad(number.cast("string"), 19, "0"))


def _start(bells: DataFrame, extents: DataFrame, parts: DataFrame) -> DataFrame:
    """The state before the first turn."""
    seq, no = dict(extents.dtypes)["seq"], F.lit(False)
    where = parts.select(F.col("node").alias("ele_id"), F.col("root").alias("part"))
    c, key = F.col, given_key(F.col("ele_id"))
    found = extents.join(bells.select("ele_id").distinct(), "ele_id", "left_semi").join(where, "ele_id")
    elements = found.select(*_row(seq, kind="element", part=c("part"), o1=c("ele_id"), o2=c("ele_id"), ele=key, stat="z", turn=F.concat(F.lit("000001|"), key), seq=c("seq"), lb=c("lb"), rb=c("rb"), done=no, strict=no))
    sides = bells.where("side = 0").join(where, "ele_id")
    both = {"lb": c("lb"), "rb": c("rb"), "lb2": c("p_lb"), "rb2": c("p_rb"), "direction": c("direction"), "score": c("score"), "iden": c("iden")}
    return elements.unionByName(sides.select(*_row(seq, kind="align", part=c("part"), o1=c("ele_id"), o2=c("p_ele"), key=given_key(c("msp_id")), ele=key, ele2=given_key(c("p_ele")), stat="s", done=no, strict=no, **both)))


# --- a task --------------------------------------------------------------------------


class _Region:
    """What a task holds, as objects."""

    def __init__(self, config: Config, rows: list[dict]):
        kinds = defaultdict(list)
        for x in rows:
            kinds[x["kind"]].append(x)
        self.part, self.strict = rows[0]["part"], kinds["element"][0]["strict"] if kinds["element"] else False
        self.until = min((x["turn"] for x in kinds["until"]), default=None)
        self.refiner, self.depth = Refiner(config), config.clan_depth
        self.keys: dict[Element, str] = {}
        self.turns: dict[Element, str] = {}
        self.touched: dict[int, str] = {}
        self.alignment_keys, self.edge_keys, self.late = [], [], None
        self.own = next(((x["o1"], x["o2"]) for x in kinds["own"]), None)
        self.borders = {x["lb"]: (x["o1"], x["o2"]) for x in kinds["border"]}
        by: dict[str, Element] = {}
        for k, x in enumerate(sorted(kinds["element"], key=lambda x: x["ele"])):
            e = by[x["ele"]] = Element(k, x["seq"], x["lb"], x["rb"], x["stat"], origin=x["o1"])
            self.refiner.elements.append(e)
            self.keys[e] = x["ele"]
            if x["turn"]:
                self.turns[e] = x["turn"]
            if x["touched"]:
                self.touched[e.origin] = max(self.touched.get(e.origin, ""), x["touched"])
        self.next_to, self.rim = defaultdict(set), {x["o1"] for x in kinds["far"]}
        for x in kinds["far"]:
            by[x["ele"]].elsewhere = True
        for x in kinds["align"] + kinds["edge"]:
            self.next_to[x["o1"]].add(x["o2"])
            self.next_to[x["o2"]].add(x["o1"])
        for k, x in enumerate(sorted(kinds["align"], key=lambda x: x["key"])):
            homes = [by[x["ele"]], by[x["ele2"]]]
            a = Alignment(k, x["iden"], x["direction"], x["score"], [x["lb"], x["lb2"]], [x["rb"], x["rb2"]], homes, x["stat"] == "p")
            self.alignment_keys.append(x["key"])
            for side in (0, 1):
                homes[side].images.append((a, side))
        for k, x in enumerate(sorted(kinds["edge"], key=lambda x: x["key"])):
            one, two = by[x["ele"]], by[x["ele2"]]
            one.edges[k] = two.edges[k] = Edge(k, one, two, x["stat"], x["score"], x["direction"])
            self.edge_keys.append(x["key"])
        for x in kinds["vote"]:
            by[x["ele"]].votes.append((x["lb"], by[x["ele2"]]))
        self.refiner.next_alignment, self.refiner.next_edge = len(self.alignment_keys), len(self.edge_keys)
        #: What came of the given elements of borders, and what turns did to them; given elements whose turns may reach them.
        self.lines: dict[int, list[Element]] = defaultdict(list)
        self.traces: dict[int, bytes] = {}
        if self.borders:
            for e in self.refiner.elements:
                self.lines[e.origin].append(e)
            self.traces = {o: b"" for o in self.lines if any(low <= o < high for low, high in self.borders.values())}
        self.watched = set(self.traces)
        for _ in range(self.depth if self.traces else 0):
            self.watched |= {y for x in self.watched for y in self.next_to[x]}

    def around(self, origin: int) -> dict[int, int] | None:
        """Given elements within reach of a turn, with their hops; None if some of them are not at hand."""
        hops, queue = {origin: 0}, deque([origin])
        while queue:
            x = queue.popleft()
            if hops[x] == self.depth:
                continue
            if x in self.rim:
                return None
            for y in self.next_to[x]:
                if y not in hops:
                    hops[y] = hops[x] + 1
                    queue.append(y)
        return hops

    def run(self) -> None:
        """All turns that can be run here, in order."""
        r, due = self.refiner, [(t, self.keys[e], e.number) for e, t in self.turns.items()]
        heapify(due)
        while due:
            turn, _, number = heappop(due)
            e = r.elements[number]
            if e.stat not in "zwt" or self.turns.get(e) != turn:
                continue
            if self.until is not None:
                near = self.around(e.origin) if turn <= self.until else None
                if near is None:
                    return
                if any(self.touched.get(o, "") > turn for o in near):
                    self.late = turn
                    return
                self.touched |= dict.fromkeys(near, turn)
            r.round, r.woken, first = int(turn[:6]), [], len(r.elements)
            r.turn(e)
            mine = f"{turn[:6]}({self.keys[e]})"
            self.alignment_keys += [f"1{mine}{k:09d}" for k in range(r.next_alignment - len(self.alignment_keys))]
            self.edge_keys += [f"{mine}{k:09d}" for k in range(r.next_edge - len(self.edge_keys))]
            for c in r.elements[first:]:
                self.keys[c] = f"1{mine}{c.birth[2]:09d}"
            for u in r.woken + r.elements[first:]:
                if u.stat in "zwt":
                    self.turns[u] = f"{r.round + (self.keys[u] <= self.keys[e]):06d}|{self.keys[u]}"
                    heappush(due, (self.turns[u], self.keys[u], u.number))
            if e.origin in self.watched:
                for c in r.elements[first:]:
                    self.lines[c.origin].append(c)
                for o in self.around(e.origin) or ():
                    if o in self.traces:
                        self.traces[o] = blake2b(self.traces[o] + repr((turn, self._told(o))).encode(), digest_size=16).digest()

    def _told(self, origin: int) -> list[tuple]:
        """All that is known of what came of a given element."""
        out, name = [], self.keys
        for e in self.lines[origin]:
            images = [(self.alignment_keys[a.number], s, a.lb, a.rb, a.direction, a.score, a.iden, a.primary, name[a.home[0]], name[a.home[1]]) for a, s in e.images]
            edges = sorted((self.edge_keys[x.number], x.kind, x.score, x.direction, name[x.one], name[x.two]) for x in e.edges.values())
            votes = sorted((at, name[by]) for at, by in e.votes)
            due = self.turns.get(e) if e.stat in "zwt" else None
            out.append((name[e], e.stat, due, e.lb, e.rb, e.fate, e.ordered, images if e.ordered else sorted(images), edges, votes, [name[c] for c in e.children], e.cuts))
        return out

    def mine(self, *origins: int) -> bool:
        """Whether a strip answers for what goes back to these given elements: the least counts."""
        return self.own is None or self.own[0] <= min(origins) < self.own[1]

    def rows(self) -> Iterable[dict]:
        """The state afterwards, and what is known for good."""
        whole = self.until is None
        if self.late:
            yield {"kind": "late", "turn": self.late}
        for number, (low, high) in self.borders.items():
            told = repr(sorted(x for x in self.traces.items() if low <= x[0] < high))
            yield {"kind": "border", "lb": number, "key": blake2b(told.encode(), digest_size=16).hexdigest()}
        seen: set[int] = set()
        for e in self.refiner.elements:
            gone, key = e.stat == "X", self.keys[e]
            if self.mine(e.origin):
                yield {"kind": "element", "o1": e.origin, "o2": e.origin, "ele": key, "stat": e.stat, "turn": self.turns.get(e) if e.stat in "zwt" else None, "touched": self.touched.get(e.origin), "fate": e.fate, "seq": e.seq, "lb": e.lb, "rb": e.rb, "done": whole or gone}
                for c in e.children:
                    yield {"kind": "child", "ele": key, "ele2": self.keys[c], "done": True}
                for bd, support in e.cuts:
                    yield {"kind": "cut", "ele": key, "lb": bd, "score": support, "done": True}
            for a, s in e.images:
                if a.number not in seen:
                    seen.add(a.number)
                    one, two = a.home
                    if self.mine(one.origin, two.origin):
                        yield {"kind": "align", "o1": one.origin, "o2": two.origin, "key": self.alignment_keys[a.number], "ele": self.keys[one], "ele2": self.keys[two], "stat": "p" if a.primary else "s", "lb": a.lb[0], "rb": a.rb[0], "lb2": a.lb[1], "rb2": a.rb[1], "direction": a.direction, "score": a.score, "iden": a.iden, "done": whole}
            for x in e.edges.values():
                if x.one is e and self.mine(e.origin, x.two.origin):
                    yield {"kind": "edge", "o1": e.origin, "o2": x.two.origin, "key": self.edge_keys[x.number], "ele": key, "ele2": self.keys[x.two], "stat": x.kind, "score": x.score, "direction": x.direction, "done": whole}
            for at, by in () if whole else e.votes:
                yield {"kind": "vote", "o1": e.origin, "o2": by.origin, "ele": key, "ele2": self.keys[by], "lb": at, "done": False}


def _kernel(config: Config, arrow: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        region = _Region(config, group.to_pylist())
        region.run()
        columns: dict[str, list] = {n: [] for n in arrow.names}
        for x in region.rows():
            x["part"], x["strict"], x["done"] = region.part, region.strict, x.get("done", False)
            for n, values in columns.items():
                values.append(x.get(n))
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in arrow}, schema=arrow)

    return run


# --- strips --------------------------------------------------------------------------


class _Border(NamedTuple):
    """Between two strips, in ranges: it is [low, high), from ``own`` on the second strip answers, which begins at ``begin``; the first one ends before ``end``."""

    low: int
    own: int
    high: int
    begin: int
    end: int
    #: Alignments before ``begin`` and before ``end``.
    to_begin: int
    to_end: int
    #: Alignments of the part.
    whole: int


def _borders(ranges: np.ndarray, reach: np.ndarray, weight: np.ndarray, config: Config, strip: int, ahead: int, behind: int) -> list[_Border]:
    """Borders of a part.

    Of each range (ascending) are given the last range that one of its alignments reaches and how many alignments it
    has.  What lies before and behind a border is more hops apart than any turn reaches across, so no turn sees both.
    """
    last, before = np.maximum.accumulate(np.maximum(reach, ranges)), np.concatenate([[0], np.cumsum(weight)])
    number = max(1, round(before[-1] / strip))
    step = before[-1] / number

    def hops(x: int, n: int) -> int:
        """The first range that lies more than ``n`` hops from all before ``x``."""
        for _ in range(n):
            k = int(np.searchsorted(ranges, x)) - 1
            x = max(x, int(last[k]) + 1) if k >= 0 else x
        return x

    def to(x: int) -> int:
        return int(before[np.searchsorted(ranges, x)])

    def back(x: int) -> int:
        """The last range from whose beginning ``x`` is ``ahead`` hops on; 0 if there is none."""
        low, high = 0, len(ranges)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if hops(int(ranges[middle]), ahead) <= x else (low, middle)
        return int(ranges[low - 1]) if low else 0

    out, at = [], step
    while at < before[-1] - step / 2:
        low = int(ranges[np.searchsorted(before, at, side="right") - 1])
        low, at = max(low, out[-1].end if out else 0), at + step
        own, high = hops(low, config.clan_depth), hops(low, 2 * config.clan_depth)
        begin, end = back(low), hops(high, behind)
        # Where strips would mostly overlap there is none.
        if begin and end <= ranges[-1] and to(end) - to(begin) <= strip:
            out.append(_Border(low, own, high, begin, end, to(begin), to(end), int(before[-1])))
            at = max(at, to(end) + step / 2)
    return out


def _bordered(state: DataFrame, config: Config, strip: int, ahead: int, behind: int) -> DataFrame:
    """part, number and a border, of parts that can be cut into strips of about ``strip`` alignments; smaller ones would not gain."""
    ends = [F.shiftright(f("o1", "o2"), SHIFT) for f in (F.least, F.greatest)]
    ranges = state.where("kind = 'align'").select("part", ends[0].alias("range"), ends[1].alias("reach")).groupBy("part", "range").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n"))
    ranges = written(ranges, "ranges")
    long = ranges.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") >= 3 * strip).select("part")
    names = ("part", "number", *_Border._fields)
    arrow = pa.schema([(n, pa.int64()) for n in names])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("range")
        found = _borders(*(group.column(n).to_numpy() for n in ("range", "reach", "n")), config, strip, ahead, behind)
        part = group.column("part")[0].as_py()
        return pa.Table.from_pylist([{"part": part, "number": k, **b._asdict()} for k, b in enumerate(found)], schema=arrow)

    return ranges.join(long, "part", "left_semi").groupBy("part").applyInArrow(run, ", ".join(f"{n} long" for n in names))


class _Task(NamedTuple):
    """Strips ``first`` to ``last`` of a part; border k lies between strips k and k + 1."""

    part: int
    first: int
    last: int


def _run_strips(state: DataFrame, tasks: list[_Task], borders: dict[int, list[_Border]], config: Config) -> DataFrame:
    """What ``tasks`` come to, with the place of each in the list, and what they say of their borders."""
    seq, spark, most = dict(state.dtypes)["seq"], state.sparkSession, 1 << 40
    held, marks = [], []
    for k, t in enumerate(tasks):
        of = borders[t.part]
        left, right = of[t.first - 1] if t.first else None, of[t.last] if t.last < len(of) else None
        held.append((t.part, k, left.begin if left else 0, right.end if right else most))
        marks.append((t.part, k, "own", left.own << SHIFT if left else 0, right.own << SHIFT if right else most << SHIFT, None))
        marks += [(t.part, k, "border", b.low << SHIFT, b.high << SHIFT, n) for b, n in ((left, t.first - 1), (right, t.last)) if b]
    bounds = spark.createDataFrame(held, "part long, task long, begin long, end long")
    mine = state.join(F.broadcast(bounds.select("part").distinct()), "part", "left_semi").withColumn("range", F.shiftright("o1", SHIFT))
    # Which tasks a range belongs to; ranges are those that elements have.
    ranges = mine.where("kind = 'element'").select("part", "range").distinct().join(F.broadcast(bounds), "part").where("range >= begin and range < end")
    across = F.shiftright("o2", SHIFT).between(F.col("begin"), F.col("end") - 1)
    work = mine.join(ranges, ["part", "range"]).where(across).select(*_COLUMNS, "task")
    marked = spark.createDataFrame(marks, "part long, task long, kind string, o1 long, o2 long, lb int")
    work = work.unionByName(marked.select(*[F.col(n) if n in marked.columns else F.lit(None).cast(t or seq).alias(n) for n, t in _COLUMNS.items()], "task"))
    schema = StructType.fromDDL(", ".join([f"{n} {t or seq}" for n, t in _COLUMNS.items()] + ["task long"]))
    kernel = _kernel(config, to_arrow_schema(StructType(schema.fields[:-1])))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        out = kernel(group)
        return out.append_column("task", pa.array(np.full(len(out), key[0].as_py()), pa.int64()))

    # Tasks are long and few: in more partitions fewer of them come to lie in one.
    return work.repartition(4 * len(tasks), "task").groupBy("task").applyInArrow(run, schema)


def _joined(tasks: list[_Task], told: dict[_Task, dict[int, str]]) -> list[_Task]:
    """The tasks of a part, in order, those joined that do not say the same of the border between them."""
    out = tasks[:1]
    for before, t in zip(tasks, tasks[1:], strict=False):
        if told[before][before.last] == told[t][t.first - 1]:
            out.append(t)
        else:
            out[-1] = _Task(t.part, out[-1].first, t.last)
    return out


def stripped(state: DataFrame, config: Config, stage: Callable, largest: int) -> tuple[list[DataFrame], list[int]]:
    """What strips settle of the state, as tables, and the parts that they settle.

    A part may be cut where what lies before and behind a border is more hops apart
    than a turn reaches across.  A strip begins AHEAD hops before its first border
    and ends BEHIND hops after its last one; all turns of it are run as if nothing
    else were there, so what it comes to near its ends may be wrong.  Both strips
    at a border tell, of each given element in it, the turns that reached it and what it was
    after each.  If they tell the same of every border of a part, then what each strip
    says of its stretch from border to border is what one run over everything
    does: take the first turn by which that run differs; it sees one border at most and what lies
    on one side of it, which until then was the same in the strip of that side, so
    it was run there, and what it did to the border the other strip has as well.
    Strips that tell different things are joined and run anew; where a joined one
    would have more than ``largest`` alignments the part is left to the rounds.
    """
    borders: dict[int, list[_Border]] = {}
    for r in stage("borders", lambda: _bordered(state, config, STRIP, AHEAD, BEHIND)).orderBy("part", "number").collect():
        borders.setdefault(r["part"], []).append(_Border(*(r[n] for n in _Border._fields)))

    def weight(t: _Task) -> int:
        of = borders[t.part]
        return (of[t.last].to_end if t.last < len(of) else of[0].whole) - (of[t.first - 1].to_begin if t.first else 0)

    told: dict[_Task, dict[int, str]] = {}
    made: list[tuple[DataFrame, list[_Task]]] = []
    now = {part: [_Task(part, k, k) for k in range(len(of) + 1)] for part, of in borders.items()}
    while True:
        now = {part: tasks for part, tasks in now.items() if max(map(weight, tasks)) <= largest}
        todo = [t for tasks in now.values() for t in tasks if t not in told]
        if not todo:
            break
        out = stage(f"strips-{len(made) + 1}", lambda todo=todo: _run_strips(state, todo, borders, config))
        made.append((out, todo))
        told |= {t: {} for t in todo}
        for r in out.where("kind = 'border'").select("task", "lb", "key").collect():
            told[todo[r["task"]]][r["lb"]] = r["key"]
        now = {part: _joined(tasks, told) for part, tasks in now.items()}
    good = {t for tasks in now.values() for t in tasks}
    tables = [out.where(F.col("task").isin([k for k, t in enumerate(todo) if t in good])).where("kind != 'border'").select(*_COLUMNS) for out, todo in made]
    return tables, list(now)


# --- a round -------------------------------------------------------------------------


def _claimed(state: DataFrame, big: DataFrame, config: Config, largest: int) -> tuple[DataFrame, DataFrame]:
    """(origin, task) of what the next turns of large parts reach, and (task, turn) of the last turn that each may run."""
    mine = state.join(big.hint("merge"), "part", "left_semi")
    between = mine.where("kind in ('align', 'edge') and o1 != o2")
    links = written(between.select(F.explode(F.array(F.struct("o1", "o2"), F.struct(F.col("o2").alias("o1"), F.col("o1").alias("o2")))).alias("l")).select("l.*").distinct(), "links")
    weight = mine.where("kind = 'align'").select(F.explode(F.array("o1", "o2")).alias("o1")).groupBy("o1").agg(F.count(F.lit(1)).alias("weight"))
    due = mine.where(_PENDING).select("part", "strict", "o1", "turn").join(weight, "o1", "left").withColumn("weight", F.coalesce("weight", F.lit(0)) + 1)
    due = written(running(due, ["part", "turn"], F.col("weight"), "before"), "due")
    base = due.groupBy("part").agg(F.min("before").alias("base"))
    next_ = written(due.join(base, "part").where(F.col("before") - F.col("base") < largest).select("part", "strict", "o1", "turn"), "turns")
    reached = next_.select(F.col("o1").alias("origin")).distinct()
    for _ in range(config.clan_depth):
        reached = reached.union(links.join(reached.hint("merge"), F.col("o1") == F.col("origin")).select(F.col("o2").alias("origin"))).distinct()
    reached = written(reached, "reached")
    ends = [reached.select(F.col("origin").alias(o)).hint("merge") for o in ("o1", "o2")]
    roots = components(links.join(ends[0], "o1", "left_semi").join(ends[1], "o2", "left_semi").where("o1 < o2").select(F.col("o1").alias("u"), F.col("o2").alias("v")))
    of_part = mine.where("kind = 'element'").select(F.col("o1").alias("origin"), "part", "strict").distinct()
    tasks = reached.join(roots.withColumnRenamed("node", "origin").hint("merge"), "origin", "left").join(of_part.hint("merge"), "origin")
    tasks = written(tasks.select("origin", "part", F.when(F.col("strict"), F.col("part")).otherwise(F.coalesce("root", "origin")).alias("task")), "tasks")
    last = next_.groupBy("part").agg(F.max("turn").alias("turn"))
    until = tasks.select("part", "task").distinct().join(last, "part").select("part", "task", "turn")
    forget(links, due)
    return tasks.select("origin", "task"), until


def _round(state: DataFrame, config: Config, largest: int) -> DataFrame:
    seq = dict(state.dtypes)["seq"]
    schema = StructType.fromDDL(", ".join(f"{n} {t or seq}" for n, t in _COLUMNS.items()))
    sizes = state.groupBy("part").agg(F.count(F.when(F.col("kind") == "align", 1)).alias("n"), F.max(F.expr(_PENDING)).alias("busy"))
    sizes = written(sizes, "sizes")
    small = sizes.where(F.col("busy") & (F.col("n") <= largest)).select("part", F.col("part").alias("task"))
    work = state.join(small.hint("merge"), "part")
    idle = state.join(sizes.where(~F.col("busy")).select("part").hint("merge"), "part", "left_semi").withColumn("done", F.lit(True))
    big = sizes.where(F.col("busy") & (F.col("n") > largest)).select("part")
    rest = None
    if big.limit(1).count():
        tasks, until = _claimed(state, big, config, largest)
        one, two = (tasks.select(F.col("origin").alias(o), F.col("task").alias(t)).hint("merge") for o, t in (("o1", "t1"), ("o2", "t2")))
        rows = written(state.join(big.hint("merge"), "part", "left_semi").join(one, "o1", "left").join(two, "o2", "left"), "dealt")
        together = F.coalesce(F.col("t1") == F.col("t2"), F.lit(False))
        names = list(_COLUMNS)
        rest = rows.where(~together).select(*names)
        sides = F.array(F.struct("part", F.col("t1").alias("task"), "o1", "ele"), F.struct("part", F.col("t2").alias("task"), F.col("o2").alias("o1"), F.col("ele2").alias("ele")))
        far = rows.where(~together).where("kind in ('align', 'edge')").select(F.explode(sides).alias("s")).select("s.*").where("task is not null").distinct()
        marks = far.select(*_row(seq, kind="far", part=F.col("part"), o1=F.col("o1"), ele=F.col("ele")), "task").unionByName(until.select(*_row(seq, kind="until", part=F.col("part"), turn=F.col("turn")), "task"))
        work = work.select(*names, "task").unionByName(rows.where(together).select(*names, F.col("t1").alias("task"))).unionByName(marks)
    out = work.select(*_COLUMNS, "task").groupBy("task").applyInArrow(_kernel(config, to_arrow_schema(schema)), schema)
    return reduce(DataFrame.unionByName, [x for x in (out, idle.select(*_COLUMNS), rest) if x is not None])


class Refined(NamedTuple):
    #: ele_id, stat, seq, lb, rb, img_no, fate.
    elements: DataFrame
    #: edge_id, ele1, ele2, type, score, direction.
    edges: DataFrame
    #: ele_id, part, msp_id, side, lb, rb, direction, score, iden, stat.
    images: DataFrame
    #: parent, child: what a split element became.
    children: DataFrame
    #: ele_id, bd, support: the boundaries at which elements were split.
    cuts: DataFrame


def settled(bells: DataFrame, extents: DataFrame, config: Config, stage: Callable, largest: int) -> DataFrame:
    """The rows that are known for good, once no turn is due.  ``stage`` (name, make) keeps tables."""

    def start() -> DataFrame:
        links = bells.where("ele_id < p_ele").select(F.col("ele_id").alias("u"), F.col("p_ele").alias("v")).distinct()
        return _start(bells, extents, least_ancestors(extents.select(F.col("ele_id").alias("node")), links, directed=False))

    first = state = stage("round-0", start)
    known, parts = stripped(first, config, stage, largest)
    if parts:
        state = first.where(~F.col("part").isin(parts))
    spoiled, n = None, 0
    while state.where(_PENDING).limit(1).count():
        n += 1
        out = stage(f"round-{n}", lambda state=state: _round(state, config, largest))
        known.append(out.where("done"))
        state = out.where("not done and kind != 'late'")
        late = out.where("kind = 'late'").select("part").distinct()
        if late.limit(1).count():
            state = state.join(late, "part", "left_anti").unionByName(first.join(late, "part", "left_semi").withColumn("strict", F.lit(True)).select(*_COLUMNS))
            spoiled = late if spoiled is None else spoiled.union(late)
    out = reduce(DataFrame.unionByName, known, state)
    # What a part had come to before it started anew does not count.
    return out if spoiled is None else out.join(spoiled.distinct().withColumn("strict", F.lit(False)), ["part", "strict"], "left_anti")


def refine(bells: DataFrame, extents: DataFrame, config: Config = Config(), stage: Callable | None = None, largest: int = LARGEST) -> Refined:  # noqa: B008
    """Stage 2.

    ``bells``: images with partner element (see dumbbells) with iden, direction
    and score, tandem elements' alignments left out; ``extents``: all elements
    but tandem ones; ``stage`` (name, make): keeps tables of rounds, so that a run
    that failed goes on behind them.
    """
    keep = stage or (lambda name, make: written(make(), name))
    done = keep("rounds", lambda: settled(bells, extents, config, keep, largest))
    # Elements that lost all images to the tandem filter are gone.
    empty = extents.join(bells.select("ele_id").distinct(), "ele_id", "left_anti")
    held = done.where("kind = 'align'").select(F.explode(F.array("ele", "ele2")).alias("ele")).groupBy("ele").agg(F.count(F.lit(1)).alias("img_no"))
    found = done.where("kind = 'element'").select("ele", "stat", "seq", "lb", "rb", "fate").join(held, "ele", "left").withColumn("img_no", F.coalesce("img_no", F.lit(0)))
    last = extents.agg(F.coalesce(F.max("ele_id"), F.lit(0)).alias("last")).first()["last"]
    given = found.where("ele like '0%'").withColumn("ele_id", F.substring("ele", 2, 19).cast("long"))
    elements = written(given.unionByName(numbered(found.where("ele like '1%'"), "ele", "ele_id", last + 1)), "refined")
    gone = empty.select("ele_id", F.lit("X").alias("stat"), "seq", "lb", "rb", F.lit(0).cast("long").alias("img_no"), F.lit("obsolete").alias("fate"))
    name = elements.select("ele", "ele_id")
    second = name.select(F.col("ele").alias("ele2"), F.col("ele_id").alias("id2"))
    two = lambda kind: done.where(F.col("kind") == kind).join(name, "ele").join(second, "ele2")
    edges = two("edge").select("key", F.col("ele_id").alias("ele1"), F.col("id2").alias("ele2"), F.col("stat").alias("type"), "score", "direction")
    edges = numbered(edges, "key", "edge_id").select("edge_id", "ele1", "ele2", "type", "score", "direction")
    top = bells.agg(F.coalesce(F.max("msp_id"), F.lit(0)).alias("last")).first()["last"]
    pairs = two("align").select("key", "part", "ele_id", "id2", "lb", "rb", "lb2", "rb2", "direction", "score", "iden", "stat")
    pairs = pairs.where("key like '0%'").withColumn("msp_id", F.substring("key", 2, 19).cast("long")).unionByName(numbered(pairs.where("key like '1%'"), "key", "msp_id", top + 1))
    sides = F.array(F.struct(F.lit(0).alias("side"), "ele_id", "lb", "rb"), F.struct(F.lit(1).alias("side"), F.col("id2").alias("ele_id"), F.col("lb2").alias("lb"), F.col("rb2").alias("rb")))
    images = pairs.select("part", "msp_id", "direction", "score", "iden", "stat", F.explode(sides).alias("s")).select("s.ele_id", "part", "msp_id", "s.side", "s.lb", "s.rb", "direction", "score", "iden", "stat")
    children = two("child").select(F.col("ele_id").alias("parent"), F.col("id2").alias("child"))
    cuts = done.where("kind = 'cut'").join(name, "ele").select("ele_id", F.col("lb").alias("bd"), F.col("score").alias("support"))
    return Refined(elements.select(*gone.columns).unionByName(gone), edges, images, children, cuts)


def alignments_left(images: DataFrame) -> DataFrame:
    """Alignments both of whose sides are still in an element."""
    return images.groupBy("msp_id").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2")
