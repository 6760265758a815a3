"""Stage 2 in rounds: the same as one run over everything, however it is dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from famloom.config import Config
from famloom.operators import rounds
from famloom.operators.elements import dumbbells, element_extents, greedy_elements, images
from famloom.operators.graph import written
from famloom.operators.refine import Alignment, Element, Refiner, birth_keys

MSPS = "msp_id long, score int, iden float, direction int, q_seq string, q_lb int, q_rb int, s_seq string, s_lb int, s_rb int"


def _msps(seed, n=160, chain=False):
    """Copies of a few stretches on many sequences, whole or in part; as a chain, each sequence is like the next ones alone."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        q = r.randrange(30)
        s = q + r.randrange(1, 3) if chain else r.randrange(30)
        at, size = r.choice((100, 420, 800)), r.choice((80, 150, 300))
        jitter = lambda: r.randrange(-8, 9)
        one, two = at + jitter(), at + jitter() + r.choice((0, 0, 0, 320))
        out.append((k, 500 + k, float(r.randrange(700, 999)) / 10, r.choice((1, 1, -1)), f"s{q:02d}", one, one + size + jitter(), f"s{s:02d}", two, two + size + jitter()))
    return out


def _stage_one(spark, msps):
    msps = spark.createDataFrame(msps, MSPS)
    assigned = written(greedy_elements(images(msps), Config()))
    return written(dumbbells(assigned).join(msps.select("msp_id", "iden", "direction", "score"), "msp_id")), written(element_extents(assigned))


def _everything_at_once(bells, extents):
    """stat, extent of each element and the edges, by keys, of one Refiner over all parts."""
    r, homes, known = Refiner(), {}, {}
    for e in sorted(extents.collect(), key=lambda e: e.ele_id):
        homes[e.ele_id] = Element(e.ele_id, e.seq, e.lb, e.rb)
        r.elements.append(homes[e.ele_id])
    for b in sorted(bells.collect(), key=lambda b: (b.msp_id, b.side)):
        a = known.setdefault(b.msp_id, Alignment(b.msp_id, b.iden, b.direction, b.score, [0, 0], [0, 0], [None, None]))
        a.lb[b.side], a.rb[b.side], a.home[b.side] = b.lb, b.rb, homes[b.ele_id]
        a.home[b.side].images.append((a, b.side))
    r.next_alignment = max(known) + 1
    r.run()
    keys = birth_keys(r.elements)
    number = {e: k + 1 for k, e in enumerate(sorted(r.elements, key=keys.get))}
    elements = sorted((number[e], e.stat, e.seq, e.lb, e.rb, len(e.images), e.fate) for e in r.elements)
    edges = sorted((x.number, number[x.one], number[x.two], x.kind, x.score, x.direction) for e in r.elements for x in e.edges.values() if x.one is e)
    images = sorted((number[e], a.number, s, a.lb[s], a.rb[s], a.direction, a.score, "p" if a.primary else "s") for e in r.elements for a, s in e.images)
    return elements, [(k, *x[1:]) for k, x in enumerate(edges)], images


def _told(refined):
    elements = sorted((x.ele_id, x.stat, x.seq, x.lb, x.rb, x.img_no, x.fate) for x in refined.elements.collect())
    edges = sorted((x.edge_id, x.ele1, x.ele2, x.type, x.score, x.direction) for x in refined.edges.collect())
    images = sorted((x.ele_id, x.msp_id, x.side, x.lb, x.rb, x.direction, x.score, x.stat) for x in refined.images.collect())
    return elements, edges, images


@pytest.mark.parametrize(("seed", "chain", "largest"), [(1, False, 100_000), (2, True, 40)])
def test_rounds_give_what_one_run_gives(spark, seed, chain, largest):
    bells, extents = _stage_one(spark, _msps(seed, chain=chain))
    elements, edges, images = _everything_at_once(bells, extents)
    got = _told(rounds.refine(bells, extents, largest=largest))
    assert got[0] == elements and got[1] == edges
    # New alignments are numbered in the order of one run, without those that went again.
    shape = lambda rows: sorted((x[0], *x[2:]) for x in rows)
    assert shape(got[2]) == shape(images) and any(x[1] == "X" for x in elements)


def _alone(rows, config=None):
    """The rounds of one part, run here: as many turns a round as ``largest`` says, each region by itself."""
    region = rounds._Region(config or Config(), rows)
    region.run()
    return region, list(region.rows())


def _element(n, stat="z", turn="000001|", touched=None, origin=None):
    key = f"0{n:019d}"
    return {"kind": "element", "part": 1, "o1": origin or n, "o2": origin or n, "ele": key, "ele2": None, "key": None, "stat": stat, "turn": turn and turn + key, "touched": touched, "fate": None, "seq": "s", "lb": 0, "rb": 100, "strict": False}


def _align(k, a, b):
    return {"kind": "align", "part": 1, "o1": a, "o2": b, "key": f"0{k:019d}", "ele": f"0{a:019d}", "ele2": f"0{b:019d}", "stat": "s", "turn": None, "lb": 0, "rb": 100, "lb2": 0, "rb2": 100, "direction": 1, "score": 9, "iden": 90.0, "strict": False}


def _mark(kind, n=None, turn=None):
    return {"kind": kind, "part": 1, "o1": n, "ele": n and f"0{n:019d}", "turn": turn, "strict": False}


def test_a_region_stops_where_its_surroundings_end():
    line = [_element(n) for n in range(1, 6)] + [_align(n, n, n + 1) for n in range(1, 5)]
    turn = lambda n: f"000001|0{n:019d}"
    # Turn 1 reaches 4; what lies behind 5 is not at hand, which 4 would have to look at.
    region, out = _alone([*line, _mark("far", 5), _mark("until", turn=turn(5))])
    stat = {x["o1"]: x["stat"] for x in out if x["kind"] == "element"}
    assert stat == {1: "v", 2: "v", 3: "v", 4: "z", 5: "z"} and not any(x["done"] for x in out) and region.late is None
    assert {x["touched"] for x in out if x["kind"] == "element"} == {turn(1), None}
    # Only as far as turns are given.
    assert {x["stat"] for x in _alone([*line, _mark("until", turn=turn(0))])[1] if x["kind"] == "element"} == {"z"}
    # A whole part has no end.
    assert {(x["stat"], x["done"]) for x in _alone(line)[1] if x["kind"] == "element"} == {("v", True)}


def test_a_turn_that_comes_too_late_is_noticed():
    later = f"000001|0{9:019d}"
    rows = [_element(1), _element(2, "v", None, later), _align(1, 1, 2), _mark("until", turn=later)]
    region, out = _alone(rows)
    assert region.late and [x["kind"] for x in out][0] == "late" and {x["stat"] for x in out if x["kind"] == "element" and x["o1"] == 1} == {"z"}


def test_a_part_that_came_too_late_starts_anew(spark, monkeypatch):
    bells, extents = _stage_one(spark, _msps(3, n=60))
    want = _told(rounds.refine(bells, extents))
    kept, real = [], rounds._round

    def spoiled(state, config, largest):
        """The first round says that every part came too late."""
        out = real(state, config, largest)
        if not kept:
            kept.append(1)
            late = out.select("part").distinct()
            marks = late.select(*rounds._row("string", kind="late", part=F.col("part"), done=F.lit(False), strict=F.lit(False)))
            return out.unionByName(marks)
        assert state.where("kind = 'element' and not strict").count() == 0
        return out

    monkeypatch.setattr(rounds, "_round", spoiled)
    assert _told(rounds.refine(bells, extents)) == want and kept


def test_a_run_goes_on_behind_its_last_round(spark, tmp_path, monkeypatch):
    from famloom.plans import pipeline

    msps = spark.createDataFrame(_msps(2, chain=True), MSPS)
    real, made = rounds._round, []

    def failing(state, config, largest):
        made.append(1)
        if len(made) == 2:
            raise RuntimeError("lost")
        return real(state, config, largest)

    monkeypatch.setattr(rounds, "_round", failing)
    with pytest.raises(RuntimeError):
        pipeline.run(msps, folder=str(tmp_path / "a"), largest=40)
    assert len(made) == 2 and (tmp_path / "a" / "round-1" / "_SUCCESS").exists()
    members = lambda r: sorted(map(tuple, r.members.collect()))
    again = members(pipeline.run(msps, folder=str(tmp_path / "a"), largest=40))
    after = len(made)
    monkeypatch.setattr(rounds, "_round", real)
    assert again == members(pipeline.run(msps)) and after > 2


def _ribbon(seqs, n, spots):
    """A long thin part: each sequence is like the next two."""
    r = random.Random(4)
    jitter = lambda: r.randrange(-8, 9)
    out = []
    for k in range(n):
        q, size = k * seqs // n, r.choice((100, 160, 300))
        one, two = r.randrange(spots) * 500 + 100 + jitter(), r.randrange(spots) * 500 + 100 + jitter()
        out.append((k, 500 + k % 400, float(r.randrange(700, 999)) / 10, r.choice((1, 1, -1)), f"s{q:04d}", one, one + size + jitter(), f"s{q + r.randrange(1, 3):04d}", two, two + size + jitter()))
    return out


@pytest.mark.parametrize(("ribbon", "joins"), [((240, 1900, 5), False), ((300, 2400, 4), True)])
def test_strips_give_what_one_run_gives(spark, monkeypatch, ribbon, joins):
    bells, extents = _stage_one(spark, _ribbon(*ribbon))
    elements, edges, images = _everything_at_once(bells, extents)
    made, real = [], rounds._run_strips

    def noted(state, tasks, borders, config):
        made.append(tasks)
        return real(state, tasks, borders, config)

    monkeypatch.setattr(rounds, "_run_strips", noted)
    for name, value in {"STRIP": 400, "SHIFT": 1, "AHEAD": 10, "BEHIND": 4}.items():
        monkeypatch.setattr(rounds, name, value)
    got = _told(rounds.refine(bells, extents))
    # Strips of one part side by side; those that say different things are run as one.
    assert len(made[0]) > 3 and len({t.part for t in made[0]}) == 1 and (len(made) > 1) == joins
    assert all(t.last > t.first for tasks in made[1:] for t in tasks)
    assert got[0] == elements and got[1] == edges
    shape = lambda rows: sorted((x[0], *x[2:]) for x in rows)
    assert shape(got[2]) == shape(images) and any(x[1] == "X" for x in elements)


def test_no_turn_sees_what_lies_on_both_sides_of_a_border():
    import numpy as np

    r = random.Random(1)
    ranges = np.array(sorted(r.sample(range(4000), 3000)))
    reach = np.maximum(ranges + np.array([r.randrange(9) for _ in ranges]), [*ranges[1:], 0])  # connected
    weight = np.array([r.randrange(1, 9) for _ in ranges])
    found = rounds._borders(ranges, reach, weight, Config(), 2000, 10, 5)
    assert len(found) > 3
    for b, after in zip(found, [*found[1:], None], strict=True):
        seen = set(ranges[ranges < b.low])
        for _ in range(2 * Config().clan_depth):
            seen |= {y for x, z in zip(ranges, reach, strict=True) if x in seen for y in range(x, z + 1)}
        assert max(seen) < b.high and b.begin < b.low < b.own < b.high < b.end and (after is None or b.end <= after.low)
    # All within few hops of all: no border.
    assert not rounds._borders(ranges, np.full(3000, 3999), weight, Config(), 2000, 10, 5)


def test_strips_that_say_different_things_are_joined():
    t = [rounds._Task(1, k, k) for k in range(4)]
    told = {t[0]: {0: "a"}, t[1]: {0: "a", 1: "b"}, t[2]: {1: "c", 2: "d"}, t[3]: {2: "d"}}
    assert rounds._joined(t, told) == [t[0], rounds._Task(1, 1, 2), t[3]]
