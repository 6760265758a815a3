"""Kernels on hand-made cases, without Spark."""

import random
import time

import numpy as np
import pytest

from places import tree_place
from famloom.config import Config
from famloom.functions.segments import Segment, best_chain, cut, facing, partner_ends, tree
from famloom.operators.boundaries import cluster_points, merge_points
from famloom.operators.chains import tree_text
from famloom.operators.elements import greedy, recluster
from famloom.operators.refine import Alignment, Element, Refiner, birth_keys


def test_gap_is_strict():
    assert greedy([(1, 100), (90, 190)], 0.0) == [0, 1]  # 100 - 90 = 10: behind the end
    assert greedy([(1, 100), (89, 190)], 0.0) == [0, 0]


def test_coverage_ties():
    assert greedy([(0, 100), (50, 150)], 0.5) == [0, 0]
    assert greedy([(0, 100), (51, 151)], 0.5) == [0, 1]
    assert greedy([(0, 100), (10, 110)], 0.9, double=True) == [0, 0]
    assert greedy([(0, 100), (11, 111)], 0.9, double=True) == [0, 1]


def test_waiting_intervals_are_tried_again_after_an_extension():
    rows = [(0, 100), (60, 160), (61, 130)]  # the second waits, the third moves the end
    assert greedy(rows, 0.5) == [0, 0, 0]
    assert greedy(rows[:2], 0.5) == [0, 1]


def test_every_interval_has_an_element():
    r = random.Random(1)
    for _ in range(200):
        rows = sorted(((a := r.randrange(300), a + r.randrange(1, 120)) for _ in range(30)), key=lambda x: (x[0], -x[1]))
        out = greedy(rows, 0.5)
        assert min(out) == 0 and set(out) == set(range(max(out) + 1))


def test_recluster_partitions_its_intervals():
    r = random.Random(2)
    for _ in range(200):
        rows = sorted((a := r.randrange(300), a + r.randrange(1, 120)) for _ in range(25))
        assert sorted(k for m in recluster(rows, 0.5) for k in m) == list(range(25))


def test_clusters_emit_suffixes_at_a_gap():
    assert cluster_points([1, 2, 3, 100]) == [(2, 3), (2, 2), (3, 1), (100, 1)]


def test_clusters_start_anew_at_the_width():
    assert cluster_points([0, 8, 16, 24]) == [(8, 3), (24, 1)]


def test_merge_ties_keep_the_earlier():
    assert merge_points([(10, 3), (20, 3)]) == [(10, 3)]
    assert merge_points([(10, 3), (20, 4)]) == [(20, 4)]
    assert merge_points([(10, 3), (21, 1)]) == [(10, 3), (21, 1)]


@pytest.mark.parametrize(
    ("direction", "at", "want"),
    [
        (1, 120, [(120, 300, 1020, 1200, False)]), (-1, 120, [(120, 300, 1000, 1180, False)]),
        (1, 280, [(100, 280, 1000, 1180, False)]), (-1, 280, [(100, 280, 1020, 1200, False)]),
        (1, 200, [(100, 200, 1000, 1100, True), (201, 300, 1101, 1200, False)]), (-1, 200, [(100, 200, 1100, 1200, True), (201, 300, 1000, 1099, False)]),
    ],
)
def test_split(direction, at, want):
    copies, rest = cut(facing(100, 300, 1000, 1200, direction), 100, [at], 30)
    parts = [*((*x, True) for x in copies), (*rest, False)]
    assert [(x.x0, x.x1, *partner_ends(x, direction), new) for x, _, new in parts] == want


def test_split_scores_add_up():
    copies, rest = cut(Segment(100, 300, 1000, 1200), 1000, [200], 30)
    assert copies[0][1] + rest[1] == 1000


def test_split_leaves_out_a_short_rest():
    copies, rest = cut(Segment(0, 400, 0, 130), 1000, [100, 200, 300], 30)
    assert [c[0][:2] for c in copies] == [(0, 100), (101, 200), (201, 300)] and rest is None
    assert cut(Segment(0, 30, 0, 30), 5, [], 30) == ([], None)


def _plain_clusters(points, width=20, step=10):
    """As stated: after a gap a cluster's tail without its first point is clustered once more; the last points once."""
    out, begin = [], 0
    while begin < len(points):
        k = begin
        while k < len(points) and points[k] - points[begin] <= width and (k == begin or points[k] - points[k - 1] <= step):
            k += 1
        out.append((points[begin] + sum(p - points[begin] for p in points[begin:k]) // (k - begin), k - begin))
        if k == len(points):
            return out
        begin = k if points[k] - points[k - 1] <= step else begin + 1
    return out


def test_point_clusters_as_stated_and_in_runs():
    r = random.Random(9)
    for _ in range(400):
        points = sorted(r.choice((r.randrange(60), r.randrange(300), 40)) for _ in range(r.randrange(1, 25)))
        want = _plain_clusters(points)
        assert cluster_points(points) == want
        runs = [[points[0]]]
        for p in points[1:]:
            runs.append([p]) if p - runs[-1][-1] > 10 else runs[-1].append(p)
        assert [c for k, run in enumerate(runs) for c in cluster_points(run, ends=k == len(runs) - 1)] == want


def test_a_million_votes_are_clustered_in_seconds():
    votes = [5] * 500_000 + [7] * 500_000
    began = time.time()
    assert len(cluster_points(votes, ends=False)) == 1_000_000 and cluster_points(votes) == [(6, 1_000_000)] and time.time() - began < 60


def test_tree_places():
    def walk(lo, hi):
        if lo > hi:
            return [], []
        mid = (lo + hi) // 2
        (a, b), (c, d) = walk(lo, mid - 1), walk(mid + 1, hi)
        return [mid, *a, *c], [*b, *d, mid]

    for n in range(1, 40):
        pre, post = walk(0, n - 1)
        assert [tree_place(i, n) for i in range(n)] == [(pre.index(i), post.index(i)) for i in range(n)]


def _pair(images, direction=1):
    a, b = Element(1, "a", 0, 300), Element(2, "b", 0, 300)
    out = [(Alignment(k, 80.0, direction, 0, [x[0], x[2]], [x[1], x[3]], [a, b]), 0) for k, x in enumerate(images)]
    return a, out


def test_a_chain_of_partial_images_is_primary():
    own, group = _pair([(0, 140, 0, 140), (145, 300, 145, 300)])
    assert Refiner().chain(group, own) == (True, 80, 1)
    assert all(a.primary for a, _ in group)


def test_a_chain_with_gaps_on_both_sides_is_not():
    own, group = _pair([(50, 100, 50, 100), (150, 200, 150, 200)])
    assert Refiner().chain(group, own)[0] is False


LOOSE, FULL = np.float32(1.0 - float(np.float32(0.9))), float(np.float32(0.9))


def _can_follow(a, b):
    if a.x0 >= b.x0 or a.y0 >= b.y0:
        return False
    for lo, hi in ((0, 1), (2, 3)):
        shared = min(a[hi], b[hi]) - max(a[lo], b[lo])
        for s in (a, b):
            if s[hi] > s[lo] and np.float32(shared / (s[hi] - s[lo])) >= LOOSE:
                return False
    return True


def _plain_tree(segments):
    """Each segment below every branch that it can follow, or beside them: [place, branches]."""
    roots = []

    def put(nodes, k):
        fits = [n for n in nodes if _can_follow(segments[n[0]], segments[k])]
        for n in fits:
            if not put(n[1], k):
                n[1].append([k, []])
        return bool(fits)

    for k in range(len(segments)):
        if not put(roots, k):
            roots.append([k, []])
    return roots


def _plain_chains(nodes, path=()):
    for k, below in nodes:
        if below:
            yield from _plain_chains(below, (*path, k))
        else:
            yield (*path, k)


def _plain_best(segments, box, gap=10, shortfall=30):
    best, marked = 0, set()
    for chain in _plain_chains(_plain_tree(segments)):
        covered, missed, score, x, y = [0, 0], [0, 0], 0, box[0], box[2]
        for s in [*(segments[k] for k in chain), None]:
            dx, dy = (box[1] - x, box[3] - y) if s is None else (s.x0 - x, s.y0 - y)
            if dx > gap and dy > gap:
                missed = [missed[0] + dx, missed[1] + dy]
            if s is not None:
                n, m = s.x1 - s.x0, s.y1 - s.y0
                covered = [covered[0] + n, covered[1] + m]
                score += int(s.iden) * (n + m) // 2
                x, y = s.x1, s.y1
        if any(c + m and c / (c + m) > FULL for c, m in zip(covered, missed, strict=True)) and min(missed) < shortfall:
            marked |= set(chain)
            best = max(best, score * 2 // max(sum(covered), 1))
    return bool(marked), best, marked


def _in_order(nodes, depth=0):
    for k, below in nodes:
        yield depth, k
        yield from _in_order(below, depth + 1)


@pytest.mark.parametrize("least", [1, 0])
def test_chains_by_the_plain_tree(least):
    r, found = random.Random(7), 0
    for _ in range(600):
        unit = r.choice((5, 20, 40))
        segments = []
        for _ in range(r.randrange(1, 11)):
            x, y = r.randrange(10) * unit, r.randrange(10) * unit
            segments.append(Segment(x, x + r.choice((least, 1, 2, 3)) * unit + r.randrange(least, 4), y, y + r.choice((least, 1, 2, 3)) * unit, r.choice((70.5, 80.0, 93.2))))
        segments.sort(key=lambda s: s[:2])
        box = (min(s.x0 for s in segments) - r.randrange(30), max(s.x1 for s in segments) + r.randrange(30), min(s.y0 for s in segments) - r.randrange(30), max(s.y1 for s in segments) + r.randrange(30))
        assert list(tree(segments, LOOSE)) == list(_in_order(_plain_tree(segments)))
        got = best_chain(segments, box, LOOSE, FULL, 10, 30)
        assert tuple(got) == _plain_best(segments, box)
        found += got.found
    assert found > 30


@pytest.mark.parametrize("remembered", [1 << 20, 50])
def test_long_and_dense_chains(monkeypatch, remembered):
    from famloom.functions import segments as rules

    monkeypatch.setattr(rules, "REMEMBERED", remembered)
    n = 5_000
    line = [Segment(100 * k, 100 * k + 99, 100 * k, 100 * k + 99, 80.0) for k in range(n)]
    got = best_chain(line, (0, 100 * n, 0, 100 * n), LOOSE, FULL, 10, 30)
    assert got.found and got.score == 80 and len(got.marked) == n
    if remembered < 100:
        return
    # Every image of a step can be followed by every image of the next: 4 ** 20 chains.
    steps = [Segment(100 * k, 100 * k + 99, 100 * k, 100 * k + 99, 80.0) for k in range(20) for _ in range(4)]
    got = best_chain(steps, (0, 2000, 0, 2000), LOOSE, FULL, 10, 30)
    assert got.found and len(got.marked) == 80


def test_a_thousand_dense_images_are_quick():
    r = random.Random(2)
    steps = []
    for k in range(250):  # four alternatives in each step, of unlike lengths and identities
        for _ in range(4):
            a, b = r.randrange(6), r.randrange(6)
            steps.append(Segment(100 * k + a, 100 * k + 99 - b, 100 * k + b, 100 * k + 99 - a, r.choice((70.2, 80.1, 90.9, 95.5))))
    steps.sort(key=lambda s: s[:2])
    began = time.time()
    got = best_chain(steps, (0, 25_000, 0, 25_000), LOOSE, FULL, 10, 30)
    assert got.found and got.score >= 90 and time.time() - began < 60


def test_tree_picture():
    assert tree_text([Segment(0, 50, 0, 50), Segment(0, 60, 200, 260), Segment(60, 90, 60, 90)]) == "0 0-50\n  2 60-90\n1 0-60"


def test_births_of_many_generations():
    line = [Element(1, "s", 0, 9)]
    for k in range(5000):
        line.append(Element(k + 2, "s", 0, 9, birth=(k + 1, line[0], k)))
    keys = birth_keys(line)
    assert sorted(keys.values()) == [keys[e] for e in line]


def test_identity_winner_is_compared_with_a_whole_number():
    a, b = Element(1, "a", 0, 100), Element(2, "b", 0, 100)
    group = []
    for k, iden in enumerate((80.7, 80.3)):
        x = Alignment(k, iden, 1, 0, [k, k], [100, 100], [a, b])
        group.append((x, 0))
        a.images.append((x, 0))
        b.images.append((x, 1))
    r = Refiner()
    r.elements = [a, b]
    r.connect(a)
    assert [x.primary for x, _ in group] == [False, True] and next(iter(a.edges.values())).score == 80


def test_config_is_checked():
    with pytest.raises(ValueError):
        Config(mode="other")
    assert Config(method="double").coverage == 0.9


def test_one_segment_needs_no_search():
    """The sums of one segment alone are those of the search, which a pair of one image no longer goes through."""
    from famloom.functions import segments as s

    rng, found = random.Random(3), 0
    for _ in range(3000):
        x0, y0 = rng.randint(0, 60), rng.randint(0, 60)
        x1, y1 = x0 + rng.randint(1, 400), y0 + rng.randint(1, 400)
        box = (0, x1 + rng.randint(-5, 60), 0, y1 + rng.randint(-5, 60))
        one, rules = [Segment(x0, x1, y0, y1, rng.uniform(0, 100))], s._Rules(box, FULL, 10, 30)
        want = s._Frontier(s.Order(one, LOOSE), one, rules).best()
        assert s._alone(one[0], rules) == want
        found += want.found
    assert 100 < found < 2900


def test_tasks_of_chains_follow_the_rows(spark, monkeypatch):
    from famloom.operators import chains

    monkeypatch.setattr(chains, "SHARE", 2)
    names = "ele_id long, p_ele long, direction int, lb int, rb int, img_id long, p_lb int, p_rb int, iden float, e_lb int, e_rb int, pe_lb int, pe_rb int"
    out = chains.chain_primaries(spark.createDataFrame([(k, k + 1, 1, 1, 90, k, 1, 90, 80.0, 1, 100, 1, 100) for k in range(20)], names))
    assert out.rdd.getNumPartitions() == 10 and {(r.is_primary, r.score, r.n_marked) for r in out.collect()} == {(True, 80, 1)}
