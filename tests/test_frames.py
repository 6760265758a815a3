"""Operators on frames against plain sequential rules."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from places import least_reaching, tree_place
from famloom.operators import edges, families
from famloom.operators.boundaries import interior, merged, merge_points, snapped
from famloom.sources import alignments, reports, store


def test_lines_are_normalised(spark):
    lines = ["000289 80.7 1 10 a 5 9 b ", "7 80 10 1 a 5 9 b", "7 80 1 10 a 9 5 b", "7 80 10 1 a 9 5 b", "7 80 10 1 a", "", "x 80 10 1 a 9 5 b"]
    got = alignments.normalise(alignments.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert [r.direction for r in got] == [1, -1, -1, 1] and all(r.q_lb == 1 and r.q_rb == 10 and r.s_lb == 5 and r.s_rb == 9 for r in got)


def test_dictionary(spark, tmp_path):
    (tmp_path / "names").write_text("3\n>b\na\n")
    assert [tuple(r) for r in alignments.read_dictionary(spark, str(tmp_path / "names")).sort("seq_id").collect()] == [(0, "a"), (1, "b")]
    long = "n" * 60
    (tmp_path / "described").write_text(f"4\n> gi|1 a description\n>{long} x\n>{long}2\n  plain  \n")
    names = alignments.read_dictionary(spark, str(tmp_path / "described"))
    assert [r.seq for r in names.sort("seq_id").collect()] == ["gi|1", long, long + "2", "plain"]
    (tmp_path / "few").write_text(f"7 80 1 10 gi|1 5 9 {long}\n7 80 1 10 {long}2 5 9 plain\n")
    assert alignments.read_msps(spark, str(tmp_path / "few"), names).count() == 2
    (tmp_path / "bad").write_text("1\na\nb\n")
    with pytest.raises(ValueError):
        alignments.read_dictionary(spark, str(tmp_path / "bad"))


def test_read_and_write(spark, tmp_path):
    (tmp_path / "m").write_text("7 80.5 10 1 a 5 9 b\n\n8 90 1 10 a 5 9 zz\n9 90 1 10 b 5 9 a\n")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "seq_id int, seq string")
    got = alignments.read_msps(spark, str(tmp_path / "m"), names).sort("msp_id")
    assert [(r.msp_id, r.score) for r in got.collect()] == [(0, 7), (1, 9)]
    assert alignments.format_msps(got).first().value == "000007 80.5 000010 000001 a 000005 000009 b "


def _filtered(edge_rows, size, limit=0.7):
    """The partial-length filter, one element after another."""
    kind = {e: t for e, _, _, t, _ in edge_rows}
    for x in sorted(size):
        mine = sorted((e, b if a == x else a, s) for e, a, b, _, s in edge_rows if x in (a, b))
        q = [(e, s) for e, o, s in mine if kind[e] in "pS" and float(np.float32(size[x] / size[o])) < limit]  # 7 / 10 is under 0.7
        if not q:
            continue
        n = len(mine)
        place = {e: tree_place(i, n) for i, (e, _, _) in enumerate(mine)}
        most = max(s for _, s in q)
        head = min(q, key=lambda i: place[i[0]][0])
        won = head[0] if head[1] == most else min((e for e, s in q if s == most), key=lambda e: place[e][1])
        for e, _, _ in mine:
            if kind[e] == "p":
                kind[e] = "S"
        kind[won] = "P"
    return kind


@pytest.mark.parametrize("seed", range(3))
def test_partial_filter_repair_and_families(spark, seed):
    r = random.Random(seed)
    n = 40
    size = {i: r.choice((50, 100, 200, 69, 70)) for i in range(1, n + 1)}
    rows = [(k, *sorted(r.sample(range(1, n + 1), 2)), r.choice("pps"), r.choice((70, 80, 90))) for k in range(70)]
    ext = spark.createDataFrame([(i, "x", 0, s) for i, s in size.items()], "ele_id long, seq string, lb int, rb int")
    frame = spark.createDataFrame([(*x, r.choice((1, -1))) for x in rows], "edge_id long, ele1 long, ele2 long, type string, score int, direction int")
    got = edges.partial_filter(frame, ext)
    kind = {x.edge_id: x.type for x in got.collect()}
    assert kind == _filtered(rows, size)
    for mode in ("original", "promote", "guarded"):
        want = {}
        for x in size:
            mine = sorted((e, b if a == x else a) for e, a, b, _, _ in rows if x in (a, b))
            ks = [kind[e] for e, _ in mine]
            block = {"original": True, "promote": "p" in ks, "guarded": "p" in ks or "P" in ks}[mode]
            for i, (e, o) in enumerate(mine):
                want[x, e] = "P" if not block and i == len(mine) - 1 and kind[e] == "S" else kind[e]
        owned = edges.repaired(got, mode)
        assert {(x.owner, x.edge_id): x.type for x in owned.collect()} == want
        ahead = {x: sorted((e, b if a == x else a) for e, a, b, _, _ in rows if x in (a, b) and want[x, e] in "pP") for x in size}
        root = {}
        for s in sorted(size):
            todo = [s] if s not in root else []
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = s
                    todo += [o for _, o in ahead[x]]
        found = families.family_roots(ext, owned)
        assert {x.ele_id: x.root for x in found.collect()} == root
        if mode == "promote":
            small = {(x.root, x.ele_id): (x.pos, x.dir) for x in families.members(found, owned).collect()}
            assert small == {(x.root, x.ele_id): (x.pos, x.dir) for x in families.members(found, owned, largest=0).collect()}


def test_merge_and_snap(spark):
    r = random.Random(5)
    rows = [(e, r.randrange(60), r.randrange(1, 5)) for e in range(20) for _ in range(8)]
    got = {}
    for x in merged(spark.createDataFrame(rows, "ele_id long, bd int, support int")).collect():
        got.setdefault(x.ele_id, []).append((x.bd, x.support))
    assert {e: sorted(v) for e, v in got.items()} == {e: merge_points(sorted((b, s) for f, b, s in rows if f == e)) for e in range(20)}
    ext = spark.createDataFrame([(1, "x", 0, 100), (2, "x", 0, 100), (3, "x", 0, 100)], "ele_id long, seq string, lb int, rb int")
    bd = spark.createDataFrame([(1, 5, 1), (1, 95, 1), (2, 50, 1)], "ele_id long, bd int, support int")
    assert {x.ele_id: (x.lb, x.rb) for x in snapped(ext, bd).collect()} == {1: (5, 95), 3: (0, 100)}
    assert [x.ele_id for x in interior(bd, ext).collect()] == [2]


def test_blast_reports(spark):
    text = ["Query= a", ">b x", "  Score = 1.5e+02 (9)", " Identities = 90/100", "Query: 1 acgt 60", "Sbjct: 5 acgt 64", "Query: 61 acgt 100", "Sbjct: 65 acgt 104", "  Score = 20", " Identities = 1/2", "Query: 7 a 9", "Sbjct: 3 a 1", "Parameters:", "  Score = 33", " Identities = 1/2"]
    got = alignments.blast_to_msps(spark.createDataFrame([(0, i, t) for i, t in enumerate(text)], "file int, n long, value string")).sort("n").collect()
    assert [(r.score, int(r.iden), r.q_start, r.q_end, r.q_seq, r.s_start, r.s_end, r.s_seq) for r in got] == [(150, 90, 1, 100, "a", 5, 104, "b"), (20, 50, 7, 9, "a", 3, 1, "b")]


def _report_records(texts):
    """Records of one report, a line after another: [score, subject, query, pairs of numbers]."""
    import re

    out, query, subject, now = [], None, None, None
    for x in texts:
        if m := re.match(r"Query=\s+(\S+)", x):
            query = m[1]
        if m := re.match(r">(\S+)", x):
            subject = m[1]
        if now and (x.startswith("Parameters:") or "Score =" in x):
            out.append(now)
            now = None
        if m := re.match(r"\s+Score =\s*(\S+)", x):
            now = {"score": int(m[1]), "s": subject}
        if now:
            now["q"] = query
            if m := re.match(r"\s+Identities =\s+(\d+)/(\d+)", x):
                now["iden"] = int(int(m[1]) / int(m[2]) * 100)
            if m := re.match(r"(Query|Sbjct):\s+(\d+)\s+\S+\s+(\d+)", x):
                now.setdefault(m[1] + "0", int(m[2]))
                now[m[1] + "1"] = int(m[3])
    return [(r["score"], r["iden"], r["Query0"], r["Query1"], r["q"], r["Sbjct0"], r["Sbjct1"], r["s"]) for r in out]


def test_blast_reports_in_blocks(spark):
    """Records, queries and subjects go on over the borders of blocks."""
    rng, texts = random.Random(5), []
    for f in range(3):
        lines = []
        for k in range(60):
            lines += [f"Query= q{k}"] * (rng.random() < 0.4 or not k) + [f">s{k} x", ""] * (rng.random() < 0.6 or not k)
            lines += [f"  Score = {k + 1} (9 bits)", "", f" Identities = {rng.randint(50, 99)}/100"]
            for j in range(rng.choice((1, 2, 9))):
                lines += [f"Query: {k + 60 * j} acgt {k + 60 * j + 59}", "", f"Sbjct: {900 - 60 * j} acgt {841 - 60 * j}"]
            lines += ["Parameters:", "noise"] * (rng.random() < 0.3)
        texts.append(lines)
    df = spark.createDataFrame([(f, i, t) for f, x in enumerate(texts) for i, t in enumerate(x)], "file int, n long, value string")
    for block in (1, 4, 14):
        got = alignments.blast_to_msps(df, block=block).sort("file", "n").collect()
        assert [(r.score, int(r.iden), r.q_start, r.q_end, r.q_seq, r.s_start, r.s_end, r.s_seq) for r in got] == [r for x in texts for r in _report_records(x)]


def test_run_diff_counts_repeats_in_one_aggregation(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    two = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (3, "d")], "k int, v string")
    out = reports.run_diff(one, two)
    assert sorted(map(tuple, out.collect())) == [(1, "a", "left"), (1, "a", "left"), (3, "c", "left"), (3, "d", "right"), (3, "d", "right")]
    # Either run is read once.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_partners_meet_in_one_shuffle(spark):
    """Images that have no partner left are out, and nothing is joined."""
    from famloom.operators.elements import dumbbells

    rows = [(0, 0, 0, 5, 1, 9, 11), (1, 0, 1, 6, 2, 8, 12), (2, 1, 0, 5, 3, 7, 11), (5, 2, 1, 7, 4, 6, 13)]
    out = dumbbells(spark.createDataFrame(rows, "img_id long, msp_id long, side int, seq int, lb int, rb int, ele_id long"), "rb")
    assert out.columns == ["img_id", "msp_id", "side", "seq", "lb", "rb", "ele_id", "p_ele", "p_seq", "p_lb", "p_rb", "prb"]
    assert sorted(map(tuple, out.collect())) == [(0, 0, 0, 5, 1, 9, 11, 12, 6, 2, 8, 8), (1, 0, 1, 6, 2, 8, 12, 11, 5, 1, 9, 9)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_images_without_cuts_bring_no_cuts_along(spark, monkeypatch):
    """Only cuts inside an image reach its rule, and an image that is short as it is does not."""
    from famloom.operators import boundaries

    seen = boundaries.map_rows
    monkeypatch.setattr(boundaries, "map_rows", lambda rows, run, types: rows)
    rows = [(0, 1, 10, 200, 10, 200, 1, 9), (1, 1, 210, 300, 5, 95, -1, 9), (2, 1, 290, 310, 5, 95, 1, 9), (3, 1, 301, 400, 5, 20, 1, 9), (4, 2, 1, 9, 1, 9, 1, 9)]
    bells = spark.createDataFrame(rows, "img_id long, ele_id long, lb int, rb int, p_lb int, p_rb int, direction int, score int")
    bounds = spark.createDataFrame([(1, b, 1) for b in (100, 205, 300)], "ele_id long, bd int, support int")
    assert sorted((r.img_id, r.cuts) for r in boundaries.split_images(bells, bounds).collect()) == [(0, [100]), (1, []), (2, [300])]
    monkeypatch.setattr(boundaries, "map_rows", seen)
    assert sorted((r.img_id, r.part, r.lb, r.rb) for r in boundaries.split_images(bells, bounds).collect()) == [(0, 0, 10, 100), (0, 1, 101, 200), (1, 0, 210, 300)]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), "k")
    s.write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    s.write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, s.read().collect())) == want and [tuple(r) for r in s.get(2).collect()] == [(2, "c")]
    s.compact()
    assert sorted(map(tuple, s.read().collect())) == want and len(s._versions()) == 1


def test_run_comparison(spark):
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "value string")
    got = reports.compare_runs(spark, {"a": t("x "), "b": t("x"), "c": t("x")}, {"a": t("x"), "b": t("y")})
    assert {r["name"]: r.verdict for r in got.collect()} == {"a": "MATCH", "b": "DIFF", "c": "MISSING"}


def test_stop_at_empty_input(spark):
    from famloom.plans.pipeline import run

    empty = spark.createDataFrame([], "msp_id long, score int, iden float, direction int, q_seq string, q_lb int, q_rb int, s_seq string, s_lb int, s_rb int")
    result = run(empty)
    assert result.members.count() == 0 and result.families.count() == 0


@pytest.mark.parametrize("directed", [True, False])
def test_reachability_by_brute_force(spark, directed):
    from famloom.operators.graph import least_ancestors

    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    links += [(v, u) for u, v in links[:25]] + links[:5] + [(129, 128), (128, 127), (126, 127), (125, 129), (120, 125)]
    want = {i: i for i in range(130)} | least_reaching(links, directed)
    nodes, frame = spark.createDataFrame([(i,) for i in range(130)], "node long"), spark.createDataFrame(links, "u long, v long")
    assert {x.node: x.root for x in least_ancestors(nodes, frame, directed).collect()} == want
    assert {x.node: x.root for x in least_ancestors(nodes, frame.limit(0), directed).collect()} == {i: i for i in range(130)}


def test_streamed_alignments(spark, tmp_path):
    from famloom.streaming.ingest import stream_extents, stream_images

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("7 80 10 1 a 5 9 b\n")
    query = stream_extents(stream_images(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("extents").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b").write_text("7 80 4 30 a 5 9 c\nbad line\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("extents").collect())) == [("a", 1, 30, 2), ("b", 5, 9, 1), ("c", 5, 9, 1)]


def test_reports_and_snapshots(spark, tmp_path):
    from famloom.plans.pipeline import run, stage_counts

    rows = [(k, 100, 90.0, 1 if k % 2 else -1, f"q{k % 3}", 1, 100 + k % 5, f"s{k % 4}", 1, 101) for k in range(12)]
    result = run(spark.createDataFrame(rows, "msp_id long, score int, iden float, direction int, q_seq string, q_lb int, q_rb int, s_seq string, s_lb int, s_rb int"))
    reports.write_reports(result, str(tmp_path / "out"))
    reports.snapshot(result, str(tmp_path / "snap"))
    again = reports.restored(spark, str(tmp_path / "snap"))
    assert reports.run_diff(again.members, result.members).count() == 0
    counts = {r["name"]: r.n for r in stage_counts(result).collect()}
    lines = spark.read.text(str(tmp_path / "out" / "eles")).collect()
    assert len(lines) == counts["ele_no"] == sum(r.copies for r in result.families.collect()) and counts["naive_ele_no"] == 7
    reports.write_gml(result.elements, result.edges, str(tmp_path / "gml"))
    assert spark.read.text(str(tmp_path / "gml")).where("value like 'edge%'").count() == reports.gml_edges(result.edges).count()
    (tmp_path / "in").write_bytes(b"7 80 10 1 a 5 9 b\n")
    assert reports.dataset_key(spark, str(tmp_path / "in")) == hashlib.md5(b"7 80 10 1 a 5 9 b\n").hexdigest()[:12]
    assert spark.read.text(str(tmp_path / "out" / "edges")).count() == result.edges.count()
    text = reports.show_elements(result, 1)
    assert text.startswith("ele 1 y\nfrag q0 1 ") and "\nmsp " in text and "\nedge " in text
    bad = spark.createDataFrame([(1, 2, 2, "p", 1, 1)], "edge_id long, ele1 long, ele2 long, type string, score int, direction int")
    with pytest.raises(Exception, match="illegal edge 1"):
        reports.edge_lines(bad).collect()
    pairs = reports.family_images(result.members, result.images.withColumn("img_id", result.images.msp_id * 2 + result.images.side).select("img_id", "ele_id", "lb", "rb"), spark.createDataFrame([(0, 1)], "img_id long, p_ele long"))
    assert [r.paired for r in pairs.collect()] == [True]


def test_clustering_is_the_same_for_any_windows_and_batches(spark):
    from famloom.operators.elements import greedy, greedy_elements, islands

    r = random.Random(4)
    rows = [(i, i // 2, i % 2, f"s{r.randrange(4)}", a := r.randrange(3000), a + r.randrange(20, 150)) for i in range(900)]
    frame = spark.createDataFrame(rows, "img_id long, msp_id long, side int, seq string, lb int, rb int")
    one, two = (sorted(map(tuple, islands(frame, bucket=b).select("img_id", "island").collect())) for b in (None, 500))
    assert one == two
    want, n = {}, 0
    for seq in sorted({x[3] for x in rows}):
        mine = sorted((x for x in rows if x[3] == seq), key=lambda x: (x[4], -x[5], x[0]))
        local = greedy([(x[4], x[5]) for x in mine], 0.5)
        want |= {x[0]: n + e + 1 for x, e in zip(mine, local, strict=True)}
        n += max(local) + 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {x.img_id: x.ele_id for x in greedy_elements(frame, bucket=500).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _spanning(spark, bounds, imgs, margin=10):
    b, i = spark.createDataFrame(bounds, "ele_id long, bd int, support int"), spark.createDataFrame(imgs, "ele_id long, lb int, rb int")
    from famloom.operators.boundaries import spans

    want = sorted((e, bd, s, 2 * sum(x == e and lo <= bd - margin and hi > bd + margin for x, lo, hi in imgs)) for e, bd, s in bounds)
    assert sorted(map(tuple, spans(b, i).select("ele_id", "bd", "support", "span").collect())) == want


def test_spans_by_brute_force(spark):
    r = random.Random(8)
    _spanning(spark, [(r.randrange(6), r.randrange(200), k) for k in range(150)], [(r.randrange(5), a := r.randrange(180), a + r.randrange(60)) for _ in range(300)])


def test_split_and_clusters_on_frames(spark):
    from famloom.functions.segments import cut, facing, partner_ends
    from famloom.operators.boundaries import cluster_points, point_clusters, split_images

    r = random.Random(9)
    rows = [(k, k % 7, a := r.randrange(300), a + r.randrange(400), b := r.randrange(300), b + r.randrange(400), r.choice((1, -1)), 1000 + k) for k in range(120)]
    cuts = {e: sorted(r.sample(range(600), 4)) for e in range(5)}
    got = split_images(spark.createDataFrame(rows, "img_id long, ele_id long, lb int, rb int, p_lb int, p_rb int, direction int, score int"), spark.createDataFrame([(e, b, 1) for e, bs in cuts.items() for b in bs], "ele_id long, bd int, support int"))
    want = []
    for img, e, lb, rb, plb, prb, d, score in rows:
        if e in cuts:
            copies, rest = cut(facing(lb, rb, plb, prb, d), score, cuts[e], 30)
            want += [(img, e, k, s.x0, s.x1, *partner_ends(s, d), n, new) for k, (s, n, new) in enumerate([*((*c, True) for c in copies), *([(*rest, False)] if rest else [])])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    votes = [(r.randrange(4), r.randrange(90), 0) for _ in range(200)]
    found = point_clusters(spark.createDataFrame(votes, "ele_id long, cp int, contributor long"))
    assert sorted(map(tuple, found.collect())) == sorted((e, *c) for e in range(4) for c in cluster_points(sorted(v[1] for v in votes if v[0] == e)))


MSPS = "msp_id long, score int, iden float, direction int, q_seq string, q_lb int, q_rb int, s_seq string, s_lb int, s_rb int"


def test_a_hand_made_split(spark, tmp_path):
    """Three sequences hold a repeat of 400; five more hold its first half alone, so 200 is a boundary and the long ones are split there.

    Worked out by hand: the three long elements (1-3) become halves, of which the
    first are one family with the five short elements (4-8), and the second another.
    """
    from famloom.plans.pipeline import run, stage_counts

    long, short = ["a1", "a2", "a3"], ["b1", "b2", "b3", "b4", "b5"]
    rows = [(100, 90.0, 1, x, 1, 401, y, 1, 401) for i, x in enumerate(long) for y in long[:i]]
    rows += [(100, 90.0, 1 if y != "b2" else -1, x, 1, 201, y, 1, 201) for x in long for y in short]
    rows += [(100, 90.0, 1 if "b2" not in (x, y) else -1, x, 1, 201, y, 1, 201) for i, x in enumerate(short) for y in short[:i]]
    msps = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], MSPS)
    result = run(msps, folder=str(tmp_path / "stages"))
    assert [(r.ele_id, r.seq, r.lb, r.rb) for r in result.naive.sort("ele_id").collect()] == [(k + 1, s, 1, 401 if s in long else 201) for k, s in enumerate(long + short)]
    stat = {r.ele_id: (r.stat, r.fate) for r in result.elements.collect()}
    assert all(stat[k] == ("X", "combo") for k in (1, 2, 3)) and all(stat[k] == ("y", None) for k in range(4, 9))
    used = {(r.seq, r.lb, r.rb) for r in result.elements.where("stat = 'y'").collect()}
    assert used == {(s, 1, 201) for s in long + short} | {(s, 202, 401) for s in long}
    young = {}
    for r in result.children.collect():
        young.setdefault(r.parent, []).append(r.child)
    assert sorted(young) == [1, 2, 3] and all(len(v) == 2 for v in young.values())
    assert {(r.ele_id, r.bd) for r in result.cuts.collect() if 150 < r.bd < 250} == {(1, 201), (2, 201), (3, 201)}
    fams = {}
    for r in result.members.collect():
        fams.setdefault(r.fam, set()).add((r.seq, r.lb, r.dir))
    assert sorted(map(len, fams.values())) == [3, 8]
    big = next(f for f in fams.values() if len(f) == 8)
    way = {s: d for s, _, d in big}
    assert {s for s in way if way[s] != way["a1"]} == {"b2"}
    # A second run finds every stage; another configuration is refused.
    again = run(msps.limit(0), folder=str(tmp_path / "stages"))
    assert {r["name"]: r.n for r in stage_counts(again).collect()} == {r["name"]: r.n for r in stage_counts(result).collect()}
    from famloom.config import Config

    with pytest.raises(ValueError):
        run(msps, Config(mode="promote"), folder=str(tmp_path / "stages"))


def test_stages_without_tandems_or_images(spark):
    from famloom.config import Config
    from famloom.plans.pipeline import run

    rows = [(k, 100, 90.0, 1, "q", 1, 101, "s", 1, 101) for k in range(30)]
    result = run(spark.createDataFrame(rows, MSPS), Config(tandem_images=20, tandem_ratio=2))
    assert {(r.stat, r.fate) for r in result.elements.collect()} == {("O", "tandem")} and result.members.count() == 0


def test_running_sums_and_scratch(spark):
    from famloom.operators.graph import forget, numbered, running, written

    df = spark.createDataFrame([(f"k{k:03d}", k % 7) for k in range(300)], "k string, v int").repartition(5)
    got = {r.k: r.before for r in running(df, ["k"], F.col("v"), "before", 5).collect()}
    total = 5
    for k in range(300):
        assert got[f"k{k:03d}"] == total
        total += k % 7
    assert running(df.limit(0), ["k"], F.col("v"), "before").count() == 0 and numbered(df, "k", "n").agg(F.max("n")).first()[0] == 299
    t = written(df)
    forget(t, None, df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        t.count()


def test_components_in_rounds(spark):
    from famloom.operators.graph import components

    r = random.Random(11)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200, 200 + k) for k in range(1, 60)] + [(300 + k, 301 + k) for k in range(40)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == least_reaching(links, False)


def test_components_contract_ranges_first(spark, monkeypatch):
    from famloom.operators import graph

    r = random.Random(12)
    chain = [(k, k + 1) for k in range(400)]
    links = chain + [(1000 + r.randrange(90), 1000 + r.randrange(90)) for _ in range(80)] + [(2000, 2000 + k) for k in range(1, 50)]
    monkeypatch.setattr(graph, "RANGE", 40)
    seen, real = [], graph._hooked
    monkeypatch.setattr(graph, "_hooked", lambda e: seen.append(1) or real(e))
    frame = spark.createDataFrame(links, "u long, v long")
    assert {x.node: x.root for x in graph.components(frame).collect()} == least_reaching(links, False)
    # A chain lies in its ranges: no round of joins is needed.
    seen.clear()
    assert {x.root for x in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0} and not seen


def test_queries_make_islands_once(spark, monkeypatch):
    from famloom.operators import elements
    from famloom.plans import queries

    made, real = [], elements.islands
    monkeypatch.setattr(elements, "islands", lambda *a, **k: made.append(1) or real(*a, **k))
    queries.filtered_edges(spark, "/root/testdata/sf0.001")
    assert made == [1]


def test_overlaps_are_found_in_bins_however_heavy(spark):
    import random

    from famloom.operators import meets

    r = random.Random(6)
    rows = []
    for k in range(150):
        lb = r.choice((r.randrange(-50, 400), 100))
        rows.append((f"s{k % 2}", k, lb, lb + r.choice((0, 1, 20, 30, 700))))
    df = spark.createDataFrame(rows, "seq string, img_id long, lb int, rb int")
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and min(a[3], b[3]) > max(a[2], b[2]))
    for heavy in (5, 1000):
        got = meets.overlapping(df, ["seq"], heavy=heavy).select("img_id", "img_id2").collect()
        assert sorted(map(tuple, got)) == want
    assert meets.overlapping(df.limit(0), ["seq"]).count() == 0


def test_tree_places_as_columns(spark):
    rows = [(k, n) for n in (*range(1, 40), 1000, 1023) for k in range(n)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("t", edges.tree_places(F.col("k"), F.col("n")))
    assert {(r.k, r.n): (r.t.pre, r.t.post) for r in df.collect()} == {x: tree_place(*x) for x in rows}


def test_files_and_splits_are_read_in_order(spark, tmp_path):
    """Splits are packed by size, which must not show in the numbers."""
    from famloom.sources.alignments import read_blast, read_lines, read_msps

    files = {"a": ["1 80 10 20 x 5 9 y"], "b": [f"{k + 2} 80 10 20 x {k + 1} {k + 9} y" for k in range(300)] + ["", "bad line"], "c": ["999 80 20 10 x 5 9 y"]}
    for name, lines in files.items():
        (tmp_path / f"{name}.msps").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_msps(spark, str(tmp_path)).sort("msp_id").collect()
            assert [(r.msp_id, r.score) for r in got] == [(0, 1), *((k + 1, k + 2) for k in range(300)), (301, 999)]
            lines = read_lines(spark, str(tmp_path)).sort("file", "n").collect()
            assert [r.value for r in lines] == [x for v in files.values() for x in v]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    report = "Query= q\n>s x\n  Score = 7 (9 bits)\n Identities = 8/10\nQuery: 1 ac 9\nSbjct: 3 ac 11\nParameters:\n"
    (tmp_path / "r").mkdir()
    for name in ("1", "2"):
        (tmp_path / "r" / name).write_text(report * 2)
    got = read_blast(spark, str(tmp_path / "r")).sort("msp_id").collect()
    assert [(r.msp_id, r.score, r.iden, r.q_seq, r.q_lb, r.s_rb) for r in got] == [(k, 7, 80.0, "q", 1, 11) for k in range(4)]


def test_images_move_without_what_their_number_tells(spark, monkeypatch):
    from famloom.plans import queries

    moved, real = {}, queries.written
    monkeypatch.setattr(queries, "written", lambda df, what="step": (moved.setdefault(what, df.columns), real(df, what))[1])
    got = queries.isles(spark, "/root/testdata/sf0.001", "iden")
    assert not {"msp_id", "side"} & set(moved["islands"])
    want = queries.imgs(spark, "/root/testdata/sf0.001", "iden")
    assert dict(want.dtypes).items() <= dict(got.dtypes).items()
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
