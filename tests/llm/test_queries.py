"""Operators on frames: brute force, awkward rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD
from famloom.llm import chat, fingerprints, licenses, mixing, packing, pii, rules, shards, simhash, warc


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def variety(seed, n=120):
    """Documents with copies, near copies and odd texts."""
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "Élan", "zeta", "eta", "#", "theta!"]
    texts = []
    for _ in range(n):
        k = r.random()
        if k < 0.2 and texts:
            texts.append(r.choice(texts))
        elif k < 0.4 and texts:
            t = r.choice(texts).split(" ")
            t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append("".join(r.choice(words) + r.choice((" ", " ", ". ", "\n")) for _ in range(r.randrange(1, 90))))
    return [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(1000 + i, *x[1:]) for i, x in enumerate(ODD)]


# --- 1 ---------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def _talks(seed):
    r = random.Random(seed)
    shared = [[("system", "be \\ nice")], [("user", "hello"), ("assistant", "hi")], [("user", "hello"), ("assistant", "<|end|> hi")]]
    out = []
    for c in range(60):
        turns = list(r.choice(shared)) if r.random() < 0.8 else []
        turns += [(r.choice(("user", "assistant", None, "tool\nx")), r.choice(("a", "b\n", None, "[INST]", "</s>", "long " * 40))) for _ in range(r.randrange(4))] or [("user", "end")]
        out += [(c, i, *t) for i, t in enumerate(turns)]
    out += [(c, i, *t) for c in range(100, 130) for i, t in enumerate(shared[1])]
    return out + [(None, 0, "user", "x"), (None, 0, "user", "x"), (7, None, "assistant", "null turn")]


def _wanted(talks):
    by = defaultdict(list)
    for c, i, role, text in talks:
        by[c].append((i is not None, i or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in by.items()}


def test_chat_tree_round_trip(spark):
    talks = _talks(1)
    want = _wanted(talks)
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(talks, TURNS).repartition(5).withColumn("path", F.lit(1)).withColumn("turns", F.lit(1))).collect()}
    assert got.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    t = chat.Template()
    for c, turns in want.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        formatted = sum(len("".join(t.parts(*x))) for x in turns)
        assert tuple(got[c])[1:] == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), formatted)


def test_chat_tree_emits_each_shared_turn_once_depth_first(spark):
    talks = _talks(2)
    want = _wanted(talks)
    nodes, paths = chat.prefix_tree(spark.createDataFrame(talks, TURNS).repartition(5))
    nodes, paths = {r.place: r for r in nodes.collect()}, {r.conv_id: r.places for r in paths.collect()}
    prefixes = {tuple(t[: k + 1]) for t in want.values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)
    end = 0
    for place in sorted(nodes):  # no gap, no overlap
        assert place == end
        end += len(nodes[place].token_ids)
    home = {}
    for c, places in paths.items():
        position, seen = 0, []
        for depth, (place, turn) in enumerate(zip(places, want[c], strict=True)):
            n = nodes[place]
            assert n.depth == depth and n.position == position and home.setdefault(place, want[c][: depth + 1]) == want[c][: depth + 1]
            assert [x for a, b in n.attend for x in range(a, b)] == seen
            assert bool(n.loss) == (turn[0] == "assistant")
            seen += range(place, place + len(n.token_ids))
            position += len(n.token_ids)
    # Depth first: below a node come its descendants, before anything else.
    last = {}
    for places in paths.values():
        for k, p in enumerate(places):
            last[p] = max(last.get(p, 0), places[-1])
    for p, hi in last.items():
        assert all(p in next(x for x in paths.values() if q in x) for q in nodes if p <= q <= hi)


def test_chat_of_nothing(spark):
    assert chat.digests(spark.createDataFrame([], TURNS)).count() == 0


# --- 2, 3, 4 ----------------------------------------------------------------------


def test_license_scan(make):
    data = variety(2) + [(2000, "Licensed under CC BY-NC 4.0. All rights reserved"), (2001, "cc  by" * 3)]
    got = rows(licenses.scans(make(data, extra=True)).drop("spans"))
    assert got == sorted(((d[0], *licenses.scan(d[1])[:7]) for d in data), key=repr)


GOOD = " ".join(f"w{k}" for k in range(20))


def test_rules(make):
    data = [(i, "good " + " ".join(f"w{i}x{k}" for k in range(20)), f"fine{i % 6}") for i in range(60)] + [(100 + i, "bad", "bad host") for i in range(60)]
    data += [(200, GOOD, "bad host"), (201, "bad", None), (202, GOOD, None), (203, "bad", "new"), *[(300 + i, *x[1:]) for i, x in enumerate(ODD)]]
    docs = make(data, extra=True)
    got = {r.key: r for r in rules.judge(docs).collect()}
    n, bad = Counter(), Counter()
    for d in data:
        m = rules.metrics(d[1])
        n[d[2] if len(d) > 2 else "s"] += 1
        bad[d[2] if len(d) > 2 else "s"] += m[0] < 10 or 100 * m[4] > 20 * m[0]
    for d in data:
        r, m, h = got[d[0]], rules.metrics(d[1]), d[2] if len(d) > 2 else "s"
        assert tuple(r[x] for x in rules.METRICS) == m
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        assert r.base_failed == failed and r.kept == (not failed and d[0] != 200)
        assert (r.host_docs, r.host_failures) == ((n[h], bad[h]) if h else (None, None)) and (r.host_rate is None) == (h is None)
    # A bad host loses its good document, and nothing else does; columns stay as they are.
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in data if got[d[0]].kept)


def test_rules_shrink_small_hosts(spark, make):
    hosts = [(f"h{i}", 100, 25) for i in range(7)] + [("tiny", 2, 2), ("huge", 10_000, 9_900), ("half", 1000, 480)]
    got = {r.host: r for r in rules.host_rates(spark.createDataFrame(hosts, "host string, docs long, failures long")).collect()}
    assert got["tiny"].rate < 0.9 and {h for h, r in got.items() if r.rejected} == {"huge"}
    alike = {r.host: r for r in rules.host_rates(spark.createDataFrame([(f"h{i}", 50, 5) for i in range(9)] + [("tiny", 1, 1)], "host string, docs long, failures long")).collect()}
    assert not any(r.rejected for r in alike.values())


def test_pii(make):
    data = variety(4) + [(3000, "mail a.b@c.de, card 4111-1111-1111-1111"), (3001, "call (555) 010-9999 or tel 555-010-9999")]
    got = rows(pii.detected(make(data, extra=True)))
    want = []
    for d in data:
        base, every = pii.spans(d[1] or "", pii.trained())
        n = Counter(s[2] for s in base)
        want.append((d[0], *(n[k] for k in pii.BASE), hashlib.sha256(pii.joined(base).encode()).hexdigest(), pii.joined(every)))
        assert set(base) <= set(every)
    assert got == sorted(want, key=repr)
    clean = pii.redact(make(data, extra=True))
    assert clean.columns == make(data, extra=True).columns
    for r in clean.where("text is not null").collect():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)


# --- 5 ---------------------------------------------------------------------------


@pytest.mark.parametrize("tail", [60, 20_000])
def test_packing(make, monkeypatch, tail):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "TAIL", tail)

    whole, data = Tokenizer.from_file(packing.tokenizer_path()), variety(5) + [(4000, "long words here " * 3000)]
    got = packing.pack(make(data, extra=True), 256).collect()
    want, lengths = Counter(), []
    for i, text, *_ in data:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, k in enumerate(range(0, len(ids), 256)):
            part = ids[k : k + 256]
            want[i, p, k, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = min((g for g in gaps if g >= n), default=256)
        if k in gaps:
            gaps.remove(k)
        gaps.append(k - n)
    assert len(by) <= 1.05 * len(gaps) + 1
    seqs = {r.sequence_id: r for r in packing.sequences(make(data), 256).collect()}
    assert sum(len(s.ids) for s in seqs.values()) == sum(lengths) and all(len(s.ids) == len(s.position_ids) == len(s.segment_ids) for s in seqs.values())


def test_the_registered_packing_runs_supersteps(make, monkeypatch):
    """As many rows as the smallest tables have, and no smaller tail: most documents are placed by supersteps."""
    r, ran, real = random.Random(12), [], packing.superstep
    monkeypatch.setattr(packing, "superstep", lambda *a: ran.append(1) or real(*a))
    rows = [(k, "word " * r.choice((5, 40, 300, 900, 1500))) for k in range(900)]
    got = packing.pack(make(rows)).collect()
    assert len(ran) > 2 and len(got) == 900 and packing.TAIL <= 500
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.CAPACITY


# --- 6 ---------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    r = random.Random(6)
    pages = [(i, f"http://h{i % 3}/ü {i}", r.choice(("x" * 99, "x" * 100, "é" * 50, "y" * 500, None, f"own {i}" * 30))) for i in range(80)]
    pages += [(None, None, "y" * 500), (3, "u", pages[3][2]), (None, "z", "small")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("name", F.lit(1)).withColumn("content", F.lit(2))
    packed = warc.packages(df, str(tmp_path / "one"), limit=3000)
    assert packed.count() > 3
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        f = first.get(h or "")
        back = len(b) >= 100 and f is not None and f != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if back else "response", f if back else None))
    assert rows(warc.records(packed).drop("url", "record_id")) == sorted(want, key=repr)
    payloads = {x.page_id: bytes(x.payload) for x in warc.records(warc.packages(df, f"file://{tmp_path}/two", zip64=True), with_payload=True).where("record_type = 'response' and page_id is not null").collect()}
    assert all(payloads[i] == (h or "").encode() for i, _, h in pages if i in payloads)
    assert rows(warc.records(warc.found(spark, str(tmp_path / "one"))).drop("url", "record_id")) == sorted(want, key=repr)
    assert warc.records(warc.packages(df.limit(0), str(tmp_path / "none"))).count() == 0


# --- 7 ---------------------------------------------------------------------------


def test_fingerprints_follow_the_order(make):
    data = [d for d in variety(7, 60)]
    got = fingerprints.fingerprints(make(data, extra=True)).collect()
    order = sorted({(d[0], d[1] or "") for d in data}, key=lambda d: (d[0] is None, -(d[0] or 0)))
    assert len(got) == len(data) and len({d[0] for d in order}) == len(order)
    nxt = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    by = {d[0]: d[1] for d in order}
    fp = {}
    for r in got:
        text = by[r.doc_id]
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[r.doc_id, text][1][:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert fp.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert len(set(fp.values())) >= len({tuple(sorted(t.split("\n"))) for t in fp})
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2


def test_fingerprints_are_homomorphic(spark):
    texts = [("a", "one\ntwo. And three.\n\nfour", "four\none\n\ntwo. And three."), ("b", "x\nx\ny", "x\ny")]
    df = spark.createDataFrame(texts, "k string, t string, u string")
    df = fingerprints.lanes(fingerprints.lanes(df, "t", "f"), "u", "g")
    one = fingerprints.lanes(spark.createDataFrame([("x",)], "t string"), "t", "one").select("one")
    out = df.crossJoin(one).select("k", (F.col("f") == F.col("g")).alias("same"), (fingerprints.added(F.col("g"), F.col("one")) == F.col("f")).alias("grown"), (fingerprints.added(F.col("f"), F.col("one"), -1) == F.col("g")).alias("shrunk"))
    assert rows(out) == [("a", True, False, False), ("b", False, True, True)]


def test_lane_sums_and_likeness_by_brute_force(spark):
    r = random.Random(14)
    bits = ["one two. ", "Three! four? ", "\n", "five", "é. x", "\n\n", ""]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 20))) for _ in range(60)]
    df = fingerprints.lanes(fingerprints.lanes(spark.createDataFrame(list(zip(texts, texts[1:] + texts[:1], strict=True)), "t string, u string"), "t", "f"), "u", "g")
    for x in df.withColumn("near", fingerprints.likeness(F.col("f"), F.col("g"))).collect():
        signs = {}
        for text, got in ((x.t, x.f), (x.u, x.g)):
            digests = [hashlib.sha256(p.encode()).digest() for p in text.split("\n")]
            assert got[:8] == [sum(int.from_bytes(d[4 * i : 4 * i + 4], "big") for d in digests) % 2**32 for i in range(8)]
            halves = [v for w in got[8:40] for v in (w >> 32, w & 0xFFFFFFFF)]
            signs[text] = np.array([2 * v - got[40] for v in halves], dtype=float)
            assert got[40] == len(__import__("re").split(r"\n|(?<=[.!?]) +", text))
        a, b = signs[x.t], signs[x.u]
        want = 1.0 if x.f == x.g else min(max(1 - ((a - b) ** 2).sum() / ((a**2).sum() + (b**2).sum()), 0), 1 - 2.0**-20)
        assert abs(x.near - want) < 1e-9


def test_fingerprints_of_one_and_none(make):
    r = fingerprints.fingerprints(make([(5, "abc\ndef")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abc\nd" + b"ab").hexdigest() and r.near_next == 1.0
    assert fingerprints.fingerprints(make([(5, "abc"), (5, "abc")])).count() == 2
    assert fingerprints.fingerprints(make([])).count() == 0


# --- 8 ---------------------------------------------------------------------------


def _components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_links_by_brute_force(spark):
    r = random.Random(8)
    fps = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in r.sample(range(64), r.choice((1, 1, 2, 2, 3))):
                x ^= 1 << b
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    edges = simhash.links(simhash.candidates(df))
    root = {x.node: x.root for x in simhash.components(edges).collect()}
    want = _components(fps)
    mine = defaultdict(set)
    for f in fps:
        mine[root.get(signed[f], signed[f])].add(f)
    real = defaultdict(set)
    for f, x in want.items():
        real[x].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, real.values()))


def test_near_duplicates(make):
    data = variety(9, 150)
    got = simhash.near_duplicates(make(data, extra=True)).collect()
    fp = {d[1]: simhash.simhash(d[1]) for d in data}
    root = _components(set(fp.values()))
    least = {}
    for d in data:
        if d[0] is not None:
            x = root[fp[d[1]]]
            least[x] = min(d[0], least.get(x, d[0]))
    want = [(d[0], fp[d[1]], least.get(root[fp[d[1]]])) for d in data]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert any(r.doc_id != r.component_id for r in got)
    assert simhash.near_duplicates(make([])).count() == 0


def test_a_dense_group_makes_no_pairs(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert simhash.links(simhash.candidates(df)).count() <= 65 * len(fps)
    assert {x.root for x in simhash.components(simhash.links(df)).collect()} == {min(fps)}


# --- 9, 10 ------------------------------------------------------------------------


def test_shards(make):
    data = variety(10)
    got = shards.shard(make(data, extra=True)).collect()
    want = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in data)
    assert Counter(tuple(r)[:3] for r in got) == want
    slots, held, grown = defaultdict(list), Counter(), shards.grown(shards.first_map(40), 40)
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.virtual_slot] += r["size"]
        virtual = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % 4096
        assert (r.law, r.virtual_slot, r.shard, r.grown_shard) == ("key", virtual, virtual % 40, grown[virtual])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r.slot_bytes == held[r.virtual_slot] for r in got)
    balanced = shards.rebalanced(grown, held, 41)
    assert all(r.balanced_shard == balanced[r.virtual_slot] for r in got)
    assert shards.shard(make([])).count() == 0


def test_the_slot_map_is_stored_by_versions(spark, make, tmp_path):
    data = [(i, "x" * (1 + i % 50 * (200 if i % 40 == 3 else 1)), "s") for i in range(800)]
    shards.shard(make(data), 5, 64, str(tmp_path / "map"))
    known = shards.SlotMap(spark, str(tmp_path / "map"))
    one, two, three = (known.shards(v) for v in (1, 2, 3))
    assert one == shards.first_map(5, 64) and two == shards.grown(one, 5) and known.shards() == three != two
    # A version holds edited slots alone.
    for v, before, after in ((2, one, two), (3, two, three)):
        assert {r.slot: r.shard for r in spark.read.parquet(str(tmp_path / "map" / f"v{v}")).collect()} == {s: k for s, k in enumerate(after) if k != before[s]}
    load = lambda m: [sum(r.slot_bytes for r in held if m[r.virtual_slot] == k) for k in range(6)]
    held = shards.slot_bytes(shards.sized(make(data), 64)).collect()
    assert max(load(three)) - min(load(three)) < max(load(two)) - min(load(two))


def _poisson(u, rate):
    import math

    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing(make):
    data = variety(11, 300)
    docs = make(data, extra=True)
    out = mixing.mix(docs)
    got = out.collect()
    size, total = Counter(), 0
    for d in data:
        size[d[2] if len(d) > 2 else "s"] += len((d[1] or "").encode())
    total, want_sum = sum(size.values()), sum(v**0.5 for v in size.values())
    want = Counter()
    for d in data:
        s = d[2] if len(d) > 2 else "s"
        rate = total * size[s] ** 0.5 / want_sum / size[s]
        key = f"{mixing.SEED}:{'null' if d[0] is None else d[0]}:{s}"
        n = _poisson((int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52, rate)
        for c in range(n):
            want[d[0], d[1], c, n] += 1
    assert Counter((r.doc_id, r.text, r["copy_"], r["copies"]) for r in got) == want
    assert set(docs.columns) < set(out.columns)


def test_mixing_to_given_weights(make):
    data = [(i, "x" * 100, "a" if i % 10 else "b") for i in range(4000)]
    n = Counter(r.source for r in mixing.mix(make(data), weights={"a": 1, "b": 3}, epochs=2.0).select("source").collect())
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 6000) < 500
    assert mixing.mix(make([])).count() == 0


def test_poisson_of_any_mean(spark):
    import math

    means = [1e-6, 0.3, 7.0, 31.5, 190.0, 900.0, 1e5, 1e8]
    got = {r.rate: r for r in mixing.poisson_tables(spark.createDataFrame([(str(m), m) for m in means], "source string, rate double")).collect()}
    for m in means:
        r = got[m]
        assert abs(r.cdf[-1] - 1) < 1e-7 and len(r.cdf) < 26 * math.sqrt(m) + 60
        if m < 1e4:
            for k in {r.low, r.low + 3, int(m), int(m + 2 * math.sqrt(m))}:
                want = sum(math.exp(j * math.log(m) - m - math.lgamma(j + 1)) for j in range(k + 1))
                assert abs(r.cdf[k - r.low] - want) < 1e-10
        else:
            assert abs(r.cdf[int(m) - r.low] - 0.5) < 0.01


def test_mixing_beyond_broadcast_and_bounds(make, monkeypatch):
    data = [(i, f"text {i}", f"s{i % 3}") for i in range(300)] + [(400 + i, None, None) for i in range(5)]
    want = rows(mixing.mix(make(data), epochs=3.0))
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert rows(mixing.mix(make(data), epochs=3.0)) == want
    assert mixing.mix(make([(1, "x", "a")]), weights={"a": 1}, epochs=50_000.0).agg(F.max("copy")).first()[0] > 48_000
    monkeypatch.setattr(mixing, "HIGHEST", 2.0)
    with pytest.raises(ValueError):
        mixing.mix(make(data), epochs=30.0)


# --- all -------------------------------------------------------------------------


def test_pipeline(spark, make, tmp_path):
    import corpus_pipeline

    good = lambda k: " ".join(f"w{k}q{j}" for j in range(30))
    data = [(i, good(i), f"s{i % 4}") for i in range(200)] + [(300 + i, good(i), "s1") for i in range(50)] + [(500, "bad", "s1"), (501, None, None), (502, good(502) + " mail a@b.co", "s2"), (0, good(0), "s0")]
    make(data).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen["quality rules"]} == {d[0] for d in data} - {500, 501}
    assert sorted(r.doc_id for r in seen["near-dedup"]) == [*range(200), 502]
    assert [r.text.endswith("mail <EMAIL>") for r in seen["pii"] if r.doc_id == 502] == [True]
    assert {r.doc_id for r in seen["mixing"]} <= {*range(200), 502} and len(seen["mixing"]) == len(seen["packing"])
    assert [len(corpus_pipeline.run(spark, str(tmp_path)).collect())] == [len(seen["packing"])]


def test_pipeline_of_nothing(spark, make, tmp_path):
    import corpus_pipeline

    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("f", [licenses.scans, rules.judge, rules.keep_good, pii.detected, pii.redact, packing.pack])
def test_empty_tables(make, f):
    assert f(make([])).count() == 0


def test_every_query_with_clashing_columns(spark, make, tmp_path):
    """All queries and the pipeline on tables that have columns of names that operators use themselves."""
    import corpus_pipeline
    from famloom.llm import queries

    def clash(df, *names):
        return df.withColumns({n: F.lit("clash") for n in names})

    own = ("rate", "copies", "copy", "place", "__rate", "__u", "__row", "__key", "__kept", "__n_words", "n_words", "base_failed", "kept", "host", "key", "root", "part", "id", "size", "seq", "turn", "sequence_id", "offset", "__id", "slot", "shard", "virtual_slot", "first", "digest", "fp", "least", "token")
    clash(make(variety(15, 40)), *own).write.parquet(str(tmp_path / "documents.parquet"))
    clash(spark.createDataFrame([(1, "u", "x" * 200), (2, None, "x" * 200), (3, "v", None)], "page_id long, url string, html string"), "digest", "first", "p", "d", "path", "bytes", "at").write.parquet(str(tmp_path / "pages.parquet"))
    clash(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], TURNS), "path", "turns", "places", "nodes", "depth").write.parquet(str(tmp_path / "conversations.parquet"))
    clash(spark.createDataFrame([(k, [k / 7.0] * 64) for k in range(5)] + [(9, None)], "vec_id long, embedding array<float>"), "cluster", "distance", "v", "key", "none", "inertia").write.parquet(str(tmp_path / "embeddings.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, query in queries.queries().items():
        n = len(query(spark, str(tmp_path)).collect())
        assert n >= 2, name
        if name.split("_")[0] in ("op2", "op3", "op4", "op7", "op8", "op9", "op11", "op12"):
            assert n == docs.count(), name
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality rules", "near-dedup", "pii", "mixing"):
        docs = stages[name](spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(str(tmp_path / "documents.parquet")).columns, name
