"""Merkle manifests, token counts by prefix and Orchard clustering against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD
from famloom.llm import merkle, orchard, prefixes

# --- 11 --------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _climb(nodes):
    """Root and the siblings of each leaf, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, k in enumerate(at):
            run = range(k // 3 * 3, min(k // 3 * 3 + 3, len(level)))
            paths[leaf].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def _audit(docs):
    by = {}
    for d in docs:
        by.setdefault(d[1], []).append((d, _leaf(d)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(_climb([leaf for _, leaf in by[s]]))
    root, tops = _climb([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (d, leaf), path in zip(by[s], paths, strict=True):
            lost = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
            node = _leaf((*d[:4], d[4].replace("\n", ""))) if lost else leaf
            for left, right in path + top:
                node = sha(left, node, right)
            out.append((d[0], leaf, subroot, root, sha(*(x for step in path + top for x in step)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sources", [1, 5, 100])
def test_manifest_by_brute_force(spark, make, sources):
    r = random.Random(sources)
    rows = [(i, r.choice(("a\nb", "c", "", None, "Élan\n")), f"é{r.randrange(sources)}") for i in range(400)]
    rows += [(i, t, r.choice(("é0", None, "", "zz"))) for i, t in ODD] + [(7, "same\n", "é0")] * 90
    got = merkle.audited(make(rows, extra=True))
    want = _audit([(i, s, "en", None if t is None else len(t), t) for i, t, s in rows])
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want
    assert {x[-1] for x in want} == {True, False}


def test_a_manifest_stores_every_few_levels_only(make):
    docs = make([(i, "t", "s") for i in range(700)])
    m = merkle.build(docs.select("doc_id", "source", merkle.row_digest(F.col("doc_id")).alias("leaf")), "leaf", "source", ["doc_id"], ["doc_id"])
    assert [t.count() for t in m.trees] == [-(-700 // merkle.SPAN), 1] and max(x.n for x in m.trees[0].select(F.size("nodes").alias("n")).collect()) == merkle.SPAN
    assert m.groups.first()["height"] == 6 and [x.depth for x in m.trees[1].collect()] == [2]
    proofs = merkle.proofs(m).withColumn("ok", merkle.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    assert proofs.where("ok and size(path) = 6").count() == 700
    assert proofs.where(merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_a_manifest_of_nothing(make):
    assert merkle.audited(make([])).count() == 0


# --- 12 --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(prefixes.tokenizer_path())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


BITS = ["hello", " world", "'re", "'ll", "'s", "'", "don't", "   ", "\n\n ", "\t", "  x", "!!", "<|endoftext|>", "<|endof", "日本語", "Élan", " \n", "123", " 45", "²", "aaaa", "=====", "\x1c", "\x85", "　", "🙂", "é", "\n", " "]


def test_every_prefix_has_the_tokens_that_the_library_gives_it(library, monkeypatch):
    r, c = random.Random(4), prefixes.Counter(prefixes.tokenizer_path())
    monkeypatch.setattr(prefixes, "MEMORY", 20)
    monkeypatch.setattr(prefixes, "PAIRS", 50)
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(9))) for _ in range(250)]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(97, 123), r.randrange(0x80, 0xD7FF)))) for _ in range(25)) for _ in range(80)]
    for t in texts:
        assert c.prefixes(t).tolist() == [library(t[:k]) for k in range(len(t) + 1)], t
        assert c.total(t) == library(t)
    assert len(c.memory) <= 20 and len(c.vocabulary._known) <= 50


def test_tokens_that_go_together_are_their_own_encoding(library):
    from tokenizers import Tokenizer

    tokenizer, v, r = Tokenizer.from_file(prefixes.tokenizer_path()), prefixes.Vocabulary(prefixes.tokenizer_path()), random.Random(8)
    words = [w for w in ("".join(r.choice("aeinrst") for _ in range(r.randrange(1, 6))) for _ in range(400)) if len(tokenizer.encode(w, add_special_tokens=False).ids) == 1]
    ids = [tokenizer.encode(w, add_special_tokens=False).ids[0] for w in words]
    for _ in range(2000):
        a, b = r.randrange(len(ids)), r.randrange(len(ids))
        assert v.together(ids[a], ids[b]) == (tokenizer.encode(words[a] + words[b], add_special_tokens=False).ids == [ids[a], ids[b]])


LONG = [(100, "tokens, " * 4000), (101, "x" * 60_000), (102, " \n" * 20_000), (103, "日本 " * 9000), (104, "one<|endoftext|>two" * 800), (105, "=" * 30_000)]


def test_token_counts_of_documents(make, library):
    rows = ODD + LONG + [(200, "word " * 1024), (201, "word " * 1025)]
    got = prefixes.counted(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert sorted(((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in got), key=repr) == sorted(((i, len((t or "").encode()), library(t or ""), library(t or "") > prefixes.LIMIT) for i, t in rows), key=repr)
    text = {i: t or "" for i, t in rows}
    for x in got:
        if x.doc_id is not None:
            t = text[x.doc_id]
            assert library(t[: x.fit_chars]) <= prefixes.LIMIT and (x.fit_chars == len(t) or library(t[: x.fit_chars + 1]) > prefixes.LIMIT)


def test_budget_questions_are_columns(make, library):
    rows = [(1, "The quick brown fox doesn't jump.  \n Does it?"), (2, None), (3, "antidisestablishmentarianism " * 3)]
    store = prefixes.prefix_counts(make(rows, extra=True))
    for r in store.withColumn("at7", prefixes.tokens_of(F.col("prefix_tokens"), F.lit(7))).withColumn("five", prefixes.fitting(F.col("prefix_tokens"), 5)).collect():
        t = r.text or ""
        counts = [library(t[:k]) for k in range(len(t) + 1)]
        assert r.prefix_tokens == counts and r.at7 == (counts[7] if len(t) >= 7 else None) and r.five == max(k for k, n in enumerate(counts) if n <= 5)


def test_token_counts_of_nothing(make):
    assert prefixes.counted(make([])).count() == 0


# --- 13 --------------------------------------------------------------------------


def test_orchard_search_by_brute_force():
    r = np.random.default_rng(3)
    for n, k, d, top in ((400, 40, 8, 60), (300, 7, 2, 4), (50, 1, 3, 9), (200, 30, 2, 3)):
        centroids = r.integers(-top, top, (k, d))
        centroids[k // 2 :] = centroids[: k - k // 2]  # ties: equal centroids
        v = r.integers(-top, top, (n, d))
        best, nearest, measured = orchard.search(v, orchard.lists(centroids))
        every = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (nearest == every.min(axis=1)).all() and measured <= n * k


def test_orchard_search_leaves_far_centroids_alone():
    r = np.random.default_rng(5)
    centroids = r.integers(-1000, 1000, (40, 2)) * 1000
    v = centroids[r.integers(0, 40, 5000)] + r.integers(-9, 9, (5000, 2))
    assert orchard.search(v, orchard.lists(centroids))[2] < 5000 * 40 / 2


def _kmeans(vectors, k, rounds, seed):
    key = lambda x: (sha(f"{seed}:", "" if x[0] is None else str(x[0])), x[0] is None, x[1])
    cs = [list(v) for _, v in sorted(vectors, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        home = [nearest(v)[1] for _, v in vectors]
        for j in range(len(cs)):
            mine = [v for (_, v), h in zip(vectors, home, strict=True) if h == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in vectors], cs


@pytest.mark.parametrize("n", [150, 12])
def test_clusters_by_brute_force(spark, n):
    r = random.Random(n)
    rows = [(i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(n)]
    rows += [rows[3], (500, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3).withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want, cs = _kmeans(kept, 40, 5, 2)
    inertia = {j: sum(d for _, h, d in want if h == j) for j in range(len(cs))}
    digest = [sha(",".join(map(str, c))) for c in cs]
    got = orchard.clusters(df).collect()
    assert sorted((tuple(x) for x in got), key=repr) == sorted(((i, h, d, inertia[h], sum(inertia.values()), digest[h]) for i, h, d in want), key=repr)


def test_clusters_of_nothing_and_of_vectors_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    assert orchard.clusters(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        orchard.clusters(spark.createDataFrame([(1, [1e9] * 64)], schema))
