"""The pipeline's stages against brute force: near copies, null and shared ids, long secrets, draws by text."""

import random

import pytest
from pyspark.sql import functions as F

from famloom.llm import jaccard, mixing, pii


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(texts):
    """The smallest index in the group of each text: Jaccard of 0.8 or more on five-word shingles, over all pairs."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (5 * len(a & b) >= 4 * len(a | b)):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def copies(seed, n=160):
    """Texts with exact copies, near copies on both sides of 0.8, chains of them, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    line = " ".join(word() for _ in range(12))
    out = []
    for _ in range(n):
        k = r.random()
        if k < 0.1 and out:
            out.append(r.choice(out))
        elif k < 0.6 and out:
            t = r.choice(out[-20:]).split()
            for _ in range(r.choice((1, 1, 2, 3, len(t) // 40))):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
        else:
            t = [word() for _ in range(r.randrange(20, 160))]
            out.append(" ".join([*t, line] if k < 0.8 else t))
    return out


@pytest.mark.parametrize("seed, rounds", [(1, 5), (2, 1), (3, 0)])
def test_groups_by_brute_force(make, monkeypatch, seed, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    texts = [*copies(seed), None, "", "one two", "One  two", "one two three"]
    got = {r.doc_id: r.root for r in jaccard.groups(make(list(enumerate(texts)))).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    want = _groups(texts)
    assert [first[got[i]] for i in range(len(texts))] == want
    assert len(set(want)) < len(set(texts)) - 20


def test_a_large_group_of_near_copies(make, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 50)
    r, base = random.Random(4), [f"b{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}y{j}"] + base[k + 1 :]) for k in r.sample(range(100), 30) for j in range(5)]
    assert len({x.root for x in jaccard.groups(make(list(enumerate(texts)))).collect()}) == 1
    assert jaccard.groups(make([])).count() == 0


def test_a_pair_is_made_in_few_of_its_buckets(spark, make):
    # Near copies on both sides of 0.8 (two draws of changed words): each pair shares a hundred prefix shingles or so.
    r, base = random.Random(6), [f"b{i}" for i in range(1500)]
    texts = []
    for j in range(30):
        t = list(base)
        for k in r.sample(range(1500), 15 + j % 3 * 5):
            t[k] = f"x{k}y{j}"
        texts.append(" ".join(t))
    rows = jaccard.indexed(make(list(enumerate(texts))))
    infos = rows.select("id", "n", *(f"p{i}" for i in range(jaccard.WORDS)))
    full = jaccard.bucketed(rows).join(infos, "id").withColumn("root", F.col("id"))
    every = jaccard.dealt_pairs(full, ["token"], "id").where(jaccard._possible("{}", "{}2"))
    made = jaccard.across(full)
    assert 10 * made.count() < every.count()
    ids = [jaccard._id(jaccard.shingles(t)) for t in texts]
    sets = [_shingles(t) for t in texts]
    links = {tuple(sorted((ids[i], ids[j]))) for i in range(30) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert links and links <= {(x.u, x.v) for x in made.distinct().collect()}


def test_near_dedup_finds_near_copies(spark, make):
    import corpus_pipeline

    texts = copies(5)
    got = sorted(r.doc_id for r in corpus_pipeline.dedup(spark, make(list(enumerate(texts))), "").collect())
    assert got == sorted(set(_groups(texts)))


def _survivors(data):
    """Of each group the row of the smallest doc_id, nulls last: (doc_ids allowed, texts allowed) by group, as rows with one doc_id in a group tie."""
    groups = {}
    for root, d in zip(_groups([d[1] for d in data]), data, strict=True):
        groups.setdefault(root, []).append(d)
    out = []
    for rows in groups.values():
        least = min((d[0] is None, d[0] or 0) for d in rows)
        out.append({(d[0], d[1]) for d in rows if (d[0] is None, d[0] or 0) == least})
    return out


def test_near_dedup_keeps_one_row_of_each_group(spark, make):
    import corpus_pipeline

    r = random.Random(6)
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    # Unrelated texts without an id, copies of named ones without an id, one id on two texts, an id that is a copy in one group and least in another.
    data = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (None, text(3)), (8, text(4)), (8, text(5)), (9, text(6)), (3, text(6)), (9, text(7)), (10, text(8)), (10, text(8))]
    data += [(r.choice((None, r.randrange(100, 140))), t) for t in copies(7, 80)]
    got = [(x.doc_id, x.text) for x in corpus_pipeline.dedup(spark, make(data), "").collect()]
    want = _survivors(data)
    assert len(got) == len(want) and all(len(w & set(got)) >= 1 for w in want)
    # No row of another group's making: groups share no texts.
    assert sorted(_groups([t for _, t in got])) == list(range(len(got)))
    assert set(got) <= set().union(*want)
    one = make([(None, text(1)), (1, text(2)), (None, text(2))])
    assert sorted(((x.doc_id, x.text) for x in corpus_pipeline.dedup(spark, one, "").collect()), key=repr) == [(1, text(2)), (None, text(1))]


def test_long_secrets_are_found():
    r, field = random.Random(9), pii.trained()
    code = lambda n: "a1" + "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-") for _ in range(n - 3)) + "z"
    for span in (code(129), code(161), code(2000), f"eyJ{code(33)}.eyJ{code(200)}.{code(43)}"):
        for before, after in (('token = "', '"'), ("bearer ", "")):
            text = f"some words {before}{span}{after} and more"
            at = text.index(span)
            assert pii.field_spans(text, field) == [(at, at + len(span), "secret")]
            assert pii.redacted(text, pii.spans(text, field)[1]) == f"some words {before}<SECRET>{after} and more"
    assert pii.field_spans("see http://a.example/" + "abc/" * 40 + "x1234567890?y=12 ok", field) == []


def test_mixing_by_text_draws_apart(make):
    data = [(None, f"text {i}", "a") for i in range(400)] + [(5, f"other {i}", "a") for i in range(400)] + [(i, "b" * 100, "b") for i in range(100, 900)]
    got = [(r.doc_id, r["copies"], r["place"]) for r in mixing.mix(make(data), weights={"a": 1, "b": 1}, epochs=1.0, by_text=True).where("source = 'a'").collect()]
    for key in (None, 5):
        assert len({n for i, n, _ in got if i == key}) > 1
    assert len({p for *_, p in got}) == len(got)
