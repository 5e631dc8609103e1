"""The Jaccard join against all pairs, on texts made to lie about the threshold."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tessella.llm import jaccard, sieve
from tessella.llm.bytehash import text_bytes
from tessella.llm.graph import components
from tessella.llm.shingles import Prefixes, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[i:] for i in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(11)
    rows = []
    for size in (1, 3, 4, 5, 9, 15, 30, 60, 120):
        for _ in range(3):
            base = [f"w{rng.randrange(500)}" for _ in range(size)]
            rows += [near(rng, base, e) for e in (0, 0, 0, 1, 1, 2, 3, size // 50, size // 40)]
            rows.append(" ".join(base[: max(1, size * 9 // 10)]))
    hot = [f"h{i}" for i in range(200)]
    rows += [near(rng, hot, rng.randint(0, 6)) for _ in range(500)]
    rows += ["Same Text Here\tnow", "same text here now", "", None, "  \n", "É é", "é é", "long " * 20000]
    ids = rng.sample(range(10**6), len(rows))
    return list(zip(ids, rows)) + [(None, "w1 w2 w3 w4 w5"), (ids[0], rows[0]), (-5, rows[40])]


def brute(rows, percent=85, words=4):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            small, large = sorted((len(a), len(b)))
            if small and 100 * small >= percent * large and find(i) != find(j) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(best.get(find(i), k), k)
    return sorted(((k, len(s), best.get(find(i), k) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("percent,words", [(85, 4), (80, 5)])
def test_components_equal_all_pairs(spark, percent, words):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, class string, n int").repartition(5)
    got = jaccard.near_components(docs, percent, words).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, percent, words)


@pytest.mark.parametrize("block", [5])
def test_large_blocks_lose_no_link(spark, monkeypatch, block):
    """Blocks of near copies, of which some are linked to the lead and some only to others."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    rows = corpus()
    base = [f"k{i}" for i in range(120)]
    for step in range(60):
        base[rng.randrange(120)] = f"s{step}"
        rows.append((10**7 + step, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_keep_one_leaves_a_document_of_each_component(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = jaccard.keep_one(docs, 85, 4).collect()
    want = {c for k, n, c in brute(rows) if n}
    assert sorted((r.doc_id for r in got if shingles(r.text)), key=str) == sorted(want, key=str)
    assert sum(not shingles(r.text) for r in got) == 3


def test_full_filters_keep_the_same_documents(spark, monkeypatch):
    monkeypatch.setattr(sieve, "MOST_BITS", 64)
    rows = corpus()
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 85, 4).collect()
    want = {c for k, n, c in brute(rows) if n}
    assert sorted((r.doc_id for r in got if shingles(r.text)), key=str) == sorted(want, key=str)


def test_keep_one_keeps_unlinked_texts_without_an_id_or_with_the_same(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(9)) for c in "abcde"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (None, texts["c"].upper()), (None, texts["c"])]
    rows += [(4, texts["d"]), (4, texts["e"]), (4, texts["e"]), (9, texts["d"]), (None, None), (None, "")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 85, 4).collect()
    kept = sorted((r.text.lower(), r.doc_id) for r in got if r.text)
    assert kept == [(texts["a"], None), (texts["b"], None), (texts["c"], None), (texts["d"], 4), (texts["e"], 4)]
    assert sum(not r.text for r in got) == 2


def test_nothing_in_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_components(docs).count() == 0
    assert jaccard.keep_one(docs).count() == 0


def test_shingles_equal_plain_ones():
    texts = [t for _, t in corpus()]
    h, at = shingle_sets(*text_bytes(pa.array(texts, pa.string())), 4)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    same = {}
    for i, t in enumerate(texts):
        assert same.setdefault(shingles(t), h[at[i] : at[i + 1]].tobytes()) == h[at[i] : at[i + 1]].tobytes()


def test_words_that_cancel_in_weak_hashes_have_sets_of_their_own():
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    texts = [f"one {x} two three four", f"one {y} two three four", x, y, x + y, y + x]
    h, at = shingle_sets(*text_bytes(pa.array(texts, pa.string())), 4)
    sets = [frozenset(h[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert len(set(sets)) == 6 and not sets[0] & sets[1]


def test_near_sets_share_a_key():
    """Whatever shingles are taken for common."""
    rng = np.random.default_rng(2)
    for size in [*range(1, 40), 100, 500]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = a.copy()
            out = rng.integers(0, size // 8 + 1)
            b[rng.permutation(len(b))[:out]] = rng.integers(0, 2**63, out)
            b = np.unique(b[: len(b) - rng.integers(0, size // 20 + 1)])
            common = np.sort(rng.permutation(np.union1d(a, b))[: rng.integers(0, size + 1)])
            order = Prefixes(85, common, rng.integers(3, 9, len(common)))
            both = len(np.intersect1d(a, b))
            if 185 * both >= 85 * (len(a) + len(b)):
                key, who = order.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(key[who == 0]) & set(key[who == 1])
                assert (who == 0).sum() == len(a) - -(-85 * len(a) // 100) + 1


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**40, rng.integers(5, 400)).astype(np.uint64)
        for _ in range(25):
            keep = rng.random(len(base)) > rng.choice([0.0, 0.03, 0.08])
            sets.append(np.unique(base[keep]))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    points = jaccard.group_counts(np.concatenate(sets), at)
    sizes = np.diff(at)
    i, j = jaccard.CountTree(points, sizes, 85).pairs()
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    for x in range(len(sets)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 185 * both >= 85 * (sizes[x] + sizes[y]):
                assert frozenset((x, y)) in found
    assert len(found) < len(sets) ** 2 / 4


def test_tree_levels_spare_most_pairs():
    """Groups of unlike sets: whole nodes are ruled out, and a linked part costs nothing."""
    rng = np.random.default_rng(9)
    bases = [rng.integers(0, 2**60, n).astype(np.uint64) for n in np.geomspace(40, 20_000, 40).astype(int)]
    sets = [np.unique(b[rng.random(len(b)) > 0.03]) for b in bases for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    points = jaccard.group_counts(np.concatenate(sets), at)
    tree = jaccard.CountTree(points, np.diff(at), 85)
    i, j = tree.pairs()
    assert len(tree.levels) > 1 and tree.tested < 0.2 * len(sets) * (len(sets) - 1) / 2 and len(i) <= tree.tested
    part = np.repeat(np.arange(40), 30)
    assert len(tree.pairs(part)[0]) == sum(part[a] != part[b] for a, b in zip(i, j))
    hot = jaccard.CountTree(points[-30:].repeat(40, axis=0), np.diff(at)[-30:].repeat(40), 85)
    hot.pairs(np.zeros(1200, int))
    assert hot.tested == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]} | {8: 8, 9: 8}
    assert got == want


def test_sieve_sends_keys_alone_to_python(spark):
    rows = spark.createDataFrame([(k, "x" * 100) for k in [*range(50), None]], "`a.b` long, text string")
    chosen = sieve.Sieve.build(spark.createDataFrame([(7,), (8,), (None,)], "k long"), "k", 3)
    some, rest = chosen.split(rows, "a.b", maybe=True), chosen.split(rows, "a.b", maybe=False)
    ids = lambda df: {r["a.b"] for r in df.collect()}
    assert {7, 8} <= ids(some) and None in ids(rest) and ids(some) | ids(rest) == {*range(50), None} and not ids(some) & ids(rest)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
