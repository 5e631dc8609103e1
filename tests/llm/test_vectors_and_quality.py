"""Vector searches against brute force; the classifier on texts that it should tell apart."""

import random
import zlib

import numpy as np
import pytest
from tessella.llm import hnsw, pivots, quality
from tessella.llm.quality import Trees, fit

NAN, INF = float("nan"), float("inf")


def _vectors(n=700, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:300] = x[100]  # a vector that many rows share
    rows = [(int(i), v.tolist(), 0, 1) for i, v in enumerate(x)]
    rows += [(5000, None, 0, 1), (5050, [0.0] * dim, 0, 1), (5100, [None] * dim, 0, 1), (5150, [NAN] * dim, 0, 1), (5200, [INF] + [1.0] * (dim - 1), 0, 1)]
    rows += [(None, x[0].tolist(), 0, 1), (5250, [1.0], 0, 1), (150, x[150].tolist(), 0, 1), (5300, [], 0, 1)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int")


def _usable(rows, zero):
    out = {}
    for k, v, *_ in rows:
        if k is not None and v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v)):
            out[k] = np.array(v, np.float32).astype(float)
    return out


def _best(scores, own, k=5):
    return sorted(((-s, i) for i, s in scores.items() if i != own))[:k]


def _by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "shard_rows": 40, "block": 7}])
def test_exact_products(spark, options):
    rows = _vectors()
    got = _by_query(pivots.exact_top_k(_frame(spark, rows), **options).collect())
    code = {k: np.floor(256 * v).astype(int) for k, v in _usable(rows, zero=True).items()}
    queries = [k for k in code if k % 50 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        want = _best({k: int(v @ code[q]) for k, v in code.items()}, q)
        assert [(-r.score, r.vec_id) for r in got[q]] == want


def test_annuli_leave_out_what_the_bound_rules_out():
    """On vectors in far-off clusters most products aren't computed, and none that counts is missed."""
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 8))
    middles *= 4000 / np.linalg.norm(middles, axis=1, keepdims=True)
    x = np.floor(middles[np.arange(3000) % 12] + rng.normal(size=(3000, 8)) * 20)
    long2 = float((x**2).sum(axis=1).max())
    up = np.column_stack([x, np.sqrt(long2 - (x**2).sum(axis=1))])
    pivot = pivots.choose_pivots(up, 1)[0]
    part = pivots._Annuli(x, [[i] for i in range(len(x))], np.linalg.norm(up - pivot, axis=1), long2, 64)
    q = x[:20]
    bar = np.sort(x @ q.T, axis=0)[-6].astype(float)
    found = part.search(q, np.linalg.norm(np.column_stack([q, np.zeros(20)]) - pivot, axis=1), 5, bar)
    for (scores, _), v in zip(found, q):
        assert scores.tolist() == np.sort(x @ v)[::-1][:6].astype(int).tolist()
    assert part.computed < 0.7 * len(x) * len(q)


def test_products_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e30, 1.0], 0, 1), (1, [1e30, 2.0], 0, 1)]
    with pytest.raises(Exception, match="fit into 64 bits"):
        pivots.exact_top_k(_frame(spark, rows)).collect()


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [1.0, float(i == 0)], 0, 1) for i in range(400)]
    want = {0: [1, 2, 3, 4, 5]}
    for search in (pivots.exact_top_k, hnsw.nearest_neighbours):
        got = _by_query(search(_frame(spark, rows), every=400).collect())
        assert {q: [r.vec_id for r in v] for q, v in got.items()} == want


@pytest.mark.parametrize("options", [{"shard_rows": 200}, {"shard_rows": 20}])
def test_neighbours_found(spark, options):
    rows = _vectors()
    got = _by_query(hnsw.nearest_neighbours(_frame(spark, rows), **options).collect())
    x = _usable(rows, zero=False)
    hits = total = 0
    for q in [k for k in x if k % 50 == 0]:
        score = {k: float(v @ x[q] / np.sqrt((v @ v) * (x[q] @ x[q]))) for k, v in x.items()}
        want = _best(score, q)
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in got[q]) and len(got[q]) == 5
        hits += len({k for _, k in want} & {r.vec_id for r in got[q]})
        total += 5
    assert hits / total >= 0.9


def test_fewer_rows_than_asked(spark):
    rows = [(0, [1.0, 2.0], 0, 1), (1, [2.0, 1.0], 0, 1)]
    for search in (pivots.exact_top_k, hnsw.nearest_neighbours):
        assert [(r.query_id, r.vec_id) for r in search(_frame(spark, rows)).collect()] == [(0, 1)]
        assert search(_frame(spark, [])).count() == 0
        assert search(_frame(spark, rows[:1])).count() == 0


def test_graph_keeps_degree_and_order():
    x = np.random.default_rng(3).normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.build(x, 8, 40)
    assert graph.neighbours[0].shape == (500, 16)
    found = 0
    for i in range(0, 500, 25):
        near = graph.nearest(x[i], 60)
        assert near[0][1] == i and near == sorted(near, reverse=True)
        found += len({j for _, j in near[:6]} & set(np.argsort(-(x @ x[i]))[:6].tolist()))
    assert found >= 0.95 * 20 * 6


def _texts(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        good = i % 3 > 0
        kind = i % 4
        if good:
            text = " ".join(words).capitalize() + "."
        elif kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " ".join(w + "&&&" for w in words)
        else:
            text = " ".join([words[0]] * 60)
        rows.append((i, text, int(good)))
    return rows


def _plain_statistics(text):
    """The features of a text, one after the other, in plain Python."""
    raw = text.encode()
    white = b"\t\n\x0b\x0c\r "
    words, now = [], b""
    for c in raw + b" ":
        if c in white:
            words += [now] if now else []
            now = b""
        else:
            now += bytes([c])
    kind = {c: next((k for k, t in quality.CLASSES.items() if t(np.array([c]))[0]), None) for c in range(256)}
    for k in quality.CLASSES:  # where classes overlap, the last one counts
        for c in range(256):
            if quality.CLASSES[k](np.array([c]))[0]:
                kind[c] = k
    n, w = len(raw), len(words)
    count = {k: sum(kind[c] == k for c in raw) for k in quality.CLASSES}
    of = lambda a, b: a / b if b else 0.0
    pairs = list(zip(words, words[1:]))
    return [of(count[k], n) for k in quality.CLASSES] + [
        np.log1p(n), np.log1p(w), of(n - count["blank"], w), of(count["upper"], count["upper"] + count["lower"]), of(len(set(words)), w),
        of(max((words.count(x) for x in words), default=0), w), of(sum(a == b for a, b in pairs), w), of(len(set(pairs)), len(pairs)),
        of(w, count["line"] + 1), of(sum(kind[x[-1]] in ("shout", "bar", "sign") for x in words), w), of(sum(kind[x[0]] == "upper" for x in words), w),
    ]


def test_statistics_equal_plain_ones():
    import pyarrow as pa
    from tessella.llm.bytehash import text_bytes

    rng = random.Random(12)
    texts = [None, "", " \n", "a", "A!", "one one two\nTwo| ", "é日 É!\x0b x\x0cy", "word " * 500]
    texts += ["".join(rng.choice("abAB12 \n\t.!|#é") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    got = quality.statistics(*text_bytes(pa.array(texts, pa.string())))
    assert got.shape == (len(texts), len(quality.FEATURES))
    assert np.allclose(got, [_plain_statistics(t or "") for t in texts])


def test_first_split_is_the_best_of_all():
    """One stump against every split of every feature."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) > 6).astype(float)
    model = fit(x, y, trees=1, depth=1, rate=1.0)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(j, t):
        left = x[:, j] <= t
        parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
        return sum(a * a / (b + 1) for a, b in parts) if min(b for _, b in parts) >= 1 else -1.0

    best = max(gain(j, t) for j in range(4) for t in np.unique(x[:, j])[:-1])
    assert np.isclose(gain(model.feature[0, 0], model.threshold[0, 0]), best)
    left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert np.allclose(model.leaf[0], [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_held_out_accuracy(spark):
    rows = _texts()
    extra = [(900, None, None), (901, "", None), (None, "some text", None), (902, "word " * 300_000, None)]
    docs = spark.createDataFrame([(k, t, "s", 0.5) for k, t, _ in rows + extra], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, most_rows=200)
    got = quality.score(docs.withColumn("held_out", quality.held_out(docs["doc_id"])), model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    truth = {k: y for k, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {0.5}


def test_no_labels_give_the_prior(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_flat_trees_equal_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit(x, y, trees=20, depth=3)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.scores(x[:50]), [walk(r) for r in x[:50]])
    assert isinstance(model, Trees)
