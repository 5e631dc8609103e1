"""Each stage of the pipeline on its own input, by what it keeps."""

import os
import re
from collections import Counter

import corpus_pipeline
import pytest
from tessella.llm import mixing

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before each stage and after the last."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_stay(steps):
    for rows in steps[:-1]:
        assert set(rows[0].asDict()) == set(corpus_pipeline.COLUMNS)


def test_poor_documents_go_and_good_ones_stay(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1]}
    known = [r.doc_id for r in steps[0] if r.doc_id in labels]
    assert sum((k in kept) == bool(labels[k]) for k in known) >= 0.97 * len(known)


def test_one_of_each_near_group(steps):
    sets = {}
    for r in steps[1]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in steps[2]) == sorted({find(k) for k in ids})


def test_secrets_are_masked(steps):
    before = {r.doc_id: r for r in steps[2]}
    assert Counter(r.doc_id for r in steps[3]) == Counter(before.keys())
    secret = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,})|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
    for r in steps[3]:
        assert not secret.search(r.text) and r.n_chars == len(r.text)
        changed = r.text != before[r.doc_id].text
        assert changed == bool(secret.search(before[r.doc_id].text))


def test_mix_repeats_documents(spark, steps):
    docs = spark.createDataFrame(steps[3])
    want = {r.doc_id: r.copies for r in mixing.mixed_sizes(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in steps[4]) == want and max(want.values()) <= 3


def test_pieces_cover_all_copies(steps):
    pieces = Counter()
    whole = {}
    for r in steps[5]:
        pieces[r.doc_id] += r.length
        whole[r.doc_id] = r.doc_tokens
    assert pieces == {k: n * whole[k] for k, n in Counter(r.doc_id for r in steps[4]).items()}


def _odd_rows():
    base = " ".join(f"plain word number {i} of a quiet story" for i in range(40)) + "."
    return [
        (1, base, "en", "web", 10), (1, base, "en", "web", 10), (2, base + " And more.", "en", "web", 10), (None, base, None, None, None),
        (3, None, "en", "web", None), (4, "", None, "web", 0), (None, None, None, None, None), (5, "password=abcdef1 " * 3000, "en", None, 1),
        (6, "q" * 300_000 + " token=abcdefgh " + "long text " * 60_000, "en", "books", 2), (7, "\n\t ", "en", "books", 3), (8, "<|endoftext|>", "en", "", 4),
        (9, "The end. " * 4, "en", "", 4), (9, "Another text with the same id. " * 4, "en", "", 4),
    ]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = f"file://{tmp_path_factory.mktemp('odd')}"
    labels = [(k, int(k % 2 == 0), 0) for k in range(9)] + [(None, 1, 0), (2, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.createDataFrame(_odd_rows(), schema), path


def test_stages_take_odd_rows(spark, odd):
    """Nulls in any column, empty and very long texts, repeated rows and ids: every stage on all of them."""
    docs, path = odd
    rows = _odd_rows()
    poor = corpus_pipeline.drop_poor(spark, docs, path).collect()
    assert not Counter(map(tuple, poor)) - Counter(rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, path).collect()
    texts = Counter(r.text for r in kept)
    base = rows[0][1]
    assert texts[base] + texts[base + " And more."] == 1 and texts[None] == 2 and len(kept) == len(rows) - 3
    masked = corpus_pipeline.mask_secrets(spark, docs, path).collect()
    assert len(masked) == len(rows) and sum(r.text is None for r in masked) == 2
    assert {r.doc_id: r.text for r in masked}[5] == "[SECRET] " * 3000 and {r.doc_id: r.n_chars for r in masked}[5] == 27_000
    mixed = corpus_pipeline.mix_sources(spark, docs, path).collect()
    assert not {tuple(r) for r in mixed} - set(rows) and max(Counter(map(tuple, mixed)).values()) <= 6
    pieces = corpus_pipeline.pack(spark, docs, path).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and sum(r.start == 0 for r in pieces) == len(rows)


def test_stages_take_an_empty_table(spark, odd):
    docs, path = odd
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_pipeline_removes_what_it_wrote(spark, odd, monkeypatch):
    from tessella.llm import common

    docs, path = odd
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    before = len(common._MADE)
    assert corpus_pipeline.run(spark, path).count() > 0
    assert len(common._MADE) == before + len(corpus_pipeline.STAGES) - 1
    place = common._MADE[before].removeprefix("file://")
    assert os.path.exists(place)
    common.clear(spark, before)
    assert not os.path.exists(place) and len(common._MADE) == before


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tessella.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
