"""Encoding, the token archive and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tessella.llm import dac, encode, packing
from tessella.llm.bytehash import text_bytes
from tessella.llm.encode import Encoder, encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library_on_odd_texts(plain):
    rng = random.Random(3)
    signs = " \n\t.,'aBé× 　\x85²日—s\x1c\r19|"
    texts = [None, "", " ", "\n", "it's  'twas", "a  　b", "x" * 5000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    flat, at = encoder(PATH).encode(*text_bytes(pa.array(texts, pa.string())))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


def test_added_token_has_its_id_wherever_a_text_holds_it():
    """The unmodified library is the reference."""
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "\n", "  ", "a", "B.", "é", "日", "<", ">", "<|ENDOFTEXT|>"]
    texts = ["a<|endoftext|>b", "a<|endof", "text|>b", "", None, "<|endoftext|>", " x  <|endoftext|>  y\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    flat, at = encoder(PATH).encode(*text_bytes(pa.array(texts, pa.string())))
    got = [flat[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got[0] == [64, 50256, 65]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def thue_morse(a, b, doublings):
    """Two different words of which polynomial hashes modulo 2^64 can't tell one from the other."""
    x, y = a, b
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


def test_ids_never_hang_on_a_hash(monkeypatch):
    """Words that cancel in weak hashes, long words, and a table whose keys all collide."""
    t = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = [w for n in (3, 5, 6, 7, 10, 11) for a, b in ("ab", "xq", "zk") for w in thue_morse(a, b, n)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 140))) for _ in range(10_000)]
    texts += [" ".join(texts[:30]), "".join(f" {w}" for w in texts[40:400])]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]

    def ids():
        flat, at = Encoder(PATH).encode(*text_bytes(pa.array(texts, pa.string())))
        return [flat[a:b].tolist() for a, b in zip(at, at[1:])]

    assert ids() == want
    monkeypatch.setattr(encode, "hash_ranges", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    assert ids() == want


def test_archive_of_texts_with_an_added_token(spark):
    ids = Tokenizer.from_file(PATH).encode("a<|endoftext|>b", add_special_tokens=False).ids + [0]
    (row,) = dac.token_archive(_docs(spark, [(1, "a<|endoftext|>b", "x")]), PATH).collect()
    assert tuple(row) == (1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    (piece,) = packing.pack_documents(_docs(spark, [(1, "a<|endoftext|>b", "x")]), PATH).collect()
    assert (piece.ids_crc32, piece.doc_tokens) == (row[3], len(ids))


def test_image_gives_any_token():
    rng = np.random.default_rng(1)
    ids = rng.choice([0, 5, 255, 256, 65535, 65536, 2**24 + 7], 3000).astype(np.uint32)
    image = dac.Image(dac.encode_image(ids, np.array([4, 9]), np.array([False, True]), np.array([0, 10, 3000])))
    assert image.tokens().tolist() == ids.tolist()
    assert [image.token(i) for i in range(3000)] == ids.tolist()
    places = rng.permutation(3000)
    assert image.take(places).tolist() == ids[places].tolist() and image.take(places[:0]).size == 0
    with pytest.raises(IndexError):
        image.token(3000)
    empty = dac.Image(dac.encode_image(ids[:0], np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(1, np.int64)))
    assert empty.tokens().size == 0


ROWS = [
    (7, "The cat sat. It slept!\nThen it left.", "x"),
    (2, "", "x"),
    (None, "no id here", "x"),
    (3, None, "x"),
    (5, "same", "x"),
    (5, "same", "x"),
    (5, "other text", "x"),
    (-4, "word " * 6000, "x"),
    (9, "unbroken" * 3000, "x"),
]


def _docs(spark, rows=ROWS):
    # extra columns whose names clash with those used inside
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id string, start int, shard int")


def test_archive_round_trip(spark, plain):
    got = [tuple(r) for r in dac.token_archive(_docs(spark), PATH, image_tokens=50).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [None, -4, 2, 3, 5, 5, 5, 7, 9]
    ids = {r[:2]: plain(r[1]) + [0] for r in ROWS}
    assert sorted(r[2] for r in got) == sorted(len(ids[r[:2]]) for r in ROWS)
    at = 0
    for doc, start, n, crc in got:
        assert start == at
        assert (n, crc) in [(len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ids.items() if k[0] == doc]
        at += n


def test_tokens_are_found_by_position(spark, plain, monkeypatch):
    from tessella.llm.common import fresh_path

    monkeypatch.setattr(dac, "BUCKET", 64)
    path = fresh_path(spark, "dac")
    dac.write_images(_docs(spark), path, PATH, image_tokens=50)
    docs = sorted(dac.read_images(spark, path).collect(), key=lambda r: r.start)
    texts = {(r[0], len(ids)): ids for r in ROWS for ids in [plain(r[1]) + [0]]}
    whole = {}
    for r in docs:
        ids = texts[r.doc_id, r.n_tokens]
        whole.update({r.start + i: t for i, t in enumerate(ids)})
    asked = [(p, 1) for p in [*range(0, len(whole), 7), 0, 0, len(whole) - 1, len(whole), -1, None]]
    got = dac.tokens_at(spark.createDataFrame(asked, "position long, token int"), path).collect()
    assert len(got) == len({p for p, _ in asked if p is not None and 0 <= p < len(whole)})
    assert all(r.token == whole[r.position] for r in got)


def test_archive_of_nothing(spark):
    assert dac.token_archive(_docs(spark, []), PATH).count() == 0


def test_packing_covers_every_id_once(spark, plain):
    got = packing.pack_documents(_docs(spark), PATH, seq_len=256, stretch=400).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        n = pieces[0].sequence_tokens
        assert at == n <= 256 and pieces[0].padding == (0 if n & (n - 1) == 0 else 256 - n)
    left = {}
    for doc, text, _ in ROWS:
        ids = plain(text) + [0]
        left.setdefault((doc, len(ids)), []).append(ids)
    seen = {}
    for r in got:
        ids = left[r.doc_id, r.doc_tokens][0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault((r.doc_id, r.doc_tokens), []).extend(range(r.start, r.start + r.length))
    for key, copies in left.items():
        assert sorted(seen[key]) == sorted(i for ids in copies for i in range(len(ids)))


def test_packing_of_nothing(spark):
    assert packing.pack_documents(_docs(spark, []), PATH).count() == 0


def test_windows_are_the_cheapest():
    """The queue's answer against a plain quadratic programme."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 40, 60))])
        penalty = rng.choice([0.0, 4.0, 32.0], len(at))
        size = 128

        def price(n):
            return 0 if n >= 64 and n & (n - 1) == 0 else size - n

        cost = [0.0]
        for j in range(1, len(at)):
            cost.append(penalty[j] + min(cost[i] + price(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= size))
        path = packing.best_windows(at, penalty, size)
        assert path[0] == 0 and path[-1] == len(at) - 1
        assert sum(penalty[j] + price(at[j] - at[i]) for i, j in zip(path, path[1:])) == pytest.approx(cost[-1])
