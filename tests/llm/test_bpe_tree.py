"""BPE by segment trees against the library that the file belongs to."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe_tree, common

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "'s", "'LL", "1", "²", "é", "ß", "日本", "😀", "<|endoftext|>", "<|endo", "\x1c", "\x85", "࢏", "\U00018d09", "�", "\0", "..", "--", "İ", "ǅ", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe_tree.Tokenizer(file.read())


def test_random_texts(own, library):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(3000)] + ["x" * 65, "ab" * 32 + "c", "q" * 5000]
    flat, ends = own.encode_all(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, a, b, w in zip(texts, ends, ends[1:], want):
        assert flat[a:b].tolist() == w.ids == own.encode(text), text
        assert own.decode(w.ids) == library.decode(w.ids, skip_special_tokens=False)


def test_every_code_point_is_of_the_same_kind(own, library):
    texts = [f"a{chr(c)}b {chr(c)}!" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(texts), 50_000):
        flat, ends = own.encode_all(texts[k : k + 50_000])
        assert all(flat[a:b].tolist() == w.ids for a, b, w in zip(ends, ends[1:], library.encode_batch(texts[k : k + 50_000], add_special_tokens=False)))


def test_trees_side_by_side_equal_single_ones(own):
    r = np.random.default_rng(2)
    words = ["".join(chr(97 + x) for x in r.integers(0, 5, r.integers(1, 64))) for _ in range(2000)] + ["é" * k for k in range(1, 30)] + ["", "a", "ab"]
    assert dict(own.merge_all(words)) == {w: own.merge(w) for w in words}


def test_ids_of_no_text_decode_alike(own, library):
    r = random.Random(3)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(20)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([72, None, 10**6, -1, 73]) == library.decode([72, 73], skip_special_tokens=False)


def test_odd_rows_keep_their_place(spark, library):
    rows = [(1, None, "k", 1), (2, "", "k", 2), (1, "Hello <|endoftext|> you", "k", 3), (None, "é" * 40_000 + " z", "k", 4), (5, "same", "k", 5), (5, "same", "k", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    got = bpe_tree.encode(df, PATH, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"] and bpe_tree.encode(df.where("false"), PATH).collect() == []
    want = sorted((repr(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _, _ in rows)
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in got.collect()) == want
    again = bpe_tree.decode(got.drop("decoded"), PATH)
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in again.collect()) == want


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in bpe_tree.op13_segment_bpe(spark, sf_dir).collect()}
    assert got == {
        i: (len(w.ids), hashlib.sha256(",".join(map(str, w.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(w.ids, skip_special_tokens=False).encode()).hexdigest())
        for i, w in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False))
    }


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"added_tokens": [{"id": 50256, "content": "<x>", "lstrip": True}]}])
def test_files_of_other_kinds_are_refused(change):
    import json

    with open(PATH, "rb") as file:
        raw = json.load(file) | change
    with pytest.raises(ValueError, match="not a plain byte-level"):
        bpe_tree.Tokenizer(json.dumps(raw).encode())


def test_later_code_points_are_looked_for_once_in_a_block(own, monkeypatch):
    looked, real = [], own.is_later
    monkeypatch.setattr(own, "is_later", lambda text: looked.append(text) or real(text))
    own.known.clear()
    flat, ends = own.encode_all([f"word{k}x{k}" for k in range(500)])
    assert len(looked) == 1 and len(ends) == 501 and flat[: ends[1]].tolist() == own.encode("word0x0")
