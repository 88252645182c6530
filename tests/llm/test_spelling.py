"""Spelling variants against edit distances, on words that share much and over ranges of few words."""

import zlib

import numpy as np
import pytest

from marginalia.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    forms, out = {}, {}
    for w, n in words.items():
        around = [(-m, v) for v, m in words.items() if near(w, v)]
        less, best = min(around, default=(0, None))
        forms[w] = best if -less >= 10 * n else None
        out[w] = [len(around), -less if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], *out[w])
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_variants_equal_brute_force(spark, parts):
    r = np.random.default_rng(parts)
    words = {"a" * k: int(r.integers(1, 10**k)) for k in range(1, 9)} | {"ab" * k: 3 for k in range(1, 6)} | {"é" + "x" * 40: 2, "e" + "x" * 40: 20, "x" * 3000: 2, "x" * 2999 + "y": 1000}
    for _ in range(400):
        w = "".join("abé÷"[x] for x in r.integers(0, 4, r.integers(3, 7)))
        words[w] = int(10 ** r.uniform(0, 4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = spelling.variants(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(words) and {x.word: tuple(x)[1:] for x in got} == brute(words)


def test_words_are_counted_after_slips(spark):
    rows = [(1, "Kitchen kitchen KITCHEN"), (1, "Kitchen kitchen KITCHEN"), (None, "kitchen"), (2, None), (3, ""), (4, "abcdefg1abcdefg\x00Übermaß Übermaß übermaß"), (-5, "Q" * 5000 + " " + "q" * 5000)]
    rows += [(k, "neighbourhood neighbourhood") for k in range(300)]
    want = {}
    for i, text in rows:
        for run in "".join(c if c.isalpha() else " " for c in text or "").split():
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            if len(w) >= 7:
                want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.counted(df).collect()} == {w: n for w, n in want.items() if n > 1}
    assert any(near(w, "neighbourhood") for w in want)


def test_empty_table(spark):
    assert spelling.variants(spelling.counted(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
