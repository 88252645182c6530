"""Merging a pre-token looks up only the pairs that are new."""

import random

from marginalia.llm import bpe


def test_short_merges_equal_long_ones_with_few_lookups():
    words = bpe.Vocabulary(open(bpe.default_vocabulary()[0], "rb").read(), bpe.default_vocabulary()[1])
    r = random.Random(7)
    for n in (2, 3, 9, 30, 64):
        for _ in range(100):
            piece = bytes(r.choice(b"aeinrst") for _ in range(n)) if r.random() < 0.7 else r.randbytes(n)
            if piece not in words.ranks:
                assert words.merge(piece) == words._merge_long(piece)

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return dict.get(self, *args)

    words.ranks = Counted(words.ranks)
    words.merge(b"q" + b"internationalisation" * 3)
    assert Counted.asked <= 3 * 61
