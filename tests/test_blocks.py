"""Matching blocks against a plain search, and their bounds."""

import difflib
import random
import time

import pytest

from curatum.functions import blocks
from curatum.operators import quality


def plain(a, b):
    """Characters in matching blocks, by trying all blocks."""
    for n in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - n + 1):
            j = b.find(a[i : i + n])
            if j >= 0:
                return n + plain(a[:i], b[:j]) + plain(a[i + n :], b[j + n :])
    return 0


@pytest.mark.parametrize("alphabet, most", [("ab", 24), ("abc", 40), ("aé𝄞 \n", 30), ("abcdefghij", 60)])
def test_equal_to_plain_search(alphabet, most):
    rng = random.Random(len(alphabet))
    for _ in range(120):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
        b = rng.choice([a[::-1], a[len(a) // 3 :] + a[: len(a) // 3], "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))])
        m, total = plain(a, b), len(a) + len(b)
        want = 2.0 * m / total if total else 1.0
        assert blocks.ratio(a, b) == want and m <= blocks.most(a, b)
        for above in (0.0, 0.3, 0.75, 0.9, want):
            assert blocks.ratio(a, b, above) == (want if want > above else None)


def test_long_texts():
    """Equal to the library's search without its popularity rule, in seconds on 20,000 characters."""
    rng = random.Random(1)
    words = ["w%d" % i for i in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a = text(400)
    b = a[:500] + text(20) + a[700:1500] + a[1600:]
    assert blocks.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    long = text(4600)
    edited = list(long)
    for _ in range(150):
        edited[rng.randrange(len(edited))] = rng.choice("abc w")
    began = time.time()
    assert 0.9 < blocks.ratio(long, "".join(edited), 0.75) < 1 and blocks.ratio("ab" * 10000, "ba" * 10000) > 0.99
    assert blocks.ratio(long, text(4600), 0.75) is None
    assert time.time() - began < 30


def test_levels_and_report(spark):
    base = "A somewhat long answer about rivers and towns"
    rows = [(1, base, base.upper()), (2, base, base[:32]), (3, base, "No."), (4, None, None), (5, "", "x"), (6, "abcdef", "fedcba"), (None, "Ab", "aB")]
    df = spark.createDataFrame(rows, "id long, chosen string, rejected string")
    got = {r.id: (r.ratio, r.level) for r in quality.response_overlap(df).collect()}
    assert got == {1: (1.0, "high"), 2: (round(64 / 77, 6), "moderate"), 4: (1.0, "high"), None: (1.0, "high")}
    assert tuple(quality.overlap_report(df).first()) == (7, 3, 1, True)
    assert tuple(quality.overlap_report(df.limit(0)).first()) == (0, 0, 0, False)
