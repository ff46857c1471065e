"""Consistent forms: equal for what looks the same, different for the rest."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from talkweave.llm import lookalike as L

PATTERN = L.segment_pattern(L.unstable_ranges())


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＡＢ１，", "AB1,"), ("cafe\u0301", "café"), ("a\u200bb\ufeff\u00ad", "ab"), ("x\u00a0y\u2003z", "x y z"), ("раураl", "paypal"), ("Τhe Νight", "The Night"), ("oﬃce ﬂoor", "office floor"), ("home\u2011made", "home-made"), ("⼤⾬", "大雨"), ("е\u0301", "é"), ("ệ", "e\u0323\u0302"), ("한", "\u1112\u1161\u11ab")],
)
def test_alike(a, b):
    assert L.consistent(a, PATTERN) == L.consistent(b, PATTERN)


@pytest.mark.parametrize(("a", "b"), [("The", "the"), ("cafe", "café"), ("x1", "x7"), ("a b", "a  b"), ("a b", "ab"), ("a.", "a,"), ("x²", "x2"), ("…", "..."), ("½", "1/2"), ("ß", "ss"), ("a\nb", "a b")])
def test_different(a, b):
    assert L.consistent(a, PATTERN) != L.consistent(b, PATTERN)


def test_splicing_equals_whole_normalization():
    rng = random.Random(1)
    chars = "abcAe\u0301\u0308\u0323éö大 \u1112\u1161\u11ab한ａ\u200b\u00a0оﬁ."
    for _ in range(3000):
        s = "".join(rng.choice(chars) for _ in range(rng.randrange(12)))
        assert L.consistent(s, PATTERN) == unicodedata.normalize("NFC", "".join(map(L._flat, s)))
        assert L.consistent(L.consistent(s, PATTERN), PATTERN) == L.consistent(s, PATTERN)
        assert bool(re.search(L.segment_pattern(L.unstable_ranges()), s)) or L.consistent(s, PATTERN) == s


def test_pairs(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "abd"), (5, "ab\u200bc"), (6, None), (7, ""), (8, "\u200b"), (None, "abc"), (2, "аbc"), (9, "x" * 50000 + "é"), (10, "x" * 50000 + "e\u0301")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c0", F.lit(1)).withColumn("own", F.lit("x")).withColumn("form", F.lit("x"))
    got = {(r.doc_id_a, r.doc_id_b) for r in L.look_alikes(df).collect()}
    assert got == {(1, 2), (2, 3), (1, 5), (3, 5), (2, 5), (7, 8), (9, 10)}
    assert L.look_alikes(df.limit(0)).count() == 0
