"""Periods and gaps against brute force over points."""

import random

import pytest
from pyspark.sql import functions as F

from talkweave.operators.intervals import periods_and_gaps

SCHEMA = "conv_id string, start long, end long, label string, block int, t string, piece int"


def brute(rows):
    out = set()
    valid = {(c, s, e, None if lab is None else lab.strip(" ").upper()) for c, s, e, lab, *_ in rows if s is not None and e is not None and e > s}
    for c in {v[0] for v in valid}:
        mine = [v for v in valid if v[0] == c]
        covered = {x for _, s, e, _ in mine for x in range(s, e)}
        lo, hi = min(v[1] for v in mine), max(v[2] for v in mine)
        free = [x for x in range(lo, hi) if x not in covered]
        for a in free:
            if a - 1 not in free:
                b = a
                while b in free:
                    b += 1
                out.add((c, "gap", "", a, b, False))
        for lab in {v[3] for v in mine} - {None}:
            ivs = {(s, e) for _, s, e, x in mine if x == lab}
            count = {}
            for s, e in ivs:
                for x in range(s, e):
                    count[x] = count.get(x, 0) + 1
            for a in count:
                if a - 1 not in count:
                    b = a
                    while b in count:
                        b += 1
                    out.add((c, "merged", lab, a, b, any(count[x] > 1 for x in range(a, b))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.randrange(1, 80)):
        s = rng.randrange(-20, 120)
        row = (rng.choice(["a", "b", None]), rng.choice([s, s, s, None]), rng.choice([s + rng.randrange(-2, 15), s + 3, None]), rng.choice(["T", " t ", "c", None, ""]), 1, "x", 2)
        rows += [row] * rng.choice([1, 1, 2])
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), block=rng.choice([3, 10, 1000]))
    assert {tuple(r) for r in got.select("conv_id", "kind", "label", "period_start", "period_end", "overlaps").collect()} == brute(rows)


def test_hot_call_and_empty(spark):
    rows = [("hot", k * 10, k * 10 + 10 + k % 2, "T", 1, "", 1) for k in range(3000)] + [("x", 5, 5, "T", 1, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[1:5] for r in periods_and_gaps(df, block=500).collect()] == [("merged", "T", 0, 30001)]
    assert periods_and_gaps(df.where(F.lit(False))).count() == 0
