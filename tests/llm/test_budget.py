"""Packing and mixing."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm.mixing import mix_shares, mix_sources
from talkweave.llm.packing import best_filling, configurations, fill_containers, fillings, pack
from talkweave.llm.tokens import RANKS, counter, encoding, n_tokens


@pytest.mark.parametrize("seed", range(8))
def test_pack_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([16, 256, 1000, 4096]))
    sizes = np.minimum(cap, (rng.lognormal(np.log(cap / 5), 0.9, 3000)).astype(int))
    box = pack(sizes, cap)
    fill = np.bincount(box, weights=sizes)
    assert fill.max() <= cap and set(box) == set(range(box.max() + 1))
    # near the bound that no packing can beat: the volume, and each item above half for itself
    bound = max(-(-sizes.sum() // cap), (sizes > cap / 2).sum())
    assert box.max() + 1 <= 1.05 * bound + 2


def test_configurations_take_everything():
    sizes, counts = np.array([90, 60, 40, 10]), np.array([7, 5, 9, 30])
    plan = configurations(sizes, counts, 100)
    assert (sum(t * n for t, n in plan) == counts).all() and all((t * sizes).sum() <= 100 for t, _ in plan)


@pytest.mark.parametrize("seed", range(6))
def test_best_filling_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    sizes, worth, most = rng.integers(5, 30, 4), rng.random(4), rng.integers(0, 4, 4)
    best = max(sum(w * n for w, n in zip(worth, t)) for t in itertools.product(*(range(m + 1) for m in most)) if sum(s * n for s, n in zip(sizes, t)) <= 60)
    got = best_filling(sizes, worth, most, 60)
    assert (got <= most).all() and (got * sizes).sum() <= 60 and (got * worth).sum() == pytest.approx(best)


def test_fillings_are_an_optimum():
    """Fewer containers than the greedy choice: 7 of each fit two (60, 40) to a container, never three 33s beside a 60."""
    sizes, counts = np.array([60, 40, 34, 33]), np.array([8, 8, 9, 18])
    columns, used = fillings(sizes, counts, 100)
    assert ((columns * sizes[:, None]).sum(0) <= 100).all() and np.allclose(columns @ used, counts) and used.sum() == pytest.approx(17.0)
    # prices that no filling exceeds prove the optimum
    price = np.linalg.solve(columns.T.astype(float), np.ones(4))
    assert all(price @ t <= 1 + 1e-6 for t in map(np.array, itertools.product(range(2), range(3), range(3), range(4))) if (t * sizes).sum() <= 100)


def test_few_groups_for_every_capacity(monkeypatch):
    from talkweave.llm import packing

    seen = []
    monkeypatch.setattr(packing, "configurations", lambda sizes, counts, cap, real=packing.configurations: seen.append(len(sizes)) or real(sizes, counts, cap))
    for cap in (256, 1024, 4096):
        packing.pack(np.random.default_rng(1).integers(1, cap, 5000), cap)
    assert all(1 < n <= packing.GROUPS for n in seen)


@pytest.mark.parametrize("sizes", [[], [0], [5], [0, 0, 0], [5, 5, 5], [10] * 7])
def test_pack_small(sizes):
    box = pack(np.array(sizes, dtype=np.int64), 10)
    assert len(box) == len(sizes)


def test_containers(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 3, 50, 120, 256, 257, 1000]), "x") for k in range(2000)] + [(None, 7, "x"), (9999, None, "x"), (5, 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, capacity string").withColumn("shard", F.lit("clash")).withColumn("limit_id", F.lit(1))
    limits = spark.createDataFrame([("s", 256), ("l", 4096), ("none", None), ("zero", 0), ("s", 256)], "limit_id string, max_tokens int")
    got = fill_containers(df, limits, shard=500).cache()
    assert {r.limit_id for r in got.select("limit_id").distinct().collect()} == {"s", "l"}
    for limit, cap in (("s", 256), ("l", 4096)):
        one = got.where(F.col("limit_id") == limit)
        assert one.agg(F.sum("size")).first()[0] == sum(r[1] or 0 for r in rows)
        sums = one.groupBy("container_id").agg(F.sum("size").alias("n"), F.max("fill").alias("fill"), F.count("*").alias("c")).collect()
        assert all(r.n == r.fill <= cap for r in sums)
        split = {r.doc_id for r in one.where("piece > 0").collect()}
        assert split == {r[0] for r in rows if (r[1] or 0) > cap}
        assert one.where("piece = 0").count() == len(rows)
    assert fill_containers(df.limit(0), limits).count() == 0
    assert fill_containers(df, limits.limit(0)).count() == 0


def test_token_sizes(spark):
    texts = ["", None, "a", "The night nurse, who's late.", "  two  blanks ", "tab\tand\nline \n x", "a   b", "中文 字符。", "x" * 5000, " lead", "trail ", "\u00a0 \u2003 x", "don't  stop"]
    encode = encoding(RANKS).encode_ordinary
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_tokens(F.col("t")).alias("n")).collect()]
    assert got == [len(encode(t or "")) for t in texts]
    rng, count = random.Random(3), counter(RANKS)
    for _ in range(3000):
        s = "".join(rng.choice("ab '1.\n\té中\u2003st") for _ in range(rng.randrange(20)))
        assert count(s) == len(encode(s)), repr(s)


def _mix(spark, total=None):
    rng = random.Random(4)
    rows = [(k, "big" if k % 10 else "rare", rng.randrange(1, 400)) for k in range(5000)] + [(9001, None, 5), (None, "big", 5), (9002, "other", 5), (9003, "big", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("key", F.lit(1)).withColumn("bucket", F.lit(1))
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "rare", 0.5, 3), ("n", "big", 0.9, 2), ("n", "rare", 0.1, 2), ("n", "gone", 0.0, 2), ("o", "big", None, 1), ("m", "big", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    return rows, mix_sources(df, targets, weight, total), targets


def test_mix(spark):
    rows, mixed, targets = _mix(spark)
    mixed = mixed.cache()
    shares = {(r.mix_id, r.source): r for r in mix_shares(mixed, targets).collect()}
    for k in (("m", "big"), ("m", "rare"), ("n", "big"), ("n", "rare")):
        assert abs(shares[k].actual_share - shares[k].target_share) < 0.002
        assert 1 <= shares[k].most_repeats <= shares[k].max_repeats
    assert shares["n", "gone"].n_docs == 0 and shares["o", "big"].n_docs == 0
    # the rare source of m is used up, whole passes before any further one
    reps = [r.repeats for r in mixed.where("mix_id = 'm' AND source = 'rare'").collect()]
    assert len(reps) == 500 and max(reps) - min(reps) <= 1
    # weights tell: of the part of big that m takes, heavy documents are most
    taken = [r.doc_id % 2 for r in mixed.where("mix_id = 'm' AND source = 'big'").collect()]
    assert taken.count(0) > 1.5 * taken.count(1)
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0


def test_mix_with_total_falls_short_where_repeats_end(spark):
    rows, mixed, targets = _mix(spark, total=10_000_000)
    shares = {(r.mix_id, r.source): r for r in mix_shares(mixed, targets).collect()}
    size = sum(r[2] for r in rows if r[1] == "rare")
    assert shares["m", "rare"].n_tokens == 3 * size and shares["m", "rare"].most_repeats == 3


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "big", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    assert mix_sources(df, targets).count() == 0
    assert mix_sources(df, targets.limit(0)).count() == 0
    assert mix_shares(mix_sources(df, targets), targets).first().n_docs == 0
