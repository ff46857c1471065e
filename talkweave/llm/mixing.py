"""Mixing sources to target shares of the total size, by weighted sampling without replacement.

A document's key is an exponential variate divided by its quality weight; taking documents by
rising key is sampling with these weights (Efraimidis and Spirakis).  A source's budget is spent on
complete passes over its documents first, then on documents by rising key until the rest is spent.
Keys are cut into many buckets, whose token sums are the only thing added up by source; the one
bucket in which a budget ends is the only one that is sorted.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.durable import checkpointed, small

BUCKETS = 4096


def quality(n_chars: Column, n_tokens: Column) -> Column:
    """Weight of a document: characters per token, from 0.1 to 1; text that falls into bits weighs less."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), n_chars / F.greatest(n_tokens, F.lit(1)) / 4.0))


def _keyed(sized: DataFrame, weight: Column, seed: int) -> DataFrame:
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return (
        sized.withColumn("weight", weight)
        .withColumn("key", -F.ln(uniform) / F.greatest(F.col("weight").cast("double"), F.lit(1e-9)))
        .withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key") / 2)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    )


def plan_budgets(targets: list, sums: dict[str, dict[int, int]], total: int | None) -> list[dict]:
    """For each mix and source: budget, complete passes, and the bucket in which the rest is spent.

    Without a given total a mix is as large as it can be with every source, that has documents, at
    its share; with one, a source that may not be repeated often enough falls short of its share.
    """
    size = {s: sum(b.values()) for s, b in sums.items()}
    by_mix: dict = defaultdict(list)
    for t in targets:
        by_mix[t["mix_id"]].append(t)
    out = []
    for mix, rows in by_mix.items():
        able = [r for r in rows if size.get(r["source"], 0) > 0 and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
        all_of = total if total is not None else min((size[r["source"]] * r["max_repeats"] / r["target_share"] for r in able), default=0)
        for r in rows:
            have, most = size.get(r["source"], 0), r["max_repeats"] or 0
            budget = min(all_of * (r["target_share"] or 0), have * most) if r in able else 0
            passes = int(budget // have) if have else 0
            rest, spent, at = budget - passes * have, 0, -1
            if rest > 0:
                for b in sorted(sums[r["source"]]):
                    if spent + sums[r["source"]][b] > rest:
                        at = b
                        break
                    spent += sums[r["source"]][b]
            out.append({"mix_id": mix, "source": r["source"], "passes": passes, "at": at, "rest": float(rest - spent)})
    return out


def mix_sources(
    sized: DataFrame, targets: DataFrame, weight: Column | None = None, total: int | None = None, seed: int = 7,
    item: str = "doc_id", source: str = "source", size: str = "n_tokens",
) -> DataFrame:
    """The documents of each mix, each with how often it is used.

    `targets` has mix_id, source, target_share and max_repeats and is small by its nature (up to
    100,000 rows, else an error).  Result: mix_id, source, <item>, size, repeats (1..max_repeats).
    The tokens a source gives differ from its budget by half a document at most.  Documents of no
    source, of a source no mix names, or with a null id are in no mix; null sizes count as 0.
    Sources without documents, shares or repeats that are null or 0 give nothing.  Equal keys are
    taken by id; repeated rows are documents of their own; empty tables give no rows.
    """
    goals = small(targets.select("mix_id", "source", "target_share", "max_repeats").distinct(), 100_000)
    named = sorted({r["source"] for r in goals if r["source"] is not None})
    rows = sized.where(F.col(source).isin(named) & F.col(item).isNotNull()).select(
        F.col(item).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), *([weight.alias("w")] if weight is not None else [])
    )
    keyed = checkpointed(_keyed(rows, F.col("w") if weight is not None else F.lit(1.0), seed).drop("w", "weight"))
    sums: dict[str, dict[int, int]] = defaultdict(dict)
    for r in small(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n")), len(named) * BUCKETS):
        sums[r["source"]][r["bucket"]] = r["n"]
    plan = plan_budgets(goals, sums, total)
    if not plan:
        plan = [{"mix_id": None, "source": None, "passes": 0, "at": -1, "rest": 0.0}]
    budgets = F.broadcast(sized.sparkSession.createDataFrame(plan, "mix_id string, source string, passes int, at int, rest double"))
    used = keyed.join(budgets, "source").withColumn(
        "extra", F.when(F.col("rest").isNull() | (F.col("at") < 0), 0).when(F.col("bucket") < F.col("at"), 1).when(F.col("bucket") > F.col("at"), 0)
    )
    last = W.partitionBy("mix_id", "source").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)
    ending = used.where("extra IS NULL").withColumn("extra", (F.sum("size").over(last) - F.col("size") / 2 <= F.col("rest")).cast("int"))
    return (
        used.where("extra IS NOT NULL")
        .unionByName(ending)
        .where("passes + extra > 0")
        .select("mix_id", "source", F.col("id").alias(item), F.col("size").alias(size), (F.col("passes") + F.col("extra")).alias("repeats"))
    )


def mix_shares(mixed: DataFrame, targets: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Per mix and source: target share, documents, tokens with repeats, the actual share and the most repeats used."""
    per = mixed.groupBy("mix_id", "source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col(size) * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    every = W.partitionBy("mix_id")
    return (
        targets.select("mix_id", "source", "target_share", "max_repeats")
        .distinct()
        .join(per, ["mix_id", "source"], "left")
        .select(
            "mix_id", "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(every)), F.lit(0.0)).alias("actual_share"),
        )
    )
