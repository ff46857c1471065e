"""Training rows from tapes: token masks, counts, priors, slices, packing, budgets, and losses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.text import let, words
from talkweave.functions.vocab import INTERLOCUTOR, MASKS, TRANSITIONS

USER = "<user>"


def token_rows(entries: DataFrame, key: str) -> DataFrame:
    """Tokens of tapes: key, pos, part, token, mask.

    A blank-separated word stands for a token of a tokenizer.  Switching and continuation tokens
    have masks of their own, own text 1, heard text 0.
    """
    heard = F.col("token").startswith(INTERLOCUTOR)
    mask = F.when(heard, 0)
    for token, m in MASKS.items():
        mask = mask.when(F.col("token") == token, m)
    shown = F.when(heard, F.concat(F.lit(USER), F.lit(" "), F.expr(f"substring(token, {len(INTERLOCUTOR) + 1})"))).otherwise(F.col("token"))
    return entries.select(key, "pos", mask.otherwise(1).alias("mask"), F.posexplode(words(shown)).alias("part", "token"))


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.where("mask >= 1").groupBy("token").agg(F.count("*").alias("n"))


def class_shares(counts: DataFrame) -> DataFrame:
    """Each control token and all responses together: count and share of all counted tokens."""
    name = F.when(F.col("token").isin(TRANSITIONS), F.col("token")).otherwise("response")
    per = counts.groupBy(name.alias("token")).agg(F.sum("n").alias("n"))
    whole = W.partitionBy(F.lit(0))  # six rows at most
    return per.select("token", "n", F.round(F.col("n") / F.sum("n").over(whole), 9).alias("share"))


def class_priors(counts: DataFrame, tau: float = 1.0, among: str = "all") -> DataFrame:
    """tau * log(prior) of control tokens, and of responses as one class; the prior is at least 1e-9.

    `among` is what control tokens are a share of: all counted tokens, or 'transition' tokens only.
    """
    shares = class_shares(counts)
    whole = W.partitionBy(F.lit(0))
    control = F.col("token") != "response"
    total = F.sum("n").over(whole)
    base = F.when(control, F.sum(F.when(control, F.col("n"))).over(whole)).otherwise(total) if among == "transition" else total
    return shares.select("token", F.round(tau * F.ln(F.greatest(F.col("n") / base, F.lit(1e-9))), 6).alias("adjustment"))


def slices(lengths: DataFrame, key: str, most: int, system: int = 0, end: int = 1) -> DataFrame:
    """Slices of up to `most` tokens, of which `system` are the system prompt and `end` the end mark: key, start, size.

    What is left is the limit of content; a slice starts 7/8 of it after the one before.
    """
    limit = most - system - end
    if limit <= 0:
        raise ValueError(f"a system prompt of {system} tokens leaves no room in {most}")
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(max(1, int(limit * 7 / 8)))))
    size = F.least(F.lit(limit), F.col("length") - F.col("start")) + system + end
    return lengths.where("length > 0").select(key, "length", starts.alias("start")).select(key, "start", size.alias("size"))


def packing_stats(lengths: DataFrame, packed: DataFrame, most: int) -> DataFrame:
    """One row: rows, tokens, mean, longest and shortest, packed rows, and the share of their room that tokens of content take.

    `packed` has batch and box.
    """
    n = F.col("length")
    boxes = packed.groupBy("batch").agg((F.max("box") + 1).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n_packed"))
    whole = lengths.agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.round(F.avg(n), 9).alias("mean"), F.max(n).alias("longest"), F.min(n).alias("shortest"))
    return whole.withColumn("n_packed", boxes.scalar()).withColumn("efficiency", F.round(F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("n_packed") * most), F.lit(0.0)), 9))


def vocabulary_priors(counts: DataFrame, tau: float = 1.0) -> DataFrame:
    """tau * log(prior) of every counted token: control tokens by their own share, all others by the share of responses together."""
    control = F.col("token").isin(TRANSITIONS)
    by_class = class_priors(counts, tau).withColumnRenamed("token", "class")
    return counts.select("token", F.when(control, F.col("token")).otherwise("response").alias("class")).join(F.broadcast(by_class), "class").select("token", "adjustment")  # six rows


def mask_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Control tokens with their mask and their one id; a token without an id, or with several, is an error.

    `vocabulary` has token and id, control tokens among them; repeated rows count once.
    """
    masks = vocabulary.sparkSession.createDataFrame(sorted(MASKS.items()), "token string, mask int")
    ids = vocabulary.where(F.col("token").isin(TRANSITIONS)).groupBy("token").agg(F.collect_set("id").alias("ids"))
    one = F.when(F.size(F.coalesce("ids", F.array().cast("array<bigint>"))) == 1, F.col("ids")[0]).otherwise(F.raise_error(F.concat(F.lit("not one id: "), "token")).cast("long"))
    return masks.join(F.broadcast(ids), "token", "left").select("token", "mask", one.alias("id"))  # five rows


def maps_differ(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tokens whose mask or id is not the same in two maps; those of data sets that are put together must not differ."""
    a, b = (m.select("token", F.struct("mask", "id").alias(n)) for m, n in ((first, "a"), (second, "b")))
    return a.join(b, "token", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("token")


def pack_next_fit(items: DataFrame, most: int, batch: str = "batch", order: str = "place", size: str = "size") -> DataFrame:
    """Items of a batch, in order, into boxes of `most`: a box is closed when the next item does not fit.

    The fold runs within a batch of bounded size.  An item larger than the box has one to itself.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        box, fill, out = 0, 0, []
        for n in pdf[size]:
            if fill and fill + n > most:
                box, fill = box + 1, 0
            fill += int(n)
            out.append(box)
        return pdf.assign(box=out)[[batch, order, size, "box"]]

    return items.groupBy(batch).applyInPandas(run, f"{batch} long, {order} long, {size} long, box long")


def tail_budget(chunks: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest chunks of each key whose sizes together stay within the budget, the newest in any case."""
    back = W.partitionBy(key).orderBy(F.desc(order))
    return (
        chunks.withColumn("_sum", F.sum(size).over(back.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_first", F.lag(order).over(back).isNull())
        .where((F.col("_sum") <= budget) | F.col("_first"))
        .drop("_sum", "_first")
    )


# -- losses -------------------------------------------------------------------------------------


def log_sum_exp(values: Column) -> Column:
    """log(sum(exp(x))) of an array, shifted by its greatest member."""
    return let(values, lambda v: let(F.array_max(v), lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))


def cross_entropy(logits: Column, label: Column) -> Column:
    return let(logits, lambda v: log_sum_exp(v) - F.element_at(v, label + 1))


def adjusted(logits: Column, adjustments: Column) -> Column:
    return F.zip_with(logits, adjustments, lambda a, b: a + b)


def fuzzy(logits: Column, control: list[int]) -> Column:
    """Loss of predicting any token that is no control token."""
    rest = F.filter(F.transform(logits, lambda x, i: F.when(i.isin(control), F.lit(None).cast("double")).otherwise(x)), lambda x: x.isNotNull())
    return log_sum_exp(logits) - log_sum_exp(rest)


def fuzzy_or_exact(exact: Column, loss: Column, fuzzy_loss: Column) -> Column:
    """The exact loss of the tokens drawn for it, of the others the fuzzy one."""
    return F.when(exact, loss).otherwise(fuzzy_loss)


def drawn(key: Column, sixteenths: int, seed: int = 7) -> Column:
    """True for a share of keys, in sixteenths, by their hash."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))) < F.lit("0123456789abcdefg"[sixteenths])


def argmax(values: Column) -> Column:
    """Index, from 0, of the greatest member; the first of equals."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def softmax_masked(logits: Column, forbidden: list[int]) -> Column:
    """Probabilities with a bias of -100 on forbidden members."""
    biased = F.transform(logits, lambda x, i: F.when(i.isin(forbidden), x - 100).otherwise(x))
    return let(biased, lambda v: let(log_sum_exp(v), lambda z: F.transform(v, lambda x: F.exp(x - z))))


def weighted_mean(loss: Column, weight: Column) -> Column:
    return F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1e-9))


def balanced_loss(rows: DataFrame) -> DataFrame:
    """One row: mean loss of responses, mean over control classes of their mean losses, and their sum.

    `rows` has loss, mask, resp_w and trans_w.
    """
    per = rows.where("mask >= 1").groupBy("mask").agg(weighted_mean(F.col("loss"), F.when(F.col("mask") == 1, F.col("resp_w")).otherwise(F.col("trans_w"))).alias("m"))
    r, t = F.coalesce(F.avg(F.when(F.col("mask") == 1, F.col("m"))), F.lit(0.0)), F.coalesce(F.avg(F.when(F.col("mask") >= 2, F.col("m"))), F.lit(0.0))
    return per.agg(F.round(r, 6).alias("response"), F.round(t, 6).alias("transition"), F.round(r + t, 6).alias("total"))


def token_loss(rows: DataFrame, resp: str = "loss", trans: str = "loss") -> DataFrame:
    """One row: weighted means over all weighted tokens, of responses, of control tokens, and their sum."""
    w = F.when(F.col("mask") == 1, F.col("resp_w")).otherwise(F.col("trans_w"))
    total = F.greatest(F.sum(w), F.lit(1e-9))
    r = F.sum(F.when(F.col("mask") == 1, F.col(resp) * w).otherwise(0.0)) / total
    t = F.sum(F.when(F.col("mask") >= 2, F.col(trans) * w).otherwise(0.0)) / total
    return rows.where("mask >= 1").agg(F.round(r, 6).alias("response"), F.round(t, 6).alias("transition"), F.round(r + t, 6).alias("total"))


def all_adjusted_loss(rows: DataFrame) -> DataFrame:
    """One row: plain means of weighted losses, of responses and of control tokens, not divided by the weights."""
    r = F.coalesce(F.avg(F.when(F.col("mask") == 1, F.col("loss") * F.col("resp_w"))), F.lit(0.0))
    t = F.coalesce(F.avg(F.when(F.col("mask") >= 2, F.col("loss") * F.col("trans_w"))), F.lit(0.0))
    return rows.agg(F.round(r, 6).alias("response"), F.round(t, 6).alias("transition"), F.round(r + t, 6).alias("total"))
