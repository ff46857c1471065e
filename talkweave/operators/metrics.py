"""Evaluation: word errors, classification counts, interruption outcomes, and score roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.text import let, words

# Common English contractions, expanded in this order before words are compared.
CONTRACTIONS = [
    (r"won't", "will not"), (r"can't", "can not"), (r"let's", "let us"), (r"n't", " not"), (r"'re", " are"), (r"'s", " is"),
    (r"'d", " would"), (r"'ll", " will"), (r"'t", " not"), (r"'ve", " have"), (r"'m", " am"),
]


def comparable(text: Column) -> Column:
    """Lower case, contractions expanded, punctuation of any script dropped (symbols such as $ + < = > stay), single blanks."""
    t = reduce(lambda c, x: F.regexp_replace(c, x[0], x[1]), CONTRACTIONS, F.lower(text))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\p{P}", ""))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Edit distance in words.

    Each different word of the two texts becomes one character, so the distance of the texts in
    words is the JVM's distance of two strings.  Characters are those of U+3400 to U+D7FF and of
    the planes from U+10000 on; texts of more different words than there are (over a million) are an error.
    """
    def spelt(ws: Column, vocabulary: Column) -> Column:
        place = F.map_from_entries(F.transform(vocabulary, lambda w, i: F.struct(w, i)))
        code = lambda n: F.when(n >= 0x110000, F.raise_error(F.lit("too many different words"))).otherwise(n)
        char = lambda i: F.decode(F.unhex(F.lpad(F.hex(code(F.when(i + 0x3400 < 0xD800, i + 0x3400).otherwise(i + 0x5C00)).cast("long")), 8, "0")), "UTF-32")
        return let(place, lambda m: F.array_join(F.transform(ws, lambda w: char(F.try_element_at(m, w))), ""))

    both = F.struct(words(comparable(reference)).alias("r"), words(comparable(hypothesis)).alias("h"))
    distance = lambda x: let(F.array_distinct(F.concat(x.r, x.h)), lambda v: F.levenshtein(spelt(x.r, v), spelt(x.h, v)))
    return let(both, distance)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Errors per reference word; null without reference words."""
    return F.try_divide(word_errors(reference, hypothesis).cast("double"), F.size(words(comparable(reference))))


def error_summary(rates: DataFrame, rate: str = "wer", most: float = 0.3, outlier: float = 1.2) -> DataFrame:
    """One row: counts and means of all, good and bad texts, the median of the rates at six places, and outliers.

    The median comes from counts of equal rates, so it is exact and no task holds all rates.
    """
    c, bad = F.col(rate), F.col(rate) > most
    per = rates.where(c.isNotNull()).groupBy(F.round(c, 6).alias("r")).agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(0))  # as many rows as there are different rates
    upto, n = F.sum("n").over(whole.orderBy("r").rowsBetween(W.unboundedPreceding, 0)), F.sum("n").over(whole)
    ranked = per.select("r", "n", upto.alias("upto"), n.alias("all"))
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    median = ranked.agg(((F.max(F.when(holds(low), F.col("r"))) + F.max(F.when(holds(high), F.col("r")))) / 2).alias("m"))
    return rates.agg(
        F.count(c).alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(c > outlier).alias("n_outliers"),
        F.round(F.avg(c), 9).alias("mean"), F.round(F.avg(F.when(~bad, c)), 9).alias("mean_good"), F.round(F.avg(F.when(bad, c)), 9).alias("mean_bad"),
        F.round(F.try_divide(F.count_if(bad).cast("double"), F.count(c)), 9).alias("share_bad"),
    ).withColumn("median", F.round(median.scalar(), 9))


def confusion(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Long form: true, pred, n and n as a share of its true class."""
    counts = rows.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("true")), 9))


def confusion_wide(counts: DataFrame, classes: list) -> DataFrame:
    """One row per true class, a column of counts per predicted class."""
    return counts.groupBy("true").pivot("pred", classes).agg(F.coalesce(F.sum("n"), F.lit(0))).na.fill(0)


def class_counts(rows: DataFrame, keys: list[str], classes: list[int]) -> DataFrame:
    """Per key and class: tp, fp, fn.

    `rows` has mask (0: not counted), label and pred, both classes; a row is a hit of its own class
    or a miss of it, and a false hit of the class predicted, unless that is its own.
    """
    own = F.struct(F.col("mask").alias("class"), (F.col("label") == F.col("pred")).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col("label") != F.col("pred")).cast("int").alias("fn"))
    other = F.struct(F.col("pred").alias("class"), F.lit(0).alias("tp"), (F.col("pred") != F.col("mask")).cast("int").alias("fp"), F.lit(0).alias("fn"))
    each = rows.where("mask <> 0").select(*keys, F.explode(F.array(own, other)).alias("x")).select(*keys, "x.*")
    return each.where(F.col("class").isin(classes)).groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_f1(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; a ratio without a base is 0."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(_ratio(2 * p * r, p + r), 9).alias("f1"))


def macro(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Plain means over classes."""
    return scores.groupBy(*keys).agg(*[F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1")])


def acted(kind: Column, response: Column) -> Column:
    """Whether the model acted: MiU by anything but listening on, UiM by yielding the floor."""
    return F.when(kind == "MiU", response != "[C.LISTEN]").otherwise(response.startswith("[S.LISTEN"))


def outcomes(probes: DataFrame) -> DataFrame:
    """Per dialogue: kind, hits before its last target, a hit at it, misses, and the one outcome mid, end or miss.

    `probes` has id, kind, target and response.
    """
    last = F.max("target").over(W.partitionBy("id"))
    hit = acted(F.col("kind"), F.col("response"))
    return (
        probes.select("id", "kind", "target", hit.alias("hit"), (F.col("target") == last).alias("at_end"))
        .groupBy("id", "kind")
        .agg(
            F.count_if(F.col("hit") & ~F.col("at_end")).alias("mid_hit"), F.count_if(F.col("hit") & F.col("at_end")).alias("end_hit"), F.count_if(~F.col("hit")).alias("miss"),
            F.min(F.when(F.col("hit"), F.col("target"))).alias("first_hit"),
        )
        .withColumn("outcome", F.when(F.col("mid_hit") > 0, "mid").when(F.col("end_hit") > 0, "end").otherwise("miss"))
    )


def interruption_metrics(dialogues: DataFrame, judged: DataFrame) -> DataFrame:
    """name, value: rates of outcomes, mean judge scores, and precision, recall and F1 of interruptions by the machine.

    `judged` has id, kind, reason, at_end, score and content.
    """
    rates = dialogues.groupBy("kind").agg(*[(F.count_if(F.col("outcome") == o) / F.count("*")).alias(o) for o in ("mid", "end", "miss")])
    mid = (F.col("kind") == "MiU") & ~F.col("at_end")
    means = judged.agg(F.coalesce(F.avg(F.when(mid, F.col("score"))), F.lit(0.0)).alias("pir"), F.avg(F.when(mid, F.col("content"))).alias("prr"), F.avg(F.when(F.col("kind") == "UiM", F.col("score"))).alias("uim"))
    rates = rates.select("*", *[means.select(n).scalar().alias(n) for n in ("pir", "prr", "uim")])
    p, r = F.col("pir") * F.col("mid") + F.col("end"), 1 - F.col("miss")
    is_miu = F.col("kind") == "MiU"
    named = rates.select(
        F.explode(
            F.array(
                F.struct(F.concat("kind", F.lit("_ir_mid")).alias("name"), F.col("mid").alias("value")),
                F.struct(F.concat("kind", F.lit("_ir_end")).alias("name"), F.col("end").alias("value")),
                F.struct(F.concat("kind", F.lit("_MIR")).alias("name"), F.col("miss").alias("value")),
                F.struct(F.when(is_miu, "MiU_PIR_mid").otherwise("UiM_PRR_avg").alias("name"), F.when(is_miu, F.col("pir")).otherwise(F.col("uim")).alias("value")),
                F.struct(F.when(is_miu, "MiU_PRR_mid").alias("name"), F.col("prr").alias("value")),
                F.struct(F.when(is_miu, "MiU_Precision").alias("name"), p.alias("value")),
                F.struct(F.when(is_miu, "MiU_Recall").alias("name"), r.alias("value")),
                F.struct(F.when(is_miu, "MiU_F1").alias("name"), _ratio(2 * p * r, p + r).alias("value")),
            )
        ).alias("m")
    ).select("m.*").where("name IS NOT NULL AND value IS NOT NULL")
    reasons = judged.where("kind = 'UiM' AND score IS NOT NULL").groupBy(F.concat(F.lit("UiM_PRR_"), "reason").alias("name")).agg(F.avg("score").alias("value"))
    return named.unionByName(reasons).select("name", F.round("value", 9).alias("value"))


def rolled_up(scores: DataFrame, subset: str, score: str) -> DataFrame:
    """Mean score per subset, a rate of advbench as a percentage, and overall, the mean of the subsets present."""
    per = scores.groupBy(subset).agg(F.avg(score).alias("score")).select(subset, F.when(F.col(subset) == "advbench", F.col("score") * 100).otherwise(F.col("score")).alias("score"))
    return per.unionByName(per.agg(F.lit("overall").alias(subset), F.avg("score").alias("score"))).select(subset, F.round("score", 6).alias("score"))


def generation_cost(rows: DataFrame, tokens_in: str, tokens_out: str, price_in: float = 10.0, price_out: float = 30.0) -> DataFrame:
    """Tokens of both directions and their cost at prices per million."""
    return rows.agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out")).select(
        "tokens_in", "tokens_out", F.round(F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out, 9).alias("cost")
    )
