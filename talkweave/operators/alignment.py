"""Text aligned to other text: pieces by word counts, punctuation put back, letters spoken so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.text import let


def split_at_counts(text: Column, counts: Column) -> Column:
    """A text cut after the given numbers of words, blanks staying with the piece before them.

    The whole text is one piece if the counts do not add up to its words.
    """
    def cut(chunks: Column) -> Column:
        ends = F.aggregate(counts, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        pieces = F.transform(counts, lambda n, i: F.array_join(F.slice(chunks, F.get(ends, i) + 1, n), ""))
        return F.when(F.aggregate(counts, F.lit(0), lambda a, n: a + n) == F.size(chunks), pieces).otherwise(F.array(text))

    return let(F.regexp_extract_all(text, F.lit(r"(^\s*\S+\s*|\S+\s*)"), 1), cut)


def with_punctuation(rows: DataFrame, keys: list[str], order: str, text: str, restored: str) -> DataFrame:
    """Words of a restored text given back to the rows they came from, by running word counts.

    `restored` is the same for all rows of the keys.  Rows keep their own text where the restored
    one has another number of words.
    """
    whole = W.partitionBy(*keys)
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    before = F.coalesce(F.sum("_n").over(whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    counted = rows.withColumn("_n", n).withColumn("_w", F.filter(F.split(restored, r"\s+"), lambda w: w != "")).withColumn("_o", before).withColumn("_t", F.sum("_n").over(whole))
    fits = F.col("_t") == F.size("_w")
    return counted.withColumn(text, F.when(fits, F.array_join(F.slice("_w", F.col("_o") + 1, F.col("_n")), " ")).otherwise(F.col(text))).drop("_n", "_w", "_o", "_t")


def letters_after(text: Column, tokens: Column) -> Column:
    """How many letters of a text are spoken after each token, found in order; blanks behind a token count with it.

    A token that is not found where the search stands leaves the count as it is.
    """
    def step(acc: Column, token: Column) -> Column:
        at = F.element_at(acc, -1)
        rest = F.substring(text, at + 1, F.length(text))
        found = F.instr(rest, token)
        behind = F.substring(rest, found + F.length(token), F.length(rest))
        blanks = F.length(behind) - F.length(F.ltrim(behind))
        return F.concat(acc, F.array(F.when((token != "") & (found > 0), at + found - 1 + F.length(token) + blanks).otherwise(at)))

    return F.aggregate(tokens, F.array(F.lit(0)), step, lambda acc: F.slice(acc, 2, F.size(tokens)))


def reason_of(task_id: Column) -> Column:
    """The third part of a probe's id, "unknown" if it has fewer."""
    parts = F.split(task_id, "_")
    return F.when(F.size(parts) > 2, parts[2]).otherwise("unknown")


def evaluation_mode(task: Column) -> Column:
    """The kind of evaluation a benchmark task is scored by; null for a task that is not known."""
    # Names of tasks and of their evaluations.
    return (
        F.when(task.isin("candor_pause_handling", "synthetic_pause_handling"), "pause_handling").when(task == "candor_turn_taking", "smooth_turn_taking")
        .when(task == "icc_backchannel", "backchannel").when(task == "synthetic_user_interruption", "user_interruption")
    )
