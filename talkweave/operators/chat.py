"""Chats: rules that keep or reject turns and conversations, and their serialisation to tapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.html import tags_to_lines
from talkweave.functions.text import BLANK, has_cjk, is_meaningful, stripped
from talkweave.functions.vocab import INTERLOCUTOR, SILENCE

MARK = "\u0001"


def first_turns(turns: DataFrame) -> DataFrame:
    """One row per (id, turn), the first delivery: id, turn, role, value; null roles and values become empty."""
    first = turns.groupBy("id", "turn").agg(F.min_by(F.struct("role", "value"), "ingested_at").alias("r"))
    return first.select("id", "turn", F.coalesce("r.role", F.lit("")).alias("role"), F.coalesce("r.value", F.lit("")).alias("value"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def too_long(text: Column, most_words: int, most_chars: int) -> Column:
    """'cjk' or 'en' if the text is longer than its kind of writing may be, else null."""
    cjk = has_cjk(text)
    return F.when(cjk & (F.length(text) > most_chars), "cjk").when(~cjk & (F.size(words(text)) > most_words), "en")


def code_reason(text: Column) -> Column:
    """Why a text looks like code: marks of copied code, or more than a quarter code symbols; else null."""
    symbols = F.length(text) - F.length(F.translate(text, "{}[]<>=;\\_", ""))
    return F.when(text.contains("Copy code") | text.contains("css\n"), "code_artifact").when(F.try_divide(symbols, F.length(text)) > 0.25, "high_symbol_density")


def gibberish_reason(text: Column) -> Column:
    """Why a text is gibberish: few different characters (CJK), long words on average, one long word; else null."""
    w = words(text)
    letters = F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    return (
        F.when(has_cjk(text), F.when((F.length(text) > 20) & (F.size(F.array_distinct(F.split(text, ""))) < 5), "repetitive_chinese"))
        .when(F.size(w) == 0, "empty")
        .when(letters / F.size(w) > 25, "high_avg_word_len")
        .when((F.size(w) == 1) & (letters > 25), "single_long_word")
    )


def turn_reasons(turns: DataFrame) -> DataFrame:
    """Adds why: the first rule a turn breaks, null if none; the order of the rules matters.

    The rules see the text of a turn as html_to_text gives it, so a turn of markup alone is empty; value stays as it is.
    """
    t = F.col("_t")
    why = F.coalesce(
        F.when(t == "", "empty"),
        F.when(~t.rlike(r"[\p{L}\p{N}]"), "only_symbols"),
        code_reason(t),
        F.when(t.contains("```"), "contains_markdown_code"),
        F.when(t.rlike(r"\$|\\frac|\\sum|\\int|\\sqrt"), "contains_math"),
        F.concat(too_long(t, 400, 600), F.lit("_too_long")),
        gibberish_reason(t),
        F.when(t.startswith("System\nYou are") | t.startswith("User\n"), "prompt_leakage"),
    )
    return turns.withColumn("_t", html_to_text(F.col("value"))).withColumn("why", why).drop("_t")


def spoken_reason(text: Column) -> Column:
    """Why a turn can't be spoken: too long, a list, or marks of layout; else null."""
    long = too_long(text, 100, 150)
    listed = text.contains(" - ") | text.contains("(a)") | text.contains("(1)") | text.contains("1. ")
    return F.when(long.isNotNull(), F.concat(long, F.lit(" exceed length limit"))).when(listed, "contain list").when(text.contains("**"), "markdown format")


def role_kind(role: Column) -> Column:
    """user, system, or bot for anything else."""
    # Names of roles.
    r = F.lower(role)
    return F.when(r.isin("human", "user", "用户"), "user").when(r == "system", "system").otherwise("bot")


def _with_wrong(turns: DataFrame) -> DataFrame:
    """Adds wrong: how a turn's role breaks the order of its conversation."""
    order = W.partitionBy("id").orderBy("turn")
    kind = role_kind(F.col("role"))
    talk = F.when(kind != "system", kind)
    last = F.last(talk, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    wrong = (
        F.when((kind == "system") & F.lag("turn").over(order).isNotNull(), "system_prompt_in_middle")
        .when(talk.isNotNull() & last.isNull() & (talk != "user"), "start_with_bot")
        .when(talk == last, F.concat(F.lit("consecutive_"), talk))
    )
    return turns.withColumn("wrong", wrong)


def _first(column: str) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("turn")))


def structure_reasons(turns: DataFrame) -> DataFrame:
    """Per conversation: the first way in which its roles do not alternate from the user on, null if they do."""
    return _with_wrong(turns).groupBy("id").agg(_n_roles().alias("roles"), _first("wrong").alias("wrong")).select("id", _structure().alias("reason"))


def _n_roles() -> Column:
    return F.size(F.collect_set(F.when(F.lower("role") != "system", F.lower("role"))))


def _structure() -> Column:
    return F.when(F.col("roles") < 2, "single_role").otherwise(F.col("wrong"))


def dialogue_reasons(turns: DataFrame) -> DataFrame:
    """Per conversation why it is rejected, and the class of the reason: its structure, else its first bad turn; null if it is kept."""
    both = turn_reasons(_with_wrong(turns)).groupBy("id").agg(_n_roles().alias("roles"), _first("wrong").alias("wrong"), _first("why").alias("why"))
    return both.select("id", F.coalesce(F.concat(F.lit("Structure: "), _structure()), F.concat(F.lit("Content: "), "why")).alias("reason"))


def top_and_other(counts: DataFrame, name: str, n: str, k: int) -> DataFrame:
    """The k most frequent names, ties by name, and the rest together as Other.

    The k names are a top-k of all rows, so no task sees more than k of each partition.
    """
    top = counts.orderBy(F.desc(n), name).limit(k).select(F.col(name).alias("top_name"))
    marked = counts.join(F.broadcast(top), F.col(name) == F.col("top_name"), "left")
    return marked.groupBy(F.coalesce("top_name", F.lit("Other")).alias(name)).agg(F.sum(n).alias(n))


def html_to_text(text: Column) -> Column:
    """List items as dashed lines, other tags as line ends, references as their characters, at most one blank line; null for null.

    A "<" that begins no tag stays; comments, scripts and styles are no text.
    """
    t = F.replace(F.replace(F.replace(text, F.lit("<li><p>"), F.lit("<li>")), F.lit("<li>"), F.lit("\n- ")), F.lit("</li>"), F.lit(""))
    return stripped(F.regexp_replace(tags_to_lines(t), r"\n{3,}", "\n\n"))


def clauses(text: Column) -> Column:
    """Sentences cut after . ! ? and clauses after , ; : before a blank, or after the Chinese marks; only those with content."""
    t = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"([.!?]+\s+)", f"$1{MARK}")
    t = F.regexp_replace(t, r"([,;:])(\s|$)", f"$1{MARK}$2")
    t = F.regexp_replace(t, r"([。！？，；：、])", f"$1{MARK}")
    return F.filter(F.split(t, MARK), lambda c: is_meaningful(c))


def clause_tape(text: Column, interlocutor: bool) -> Column:
    """Clauses as tape entries with the continuation token between them."""
    token = F.lit("[C.LISTEN]" if interlocutor else "[C.SPEAK]")
    entry = (lambda c: F.concat(F.lit(INTERLOCUTOR), c)) if interlocutor else (lambda c: stripped(c))
    return F.flatten(F.transform(clauses(text), lambda c, i: F.when(i == 0, F.array(entry(c))).otherwise(F.array(token, entry(c)))))


def chat_tapes(turns: DataFrame, view: str, silences: Column) -> DataFrame:
    """The tape of each conversation seen by `view` ('assistant' or 'user'): id, tape.

    `silences` says how many silence tokens stand before a turn of the other side.  System turns are
    left out; a conversation is gathered turn by turn, so its tape is as long as its text.
    """
    kind = role_kind(F.col("role"))
    other = "user" if view == "assistant" else "bot"
    heard = F.concat(F.flatten(F.array_repeat(F.array(F.lit(INTERLOCUTOR + SILENCE), F.lit("[C.LISTEN]")), silences)), clause_tape(F.col("value"), True))
    said = clause_tape(F.col("value"), False)
    if view == "assistant":
        tape = F.when(kind == other, F.concat(heard, F.array(F.lit("[S.SPEAK]")))).otherwise(F.concat(said, F.array(F.lit("[S.LISTEN.NATURAL]"))))
    else:
        tape = F.when(kind == other, heard).otherwise(F.concat(F.array(F.lit("[S.SPEAK]")), said, F.array(F.lit("[S.LISTEN.NATURAL]"))))
    return (
        turns.where(kind != "system")
        .select("id", "turn", tape.alias("t"))
        .groupBy("id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x.t)).alias("tape"))
        .where(F.size("tape") > 0)
    )


def consistency(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per conversation: Passed, Filtered (nothing came back), or how the output differs in turns or roles."""
    i = inputs.select("id", "turn", F.col("role").alias("in_role"))
    o = outputs.select("id", "turn", F.col("role").alias("out_role"), F.lit(1).alias("there"))
    each = i.join(o, ["id", "turn"], "full")
    return each.groupBy("id").agg(
        F.count("in_role").alias("n_in"), F.count("there").alias("n_out"),
        F.min(F.when(F.col("in_role") != F.col("out_role"), F.col("turn"))).alias("first_wrong"),
    ).select(
        "id",
        F.when(F.col("n_in") == 0, "unknown").when(F.col("n_out") == 0, "filtered").when(F.col("n_in") != F.col("n_out"), "turn_count").when(F.col("first_wrong").isNotNull(), "role").otherwise("passed").alias("outcome"),
        "first_wrong",
    )
