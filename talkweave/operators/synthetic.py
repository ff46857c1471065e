"""Generated dialogues: parameters of tasks, parsing of raw responses, and their tapes and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from talkweave.functions.vocab import INTERLOCUTOR, SILENCE, TRANSITIONS
from talkweave.operators.chat import clause_tape

UNFINISHED = "<NOT_FINISHED>"


def reasoning_split(text: Column) -> Column:
    """struct(reasoning, response) around the first </think>; all is response without one."""
    parts = F.split(text, "</think>", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(F.replace(parts[0], F.lit("<think>"), F.lit(""))).alias("reasoning"), F.trim(parts[1]).alias("response"))).otherwise(
        F.struct(F.lit("").alias("reasoning"), F.trim(text).alias("response"))
    )


def clean_response(text: Column) -> Column:
    """A generation up to the first token that stops speaking, without other control tokens."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"(?s)\[S\.LISTEN.*$", "")), r"\[(?:C\.LISTEN|C\.SPEAK|S\.SPEAK)\]", "")


def from_first_token(text: Column) -> Column:
    """A generation from its first control token on, the whole of it if there is none."""
    found = F.regexp_extract(text, r"(?s)(\[(?:C\.LISTEN|C\.SPEAK|S\.SPEAK|S\.LISTEN\.INTERRUPT|S\.LISTEN\.NATURAL)\].*)$", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def tape_prompt(segments: Column, system: Column, user: str = "<user>") -> Column:
    """System text, heard segments joined by waiting, and the cue to speak; leading silences are left out."""
    first = F.array_position(F.transform(segments, lambda x: x != SILENCE), True)
    kept = F.when(first > 0, F.slice(segments, first.cast("int"), F.size(segments))).otherwise(F.array().cast("array<string>"))
    return F.concat(system, F.lit(user), F.array_join(kept, f"[C.LISTEN]{user}"), F.lit("[S.SPEAK]"))


def tape_context(tape: Column, upto: Column, user: str = "<user>") -> Column:
    """The text of a tape before index `upto`, with the prefix of training."""
    return F.replace(F.array_join(F.slice(tape, 1, upto), ""), F.lit(INTERLOCUTOR), F.lit(user))


def filled_in(template: Column, values: dict[str, Column]) -> Column:
    """A template with {{NAME}} replaced."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), v)
    return template


def hashed(key: Column, seed: int, k: int) -> Column:
    """A number below 2**32 by md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed), F.lit(k))), 1, 8), 16, 10).cast("long")


def task_parameters(spark: SparkSession, n: int, topics: list[str], seed: int = 42, fewest: int = 3, most: int = 8) -> DataFrame:
    """Tasks with a number of rounds, two different rounds for events, and a topic, all from a hash of the task's number."""
    h = lambda k: hashed(F.col("id"), seed, k)
    rounds = (F.lit(fewest) + F.pmod(h(0), F.lit(most - fewest + 1))).cast("int")
    shuffled = F.array_sort(F.transform(F.sequence(F.lit(1), F.col("rounds")), lambda r: F.struct(F.md5(F.concat_ws("|", r, "id", F.lit(seed + 1))).alias("h"), r.alias("r"))))
    return (
        spark.range(n)
        .withColumn("rounds", rounds)
        .withColumn("topic", F.element_at(F.array(*map(F.lit, topics)), (F.pmod(h(1), F.lit(len(topics))) + 1).cast("int")))
        .withColumn("events", F.array_sort(F.transform(F.slice(shuffled, 1, 2), lambda x: x.r)))
        .select(F.format_string("task_%d", "id").alias("task_id"), "rounds", "topic", "events")
    )


def silence_counts(key: Column, low: int, high: int, shape: str = "uniform", seed: int = 42) -> Column:
    """A seeded number of silences from low to high: uniform, triangular (peak at low) or gaussian about the middle."""
    u = lambda k: (hashed(key, seed, k) + 0.5) / float(1 << 32)
    if shape == "uniform":
        x = F.floor(low + u(0) * (high - low + 1))
    elif shape == "triangular":
        x = F.floor(high - F.sqrt((1 - u(0)) * (high - low) ** 2))
    else:
        x = F.floor((low + high) / 2 + F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * 3.141592653589793 * u(1)) * (high - low) / 4)
    return F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("int")


def parsed_test(records: DataFrame, machine_interrupts: bool) -> DataFrame:
    """Raw responses of USER: and ASSISTANT: lines as turns: task_id, turn, role, value.

    A last turn said twice counts once.  Kept are alternating dialogues that end as their kind must:
    if the machine interrupts, with its turn, which is dropped; else with the user, after a turn of
    the machine that is marked as not finished (an ellipsis is such a mark).
    """
    line = r"^(?:\*\*)?(USER|ASSISTANT):(?:\*\*)?(.*)$"
    turns = (
        records.select("task_id", F.posexplode(F.split("raw_response", "\n")).alias("pos", "line"))
        .where(F.col("line").rlike(line))
        .select("task_id", "pos", F.lower(F.regexp_extract("line", line, 1)).alias("role"), F.trim(F.regexp_extract("line", line, 2)).alias("value"))
    )
    order = W.partitionBy("task_id").orderBy("pos")
    said_twice = F.lead("pos").over(order).isNull() & (F.lag("role").over(order) == F.col("role")) & (F.lag("value").over(order) == F.col("value"))
    once = turns.withColumn("twice", F.coalesce(said_twice, F.lit(False))).withColumn("lines", F.count("*").over(W.partitionBy("task_id"))).where("NOT twice AND lines > 1")
    whole = W.partitionBy("task_id")
    placed = once.select(
        "task_id", "role", "value", "pos",
        (F.row_number().over(order) - 1).alias("turn"), F.count("*").over(whole).alias("n"),
        (F.lag("role").over(order) == F.col("role")).alias("same"),
    )
    if not machine_interrupts:
        cut = (F.col("turn") == F.col("n") - 2) & F.col("value").endswith("...")
        placed = placed.withColumn("value", F.when(cut, F.concat(F.expr("substring(value, 1, length(value) - 3)"), F.lit(UNFINISHED))).otherwise(F.col("value")))
    checked = placed.withColumn("bad", F.max(F.coalesce("same", F.lit(False))).over(whole)).withColumn("last_role", F.max_by("role", "turn").over(whole))
    checked = checked.withColumn("cut", F.max((F.col("turn") == F.col("n") - 2) & F.col("value").contains(UNFINISHED)).over(whole))
    kept = checked.where(~F.col("bad"))
    kept = kept.where("last_role = 'assistant' AND turn < n - 1") if machine_interrupts else kept.where("last_role = 'user' AND cut")
    return kept.select("task_id", F.col("turn").cast("int").alias("turn"), "role", "value")


def parsed_train(records: DataFrame) -> DataFrame:
    """Raw responses of training dialogues as turns: the first User: line, then Content: lines of either side; an ellipsis marks a turn as not finished."""
    lines = records.select("task_id", F.posexplode(F.split("raw_response", "\n")).alias("pos", "raw")).select("task_id", "pos", F.trim("raw").alias("line"))
    first = r"^User:(.*)$"
    content = r"^(User|Assistant) Content:(.*)$"
    kind = F.when(F.col("line").rlike(first), "opening").when(F.col("line").rlike(content), "content")
    order = W.partitionBy("task_id").orderBy("pos")
    turns = lines.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("k", F.row_number().over(order)).where("kind = 'content' OR k = 1")
    value = F.trim(F.when(F.col("kind") == "opening", F.regexp_extract("line", first, 1)).otherwise(F.regexp_extract("line", content, 2)))
    role = F.when(F.col("kind") == "opening", "user").otherwise(F.lower(F.regexp_extract("line", content, 1)))
    marked = F.when(value.endswith("..."), F.concat(F.regexp_replace(value, r"\.\.\.$", ""), F.lit(UNFINISHED))).otherwise(value)
    return turns.select("task_id", (F.row_number().over(order) - 1).cast("int").alias("turn"), role.alias("role"), marked.alias("value"))


def _gathered(turns: DataFrame, part: Column) -> DataFrame:
    return turns.select("task_id", "turn", part.alias("t")).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("l"))


def test_tapes(turns: DataFrame, machine_interrupts: bool) -> DataFrame:
    """Tapes of parsed tests with the places at which a model is asked: task_id, tape, eval_targets (tokens of the last turn)."""
    n = F.count("*").over(W.partitionBy("task_id"))
    heard, said = clause_tape(F.col("value"), True), clause_tape(F.replace(F.col("value"), F.lit(UNFINISHED), F.lit("")), False)
    last = F.col("turn") == F.col("n") - 1
    is_token = lambda t: t.isin(TRANSITIONS)
    pinned = F.transform(heard, lambda t: F.when(is_token(t), F.lit("[C.SPEAK]")).otherwise(t))
    if machine_interrupts:
        user = F.concat(heard, F.array(F.lit("[S.SPEAK]")))
        own = F.concat(said, F.array(F.lit("[S.LISTEN.NATURAL]")))
    else:
        user = F.when(last, F.concat(pinned, F.array(F.lit("[C.SPEAK]")))).otherwise(F.concat(heard, F.array(F.lit("[S.SPEAK]"))))
        cut = (F.col("turn") == F.col("n") - 2) & F.col("value").endswith(UNFINISHED)
        own = F.when(cut, said).otherwise(F.concat(said, F.array(F.lit("[S.LISTEN.NATURAL]"))))
    part = F.when(F.col("role") == "user", user).otherwise(own)
    whole = _gathered(turns.withColumn("n", n), part).select("task_id", F.flatten(F.transform("l", lambda x: x.t)).alias("tape"), F.size(F.element_at("l", -1).t).alias("tail"))
    places = F.filter(F.transform("tape", lambda t, i: F.when(is_token(t) & (i >= F.size("tape") - F.col("tail")), i)), lambda i: i.isNotNull())
    return whole.where(F.size("tape") > 0).select("task_id", "tape", places.alias("eval_targets"))


def train_tapes(turns: DataFrame) -> DataFrame:
    """Tapes of parsed training dialogues: task_id, tape.

    A user turn after an unfinished turn of the machine interrupts it: the machine goes on speaking
    if its next turn goes on with the sentence (lower case or a mark of continuation), else it yields.
    """
    order = W.partitionBy("task_id").orderBy("turn")
    bare = F.trim(F.replace(F.col("value"), F.lit(UNFINISHED), F.lit("")))
    open_ = F.col("value").contains(UNFINISHED)
    cut_before = (F.lag("role").over(order) == "assistant") & F.lag(open_).over(order)
    next_text = F.when(F.lead("role").over(order) == "assistant", F.lead(bare).over(order))
    goes_on = next_text.rlike(r"^[\p{Ll},;:.\-]") | F.regexp_extract(next_text, r"^\P{L}*(\p{L})", 1).rlike(r"^\p{Ll}")
    rows = turns.select("task_id", "turn", "role", bare.alias("value"), open_.alias("open"), F.coalesce(cut_before, F.lit(False)).alias("interrupts"), F.coalesce(goes_on, F.lit(False)).alias("goes_on"))
    heard, said = clause_tape(F.col("value"), True), clause_tape(F.col("value"), False)
    one = lambda *x: F.array(*map(F.lit, x))
    # entries stand at even places, tokens between them; the first token yields, the rest keep waiting
    speaking = F.concat(F.transform(heard, lambda t, i: F.when(i % 2 == 1, F.lit("[C.SPEAK]")).otherwise(t)), one("[C.SPEAK]"))
    yielding = F.when(F.size(heard) > 1, F.concat(F.transform(heard, lambda t, i: F.when(i == 1, F.lit("[S.LISTEN.INTERRUPT]")).otherwise(t)), one("[S.SPEAK]"))).otherwise(F.concat(heard, one("[S.LISTEN.INTERRUPT]", SILENCE, "[S.SPEAK]")))
    user = F.when(F.col("interrupts") & F.col("goes_on"), speaking).when(F.col("interrupts"), yielding).otherwise(F.concat(heard, one("[S.SPEAK]")))
    own = F.when(F.col("open"), said).otherwise(F.concat(said, one("[S.LISTEN.NATURAL]")))
    part = F.when(F.col("role") == "user", user).otherwise(own)
    return _gathered(rows, part).select("task_id", F.flatten(F.transform("l", lambda x: x.t)).alias("tape")).where(F.size("tape") > 0)
