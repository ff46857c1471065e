"""Tapes: labelled segments and their words as one sequence of control tokens and text, and its checks."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.durable import checkpointed
from talkweave.functions.text import let
from talkweave.functions.vocab import INTERLOCUTOR, SILENCE, SILENCE_S, STOP_SPEAKING, TRANSITIONS, UNITS
from talkweave.operators.blocks import beside, latest, matched, numbered, past
from talkweave.operators.timeline import BLOCK, CALL, FIRST_SCENE, SCENE, clipped_once, event_segments, floor_holders, scenes, words_in_segments

LISTEN_ON, SPEAK_ON, SPEAK = "[C.LISTEN]", "[C.SPEAK]", "[S.SPEAK]"


@dataclass(frozen=True)
class Rule:
    """How a segment is written: a lead token, own words, then heard words with `join` between them."""

    lead: str = ""
    own: bool = False
    heard: bool = True
    join: str = LISTEN_ON
    no_silence: bool = False
    tail: str = ""
    stop: str = ""  # takes the place of the first [C.LISTEN]
    lead_if: str = "always"  # or "heard", or "unless_token" (the tape does not end in a token already)


#: By label and the party concerned: the initiator, for P and G the floor holder (2: nobody yet).
RULES = {
    ("T", 1): Rule(SPEAK, own=True, heard=False),
    ("P", 0): Rule(LISTEN_ON, lead_if="heard"),
    ("P", 1): Rule(heard=False),
    ("G", 0): Rule(LISTEN_ON),
    ("G", 1): Rule("[S.LISTEN.NATURAL]"),
    ("G", 2): Rule(),
    ("IF", 0): Rule(SPEAK_ON, own=True, tail=LISTEN_ON, stop="[S.LISTEN.INTERRUPT]"),
    ("IF", 1): Rule(SPEAK, own=True, join=SPEAK_ON, no_silence=True),
    ("IB", 0): Rule(SPEAK_ON, own=True, join=SPEAK_ON, no_silence=True),
    ("BC", 0): Rule(SPEAK_ON, own=True, join=SPEAK_ON, no_silence=True),
    ("IB", 1): Rule(SPEAK, own=True, no_silence=True, tail=LISTEN_ON, stop="[S.LISTEN.INTERRUPT]"),
    ("BC", 1): Rule(SPEAK, own=True, no_silence=True, tail=LISTEN_ON, stop="[S.LISTEN.NATURAL]"),
    ("C", 0): Rule(LISTEN_ON, lead_if="unless_token"),
    ("C", 1): Rule(SPEAK_ON, own=True, heard=False, lead_if="unless_token"),
}
#: A turn of the interlocutor's: at the call's beginning, after a gap, and else.
TURN_HEARD = {"first": Rule(), "after_gap": Rule(LISTEN_ON), "else": Rule("[S.LISTEN.NATURAL]")}


def rule_of(label: Column, who: Column, floor: Column, before: Column) -> Column:
    """The rule of a segment as a struct, null if none covers it; `before` is the label of the segment before."""
    party = F.when(label.isin("P", "G"), F.coalesce(floor, F.lit(2))).when(who.isNull() & label.isin("IB", "BC"), 1 - floor).otherwise(who)
    shown = lambda r: F.struct(*[F.lit(v).alias(f.name) for f, v in zip(fields(Rule), astuple(r))])
    heard = F.when(before.isNull(), shown(TURN_HEARD["first"])).when(before == "G", shown(TURN_HEARD["after_gap"])).otherwise(shown(TURN_HEARD["else"]))
    out = F.when((label == "T") & (party == 0), heard)
    for (name, k), rule in RULES.items():
        out = out.when((label == name) & (party == k), shown(rule))
    return out


def written(rule: Column, heard: Column, own: Column, after_token: Column) -> Column:
    """The part of a tape that a segment gives; empty if it has no rule.  `after_token`: the tape ends in a switching token."""
    some = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    audible = F.when(rule["heard"], F.filter(heard, lambda w: ~(rule["no_silence"] & w.contains(SILENCE)))).otherwise(none)
    words = F.flatten(F.transform(audible, lambda w, i: F.when(i == 0, F.array(F.concat(F.lit(INTERLOCUTOR), w))).otherwise(F.array(rule["join"], F.concat(F.lit(INTERLOCUTOR), w)))))
    led = (rule["lead"] != "") & ((rule["lead_if"] == "always") | ((rule["lead_if"] == "heard") & (F.size(audible) > 0)) | ((rule["lead_if"] == "unless_token") & ~after_token))
    plain = F.concat(some(led, rule["lead"]), F.when(rule["own"], own).otherwise(none), words, some(rule["tail"] != "", rule["tail"]))
    stopped = let(plain, lambda p: let(F.array_position(p, LISTEN_ON), lambda at: F.transform(p, lambda x, i: F.when((i == at - 1) & (rule["stop"] != ""), rule["stop"]).otherwise(x))))
    return F.when(rule.isNotNull(), stopped).otherwise(none)


def speaks_before(token: Column) -> Column:
    """Whether the agent was speaking when it gave the token."""
    return token.isin(SPEAK_ON, *STOP_SPEAKING)


def met(first: Column, second: Column) -> Column:
    """One token for two that meet: the step from the state before the first to the state after the second."""
    speaks_after = second.isin(SPEAK_ON, SPEAK)
    return (
        F.when(speaks_before(first) & speaks_after, SPEAK_ON).when(speaks_after, SPEAK).when(~speaks_before(first), LISTEN_ON)
        .when(first.isin(STOP_SPEAKING), first).otherwise(second)
    )


def complemented(silences: Column, length: Column) -> Column:
    """The silences heard in a gap or pause, or as many as its length (in units of time) has room for if they are fewer."""
    room = F.floor(length / int(SILENCE_S * UNITS)).cast("int")
    heard = F.size(F.filter(silences, lambda w: w == SILENCE))
    return F.when(room > heard, F.array_repeat(F.lit(SILENCE), room)).otherwise(silences)


TAPE = ["conv_id", "part"]


def _parts(timed: DataFrame, segments: DataFrame, complement: bool) -> DataFrame:
    """What each segment writes: conv_id, part, segment, written.

    Parts of a call are cut after a word of the interlocutor's, the last such place in a scene:
    neither tokens nor clauses nor silences reach over it.
    """
    placed = words_in_segments(timed, segments).where("e > start").groupBy(*SCENE, "start").agg(F.array_sort(F.collect_list(F.struct("s", "seq", "spk", "text"))).alias("w"))
    of = lambda k: F.coalesce(F.transform(F.filter("w", lambda x: x.spk == k), lambda x: x.text), F.array().cast("array<string>"))
    order = W.partitionBy(*SCENE).orderBy("start")
    rows = matched(floor_holders(segments), placed, [*SCENE, "start"]).select(*SCENE, "start", "end", "label", "initiator", "floor", of(0).alias("heard"), of(1).alias("own"))
    if complement:
        rows = rows.withColumn("heard", F.when(F.col("label").isin("P", "G"), complemented(F.col("heard"), F.col("end") - F.col("start"))).otherwise(F.col("heard")))
    # what a segment writes last does not depend on what came before, but for a C without words, which is or follows a token
    rows = rows.withColumn("rule", rule_of(F.col("label"), F.col("initiator"), F.col("floor"), F.lit("?")))
    rows = rows.withColumn("alone", written(F.col("rule"), F.col("heard"), F.col("own"), F.lit(True))).withColumn("last", F.when(F.size("alone") > 0, F.element_at("alone", -1)))
    last, own_words = F.col("last"), F.size(F.when(F.col("initiator") == 1, F.col("own")).otherwise(F.col("heard"))) > 0
    # of a turn heard only the lead depends on the segment before; without words it may write nothing
    silent_turn = F.coalesce((F.col("label") == "T") & (F.col("initiator") == 0) & ~own_words, F.lit(False))
    rows = rows.select(
        *SCENE, "start", "label", "initiator", "floor", "heard", "own",
        F.when((F.col("label") == "C") & F.col("rule").isNotNull(), ~own_words).when(~silent_turn, last.isin(TRANSITIONS)).alias("token_last"),
        silent_turn.alias("silent_turn"), (last.startswith(INTERLOCUTOR) & ~last.contains(SILENCE)).alias("word_last"),
    )
    made = {"_n": F.count("*"), "_label": latest(F.col("label"), F.col("start"))}
    back = past(CALL, "scene")
    near = beside(rows, CALL, "scene", made, {"_before": F.coalesce(F.sum("_n").over(back), F.lit(0)), "_lab": F.lag("_label").over(W.partitionBy("conv_id").orderBy("scene"))})
    rows = near.select(
        "*", F.coalesce(F.lag("label").over(order), F.col("_lab")).alias("before"), (F.col("_before") + F.row_number().over(order) - 1).cast("int").alias("segment")
    ).withColumn("token_last", F.when(F.col("silent_turn") & F.col("before").isNotNull(), F.lit(True)).otherwise(F.col("token_last")))
    made = {"_t": latest(F.col("token_last"), F.col("start")), "_c": F.max(F.when(F.col("word_last"), F.col("start")))}
    seen = {"_token": F.last("_t", ignorenulls=True).over(back), "_cut": F.col("_c"), "_part": F.coalesce(F.last(F.when(F.col("_c").isNotNull(), F.col("scene")), ignorenulls=True).over(back), F.lit(FIRST_SCENE))}
    rows = beside(rows.drop("_before", "_lab", "silent_turn"), CALL, "scene", made, seen)
    after = F.coalesce(F.last("token_last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_token"), F.lit(False))
    ruled = rows.select("*", after.alias("_after"), rule_of(F.col("label"), F.col("initiator"), F.col("floor"), F.col("before")).alias("rule"))
    return ruled.select(
        "conv_id", F.when(F.col("start") > F.col("_cut"), F.col("scene")).otherwise(F.col("_part")).alias("part"), "segment",
        written(F.col("rule"), F.col("heard"), F.col("own"), F.col("_after")).alias("written"),
    )


def _merged(entries: DataFrame) -> DataFrame:
    """Neighbouring switching tokens of different segments as one: conv_id, part, run, token, segment."""
    order = W.partitionBy(*TAPE).orderBy("segment", "i")
    token = F.col("token").isin(TRANSITIONS)
    linked = F.coalesce(token & F.lag("token").over(order).isin(TRANSITIONS) & (F.lag("segment").over(order) != F.col("segment")), F.lit(False))
    listed = F.array_sort(F.collect_list(F.struct("segment", "i", "token")))

    def step(acc: Column, x: Column) -> Column:
        t = met(acc.token, x.token)
        return F.when(t == acc.token, acc).otherwise(F.struct(t.alias("token"), x.segment.alias("segment")))

    return (
        entries.withColumn("run", F.sum((~linked).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*TAPE, "run")
        .agg(listed.alias("l"))
        .select(*TAPE, "run", F.aggregate(F.slice("l", 2, F.size("l")), F.struct(F.col("l")[0].token.alias("token"), F.col("l")[0].segment.alias("segment")), step).alias("x"))
        .select(*TAPE, "run", "x.token", "x.segment")
    )


def _without_gap_silence(entries: DataFrame) -> DataFrame:
    """Drops silences and waiting between what the interlocutor said last and the agent's [S.SPEAK]."""
    quiet = F.col("token").contains(SILENCE) | (F.col("token") == LISTEN_ON)
    loud = F.when(~quiet, F.col("token"))
    order = W.partitionBy(*TAPE).orderBy("run")
    # parts but the first begin after a word of the interlocutor's
    said = F.coalesce(F.last(loud, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.when(F.col("part") != FIRST_SCENE, INTERLOCUTOR), F.lit(""))
    follows = F.last(loud, ignorenulls=True).over(W.partitionBy(*TAPE).orderBy(F.desc("run")).rowsBetween(W.unboundedPreceding, 0))
    dropped = quiet & said.startswith(INTERLOCUTOR) & F.coalesce(follows == SPEAK, F.lit(False))
    return entries.withColumn("_d", dropped).where("NOT _d").drop("_d")


#: After the marks of sentences and clauses.
_CUT = r"(?<=[.!?])\s+|(?<=[,;:])(?=\s)|(?<=[。！？，；：、])"


def _in_clauses(entries: DataFrame) -> DataFrame:
    """Own words joined to running text across single [C.SPEAK], then cut into clauses with [C.SPEAK] between them."""
    own = ~F.col("token").isin(TRANSITIONS) & ~F.col("token").startswith(INTERLOCUTOR)
    order = W.partitionBy(*TAPE).orderBy("run")
    marked = entries.withColumn("own", own)
    between = (F.col("token") == SPEAK_ON) & F.coalesce(F.lag("own").over(order) & F.lead("own").over(order), F.lit(False))
    kept = marked.withColumn("_d", between).where("NOT _d").drop("_d")
    goes_on = F.coalesce(F.col("own") & F.lag("own").over(order), F.lit(False))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "token"))), lambda x: x.token), " ")
    joined = (
        kept.withColumn("span", F.sum((~goes_on).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*TAPE, "span")
        .agg(text.alias("text"), F.first("own").alias("own"), F.min("segment").alias("segment"))
    )
    clauses = F.filter(F.transform(F.split("text", _CUT), lambda c: F.trim(c)), lambda c: c.rlike(r"[^\p{Punct}\s]"))
    spoken = F.flatten(F.transform(clauses, lambda c, i: F.when(i == 0, F.array(c)).otherwise(F.array(F.lit(SPEAK_ON), c))))
    return joined.select(*TAPE, "span", "segment", F.posexplode(F.when(F.col("own"), spoken).otherwise(F.array("text"))).alias("i", "token"))


def call_tapes(words: DataFrame, silences: DataFrame, clip: bool = True, clauses: bool = True, trim_gaps: bool = False, complement: bool = False, block: int = BLOCK) -> DataFrame:
    """The tape of each call, heard by speaker 1: conv_id, pos, token, segment.

    Words, clipped by default, and silences of speaker 0 are placed in the segment they start in, if
    they end after its start.  `complement` adds the silences that fit in a gap or pause where fewer
    were heard.  Segments write their parts, neighbouring tokens become one, silences before the
    agent's turns go if wanted (`trim_gaps`), and own words become clauses.  All windows run within
    parts of a call.  An empty table gives no tapes.
    """
    cols = ["conv_id", "spk", "seq", "text", "s", "e"]
    timed = scenes(words.select(*cols).unionByName(silences.select(*cols)), block)
    timed = clipped_once(timed) if clip else checkpointed(timed)
    segments = checkpointed(event_segments(timed.where(F.col("text") != SILENCE), clip=False))
    entries = _parts(timed, segments, complement).repartition(*TAPE).select(*TAPE, "segment", F.posexplode("written").alias("i", "token"))
    tape = _merged(entries)
    tape = _without_gap_silence(tape) if trim_gaps else tape
    tape = _in_clauses(tape) if clauses else tape
    order = ["span", "i"] if clauses else ["run"]
    return numbered(tape, CALL, "part", order, "_pos").select("conv_id", (F.col("_pos") - 1).cast("int").alias("pos"), "token", "segment")


def first_errors(entries: DataFrame, key: str) -> DataFrame:
    """Per tape the place of its first illegal entry, null if it is legal.

    `entries` has the key, pos and token.  The agent's state before an entry is set by the last
    switching token before it; up to the first error that is the state of the machine.
    """
    order = W.partitionBy(key).orderBy("pos")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    t, before = F.col("token"), F.lag("token").over(order)
    switch = F.when(t == "[S.SPEAK]", "S").when(t.isin(STOP_SPEAKING), "L")
    state = F.coalesce(F.last(switch, ignorenulls=True).over(past), F.lit("L"))
    illegal = (
        (t.isin("[S.SPEAK]", "[C.LISTEN]") & (state != "L"))
        | (t.isin("[C.SPEAK]", *STOP_SPEAKING) & (state != "S"))
        | (t.startswith(INTERLOCUTOR) & F.coalesce(before.startswith(INTERLOCUTOR), F.lit(False)))
        | (t.isin(TRANSITIONS) & F.coalesce(before.isin(TRANSITIONS), F.lit(False)))
    )
    return entries.withColumn("bad", illegal).groupBy(key).agg(F.min(F.when(F.col("bad"), F.col("pos"))).alias("first_bad"))


def first_speakers(entries: DataFrame, key: str) -> DataFrame:
    """Per tape the role it is for: 'assistant' if the interlocutor speaks first, else 'user'; tapes without speech are dropped."""
    speech = entries.where(~F.col("token").isin(TRANSITIONS) & ~F.col("token").contains(SILENCE))
    first = speech.groupBy(key).agg(F.min_by("token", "pos").alias("token"))
    return first.select(key, F.when(F.col("token").startswith(INTERLOCUTOR), "assistant").otherwise("user").alias("role"))


def sample_roles(samples: DataFrame, conversation: str, order: str) -> DataFrame:
    """Roles of the samples of a conversation, of which the first keeps its `role` and the others take turns with it."""
    w = W.partitionBy(conversation).orderBy(order)
    first, odd = F.first("role").over(w.rowsBetween(W.unboundedPreceding, 0)), F.pmod(F.row_number().over(w), F.lit(2)) == 1
    opposite = F.when(first == "assistant", "user").otherwise("assistant")
    return samples.withColumn("_r", F.when(odd, first).otherwise(opposite)).drop("role").withColumnRenamed("_r", "role")


def readable(entries: DataFrame, key: str) -> DataFrame:
    """A tape as text for people, a new line before every switching token."""
    shown = F.when(F.col("token").startswith("[S."), F.concat(F.lit("\n"), F.col("token"))).otherwise(F.col("token"))
    return entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("x")))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x.x), " ").alias("text"))


def unpunctuated(tape):
    """Column: heard entries of a tape array without one closing ASCII punctuation mark."""
    return F.transform(tape, lambda t: F.when(F.trim(t).startswith(INTERLOCUTOR), F.regexp_replace(F.trim(t), r"\p{Punct}$", "")).otherwise(F.trim(t)))


def forced_probe(tape, target):
    """Column: a tape array that yields at index `target` (from 0) and waits from there on, then is asked to speak."""
    n = F.size(tape)
    pinned = F.transform(tape, lambda t, i: F.when(i == target, F.lit("[S.LISTEN.INTERRUPT]")).when((i > target) & t.isin(TRANSITIONS), F.lit("[C.LISTEN]")).otherwise(t))
    ended = F.transform(pinned, lambda t, i: F.when(i == n - 1, F.lit("[S.SPEAK]")).otherwise(t))
    return F.when(target == n - 1, F.concat(pinned, F.array(F.lit(SILENCE), F.lit("[S.SPEAK]")))).otherwise(ended)


def history(tape):
    """Column: a tape array as a transcript, one line per run of a speaker, tokens and silences left out."""
    bare = F.transform(tape, lambda t: F.regexp_replace(t, r"\[[SC]\.[A-Z.]+\]|<SIL>", ""))
    kept = F.filter(bare, lambda t: F.trim(t) != "")
    who = lambda t: F.when(t.contains(INTERLOCUTOR), F.lit("USER")).otherwise(F.lit("ASSISTANT"))
    zero = F.struct(F.lit("").alias("who"), F.lit("").alias("text"))

    def step(acc, t):
        said = F.replace(t, F.lit(INTERLOCUTOR), F.lit(""))
        near = F.when(acc.text.endswith(" ") | said.startswith(" "), F.lit("")).otherwise(F.lit(" "))
        head = F.concat(F.when(acc.text == "", F.lit("")).otherwise(F.lit("\n")), who(t), F.when(said.startswith(" "), F.lit(":")).otherwise(F.lit(": ")))
        return F.struct(who(t).alias("who"), F.concat(acc.text, F.when(acc.who == who(t), near).otherwise(head), said).alias("text"))

    return F.aggregate(kept, zero, step, lambda acc: acc.text)
