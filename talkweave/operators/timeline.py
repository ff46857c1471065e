"""Two-speaker word timelines: end repair, clipping, inter-pausal units, and turn-taking segments.

No window spans a call, which may hold a third of all rows.  A call is cut into scenes at moments at
which both speakers are silent; units, overlaps and stretches of activity never cross them, and what
a label must know of other scenes comes from one row a scene.  Which units are active at a time is a
running sum over the units' edges, not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.durable import checkpointed
from talkweave.functions.text import is_backchannel, is_punctuation, speaker_index
from talkweave.functions.vocab import LONGEST_WORD_S, PAUSE, SILENCE, SMALL_OVERLAP, UNITS
from talkweave.operators.blocks import beside, block_of, earliest, future, latest, matched, numbered, past, runs

#: Length of a block in units and in seconds: scenes are cut once a block.
BLOCK, BLOCK_S = 3_000_000, 300.0
#: The scene of a call's beginning; others bear the number of the block they begin in.
FIRST_SCENE = -(1 << 40)
CALL, SCENE = ["conv_id"], ["conv_id", "scene"]


def units(seconds: Column) -> Column:
    """Seconds as integer units, halves to even."""
    return F.rint(seconds * UNITS).cast("long")


def asr_records(asr: DataFrame) -> DataFrame:
    """First delivery of each piece (conv_id, seq) with anything but punctuation: spk, text, start, end in seconds.

    Null texts are dropped like empty ones, and pieces of no call; `<SIL>` pieces stay.
    """
    first = asr.groupBy("conv_id", "seq").agg(
        F.min_by(F.struct("speaker_id", "text", "audio_start", "audio_end"), "receive").alias("r")
    )
    return (
        first.select("conv_id", speaker_index(F.col("r.speaker_id")).alias("spk"), "seq", F.trim("r.text").alias("text"), F.col("r.audio_start").alias("start"), F.col("r.audio_end").alias("end"))
        .where(F.col("text").isNotNull() & F.col("spk").isNotNull() & F.col("conv_id").isNotNull())
        .where((F.col("text") == SILENCE) | ~is_punctuation(F.col("text")))
    )


def repair_ends(rows: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """A piece that ends no later than it starts lasts until the next piece of its speaker, half a second at most."""
    return _repaired(rows, block_s).drop("_b")


def _repaired(rows: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """The same, dealt out by call and block, with the block as `_b`.

    The next piece matters only if it starts within half a second, so a piece that starts so soon
    after a block's edge also stands, as a neighbour, in the block before.
    """
    own, near = F.floor(F.col("start") / block_s), F.floor((F.col("start") - LONGEST_WORD_S) / block_s)
    placed = rows.withColumn("_own", own).withColumn("_b", F.explode(F.when(near < own, F.array(own, near)).otherwise(F.array(own)))).repartition("conv_id", "_b")
    order = W.partitionBy("conv_id", "_b", "spk").orderBy("start", "seq")
    latest_end = F.col("start") + LONGEST_WORD_S
    following = F.least(F.coalesce(F.lead("start").over(order), latest_end), latest_end)
    end = F.when(F.col("end") > F.col("start"), F.col("end")).when(following > F.col("start"), following).otherwise(latest_end)
    return placed.withColumn("end", end).where(F.col("_b").eqNullSafe(F.col("_own"))).drop("_own")


def timed_words(asr: DataFrame) -> DataFrame:
    """Words of both speakers in integer time: conv_id, spk, seq, text, s, e.  Pieces without a start have no place in time and are left out."""
    return blocked_words(asr).drop("_b")


def blocked_words(asr: DataFrame) -> DataFrame:
    """The same as they were dealt out for the repair of ends, with the block `_b`, which spares `scenes` a shuffle."""
    return _in_units(_repaired(asr_records(asr).where((F.col("text") != SILENCE) & F.col("start").isNotNull())))


def timed_silences(asr: DataFrame) -> DataFrame:
    """Silences of speaker 0 in integer time, as timed_words has words."""
    return _in_units(_repaired(asr_records(asr).where((F.col("text") == SILENCE) & (F.col("spk") == 0) & F.col("start").isNotNull()))).drop("_b")


def _in_units(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "_b", "spk", "seq", "text", units(F.col("start")).alias("s"), units(F.col("end")).alias("e"))


def scenes(rows: DataFrame, block: int = BLOCK, pause: int = PAUSE) -> DataFrame:
    """Adds `scene` to timed words, and to silences among them, and deals the rows out by (call, scene).

    Within each block of a call the last word before which nobody has spoken for `pause` begins a
    scene, if nothing said in earlier blocks lasts up to it either.  A call in which speech never
    pauses is one scene.  Silences (text <SIL>) have scenes and make none.  Times count from 0.
    """
    said = F.col("text") != SILENCE
    placed = rows if "_b" in rows.columns else rows.withColumn("_b", F.floor(F.col("s") / block).cast("long")).repartition("conv_id", "_b")
    order = W.partitionBy("conv_id", "_b").orderBy("s", "seq")
    reach = F.max(F.when(said, F.col("e"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(said & F.coalesce(F.col("s") - reach >= pause, F.lit(True)), F.col("s"))
    per = placed.withColumn("_c", begins).groupBy("conv_id", "_b").agg(F.max("_c").alias("_c"), F.max(F.when(said, F.col("e"))).alias("_top"))
    whole = past(CALL, "_b")
    cut = per.select("conv_id", "_b", F.when(F.col("_c") - F.max("_top").over(whole) >= pause, F.col("_c")).alias("_c"))
    cuts = cut.select("conv_id", "_b", "_c", F.coalesce(F.last(F.when(F.col("_c").isNotNull(), F.col("_b")), ignorenulls=True).over(whole), F.lit(FIRST_SCENE)).alias("_p"))
    scene = F.when(F.col("s") >= F.col("_c"), F.col("_b")).otherwise(F.col("_p"))
    return matched(placed, cuts, ["conv_id", "_b"]).withColumn("scene", scene).drop("_b", "_c", "_p").repartition(*SCENE)


def in_scenes(words: DataFrame) -> DataFrame:
    return words if "scene" in words.columns else scenes(words)


def pausal_units(words: DataFrame, pause: int = PAUSE, keep_words: bool = False) -> DataFrame:
    """Words of a speaker joined while pauses stay below `pause`: conv_id, scene, spk, ipu, text, s, e, n_words.

    `ipu` counts the units of a speaker in their scene.  A unit ends with its last word, which may
    end before an earlier one.
    """
    order = W.partitionBy(*SCENE, "spk").orderBy("s", "seq")
    new = F.coalesce((F.col("s") - F.lag("e").over(order) >= pause).cast("int"), F.lit(1))
    counted = in_scenes(words).withColumn("ipu", F.sum(new).over(order.rowsBetween(W.unboundedPreceding, 0)))
    if keep_words:
        return counted
    listed = F.array_sort(F.collect_list(F.struct("s", "seq", "e", "text")))
    return (
        counted.groupBy(*SCENE, "spk", "ipu")
        .agg(listed.alias("w"))
        .select(
            *SCENE, "spk", "ipu",
            F.array_join(F.transform("w", lambda x: x.text), " ").alias("text"),
            F.col("w")[0].s.alias("s"),
            F.element_at("w", -1).e.alias("e"),
            F.size("w").cast("long").alias("n_words"),
        )
    )


def numbered_units(ipus: DataFrame) -> DataFrame:
    """`ipu` as the number of a unit among all of its speaker in the call, without scenes."""
    return numbered(ipus, ["conv_id", "spk"], "scene", ["ipu"], "_i").drop("ipu", "scene").withColumnRenamed("_i", "ipu")


def mark_backchannels(ipus: DataFrame) -> DataFrame:
    """Adds is_bc: a short backchannel text that overlaps a unit of the other speaker by more than a point.

    Of the other speaker's units, those that started before this one ends less those that ended by
    its start overlap it; both counts are running sums over the edges of all units of the scene.
    """
    whole = F.col("e") > F.col("s")
    edge = F.explode(F.array(F.struct(F.col("e").alias("t"), F.lit(0).alias("opens")), F.struct(F.col("s").alias("t"), F.lit(1).alias("opens"))))
    edges = ipus.withColumn("whole", whole).withColumn("edge", edge).select("*", "edge.t", "edge.opens")
    upto = W.partitionBy(*SCENE).orderBy("t", "opens").rowsBetween(W.unboundedPreceding, 0)

    def seen(spk: int, opens: int) -> Column:
        return F.sum(((F.col("spk") == spk) & (F.col("opens") == opens) & F.col("whole")).cast("int")).over(upto)

    counted = edges.select(
        "*",
        F.when(F.col("spk") == 0, seen(1, 1)).otherwise(seen(0, 1)).alias("started"),
        F.when(F.col("spk") == 0, seen(1, 0)).otherwise(seen(0, 0)).alias("ended"),
    )
    return (
        counted.groupBy(*SCENE, "spk", "ipu")
        .agg(
            F.first("text").alias("text"), F.first("s").alias("s"), F.first("e").alias("e"), F.first("n_words").alias("n_words"), F.first("whole").alias("whole"),
            F.max(F.when(F.col("opens") == 0, F.col("started"))).alias("started"),
            F.max(F.when(F.col("opens") == 1, F.col("ended"))).alias("ended"),
        )
        .select(
            *SCENE, "spk", "ipu", "text", "s", "e", "n_words",
            (F.col("whole") & (F.col("started") > F.col("ended")) & is_backchannel(F.col("text"), F.col("e") - F.col("s"))).alias("is_bc"),
        )
    )


_COUNTS = ("n0", "n1", "b0", "b1")


def _who() -> tuple[Column, Column, Column]:
    """How many units are active, the first speaker of them, and the only speaker."""
    n = F.col("n0") + F.col("n1")
    first = F.when(F.col("n0") > 0, 0).when(F.col("n1") > 0, 1)
    return n, first, F.when((F.col("n0") > 0) != (F.col("n1") > 0), first)


def stretches(ipus: DataFrame) -> DataFrame:
    """Stretches between neighbouring edges of units, 0 being an edge: how many units of each speaker are active, and backchannels.

    A scene's last stretch lasts until the next scene.  Beside start, end and counts there is what
    was heard before the scene: `_before`, the last speech, and `_floor`, the last to speak alone.
    """
    whole = (F.col("e") > F.col("s")).cast("int")
    bc = F.col("is_bc").cast("int") * whole

    def edge(t: Column, sign: int) -> Column:
        mine = [(F.when(F.col("spk") == k, x).otherwise(0) * sign).alias(n) for x, n, k in ((whole, "n0", 0), (whole, "n1", 1), (bc, "b0", 0), (bc, "b1", 1))]
        return F.struct(t.alias("t"), *mine)

    zero = F.when(F.col("scene") == FIRST_SCENE, F.struct(F.lit(0).cast("long").alias("t"), *[F.lit(0).alias(n) for n in _COUNTS]))
    edges = ipus.select(*SCENE, F.explode(F.array_compact(F.array(edge(F.col("s"), 1), edge(F.col("e"), -1), zero))).alias("x"))
    sums = edges.groupBy(*SCENE, F.col("x.t").alias("start")).agg(*[F.sum(f"x.{n}").alias(n) for n in _COUNTS])
    order = W.partitionBy(*SCENE).orderBy("start")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    inside = sums.select(*SCENE, "start", F.lead("start").over(order).alias("end"), *[F.sum(n).over(upto).cast("int").alias(n) for n in _COUNTS])
    n, first, solo = _who()
    made = {"_first": F.min("start"), "_last": latest(F.when(n > 0, F.struct(n.alias("n"), first.alias("a0"))), F.col("start")), "_solo": latest(solo, F.col("start"))}
    back = past(CALL, "scene")
    seen = {
        "_next": F.lead("_first").over(W.partitionBy("conv_id").orderBy("scene")),
        "_before": F.last("_last", ignorenulls=True).over(back), "_floor": F.last("_solo", ignorenulls=True).over(back),
    }
    return beside(inside, CALL, "scene", made, seen).withColumn("end", F.coalesce("end", "_next")).drop("_next").where("end IS NOT NULL")


def activity(ipus: DataFrame) -> DataFrame:
    """The stretches with their counts."""
    return stretches(ipus).select(*SCENE, "start", "end", *_COUNTS)


def label_segments(around: DataFrame) -> DataFrame:
    """Turn-taking labels T, C, P, G, BC, IF, IB and the initiator of each of the `stretches`."""
    order = W.partitionBy(*SCENE).orderBy("start")
    back = order.rowsBetween(W.unboundedPreceding, -1)
    # what follows, read backwards: a frame that only grows is one running value, the other way round it is not
    ahead = W.partitionBy(*SCENE).orderBy(F.desc("start")).rowsBetween(W.unboundedPreceding, -1)
    n, first_spk, solo = _who()
    seen = around.select(
        *SCENE, "start", "end", *_COUNTS, n.alias("n"), first_spk.alias("a0"),
        F.coalesce(F.last(F.when(n > 0, F.struct(n.alias("n"), first_spk.alias("a0"))), ignorenulls=True).over(back), F.col("_before")).alias("before"),
        F.coalesce(F.last(solo, ignorenulls=True).over(back), F.col("_floor")).alias("floor"),
    )
    ignore = F.coalesce(F.col("before.n") > 1, F.lit(False))
    bc0, bc1 = ((F.col(b) > 0) & ~ignore for b in ("b0", "b1"))
    was_solo = lambda k: F.coalesce((F.col("before.n") == 1) & (F.col("before.a0") == k), F.lit(False))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    bc_of = F.when(both & bc0 & ~bc1 & ~was_solo(0), 0).when(both & bc1 & ~bc0 & ~was_solo(1), 1)
    l1 = (
        F.when((F.col("n") == 0) & F.col("before").isNull(), "G").when(F.col("n") == 0, "NA")
        .when(both & (bc_of.isNotNull() | (bc0 & bc1)), "BC").when(both, "I")
        .when(F.col("floor").isNull() | (F.col("floor") != F.col("a0")), "T").otherwise("C")
    )
    first_pass = seen.select(*SCENE, "start", "end", "n0", "n1", "n", "a0", bc_of.alias("bc_of"), l1.alias("l1"))
    speech, at = F.when(F.col("n") > 0, F.struct("l1", "a0")), F.col("start")
    made = {"_l_first": earliest(F.col("l1"), at), "_l_last": latest(F.col("l1"), at), "_s_first": earliest(speech, at), "_s_last": latest(speech, at)}
    call = W.partitionBy("conv_id").orderBy("scene")
    beyond = {
        "_prev": F.lag("_l_last").over(call), "_next": F.lead("_l_first").over(call),
        "_p": F.last("_s_last", ignorenulls=True).over(past(CALL, "scene")), "_f": F.last("_s_first", ignorenulls=True).over(future(CALL, "scene")),
    }
    near = beside(first_pass, CALL, "scene", made, beyond).select(
        "*",
        F.coalesce(F.lag("l1").over(order), F.col("_prev")).alias("prev"), F.coalesce(F.lead("l1").over(order), F.col("_next")).alias("next"),
        F.coalesce(F.last(speech, ignorenulls=True).over(back), F.col("_p")).alias("p"), F.coalesce(F.last(speech, ignorenulls=True).over(ahead), F.col("_f")).alias("f"),
    )
    label = (
        F.when(F.col("l1") == "NA", F.when((F.col("next") == "T") & ~F.coalesce(F.col("prev") == "I", F.lit(False)), "G").otherwise("P"))
        .when((F.col("l1") == "T") & F.coalesce(F.col("p.l1") == "I", F.lit(False)), "C")
        .when(F.col("l1") == "I", F.when(F.col("f.l1") == "C", "IB").otherwise("IF"))
        .otherwise(F.col("l1"))
    )
    initiator = (
        F.when(F.col("l1").isin("T", "C"), F.col("a0"))
        .when(F.col("l1") == "BC", F.col("bc_of"))
        .when(F.col("l1") == "I", F.when(F.col("f.l1") == "T", F.col("f.a0")).when(F.col("f.l1") == "C", 1 - F.col("f.a0")).otherwise(1 - F.col("p.a0")))
    )
    return near.select(*SCENE, "start", "end", label.alias("label"), initiator.cast("int").alias("initiator"), "n0", "n1")


def event_segments(words: DataFrame, clip: bool = True) -> DataFrame:
    """The whole chain from timed words to labelled segments: conv_id, scene, start, end, label, initiator, n0, n1.

    With `clip` small overlaps are clipped first, as the pipeline does unless told otherwise.  Null labels of speakers and null texts were
    dropped with the words; a call without words has no segments; ties in time keep the order of
    `seq`; an empty table gives none.
    """
    return label_segments(stretches(mark_backchannels(pausal_units(clipped_once(words) if clip else words))))


def floor_holders(segments: DataFrame) -> DataFrame:
    """Adds floor: the speaker who last took a turn, or took the floor by interrupting."""
    taken = F.when(F.col("label").isin("IF", "T"), F.col("initiator"))
    order = W.partitionBy(*SCENE).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    held = beside(segments, CALL, "scene", {"_t": latest(taken, F.col("start"))}, {"_held": F.last("_t", ignorenulls=True).over(past(CALL, "scene"))})
    return held.withColumn("floor", F.coalesce(F.last(taken, ignorenulls=True).over(order), F.col("_held"))).drop("_held")


def words_in_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Each word with the segment it starts in: the last segment edge at or before its start, by one sorted pass over a scene."""
    seg = segments.select(*SCENE, F.col("start").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("spk"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("e"), F.struct("start", "end").alias("g"))
    word = in_scenes(words).select(*SCENE, F.col("s").alias("t"), F.lit(1).alias("kind"), "spk", F.col("seq").cast("long").alias("seq"), "text", "e", F.lit(None).cast("struct<start:bigint,end:bigint>").alias("g"))
    upto = W.partitionBy(*SCENE).orderBy("t", "kind", "seq").rowsBetween(W.unboundedPreceding, 0)
    return (
        seg.unionByName(word)
        .withColumn("g", F.last("g", ignorenulls=True).over(upto))
        .where("kind = 1 AND t < g.end")
        .select(*SCENE, F.col("g.start").alias("start"), F.col("g.end").alias("end"), "spk", "seq", F.col("t").alias("s"), "e", "text")
    )


def segment_texts(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words heard in each segment, of speaker 0 and of speaker 1."""
    of = lambda k: F.array_join(F.transform(F.filter("w", lambda x: x.spk == k), lambda x: x.text), " ")
    return (
        words_in_segments(words, segments)
        .groupBy(*SCENE, "start", "end")
        .agg(F.array_sort(F.collect_list(F.struct("s", "seq", "spk", "text"))).alias("w"))
        .select("conv_id", "start", "end", of(0).alias("text0"), of(1).alias("text1"))
    )


def label_stats(segments: DataFrame, *keys: str) -> DataFrame:
    """Segments and their duration per label, and per other keys if given."""
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    return segments.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.sum(length).alias("units"))


def label_stats_rolled_up(segments: DataFrame) -> DataFrame:
    """Per call and label, and per label over all calls (conv_id null): the latter summed from the former."""
    each = label_stats(segments, "conv_id")
    return each.rollup("label", "conv_id").agg(F.sum("n").alias("n"), F.sum("units").alias("units"), F.grouping_id().alias("g")).where("g < 2").drop("g")


def clip_small_overlaps(words: DataFrame, most: int = SMALL_OVERLAP) -> DataFrame:
    """Words of speaker 0 trimmed so that overlaps with speaker 1's units below `most` disappear; adds scenes if there are none yet.

    A unit of speaker 0 whose head lies inside a unit of speaker 1 is pushed to that unit's end, one
    whose tail does is pulled back to its start, unless either may be a backchannel or one contains
    the other.  Words outside the new bounds keep one unit of time at the bound.  Silences among the
    words pass unchanged.
    """
    rows = in_scenes(words)
    spoken = rows.where(F.col("text") != SILENCE)
    ipus = pausal_units(spoken).withColumn("bc", is_backchannel(F.col("text"), F.col("e") - F.col("s")))
    # a unit of the other speaker can hold an edge only if it is the last that started before it; a head meets units that started at or
    # before it, a tail those that started before it
    met_by = lambda t, k, side: F.struct(F.col(t).alias("t"), F.lit(k).alias("k"), F.lit(side).alias("side"))
    points = F.when(F.col("spk") == 0, F.array(met_by("e", 0, "tail"), met_by("s", 2, "head"))).otherwise(F.array(met_by("s", 1, "other")))
    upto = W.partitionBy(*SCENE).orderBy("t", "k", "s").rowsBetween(W.unboundedPreceding, 0)
    edges = ipus.select(*SCENE, "ipu", "s", "e", "bc", F.explode(points).alias("x")).select("*", "x.*")
    unit = F.when(F.col("side") == "other", F.struct("s", "e", "bc"))
    met = edges.withColumn("o", F.last(unit, ignorenulls=True).over(upto)).where("side <> 'other' AND NOT bc AND NOT o.bc")
    head = (F.col("side") == "head") & (F.col("o.s") <= F.col("s")) & (F.col("s") < F.col("o.e")) & (F.col("o.e") < F.col("e")) & (F.col("o.e") - F.col("s") < most)
    tail = (F.col("side") == "tail") & (F.col("s") < F.col("o.s")) & (F.col("o.s") < F.col("e")) & (F.col("e") <= F.col("o.e")) & (F.col("e") - F.col("o.s") < most)
    bounds = met.where(head | tail).groupBy(*SCENE, "ipu").agg(F.max(F.when(head, F.col("o.e"))).alias("head"), F.max(F.when(tail, F.col("o.s"))).alias("tail"))
    user = matched(pausal_units(spoken.where("spk = 0"), keep_words=True), bounds, [*SCENE, "ipu"])
    s1 = F.greatest("s", F.coalesce("head", "s"))
    moved = user.withColumn("s1", s1).withColumn("e1", F.greatest(F.col("e"), F.when(F.col("s") < F.col("head"), F.col("s1") + 1).otherwise(F.col("e"))))
    cut = F.col("e1") > F.col("tail")
    clipped = moved.select(
        *SCENE, "spk", "seq", "text",
        F.when(cut & (F.col("s1") >= F.col("tail")), F.col("tail") - 1).otherwise(F.col("s1")).alias("s"),
        F.when(cut, F.col("tail")).otherwise(F.col("e1")).alias("e"),
    )
    return clipped.unionByName(rows.where((F.col("spk") == 1) | (F.col("text") == SILENCE)).select(*SCENE, "spk", "seq", "text", "s", "e")).repartition(*SCENE)


def clipped_once(words: DataFrame) -> DataFrame:
    """Clipped words written once, as what follows reads them several times."""
    return checkpointed(clip_small_overlaps(words))


def _joined(separator: str) -> tuple:
    """Aggregates of a run: its start, end and texts; in a block, and over its pieces."""
    listed = lambda: F.array_sort(F.collect_list(F.struct("start", "seq", "end", "text")))
    pieces = lambda: F.array_sort(F.collect_list(F.struct("head", "w")))
    parts = lambda: {"w": listed()}
    whole = lambda: {"w": F.flatten(F.transform(pieces(), lambda p: p.w))}
    text = F.array_join(F.transform("w", lambda x: x.text), separator)
    return parts, whole, [F.col("w")[0].start.alias("start"), F.element_at("w", -1).end.alias("end"), text.alias("text")]


def merge_asr(rows: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """Runs of text and of silence of a speaker: speech starts where the run before it ended, texts join without a blank."""
    keys = ["conv_id", "spk"]
    parts, whole, shown = _joined("")
    found = runs(rows.withColumn("silent", F.col("text") == SILENCE), keys, "start", "silent", block_s, parts, whole).select(*keys, "silent", "head", "block", *shown)
    by = W.partitionBy(*keys, "block").orderBy("head")
    back = past(keys, "block")
    made, seen = {"_n": F.count("*"), "_e": F.max_by("end", "head")}, {"_before": F.coalesce(F.sum("_n").over(back), F.lit(0)), "_end": F.last("_e").over(back)}
    placed = beside(found, keys, "block", made, seen)
    previous = F.coalesce(F.lag("end").over(by), F.when(F.lag("head").over(by).isNull(), F.col("_end")))
    return placed.select(
        *keys, (F.col("_before") + F.row_number().over(by)).cast("long").alias("run"), "silent",
        F.when(F.col("silent"), F.col("start")).otherwise(F.coalesce(previous, "start")).alias("start"), "end",
        F.when(F.col("silent"), SILENCE).otherwise(F.col("text")).alias("text"),
    )


def speaker_runs(rows: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """Consecutive rows of one speaker as one utterance, with the start of the first and the end of the last row."""
    parts, whole, shown = _joined(" ")
    found = runs(rows, CALL, "start", "spk", block_s, parts, whole).select("conv_id", "spk", "head", "block", *shown)
    return numbered(found, CALL, "block", ["head"], "run").select("conv_id", "run", "spk", "start", "end", F.concat("text", F.lit(" ")).alias("text"))


def named_speakers(rows: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """Fills `spk` where it is null with that of the row before in time, in the order of (start, seq)."""
    placed = rows.withColumn("_b", block_of("start", rows.schema["start"].dataType, block_s))
    at = F.struct("start", "seq")
    seen = beside(placed, CALL, "_b", {"_s": latest(F.col("spk"), at)}, {"_held": F.last("_s", ignorenulls=True).over(past(CALL, "_b"))})
    upto = W.partitionBy("conv_id", "_b").orderBy("start", "seq").rowsBetween(W.unboundedPreceding, 0)
    return seen.withColumn("spk", F.coalesce(F.last("spk", ignorenulls=True).over(upto), F.col("_held"))).drop("_b", "_held")


def _hundredths(x: Column) -> Column:
    return F.rint(x * 100) / 100


def interpolate(rows: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Times of parts of an utterance by their share of its characters; the last part ends with the utterance.

    `rows` has the keys of the utterance, utt_start, utt_end, the order column and text.
    """
    whole = W.partitionBy(*keys)
    order = whole.orderBy(order_by)
    size = F.length("text")
    total = F.sum(size).over(whole)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    span = F.col("utt_end") - F.col("utt_start")
    at = lambda n: F.col("utt_start") + span * F.try_divide(n.cast("double"), total.cast("double"))
    return rows.select(
        *keys, order_by, "text",
        _hundredths(at(before)).alias("start"),
        _hundredths(F.when(F.lead("text").over(order).isNull(), F.col("utt_end")).otherwise(at(before + size))).alias("end"),
    )
