"""Speech transcripts into clean, ordered speaker turns.

SQL expressions extract the speaker and the words of a row, windows fill the speaker forward, and
gaps-and-islands numbers make turns of consecutive rows.  The windows run over blocks of time of a
call, so that a call with a third of all rows is many groups; only the first and last islands of a
block, which a neighbouring block may continue, meet in one window per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Seconds of a call in a block.
BLOCK_S = 300.0

# -- what is not a word (Java regular expressions) ---------------------------------------------
#: A speaker label at the head of a text: "A:", ">>A:", "A>", "(A) -", "Speaker A:", "Channel 1:".
LABEL = r"^\s*(?:>>\s*)?(?:\(([AB])\)\s*[-:]+|([AB])\s*[:>](?!\d)|(?i:speaker|spk)[\s_-]*([ABab])\s*[:>]|(?i:channel|ch)[\s_-]*([12])\s*[:>])\s*"
#: Times put in by a transcriber: [00:46], <t=71.3>, (16.5s), 00:01:11.92 -->.  "7:40" is spoken.
TIMES = r"\[\d+(?::\d+)+(?:[.,]\d+)?\]|<t=[^<>]*>|\(\d+(?:[.,]\d+)?\s*s\)|(?<!\S)\d+:\d\d:\d\d(?:[.,]\d+)?(?:\s*-->(?:\s*\d+:\d\d:\d\d(?:[.,]\d+)?)?)?|-->"
#: <SIL>, <noise/>, <b_aside>, {breath}, *sniff*, (door slams), [Phone Ringing]; but not ((word)), fl[oor]-, [laughter-word].
MARKS = r"<[^<>]*>|\{[^{}]*\}|\*[^*]+\*|(?<!\()\((?!\()[^()]*\)(?!\))|(?<![\p{L}\p{N}])\[(?!(?i:laughter)-)[^\[\]]*\](?![\p{L}\p{N}])"
#: Any spelling of uh, um, er, ah standing alone, with the punctuation around it.
HESITATION = r"(?i)(?<!\S)[^\p{L}\p{N}\s]*(?:u+h+m*|u+m+|e+r+m*|a+h+m*)[^\p{L}\p{N}\s]*(?!\S)"
WORD = r"\S*[\p{L}\p{N}]\S*"


def speaker_of(label: Column) -> Column:
    """1 for A, 2 for B, null for none: `A`, `a:`, `SPEAKER A`, `spk_A`, `sw001-A`, `sw001A`, `ch1`, `Channel 2`."""
    s = F.regexp_replace(F.upper(F.trim(label)), r"[:.>\s]+$", "")
    letter = F.regexp_extract(s, r"(?:^|[\s_\d-])([AB])$", 1)
    channel = F.regexp_extract(s, r"^(?:CHANNEL|CH)[\s_-]*([12])$", 1)
    return (
        F.when((letter == "A") | (channel == "1"), F.lit(1))
        .when((letter == "B") | (channel == "2"), F.lit(2))
        .cast("int")
    )


def label_in(text: Column) -> Column:
    """The speaker that a label at the head of a text names."""
    found = F.upper(F.concat(*[F.regexp_extract(text, LABEL, k) for k in (1, 2, 3, 4)]))
    return F.when(text.rlike(LABEL), F.when(found.isin("A", "1"), F.lit(1)).otherwise(F.lit(2))).cast("int")


def clean_text(text: Column) -> Column:
    """The text without label, times, sound annotations, aside marks, silences and hesitations."""
    plain = F.regexp_replace(text, LABEL, "")
    marked = F.regexp_replace(F.regexp_replace(plain, TIMES, " "), MARKS, " ")
    bare = F.when(text.rlike(r"[<\[({*:>]"), marked).otherwise(text)
    return F.regexp_replace(bare, HESITATION, " ")


def unmarked(text: Column) -> Column:
    """Laughed and uncertain words without their marks: [laughter-word], ((word))."""
    return F.regexp_replace(F.regexp_replace(text, r"\[(?i:laughter)-([^\[\]]*)\]", "$1"), r"\(\(|\)\)", "")


def _rows(df: DataFrame, start: str, received: str | None, keep_text: bool) -> DataFrame:
    """One row per (conv_id, seq): t, speaker (null if unnamed), n_words, and the clean text if wanted."""
    text = clean_text(F.coalesce(F.col("text"), F.lit("")))
    rows = df.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col(start).cast("double"), F.lit(0.0)).alias("t"),
        F.coalesce(speaker_of(F.col("speaker_id")), label_in(F.col("text"))).alias("speaker"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        (F.coalesce(F.col(received).cast("double"), F.lit(float("inf"))) if received else F.lit(0.0)).alias("received"),
        *([F.array_join(F.regexp_extract_all(unmarked(text), F.lit(f"({WORD})")), " ").alias("words")] if keep_text else []),
    )
    first = lambda c: F.min_by(c, "received").alias(c)
    return rows.groupBy("conv_id", "seq").agg(*map(first, ["t", "speaker", "n_words"]), *([first("words")] if keep_text else []))


def speaker_turns(
    df: DataFrame, start: str, received: str | None = None, keep_text: bool = False, block_s: float = BLOCK_S
) -> DataFrame:
    """Clean turns of a stream of transcript rows.

    Takes conv_id, seq, speaker_id, text and the column `start` (seconds); `received`, if given,
    tells deliveries of the same (conv_id, seq) apart, of which the first counts, one without a time
    last, and any one of those at the same time.  Gives conv_id,
    speaker ('A', 'B'), first_seq, n_words, started (seconds) and, if wanted, text.

    Rows of a call are taken by (start, seq).  A null start counts as 0.  Null and empty texts and
    rows of marks only have no words: they neither make nor end a turn, but a label on them holds
    for unlabelled rows after them.  Words before any label of their call have speaker null.  Very
    long texts, ties, repeated rows and other columns of any name need nothing special; null
    conv_ids form one call; an empty table gives no turns.
    """
    block = ["conv_id", "block"]
    by_time = W.partitionBy(*block).orderBy("t", "seq")
    upto = by_time.rowsBetween(W.unboundedPreceding, 0)
    whole = by_time.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = (
        _rows(df, start, received, keep_text)
        .withColumn("block", F.floor(F.col("t") / block_s).cast("long"))
        .withColumn("speaker", F.last("speaker", ignorenulls=True).over(upto))
        .withColumn("block_speaker", F.last("speaker").over(whole))
        .withColumn("at_end", F.lead("seq").over(by_time).isNull())
        # a last row without words stays, to tell the next block who spoke
        .where((F.col("n_words") > 0) | F.col("at_end"))
    )
    new = (F.col("n_words") == 0) | F.lag("seq").over(by_time).isNull() | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_time))
    islands = (
        rows.withColumn("island", F.sum(new.cast("int")).over(upto))
        .groupBy(*block, "island")
        .agg(
            F.first("speaker").alias("speaker"),
            F.min(F.struct("t", "seq")).alias("head"),
            F.sum("n_words").alias("n_words"),
            F.first("block_speaker").alias("block_speaker"),
            *([F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "words"))), lambda x: x.words), " ").alias("text")] if keep_text else []),
        )
    )
    # islands that another block may continue or name stand in one group per call, others in their block
    in_block = W.partitionBy(*block).orderBy("island")
    near = (F.lag("speaker").over(in_block).isNull()) | (F.lead("n_words").over(in_block).isNull()) | (F.lead("n_words").over(in_block) == 0)
    edge = islands.withColumn("edge", near | F.col("speaker").isNull() | (F.col("n_words") == 0)).withColumn(
        "own", F.when(~F.col("edge"), F.col("block"))
    )
    call = W.partitionBy("conv_id", "edge", "own").orderBy("block", "island")
    before = W.partitionBy("conv_id", "edge", "own").orderBy("block").rangeBetween(W.unboundedPreceding, -1)
    named = edge.withColumn("speaker", F.coalesce("speaker", F.last("block_speaker", ignorenulls=True).over(before))).where("n_words > 0")
    starts = (
        F.lag("block").over(call).isNull()
        | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(call))
        | ((F.lag("block").over(call) == F.col("block")) & (F.lag("island").over(call) < F.col("island") - 1))
    )
    turns = (
        named.withColumn("turn", F.sum(starts.cast("int")).over(call.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("conv_id", "edge", "own", "turn")
        .agg(
            F.first("speaker").alias("speaker"),
            F.min("head").alias("head"),
            F.sum("n_words").alias("n_words"),
            *([F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "text"))), lambda x: x.text), " ").alias("text")] if keep_text else []),
        )
    )
    return turns.select(
        "conv_id",
        F.when(F.col("speaker") == 1, "A").when(F.col("speaker") == 2, "B").alias("speaker"),
        F.col("head.seq").alias("first_seq"),
        "n_words",
        F.col("head.t").alias("started"),
        *(["text"] if keep_text else []),
    )
