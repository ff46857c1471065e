"""Clean speaker turns: the block-wise form against a row by row fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talkweave.llm.speech import clean_text, label_in, speaker_of, speaker_turns

SCHEMA = "conv_id string, seq long, speaker_id string, text string, start double, receive double, t string, block string"


@pytest.mark.parametrize(
    ("label", "who"),
    [("A", 1), ("b", 2), ("A:", 1), ("SPEAKER B", 2), ("Speaker-a", 1), ("spk_B", 2), ("sw00000001A", 1), ("sw00000001-B", 2), ("ch1", 1), ("Channel 2", 2), ("", None), (None, None), ("narrator", None), ("sw1", None)],
)
def test_labels(spark, label, who):
    assert spark.createDataFrame([(label,)], "x string").select(speaker_of(F.col("x"))).first()[0] == who


@pytest.mark.parametrize(
    ("text", "who", "words"),
    [
        ("A: the tall cook", 1, "the tall cook"), (">>B: yes", 2, "yes"), ("(A) - the red", 1, "the red"), ("B> on", 2, "on"), ("Speaker A: mm-hmm", 1, "mm-hmm"),
        ("[00:46] errr right?", None, "right?"), ("00:01:11.92 --> of", None, "of"), ("<t=71.3> right", None, "right"), ("(16.5s) the", None, "the"), ("at 7:40.", None, "at 7:40."),
        ("{LAUGH} of (door slams) [Phone Ringing] *sniff* <noise/> it", None, "of it"), ("[laughter-night] ((month)) fl[oor]- station_1", None, "[laughter-night] ((month)) fl[oor]- station_1"),
        ("UM-- uh... Ah, errr, uhm uh-huh yeah umbrella", None, "uh-huh yeah umbrella"), ("<b_aside> x <e_aside>", None, "x"), ("<SIL>", None, ""), ("...", None, ""), ("", None, ""), (None, None, ""), ("♪", None, ""),
    ],
)
def test_words(spark, text, who, words):
    row = spark.createDataFrame([(text,)], "x string").select(label_in(F.col("x")).alias("who"), clean_text(F.coalesce("x", F.lit(""))).alias("t")).first()
    assert row.who == who
    assert " ".join(w for w in row.t.split() if re.search(r"\w", w.replace("_", ""))) == words


def fold(rows):
    out = []
    for conv in sorted({r[0] for r in rows}):
        first = {}
        for r in rows:
            if r[0] == conv and (r[1] not in first or r[5] < first[r[1]][5]):
                first[r[1]] = r
        who, turn = None, None
        for r in sorted(first.values(), key=lambda r: (r[4], r[1])):
            who = {"A": "A", "B": "B"}.get(r[2], who)
            n = len([w for w in (r[3] or "").split() if w not in ("uh", "...")])
            if n:
                if turn and turn[1] == who:
                    turn[3] += n
                else:
                    turn = [conv, who, r[1], n]
                    out.append(turn)
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_equal_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in ("c1", "c2", "c3"):
        for seq in range(rng.randrange(1, 120)):
            row = [conv, seq, rng.choice(["A", "A", "B", None, None, "?"]), rng.choice(["one two", "word", "uh", "", None, "..."]), rng.randrange(200) / 2.0, 1.0, "x", "y"]
            rows += [tuple(row)] * rng.choice([1, 1, 1, 2])
    got = speaker_turns(spark.createDataFrame(rows, SCHEMA), "start", "receive", block_s=rng.choice([1.0, 7.0, 50.0, 1000.0]))
    assert sorted([(r.conv_id, r.speaker, r.first_seq, r.n_words) for r in got.collect()], key=str) == fold(rows)


def test_text_and_edges(spark):
    rows = [("c", 1, "A", "the  first uh", 0.0, 2.0, "", ""), ("c", 1, "A", "a later delivery", 0.0, 3.0, "", ""), ("c", 2, "B", "<SIL>", 1.0, 1.0, "", ""), ("c", 3, None, "second " * 5000, None, 1.0, "", ""), (None, 9, "B", "lone", 5.0, None, "", "")]
    got = {(r.conv_id, r.first_seq): r for r in speaker_turns(spark.createDataFrame(rows, SCHEMA), "start", "receive", keep_text=True).collect()}
    assert got["c", 1].text.startswith("the first second second") and got["c", 1].n_words == 5002 and got["c", 1].speaker == "A"
    assert got[None, 9].text == "lone"
    assert speaker_turns(spark.createDataFrame([], SCHEMA), "start").count() == 0
