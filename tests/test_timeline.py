"""Timelines: the window forms against plain folds over random calls, and the edge of every rule."""

import random

import pytest

from talkweave.functions.vocab import BACKCHANNELS
from talkweave.operators import timeline as T

WORDS = "conv_id string, spk int, seq long, text string, s long, e long"


def units_of(words):
    out = []
    for spk, seq, text, s, e in sorted(words, key=lambda w: (w[0], w[3], w[1])):
        if out and out[-1]["spk"] == spk and s - out[-1]["e"] < 320:
            out[-1]["text"] += " " + text
            out[-1]["e"] = e
        else:
            out.append({"spk": spk, "text": text, "s": s, "e": e})
    return out


def short(u):
    key = "".join(c for c in u["text"].lower() if c.isalnum())
    return key in BACKCHANNELS and u["e"] - u["s"] < 10000


def labels_of(words):
    ipus = units_of(words)
    for u in ipus:
        u["bc"] = short(u) and any(v["spk"] != u["spk"] and max(u["s"], v["s"]) < min(u["e"], v["e"]) for v in ipus)
    edges = sorted({0} | {u["s"] for u in ipus} | {u["e"] for u in ipus})
    segs, floor = [], None
    for a, b in zip(edges, edges[1:]):
        on = [u for u in ipus if 2 * u["s"] <= a + b < 2 * u["e"]]
        who = sorted(u["spk"] for u in on)
        spoken = [s for s in segs if s["who"]]
        label, init = None, None
        if not who:
            label = "NA" if spoken else "G"
        elif len(set(who)) == 2:
            flags = [any(u["bc"] for u in on if u["spk"] == k) for k in (0, 1)]
            if spoken and len(spoken[-1]["who"]) > 1:
                flags = [False, False]
            solo = spoken[-1]["who"][0] if spoken and len(spoken[-1]["who"]) == 1 else None
            if flags[0] != flags[1] and solo != flags.index(True):
                label, init = "BC", flags.index(True)
            else:
                label = "BC" if all(flags) else "I"
        else:
            init = who[0]
            label = "C" if floor == init else "T"
            if label == "T" and segs and segs[-1]["label"] == "NA":
                segs[-1]["label"] = "P" if len(segs) > 1 and segs[-2]["label"] == "I" else "G"
            floor = init
        segs.append({"a": a, "b": b, "label": label, "init": init, "who": who})
    for k, s in enumerate(segs):
        if s["label"] == "NA":
            s["label"] = "P"
        if s["label"] == "I":
            after = next((x for x in segs[k + 1 :] if x["who"]), None)
            before = next((x for x in segs[:k][::-1] if x["who"]), None)
            if after and after["label"] == "T":
                s["label"], s["init"], after["label"] = "IF", after["who"][0], "C"
            elif after and after["label"] == "C":
                s["label"], s["init"] = "IB", 1 - after["who"][0]
            else:
                s["label"], s["init"] = "IF", 1 - before["who"][0] if before else None
    return [(s["a"], s["b"], s["label"], s["init"]) for s in segs]


def call(rng, n):
    words, t = [], [rng.choice([0, 500]), 700]
    for seq in range(n):
        k = rng.randrange(2)
        t[k] = max(t[k], t[1 - k] - rng.choice([0, 0, 1500, 4000])) + rng.choice([0, 100, 319, 320, 321, 5000])
        e = t[k] + rng.choice([400, 1500, 3000, 9999, 10000])
        words.append((k, seq, rng.choice(["yeah", "uh-huh", "right", "the", "cook", "oh"]), t[k], e))
        t[k] = e
    return words


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [T.BLOCK, 20_000, 3_000])
def test_labels_equal_fold(spark, seed, block):
    """Whatever the length of blocks at which calls are cut into scenes."""
    rng = random.Random(seed)
    calls = {f"c{k}": call(rng, rng.randrange(1, 40)) for k in range(25)}
    rows = [(c, *w) for c, ws in calls.items() for w in ws]
    placed = T.scenes(spark.createDataFrame(rows, WORDS), block)
    got = {}
    for r in T.event_segments(placed, clip=False).collect():
        got.setdefault(r.conv_id, []).append((r.start, r.end, r.label, r.initiator))
    assert {c: sorted(x) for c, x in got.items()} == {c: labels_of(ws) for c, ws in calls.items()}
    n = placed.select("conv_id", "scene").distinct().count()
    assert n == len(calls) if block == T.BLOCK else n > 2 * len(calls)


def test_hot_call_is_spread(spark):
    """A call with a third of all words is as many scenes as it has blocks; none is much larger than the others."""
    hot = [("hot", k % 2, k, "cook", 4000 * k, 4000 * k + 3000) for k in range(3000)]
    rest = [(f"c{j}", k % 2, k, "cook", 4000 * k, 4000 * k + 3000) for j in range(20) for k in range(300)]
    sizes = [r["count"] for r in T.scenes(spark.createDataFrame(hot + rest, WORDS), 400_000).groupBy("conv_id", "scene").count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2] and len(sizes) > 80


def test_speech_without_pause_is_one_scene(spark):
    rows = [("c", k % 2, k, "cook", 1000 * k, 1000 * k + 1500) for k in range(200)]
    assert T.scenes(spark.createDataFrame(rows, WORDS), 10_000).select("scene").distinct().count() == 1


def clipped(words):
    """User words trimmed one overlap after the other."""
    user = [list(w) for w in words if w[0] == 0]
    agents = units_of([w for w in words if w[0] == 1])
    for u in units_of([tuple(w) for w in user]):
        bc = short(u)
        for a in agents:
            n = min(u["e"], a["e"]) - max(u["s"], a["s"])
            if not 0 < n < 500 or bc or short(a):
                continue
            inside = [w for w in user if u["s"] <= w[3] < u["e"]]
            if u["s"] < a["s"] < u["e"] <= a["e"]:
                for w in inside:
                    if w[4] > a["s"]:
                        w[4] = a["s"]
                        w[3] = min(w[3], w[4] - 1)
                u["e"] = a["s"]
            elif a["s"] <= u["s"] < a["e"] < u["e"]:
                for w in inside:
                    if w[3] < a["e"]:
                        w[3] = a["e"]
                        w[4] = max(w[4], w[3] + 1)
                u["s"] = a["e"]
    return sorted(map(tuple, user))


@pytest.mark.parametrize(("seed", "block"), [(0, T.BLOCK), (1, 20_000), (2, 5_000)])
def test_clipping_equals_fold(spark, seed, block):
    rng = random.Random(seed)
    calls = {}
    for k in range(40):
        words, t = [], [0, 0]
        for seq in range(rng.randrange(2, 20)):
            j = rng.randrange(2)
            t[j] = max(t[j], t[1 - j] - rng.choice([0, 100, 400, 499, 500, 2000])) + rng.choice([0, 50, 400, 3000])
            e = t[j] + rng.choice([200, 700, 3000, 12000])
            words.append((j, seq, rng.choice(["yeah", "cook", "plum", "door"]), t[j], e))
            t[j] = e + rng.choice([0, 400])
        calls[f"c{k}"] = words
    df = spark.createDataFrame([(c, *w) for c, ws in calls.items() for w in ws], WORDS)
    got = {}
    for r in T.clip_small_overlaps(T.scenes(df, block)).where("spk = 0").collect():
        got.setdefault(r.conv_id, []).append((0, r.seq, r.text, r.s, r.e))
    want = {c: clipped(ws) for c, ws in calls.items()}
    assert {c: sorted(x) for c, x in got.items()} == {c: w for c, w in want.items() if w}
    assert any(w != sorted(x for x in calls[c] if x[0] == 0) for c, w in want.items())


@pytest.mark.parametrize(("gap", "n"), [(319, 1), (320, 2), (321, 2)])
def test_pause_edge(spark, gap, n):
    df = spark.createDataFrame([("c", 0, 1, "a", 0, 1000), ("c", 0, 2, "b", 1000 + gap, 3000)], WORDS)
    assert T.pausal_units(df).count() == n


def test_unit_ends_with_its_last_word(spark):
    df = spark.createDataFrame([("c", 0, 1, "a", 0, 5000), ("c", 0, 2, "b", 100, 300)], WORDS)
    r = T.pausal_units(df).first()
    assert (r.s, r.e, r.text) == (0, 300, "a b")


def test_half_even_units(spark):
    df = spark.createDataFrame([(0.00005,), (0.00015,), (0.00025,)], "x double")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(T.units(F.col("x"))).collect()] == [round(x * 10000) for x in (0.00005, 0.00015, 0.00025)]


def test_end_repair(spark):
    rows = [("c", 0, 1, "a", 0.0, 0.0), ("c", 0, 2, "b", 0.2, 0.1), ("c", 0, 3, "b", 0.2, 0.2), ("c", 0, 4, "d", 5.0, 5.0), ("c", 0, 5, "e", 6.0, 6.3)]
    got = T.repair_ends(spark.createDataFrame(rows, "conv_id string, spk int, seq long, text string, start double, end double")).orderBy("seq").collect()
    assert [round(r.end, 6) for r in got] == [0.2, 0.7, 0.7, 5.5, 6.3]


def test_asr_merge_and_runs(spark):
    rows = [("c", 0, 1, "a", 0.0, 1.0), ("c", 0, 2, " b", 1.1, 2.0), ("c", 0, 3, "<SIL>", 2.0, 2.6), ("c", 0, 4, "<SIL>", 2.6, 3.2), ("c", 0, 5, "c", 4.0, 5.0)]
    got = T.merge_asr(spark.createDataFrame(rows, "conv_id string, spk int, seq long, text string, start double, end double")).orderBy("run").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("a b", 0.0, 2.0), ("<SIL>", 2.0, 3.2), ("c", 3.2, 5.0)]


@pytest.mark.parametrize("block", [300.0, 7.0, 0.5])
def test_runs_equal_fold(spark, block):
    """Runs that end in their block, that cross an edge, and that span several blocks."""
    rng = random.Random(8)
    rows, calls = [], {}
    for c in range(8):
        t, who = 0.0, 0
        for seq in range(60):
            t += rng.choice([0.0, 0.1, 0.4, 3.0])
            who = 1 - who if rng.random() < 0.3 else who
            text = rng.choice(["a", "b", "<SIL>"])
            calls.setdefault(f"c{c}", []).append((t, seq, who, text))
            rows.append((f"c{c}", who, seq, text, t, t + 0.1))
    df = spark.createDataFrame(rows, "conv_id string, spk int, seq long, text string, start double, end double")
    got = {}
    for r in T.speaker_runs(df, block).orderBy("conv_id", "run").collect():
        got.setdefault(r.conv_id, []).append((r.run, r.spk, r.start, r.text))
    merged = {}
    for r in T.merge_asr(df, block).orderBy("conv_id", "spk", "run").collect():
        merged.setdefault((r.conv_id, r.spk), []).append((r.run, r.text, round(r.start, 6), round(r.end, 6)))
    for c, lines in calls.items():
        want = []
        for t, seq, who, text in sorted(lines):
            if want and want[-1][1] == who:
                want[-1][3] += text + " "
            else:
                want.append([len(want) + 1, who, t, text + " "])
        assert got[c] == [tuple(w) for w in want]
        for who in (0, 1):
            want = []
            for t, seq, k, text in sorted(lines):
                if k != who:
                    continue
                if want and (want[-1][1] == "<SIL>") == (text == "<SIL>"):
                    want[-1][1] = "<SIL>" if text == "<SIL>" else want[-1][1] + text
                    want[-1][3] = round(t + 0.1, 6)
                else:
                    start = t if text == "<SIL>" or not want else want[-1][3]
                    want.append([len(want) + 1, text, round(start, 6), round(t + 0.1, 6)])
            assert merged.get((c, who), []) == [tuple(w) for w in want]


@pytest.mark.parametrize("block", [300.0, 2.0])
def test_named_speakers(spark, block):
    rows = [("c", None, 1, 0.0), ("c", 1, 2, 1.0), ("c", None, 3, 9.0), ("c", None, 4, 30.0), ("c", 0, 5, 30.0), ("c", None, 6, 31.0), ("d", None, 1, 5.0)]
    got = T.named_speakers(spark.createDataFrame(rows, "conv_id string, spk int, seq long, start double"), block).orderBy("conv_id", "seq").collect()
    assert [r.spk for r in got] == [None, 1, 1, 1, 0, 0, None]


@pytest.mark.parametrize(("text", "spk"), [("A: yes", 0), (">> b> no", 1), ("(A) - so", 0), ("Speaker B: x", 1), ("ch1: x", 0), ("7:40 it is", None), ("Bees: many", None), ("a plain line", None), (None, None)])
def test_speaker_in_text(spark, text, spk):
    from pyspark.sql import functions as F

    from talkweave.functions.text import speaker_in_text

    assert spark.createDataFrame([(text,)], "t string").select(speaker_in_text(F.col("t"))).first()[0] == spk


@pytest.mark.parametrize("size", [3600.0, 3.0])
def test_as_of(spark, size):
    from pyspark.sql import functions as F

    from talkweave.operators.joins import as_of

    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 50, "c"), ("j", 3, "d"), ("k", None, "e")], "key string, t int, name string")
    right = spark.createDataFrame([("k", 1, 10), ("k", 4, 40), ("k", 5, 50), ("k", 51, 99), ("k", 6, None)], "key string, t int, v int")
    got = {r.name: r.got for r in as_of(left, right, "key", "t", F.col("v"), "got", size).collect()}
    assert got == {"a": 10, "b": 50, "c": 50, "d": None, "e": None}


def test_interpolation(spark):
    rows = [("c", 1, 0, "ab", 1.0, 2.0), ("c", 1, 1, "cdef", 1.0, 2.0), ("c", 1, 2, "gh", 1.0, 2.0)]
    got = T.interpolate(spark.createDataFrame(rows, "conv_id string, seq long, pos int, text string, utt_start double, utt_end double"), ["conv_id", "seq"], "pos").orderBy("pos").collect()
    assert [(r.start, r.end) for r in got] == [(1.0, 1.25), (1.25, 1.75), (1.75, 2.0)]


def test_empty(spark):
    df = spark.createDataFrame([], WORDS)
    assert T.event_segments(df).count() == 0 and T.clip_small_overlaps(df).count() == 0
