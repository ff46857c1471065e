"""Tapes: every rule of writing a segment, the merging of tokens, clauses, and validity."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from talkweave.functions.vocab import TRANSITIONS
from talkweave.operators import sampling as S
from talkweave.operators import tape as P

I = "<interlocutor>"  # noqa: E741


@pytest.mark.parametrize(
    ("label", "who", "floor", "before", "heard", "own", "last", "tape"),
    [
        ("T", 0, 0, "G", ["a", "b"], [], None, ["[C.LISTEN]", I + "a", "[C.LISTEN]", I + "b"]),
        ("T", 0, 0, None, ["a"], [], None, [I + "a"]),
        ("T", 0, 0, "C", ["a"], [], "x", ["[S.LISTEN.NATURAL]", I + "a"]),
        ("T", 1, 1, "G", ["a"], ["x", "y"], None, ["[S.SPEAK]", "x", "y"]),
        ("P", None, 0, "C", ["<SIL>"], [], "x", ["[C.LISTEN]", I + "<SIL>"]),
        ("P", None, 0, "C", [], [], "x", []),
        ("P", None, 1, "C", ["<SIL>"], [], "x", []),
        ("G", None, 0, "C", ["<SIL>"], [], "x", ["[C.LISTEN]", I + "<SIL>"]),
        ("G", None, 1, "C", ["<SIL>"], [], "x", ["[S.LISTEN.NATURAL]", I + "<SIL>"]),
        ("G", None, None, None, ["<SIL>"], [], None, [I + "<SIL>"]),
        ("IF", 0, 0, "C", ["a", "b"], ["x"], "x", ["[C.SPEAK]", "x", I + "a", "[S.LISTEN.INTERRUPT]", I + "b", "[C.LISTEN]"]),
        ("IF", 1, 1, "C", ["a", "<SIL>", "b"], ["x"], "x", ["[S.SPEAK]", "x", I + "a", "[C.SPEAK]", I + "b"]),
        ("IB", 0, 1, "C", ["a", "b"], ["x"], "x", ["[C.SPEAK]", "x", I + "a", "[C.SPEAK]", I + "b"]),
        ("BC", None, 1, "C", ["a"], ["x"], "x", ["[C.SPEAK]", "x", I + "a"]),
        ("IB", 1, 0, "C", ["a", "b"], ["x"], "x", ["[S.SPEAK]", "x", I + "a", "[S.LISTEN.INTERRUPT]", I + "b", "[C.LISTEN]"]),
        ("BC", 1, 0, "C", ["a"], ["x"], "x", ["[S.SPEAK]", "x", I + "a", "[S.LISTEN.NATURAL]"]),
        ("C", 0, 0, "P", ["a"], [], "x", ["[C.LISTEN]", I + "a"]),
        ("C", 0, 0, "P", ["a"], [], "[C.LISTEN]", [I + "a"]),
        ("C", 1, 1, "P", [], ["x"], "y", ["[C.SPEAK]", "x"]),
        ("C", 1, 1, "P", [], ["x"], "[C.SPEAK]", ["x"]),
    ],
)
def test_rules(spark, label, who, floor, before, heard, own, last, tape):
    schema = "label string, who int, floor int, before string, heard array<string>, own array<string>, after boolean"
    df = spark.createDataFrame([(label, who, floor, before, heard, own, last in TRANSITIONS)], schema)
    rule = P.rule_of(F.col("label"), F.col("who"), F.col("floor"), F.col("before"))
    assert df.select(P.written(rule, F.col("heard"), F.col("own"), F.col("after"))).first()[0] == tape


def joined(a, b):
    """The step between the state before `a` and the state after `b`."""
    speaks_before, speaks_after = a not in ("[S.SPEAK]", "[C.LISTEN]"), b in ("[C.SPEAK]", "[S.SPEAK]")
    if speaks_after:
        return "[C.SPEAK]" if speaks_before else "[S.SPEAK]"
    return "[C.LISTEN]" if not speaks_before else a if a.startswith("[S.") else b


def test_merging_keeps_the_states(spark):
    speaks_before = {"[C.SPEAK]", "[S.LISTEN.INTERRUPT]", "[S.LISTEN.NATURAL]"}
    speaks_after = {"[C.SPEAK]", "[S.SPEAK]"}
    pairs = spark.createDataFrame(list(itertools.product(TRANSITIONS, TRANSITIONS)), "a string, b string")
    for a, b, m in pairs.select("a", "b", P.met(F.col("a"), F.col("b"))).collect():
        assert m == joined(a, b)
        if (a, b) == ("[C.SPEAK]", "[C.LISTEN]"):
            continue  # no two neighbouring segments meet like this
        assert (m in speaks_before) == (a in speaks_before) and (m in speaks_after) == (b in speaks_after)


def plain_tape(parts, trim, cut):
    """A tape entry by entry from the parts of its segments: (token, segment)."""
    tape = []
    for k, part in enumerate(parts):
        for i, x in enumerate(part):
            if i == 0 and tape and x in TRANSITIONS and tape[-1][0] in TRANSITIONS:
                t = joined(tape[-1][0], x)
                tape[-1] = tape[-1] if t == tape[-1][0] else (t, k)
            else:
                tape.append((x, k))
    quiet = lambda x: "<SIL>" in x or x == "[C.LISTEN]"
    if trim:
        out = []
        for x, k in tape:
            n = len(out)
            while x == "[S.SPEAK]" and n and quiet(out[n - 1][0]):
                n -= 1
            if x == "[S.SPEAK]" and n and out[n - 1][0].startswith(I):
                del out[n:]
            out.append((x, k))
        tape = out
    if cut:
        own = lambda j: 0 <= j < len(tape) and tape[j][0] not in TRANSITIONS and not tape[j][0].startswith(I)
        tape = [e for j, e in enumerate(tape) if not (e[0] == "[C.SPEAK]" and own(j - 1) and own(j + 1))]
        out, text = [], []
        for j, (x, k) in enumerate(tape):
            if not own(j):
                out.append((x, k))
                continue
            text.append((x, k))
            if not own(j + 1):
                said = re.split(r"(?<=[.!?])\s+|(?<=[,;:])(?=\s)|(?<=[。！？，；：、])", " ".join(w for w, _ in text))
                for i, c in enumerate(c.strip() for c in said if re.search(r"\w", c)):
                    out += [("[C.SPEAK]", text[0][1])] * bool(i) + [(c, text[0][1])]
                text = []
        tape = out
    return tape


@pytest.mark.parametrize(("block", "trim", "cut"), [(3_000_000, False, True), (30_000, True, False), (6_000, True, True), (6_000, False, False)])
def test_tapes_equal_fold(spark, block, trim, cut):
    """Whatever the length of the blocks at which a call is cut."""
    from talkweave.operators import timeline as T

    rng = random.Random(block)
    schema = "conv_id string, spk int, seq long, text string, s long, e long"
    words, silences = [], []
    for c in range(12):
        t = [rng.choice([0, 500]), 700]
        for seq in range(50):
            k = rng.randrange(2)
            t[k] = max(t[k], t[1 - k] - rng.choice([0, 0, 1500, 4000])) + rng.choice([0, 100, 319, 321, 7000])
            e = t[k] + rng.choice([400, 1500, 3000, 10000])
            words.append((f"c{c}", k, seq, rng.choice(["yeah", "uh-huh", "the,", "cook.", "oh"]), t[k], e))
            t[k] = e
            if rng.random() < 0.4:
                silences.append((f"c{c}", 0, 1000 + seq, "<SIL>", e + rng.randrange(3000), e + 6400))
    w, q = spark.createDataFrame(words, schema), spark.createDataFrame(silences, schema)
    timed = T.clipped_once(T.scenes(w.unionByName(q), 10**9))
    segments = T.event_segments(timed.where("text <> '<SIL>'"), clip=False)
    placed = T.words_in_segments(timed, segments).where("e > start").collect()
    floor = T.floor_holders(segments).orderBy("conv_id", "start").collect()
    cases, before = [], {}
    for r in floor:
        mine = sorted((x.s, x.seq, x.spk, x.text) for x in placed if x.conv_id == r.conv_id and x.start == r.start)
        cases.append((r.conv_id, r.start, r.label, r.initiator, r.floor, before.get(r.conv_id), [x[3] for x in mine if x[2] == 0], [x[3] for x in mine if x[2] == 1]))
        before[r.conv_id] = r.label
    df = spark.createDataFrame(cases, "conv_id string, start long, label string, who int, floor int, before string, heard array<string>, own array<string>")
    ruled = df.withColumn("rule", P.rule_of(F.col("label"), F.col("who"), F.col("floor"), F.col("before")))
    each = {}
    for r in ruled.select("conv_id", "start", *[P.written(F.col("rule"), F.col("heard"), F.col("own"), F.lit(x)).alias(f"w{int(x)}") for x in (False, True)]).orderBy("start").collect():
        parts = each.setdefault(r.conv_id, [])
        last = next((p[-1] for p in reversed(parts) if p), None)
        parts.append(list(r.w1 if last in TRANSITIONS else r.w0))
    got = {}
    for r in P.call_tapes(w, q, clauses=cut, trim_gaps=trim, block=block).orderBy("conv_id", "pos").collect():
        got.setdefault(r.conv_id, []).append((r.token, r.segment))
        assert r.pos == len(got[r.conv_id]) - 1
    assert got == {c: plain_tape(parts, trim, cut) for c, parts in each.items()}


def test_complemented(spark):
    df = spark.createDataFrame([(["<SIL>"], 20000), (["<SIL>"] * 4, 20000), ([], 6399), ([], 6400)], "x array<string>, n long")
    assert [len(r[0]) for r in df.select(P.complemented(F.col("x"), F.col("n"))).collect()] == [3, 4, 0, 1]


@pytest.mark.parametrize(
    ("tape", "bad"),
    [
        ([], None), ([I + "a", "[S.SPEAK]", "x", "[C.SPEAK]", "y", "[S.LISTEN.NATURAL]", I + "b", "[C.LISTEN]", I + "c"], None),
        (["[C.SPEAK]"], 0), (["[S.LISTEN.INTERRUPT]"], 0), (["[S.SPEAK]", "x", "[S.SPEAK]"], 2), (["[S.SPEAK]", "x", "[C.LISTEN]"], 2), ([I + "a", I + "b"], 1), (["[C.LISTEN]", "[S.SPEAK]"], 1), ([I + "a", "[S.SPEAK]", "x", "[S.LISTEN.NATURAL]", "[C.LISTEN]"], 4),
    ],
)
def test_validity(spark, tape, bad):
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(tape)], "id string, pos int, token string")
    got = P.first_errors(df, "id").collect()
    assert (got[0].first_bad if got else None) == bad


def test_probe_and_history(spark):
    tape = [I + "so?", "[C.LISTEN]", I + " now.", "[S.SPEAK]", "Yes,", "[C.SPEAK]", "we do.", "[S.LISTEN.NATURAL]"]
    df = spark.createDataFrame([(tape,)], "tape array<string>")
    r = df.select(P.unpunctuated(F.col("tape")).alias("u"), P.forced_probe(F.col("tape"), F.lit(1)).alias("p"), P.forced_probe(F.col("tape"), F.lit(7)).alias("q"), P.history(F.col("tape")).alias("h")).first()
    assert r.u[0] == I + "so" and r.u[2] == I + " now" and r.u[4] == "Yes,"
    assert r.p[1] == "[S.LISTEN.INTERRUPT]" and r.p[3] == r.p[5] == "[C.LISTEN]" and r.p[-1] == "[S.SPEAK]"
    assert r.q[-3:] == ["[S.LISTEN.INTERRUPT]", "<SIL>", "[S.SPEAK]"]
    assert r.h == "USER: so? now.\nASSISTANT: Yes, we do."


def test_tapes_of_calls_hold_every_word_once(spark):
    from talkweave.plans import tape as plans, timeline

    folder = "/root/testdata/sf0.001"
    tokens = plans.boundary_merge(spark, folder).where("NOT token LIKE '[%' AND NOT token LIKE '%<SIL>%'")
    placed = timeline.T.words_in_segments(*timeline.placed(spark, folder)).where("e > start")
    # own words that no rule writes (in the other's pauses) are the only ones missing
    assert 0.97 * placed.count() <= tokens.count() <= placed.count()


def test_seeded_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("total", F.lit(0)).drop("total")
    ranked = S.hash_ranked(df, "k").cache()
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1000))
    counts = {r.split: r["count"] for r in S.split_names(ranked).groupBy("split").count().collect()}
    assert counts == {"train": 700, "val": 100, "test": 200}
    for scale in (0.25, 1.0, 2.5):
        assert S.resampled(ranked, scale).count() == int(1000 * scale)
    again = {r.k: r["rank"] for r in S.hash_ranked(df.repartition(7), "k").collect()}
    assert again == {r.k: r["rank"] for r in ranked.collect()}
