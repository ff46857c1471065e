"""Training rows, metrics and joins against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talkweave.functions.vocab import TRANSITIONS
from talkweave.operators import joins as J
from talkweave.operators import metrics as M
from talkweave.operators import synthetic as Y
from talkweave.operators import trainset as N


def test_masks_and_counts(spark):
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(["<interlocutor>a b", "[S.SPEAK]", "c d", "[S.LISTEN.NATURAL]"])], "id string, pos int, token string")
    got = [(r.token, r["mask"]) for r in N.token_rows(df, "id").orderBy("pos", "part").collect()]
    assert got == [("<user>", 0), ("a", 0), ("b", 0), ("[S.SPEAK]", 6), ("c", 1), ("d", 1), ("[S.LISTEN.NATURAL]", 5)]
    shares = {r.token: r.n for r in N.class_shares(N.token_counts(N.token_rows(df, "id"))).collect()}
    assert shares == {"[S.SPEAK]": 1, "[S.LISTEN.NATURAL]": 1, "response": 2}
    prior = {r.token: r.adjustment for r in N.class_priors(N.token_counts(N.token_rows(df, "id")), 2.0, "transition").collect()}
    assert prior["[S.SPEAK]"] == pytest.approx(2 * math.log(0.5), abs=1e-6) and prior["response"] == pytest.approx(2 * math.log(0.5), abs=1e-6)


def test_slices(spark):
    got = [(r.start, r["size"]) for r in N.slices(spark.createDataFrame([("a", 20), ("b", 0)], "id string, length int"), "id", 11, 2, 1).orderBy("start").collect()]
    assert got == [(0, 11), (7, 11), (14, 9)]  # eight tokens of content, a prompt of two, an end mark
    with pytest.raises(ValueError):
        N.slices(spark.createDataFrame([("a", 20)], "id string, length int"), "id", 3, 2, 1)


def test_packing_stats(spark):
    lengths = spark.createDataFrame([("a", 6), ("b", 2)], "id string, length int")
    packed = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "batch long, box long")
    r = N.packing_stats(lengths, packed, 8).first()
    assert (r.n, r.total, r.longest, r.shortest, r.n_packed) == (2, 8, 6, 2, 3) and r.efficiency == pytest.approx(8 / 24)
    assert N.packing_stats(lengths.limit(0), packed.limit(0), 8).first().efficiency == 0.0


def test_vocabulary_maps(spark):
    rows = [(t, k) for k, t in enumerate(TRANSITIONS)] + [("word", 9)]
    good = N.mask_vocabulary(spark.createDataFrame(rows + rows[:1], "token string, id long"))
    assert {(r.token, r.mask, r.id) for r in good.collect()} == {(t, k + 2, k) for k, t in enumerate(TRANSITIONS)}
    for bad in (rows[1:], [*rows, (TRANSITIONS[0], 77)]):
        with pytest.raises(Exception, match="not one id"):
            N.mask_vocabulary(spark.createDataFrame(bad, "token string, id long")).collect()
    other = N.mask_vocabulary(spark.createDataFrame([(t, k + (k == 3)) for t, k in rows], "token string, id long"))
    assert [r.token for r in N.maps_differ(good, other).collect()] == [TRANSITIONS[3]] and N.maps_differ(good, good).count() == 0


def test_priors_of_the_vocabulary(spark):
    counts = spark.createDataFrame([("[S.SPEAK]", 2), ("a", 5), ("b", 1)], "token string, n long")
    got = {r.token: r.adjustment for r in N.vocabulary_priors(counts).collect()}
    assert got == {"[S.SPEAK]": pytest.approx(math.log(0.25), abs=1e-6), "a": pytest.approx(math.log(0.75), abs=1e-6), "b": pytest.approx(math.log(0.75), abs=1e-6)}


def test_drawn_share(spark):
    df = spark.range(4000)
    assert df.where(N.drawn(F.col("id"), 0)).count() == 0 and df.where(N.drawn(F.col("id"), 16)).count() == 4000 and 900 < df.where(N.drawn(F.col("id"), 4)).count() < 1100


@pytest.mark.parametrize(("sizes", "boxes"), [([4, 4, 1], [0, 0, 1]), ([8, 1], [0, 1]), ([9, 1], [0, 1]), ([3, 3, 3, 3], [0, 0, 1, 1]), ([1], [0])])
def test_next_fit(spark, sizes, boxes):
    df = spark.createDataFrame([(0, k, n) for k, n in enumerate(sizes)], "batch long, place long, size long")
    assert [r.box for r in N.pack_next_fit(df, 8).orderBy("place").collect()] == boxes


def test_budget(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, 4), ("a", 2, 4), ("b", 0, 99)], "id string, turn int, n int")
    assert {(r.id, r.turn) for r in N.tail_budget(df, "id", "turn", "n", 8).collect()} == {("a", 1), ("a", 2), ("b", 0)}


def test_losses(spark):
    logits = [0.5, -1.0, 2.0, 1000.0]
    r = spark.createDataFrame([(logits, 2)], "x array<double>, y int").select(
        N.cross_entropy(F.col("x"), F.col("y")).alias("ce"), N.fuzzy(F.slice("x", 1, 3), [0]).alias("f"), N.argmax(F.col("x")).alias("a"), N.softmax_masked(F.slice("x", 1, 3), [2]).alias("p"),
    ).first()
    e = [math.exp(x) for x in logits[:3]]
    assert r.ce == pytest.approx(998.0) and r.f == pytest.approx(math.log(sum(e)) - math.log(e[1] + e[2])) and r.a == 3
    assert r.p[0] == pytest.approx(e[0] / (e[0] + e[1])) and r.p[2] == pytest.approx(0, abs=1e-9)
    rows = spark.createDataFrame([(1.0, 1, 2.0, 9.0), (3.0, 1, 1.0, 9.0), (5.0, 2, 9.0, 1.0), (7.0, 3, 9.0, 2.0), (100.0, 0, 1.0, 1.0)], "loss double, mask int, resp_w double, trans_w double")
    assert tuple(N.balanced_loss(rows).first()) == pytest.approx((5 / 3, 6.0, 5 / 3 + 6), abs=1e-6)
    assert tuple(N.token_loss(rows).first()) == pytest.approx((5 / 6, 19 / 6, 4.0), abs=1e-6)
    assert tuple(N.all_adjusted_loss(rows).first()) == pytest.approx((2.5, 9.5, 12.0), abs=1e-6)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_word_errors(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for _ in range(100)]
    got = spark.createDataFrame(rows, "r string, h string").select("r", "h", M.word_errors(F.col("r"), F.col("h")).alias("n")).collect()
    assert all(x.n == distance(x.r.split(), x.h.split()) for x in got)
    r = spark.createDataFrame([("I can't go, it's LATE.", "i can not go it is late"), ("", "x"), ("a b c d", "a x c")], "r string, h string").select(M.word_error_rate(F.col("r"), F.col("h"))).collect()
    assert [x[0] for x in r] == [0.0, None, 0.5]


def test_punctuation_of_any_script_goes_and_symbols_stay(spark):
    t = spark.createDataFrame([("«Ja», sagt’s er — $5 + 3 = 8 <x> 好。",)], "t string").select(M.comparable(F.col("t"))).first()[0]
    assert t.split() == ["ja", "sagts", "er", "$5", "+", "3", "=", "8", "<x>", "好"]


def test_word_errors_of_many_different_words(spark):
    """More different words than characters of the basic plane."""
    n = 50_000
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit("w"), k.cast("string")))
    text = lambda x: F.array_join(x, " ")
    tail = F.slice(words, n - 60, 61)  # words that stand last in the vocabulary
    both = spark.range(1).select(text(words).alias("all"), text(tail).alias("r"), text(F.filter(tail, lambda w: ~w.endswith("7"))).alias("h"))
    r = both.select(M.word_errors(F.concat_ws(" ", "r", "r"), F.concat_ws(" ", "h", "r")).alias("n"), M.word_errors(F.col("all"), F.lit("")).alias("whole")).first()
    assert (r.n, r.whole) == (6, n)
    # one word of the vocabulary's end against its neighbour: they must not get the same character
    v = spark.range(1).select(F.slice(words, 1, 44_000).alias("w")).select(M.word_errors(text(F.slice("w", 41_980, 10)), text(F.reverse(F.slice("w", 41_980, 10)))).alias("n")).first()
    assert v.n >= 9


def test_summary_and_gate(spark):
    rates = [0.0, 0.1, 0.1, 0.5, 1.5, None]
    r = M.error_summary(spark.createDataFrame([(x,) for x in rates], "wer double")).first()
    assert (r.n, r.n_bad, r.n_outliers, r.median) == (5, 2, 1, 0.1) and r.mean == pytest.approx(0.44) and r.mean_good == pytest.approx(0.2 / 3, abs=1e-9) and r.share_bad == 0.4
    assert M.error_summary(spark.createDataFrame([(0.1,), (0.4,)], "wer double")).first().median == 0.25
    assert M.error_summary(spark.createDataFrame([], "wer double")).first().n == 0


def test_transcript_wer(spark, tmp_path):
    from talkweave.plans import metrics

    asr = [("c", "A", 1, "hello there", 1.0, 1.0, 0.0, 0.5), ("c", "A", 3, "general", 3.0, 3.0, 2.0, 2.5), ("c", "A", 2, "<SIL>", 2.0, 2.0, 1.0, 1.5), ("c", "B", 4, "so far", 4.0, 4.0, 400.0, 401.0)]
    trans = [("c", 1, "A", 0.0, 1.0, "hello there [noise]"), ("c", 2, "A", 2.0, 3.0, "general kenobi"), ("c", 3, None, 3.0, 4.0, "yes"), ("c", 4, "B", 400.0, 401.0, "so far")]
    spark.createDataFrame(asr, "conv_id string, speaker_id string, seq long, text string, receive double, finish double, audio_start double, audio_end double").write.parquet(f"{tmp_path}/asr_stream.parquet")
    spark.createDataFrame(trans, "conv_id string, seq long, speaker_id string, start double, end double, text string").write.parquet(f"{tmp_path}/trans_stream.parquet")
    got = {r.spk: (r.errors, r.n_words, r.passes) for r in metrics.transcript_wer(spark, str(tmp_path)).collect()}
    assert got == {0: (2, 5, False), 1: (0, 2, True)}


def test_outcomes_and_metrics(spark):
    probes = [("m1", "MiU", 1, "[S.SPEAK]"), ("m1", "MiU", 2, "[C.LISTEN]"), ("m2", "MiU", 1, "[C.LISTEN]"), ("m2", "MiU", 2, "[S.SPEAK]"), ("u1", "UiM", 1, "[C.SPEAK]"), ("u1", "UiM", 2, "[S.LISTEN.INTERRUPT]"), ("u2", "UiM", 1, "[C.SPEAK]")]
    d = M.outcomes(spark.createDataFrame(probes, "id string, kind string, target int, response string"))
    assert {r.id: r.outcome for r in d.collect()} == {"m1": "mid", "m2": "end", "u1": "end", "u2": "miss"}
    judged = spark.createDataFrame([("m1", "MiU", "r", False, 1.0, 3.0), ("m2", "MiU", "r", True, 0.0, 0.0), ("u1", "UiM", "pain", True, 0.5, None)], "id string, kind string, reason string, at_end boolean, score double, content double")
    m = {r.name: r.value for r in M.interruption_metrics(d, judged).collect()}
    assert m["MiU_Precision"] == 1.0 and m["MiU_Recall"] == 1.0 and m["MiU_F1"] == 1.0 and m["UiM_MIR"] == 0.5 and m["UiM_PRR_pain"] == 0.5 and m["MiU_PRR_mid"] == 3.0


def test_f1(spark):
    rows = spark.createDataFrame([(2, 2, 2), (2, 2, 3), (3, 3, 3), (0, 2, 2), (1, 1, 3)], "mask int, label int, pred int").withColumn("k", F.lit(1))
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in M.class_counts(rows, ["k"], [2, 3]).collect()}
    assert got == {2: (1, 0, 1), 3: (1, 2, 0)}


def test_joins(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, t int, v string")
    assert {r.id: r.got for r in J.as_of(left, right, "k", "t", F.col("v"), "got").collect()} == {1: "y", 2: None, 3: None}
    chunks = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [10.0, 20.0])], "k string, at int, x array<double>")
    assert {r.sample: r.value for r in J.overlaid(chunks, "k", "at", "x", F.lit(2)).collect()} == {0: 1.0, 1: 12.0}
    rows = spark.createDataFrame([("c", "A", "B"), ("c", "B", "A"), ("d", "A", "B")], "k string, a string, b string")
    assert {r.k for r in J.both_directions(rows, "k", "a", "b").collect()} == {"c"}
    entries = spark.createDataFrame([("a", 1.0, "x", 0), ("a", 2.0, "x", 1), ("a", 2.0, "y", 2)], "k string, h double, t string, pos int")
    req = spark.createDataFrame([("a", 2.0, "x", 1), ("a", 9.0, "x", 2), ("a", 9.0, "q", 3)], "k string, h double, t string, n int")
    assert {r.n: r.found for r in J.located(req, entries, "k", "h", "t", "pos").collect()} == {1: 2, 2: 1, 3: None}


def test_synthetic(spark):
    raw = [("m", "USER: Hi, you.\n**ASSISTANT:** Yes.\n**ASSISTANT:** Yes."), ("u", "USER: Hi.\nASSISTANT: The cook is...\nUSER: Stop, please."), ("x", "USER: a\nUSER: b"), ("s", "USER: a")]
    df = spark.createDataFrame(raw, "task_id string, raw_response string")
    miu, uim = Y.parsed_test(df, True), Y.parsed_test(df, False)
    assert [(r.task_id, r.role) for r in miu.collect()] == [("m", "user")]
    assert {(r.turn, r.value) for r in uim.collect()} == {(0, "Hi."), (1, "The cook is<NOT_FINISHED>"), (2, "Stop, please.")}
    t = Y.test_tapes(miu, True).first()
    assert t.tape == ["<interlocutor>Hi,", "[C.LISTEN]", "<interlocutor> you.", "[S.SPEAK]"] and t.eval_targets == [1, 3]
    t = Y.test_tapes(uim, False).first()
    assert t.tape == ["<interlocutor>Hi.", "[S.SPEAK]", "The cook is", "<interlocutor>Stop,", "[C.SPEAK]", "<interlocutor> please.", "[C.SPEAK]"] and t.eval_targets == [4, 6]
    train = spark.createDataFrame([("k", "User: Hi.\nAssistant Content: The cook is...\nUser Content: ok\nAssistant Content: late again."), ("y", "User: Hi.\nAssistant Content: The cook is...\nUser Content: stop\nAssistant Content: Sure.")], "task_id string, raw_response string")
    tapes = {r.task_id: r.tape for r in Y.train_tapes(Y.parsed_train(train)).collect()}
    assert tapes["k"] == ["<interlocutor>Hi.", "[S.SPEAK]", "The cook is", "<interlocutor>ok", "[C.SPEAK]", "late again.", "[S.LISTEN.NATURAL]"]
    assert tapes["y"] == ["<interlocutor>Hi.", "[S.SPEAK]", "The cook is", "<interlocutor>stop", "[S.LISTEN.INTERRUPT]", "<SIL>", "[S.SPEAK]", "Sure.", "[S.LISTEN.NATURAL]"]
    p = Y.task_parameters(spark, 200, ["a", "b"]).collect()
    assert all(3 <= r.rounds <= 8 and len(set(r.events)) == 2 and max(r.events) <= r.rounds for r in p) and {r.topic for r in p} == {"a", "b"}
    n = {s: [r[0] for r in spark.range(4000).select(Y.silence_counts(F.col("id"), 0, 8, s)).collect()] for s in ("uniform", "triangular", "gaussian")}
    assert all(min(x) == 0 and max(x) <= 8 for x in n.values()) and sum(n["triangular"]) < sum(n["uniform"]) and abs(sum(n["gaussian"]) / 4000 - 3.5) < 0.3


def test_small_texts(spark):
    df = spark.createDataFrame([("<think>why</think> so", ["<SIL>", "a", "b"], "x [S.SPEAK] y", "Hi {{N}}!")], "t string, s array<string>, g string, p string")
    r = df.select(Y.reasoning_split(F.col("t")).alias("r"), Y.tape_prompt(F.col("s"), F.lit("S")).alias("s"), Y.from_first_token(F.col("g")).alias("g"), Y.filled_in(F.col("p"), {"N": F.lit("you")}).alias("p"), Y.clean_response(F.lit("a [C.SPEAK]b [S.LISTEN.NATURAL] c")).alias("c")).first()
    assert r.r.reasoning == "why" and r.r.response == "so" and r.s == "S<user>a[C.LISTEN]<user>b[S.SPEAK]" and r.g == "[S.SPEAK] y" and r.p == "Hi you!" and r.c == "a b"
