"""Rules over chats, each at its edge."""

import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import chat as C

TURN = "id string, turn int, role string, value string"


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("fine words here", None), ("", "empty"), ("  \t", "empty"), ("!!! ...", "only_symbols"), ("x Copy code y", "code_artifact"), ("{}[]<> ab", "high_symbol_density"), ("see ```x``` there", "contains_markdown_code"),
        ("costs $5", "contains_math"), (r"a \frac b", "contains_math"), ("w " * 400, None), ("w " * 401, "en_too_long"), ("字" * 9 + "一二三四五" * 118 + "六", None), ("一二三四五" * 121, "cjk_too_long"), ("哈" * 21, "repetitive_chinese"), ("a" * 26, "high_avg_word_len"), ("User\nhello", "prompt_leakage"), ("System\nYou are", "prompt_leakage"),
    ],
)
def test_turn_reasons(spark, text, why):
    df = spark.createDataFrame([("a", 0, "user", text)], TURN)
    assert C.turn_reasons(df).first().why == why


@pytest.mark.parametrize(
    ("roles", "why"),
    [
        (["human", "gpt"], None), (["system", "human", "gpt", "human"], None), (["human"], "single_role"), (["system", "human"], "single_role"), (["human", "system", "gpt"], "system_prompt_in_middle"), (["gpt", "human"], "start_with_bot"),
        (["human", "gpt", "gpt"], "consecutive_bot"), (["human", "user", "gpt"], "consecutive_user"), (["Human", "bing"], None), (["human", "who knows"], None), (["用户", "助手"], None), (["human", "HUMAN"], "single_role"),
    ],
)
def test_structure(spark, roles, why):
    df = spark.createDataFrame([("a", k, r, "x") for k, r in enumerate(roles)], TURN)
    assert C.structure_reasons(df).first().reason == why
    assert C.dialogue_reasons(df).first().reason == (why and f"Structure: {why}")


def test_first_bad_turn_rejects(spark):
    df = spark.createDataFrame([("a", 0, "human", "ok then"), ("a", 1, "gpt", "$"), ("a", 2, "human", "")], TURN)
    assert C.dialogue_reasons(df).first().reason == "Content: only_symbols"


@pytest.mark.parametrize(("text", "why"), [("fine", None), ("a - b", "contain list"), ("(a) x", "contain list"), ("1. x", "contain list"), ("**x**", "markdown format"), ("w " * 101, "en exceed length limit"), ("字" * 151, "cjk exceed length limit")])
def test_spoken(spark, text, why):
    assert spark.createDataFrame([(text,)], "value string").select(C.spoken_reason(F.col("value"))).first()[0] == why


@pytest.mark.parametrize(("text", "only", "meaning"), [("", True, False), ("...", True, False), (" . ", True, False), ("a.", False, True), ("。", False, True), (" ", True, False)])
def test_punctuation(spark, text, only, meaning):
    r = spark.createDataFrame([(text,)], "t string").select(X.is_punctuation(F.col("t")).alias("a"), X.is_meaningful(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (only, meaning)


def test_html_and_clauses(spark):
    r = spark.createDataFrame([("<ul><li><p>a</p></li><li>b</li></ul><div>c</div>",)], "t string").select(C.html_to_text(F.col("t"))).first()[0]
    assert r.split() == ["-", "a", "-", "b", "c"]
    got = spark.createDataFrame([("Well, the 1,000 cooks wait. Yes!\nReally; ... 好，走。",)], "t string").select(C.clauses(F.col("t"))).first()[0]
    assert [c.strip() for c in got] == ["Well,", "the 1,000 cooks wait.", "Yes!", "Really;", "好，", "走。"]


def test_tapes(spark):
    df = spark.createDataFrame([("a", 0, "system", "x"), ("a", 1, "human", "Hi, you."), ("a", 2, "gpt", "Yes, me."), ("b", 0, "gpt", "...")], TURN)
    got = {r.id: r.tape for r in C.chat_tapes(df, "assistant", F.lit(1)).collect()}
    p = "<interlocutor>"
    assert got["a"] == [p + "<SIL>", "[C.LISTEN]", p + "Hi,", "[C.LISTEN]", p + " you.", "[S.SPEAK]", "Yes,", "[C.SPEAK]", "me.", "[S.LISTEN.NATURAL]"]
    assert got["b"] == ["[S.LISTEN.NATURAL]"]
    user = {r.id: r.tape for r in C.chat_tapes(df, "user", F.lit(0)).collect()}
    assert user["a"] == ["[S.SPEAK]", "Hi,", "[C.SPEAK]", "you.", "[S.LISTEN.NATURAL]", p + "Yes,", "[C.LISTEN]", p + " me."] and "b" not in user


def test_consistency(spark):
    i = spark.createDataFrame([("a", 0, "human", ""), ("b", 0, "human", ""), ("b", 1, "gpt", ""), ("c", 0, "human", ""), ("d", 0, "human", "")], TURN)
    o = spark.createDataFrame([("a", 0, "human", ""), ("b", 0, "human", ""), ("c", 0, "gpt", "")], TURN)
    assert {r.id: r.outcome for r in C.consistency(i, o).collect()} == {"a": "passed", "b": "turn_count", "c": "role", "d": "filtered"}


def test_cleaning(spark):
    r = spark.createDataFrame([("m[aybe]- [laughter-tie] [noise] week_1 <b_aside> x", "i._b._m. [mn] ((so there)) [noise] y- well - ok")], "a string, b string").select(X.clean_switchboard(F.col("a")), X.clean_fisher(F.col("b"))).first()
    assert tuple(r) == ("maybe- tie week x", "i.b.m. mhm so there well ok")
    assert spark.createDataFrame([("[noise]",)], "a string").select(X.clean_fisher(F.col("a"))).first()[0] is None


def test_top_and_other(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", 1)], "reason string, n long")
    assert {tuple(r) for r in C.top_and_other(df, "reason", "n", 3).collect()} == {("a", 5), ("b", 3), ("c", 3), ("Other", 2)}
