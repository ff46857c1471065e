"""Queries over small tables whose whole result is known."""

import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import chat
from talkweave.plans import chat as chat_plans, joins


def test_partner_semi_exact_callers(spark, tmp_path):
    """Callers 50 apart are not the same; every call of a pair of callers is there, with its id."""
    rows = [("a", 1, 2), ("b", 2, 1), ("c", 51, 2), ("d", 2, 101), ("e", 1, 2), ("e", 1, 2), ("f", 7, 7), ("g", None, 1), ("h", 1, None)]
    spark.createDataFrame(rows, "call_id string, caller_a long, caller_b long").write.parquet(f"{tmp_path}/call_meta.parquet")
    got = joins.partner_semi(spark, str(tmp_path)).select("call_id", "a", "b").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 2), ("b", 2, 1), ("e", 1, 2), ("f", 7, 7)]


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("<br>", "empty"), ("<p></p>", "empty"), ("&nbsp;", "empty"), ("<b>!!!</b>", "only_symbols"), ("<p>yes</p>", None), ("<div>" * 9 + "short words here" + "</div>" * 9, None), ("<p>User</p>hello", "prompt_leakage"),
        ("<a href='https://example.org/a/long/address'>here</a>", None), ("<p>costs &#36;5</p>", "contains_math"), ("x <y", None),
    ],
)
def test_turn_reasons_without_markup(spark, text, why):
    df = spark.createDataFrame([("a", 0, "human", text)], "id string, turn int, role string, value string")
    assert chat.turn_reasons(df).first().why == why
    assert chat.turn_reasons(df).first().value == text


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("a<br>b", "a\nb"), ("if x < 3 and y > 2 <i>then</i>", "if x < 3 and y > 2 \nthen"), ("R&amp;D, AT&T &lt;b&gt;", "R&D, AT&T <b>"), ("a<!-- <b> no -->b", "a\nb"), ("<script>var x</script>ok", "ok"), ("a\n\n\n\nb ", "a\n\nb"),
        ('<a title="1 > 0">link</a>', "link"), ("<ul><li>a</li> <li><p>b</p></li></ul>", "- a \n- b"), (None, None), ("&#8217;&#146;&#xD800;&#99999999;", "\u2019\u2019\ufffd\ufffd"),
    ],
)
def test_html_to_text(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(chat.html_to_text(F.col("t"))).first()[0] == plain


def test_html_text_converts_every_turn(spark, tmp_path):
    rows = [("a", 0, "human", "<div>x</div>", 1), ("a", 1, "gpt", "b<br>c", 1), ("a", 2, "human", "plain &amp; short", 1), ("a", 3, "gpt", "<p>y</p>", 1), ("a", 4, "human", None, 1)]
    spark.createDataFrame(rows, "id string, turn int, role string, value string, ingested_at long").write.parquet(f"{tmp_path}/conversation_turn.parquet")
    assert {r.turn: r.text for r in chat_plans.html_text(spark, str(tmp_path)).collect()} == {0: "x", 1: "b\nc", 2: "plain & short", 3: "y", 4: ""}


@pytest.mark.parametrize(
    ("text", "logprob", "simultaneous", "whole"),
    [
        ("Thank you.", -0.31, True, True), ("Thank you.", -0.3, False, False), ("well, THANK YOU so much", -0.9, True, False), ("See you next time.", -0.9, True, False), ("so see you next time.", -0.9, True, True),
        ("goodbye", -0.9, True, False), ("hello there", -0.9, False, False), (None, -0.9, False, False), ("Bye.", None, False, False),
    ],
)
def test_is_hallucination(spark, text, logprob, simultaneous, whole):
    t, p = F.col("t"), F.col("p")
    r = spark.createDataFrame([(text, logprob)], "t string, p double").select(X.is_hallucination(t, p, True).alias("a"), X.is_hallucination(t, p, False).alias("b")).first()
    assert (r.a, r.b) == (simultaneous, whole)
