"""Alignment of texts, settings, and stages."""

import pytest
from pyspark.sql import functions as F

from talkweave.functions.config import Named, expanded, merged, overridden
from talkweave.operators import alignment as L
from talkweave.operators.stages import LOSSES, model_stage, run_stages


@pytest.mark.parametrize(("text", "counts", "pieces"), [(" a  b c ", [1, 2], [" a  ", "b c "]), ("a b", [1], ["a b"]), ("a b", [1, 1, 1], ["a b"]), ("a b c", [1, 1, 1], ["a ", "b ", "c"])])
def test_pieces(spark, text, counts, pieces):
    df = spark.createDataFrame([(text, counts)], "t string, n array<int>")
    assert df.select(L.split_at_counts(F.col("t"), F.col("n"))).first()[0] == pieces


def test_punctuation(spark):
    rows = [("a", 0, "x y", "X, y. Z!"), ("a", 1, "z", "X, y. Z!"), ("b", 0, "p q", "P."), ("b", 1, "r", "P.")]
    got = {(r.k, r.n): r.t for r in L.with_punctuation(spark.createDataFrame(rows, "k string, n int, t string, restored string"), ["k"], "n", "t", "restored").collect()}
    assert got == {("a", 0): "X, y.", ("a", 1): "Z!", ("b", 0): "p q", ("b", 1): "r"}


def test_letters(spark):
    df = spark.createDataFrame([("one 2 three.", ["one", "two", "three", "."])], "t string, w array<string>")
    assert df.select(L.letters_after(F.col("t"), F.col("w"))).first()[0] == [4, 4, 11, 12]


def test_names(spark):
    df = spark.createDataFrame([("test_UiM_pain_3", "icc_backchannel"), ("x", "y")], "i string, t string")
    assert [tuple(r) for r in df.select(L.reason_of(F.col("i")), L.evaluation_mode(F.col("t"))).collect()] == [("pain", "backchannel"), ("unknown", None)]


def test_settings():
    base = {"a": {"b": 1, "c": [1]}, "d": "${HOME}/x"}
    assert merged(base, {"a": {"b": 2}})["a"] == {"b": 2, "c": [1]} and base["a"]["b"] == 1
    assert overridden(base, ["a.b=3", "--e.f=text", "a.c=[2]"]) == {"a": {"b": 3, "c": [2]}, "d": "${HOME}/x", "e": {"f": "text"}}
    assert expanded(base, {"HOME": "/h"})["d"] == "/h/x"
    with pytest.raises(KeyError):
        expanded("${NO}", {})
    with pytest.raises(KeyError, match="token"):
        LOSSES["none"]
    choices = Named()
    choices.add("x")(len)
    assert choices["x"] is len


def test_stages(spark, tmp_path):
    df = model_stage(spark.createDataFrame([("a", 1)], "t string, n int"), lambda: lambda pdf: pdf["t"] + "!", "said")
    assert tuple(df.first()) == ("a", 1, "a!")
    runs = []
    stages = [("one", lambda s, d: runs.append(1) or s.range(3)), ("two", lambda s, d: runs.append(2) or d["one"].where("id > 0"))]
    for _ in range(2):
        assert run_stages(spark, str(tmp_path), stages)["two"].count() == 2
    assert runs == [1, 2]
