"""Defects of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from talkweave.llm import pairs as P
from talkweave.llm.language import sample_field


@pytest.fixture(scope="module")
def field(spark):
    return sample_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), docs=60, most=300)


Q = "Could you explain why the night nurse keeps a list of overdue books every Thursday?"
CASES = [
    (Q, "The landlord feeds the geese because nobody asked for it.", None), (Q, "Sure :)", None), (Q, "No, not yet.", None),
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \u00a0\t", "empty"), (Q, "...", "empty"), (Q, "<p></p>", "empty"), (Q, "&nbsp;", "empty"), (Q, "“”", "empty"), (Q, "\u200b", "empty"), (Q, "<SIL> <SIL>", "empty"),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Unfortunately, I won't be able to assist with this request. Please ask somebody else.", "refusal"), (Q, "That topic is off limits for me.", "refusal"),
    (Q, "Dabei kann ich nicht helfen.", "refusal"), (Q, "Je suis désolé, mais je dois refuser cette demande. Souhaitez-vous parler d'autre chose ?", "refusal"), (Q, "Lo siento, pero prefiero no hablar de ese tema.", "refusal"), (Q, "Sinto muito, mas não consigo responder a esta pergunta.", "refusal"), (Q, "很抱歉，回答这个问题会违反我的准则。感谢您的理解。", "refusal"),
    (Q, "I'm sorry to hear that the boat was late.", None), (Q, "I cannot recommend the soup enough.", None), (Q, "Unfortunately the gate is closed on Mondays, so take the side door.", None), (Q, "The clerk refused to stamp the form, but that has nothing to do with you.", None), (Q, "I can't help with that. The nurse keeps the list because she likes it.", None),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, Q.rstrip("?"), "copy"), (Q, Q.replace("night ", "night night "), "copy"), (Q, Q + " She keeps it because the library closed and nobody else wanted to.", None),
    (Q, "The baker on the corner carries", "truncated"), (Q, "The nurse does it. Her cousin draws a map of the footp", "truncated"), (Q, "The nurse waits beside...", "truncated"), (Q, "The nurse waits (", "truncated"), (Q, "She does this:\n1. waits for the bus\n2. sorts the cards\n3.", "truncated"), (Q, "See here.\n```python\nx = 1", "truncated"), (Q, "See here.\n```python\nx = 1\n```", None), (Q, "She does this:\n- waits for the bus\n- sorts the cards", None), (Q, "See.\n<pre>\nx\n</pre>", None), (Q, "She likes it. :)", None), (Q, "Here it is.\n$$x^2$$", None), (Q, 'The sign says "open today".', None),
    (Q, "Der Bäcker an der Ecke sortiert die Karten für den Abend, weil der Bus zu spät kommt.", "other_language"), ("Please put this into German for me: the baker sorts the cards for the evening.", "Der Bäcker sortiert die Karten für den Abend.", None), (None, "Der Bäcker sortiert die Karten für den Abend.", None),
]


@pytest.mark.parametrize(("prompt", "response", "defect"), CASES)
def test_defects(field, prompt, response, defect):
    assert P.defects([prompt], [response], field) == [defect]


def test_tiling_covers_like_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        tiles = P.tiled(a, b, 3)
        assert all(n >= 3 for n in tiles) and sum(tiles) <= min(len(a), len(b))
        longest = max((n for n in range(3, len(b) + 1) for j in range(len(b) - n + 1) if any(a[i : i + n] == b[j : j + n] for i in range(len(a)))), default=0)
        assert max(tiles, default=0) == longest


def old_greedy(prompt, response, least):
    """Greedy string tiling letter by letter."""
    used_p, used_r, tiles = set(), set(), []
    while True:
        best = []
        for j in range(len(response)):
            for i in range(len(prompt)):
                n = 0
                while i + n < len(prompt) and j + n < len(response) and prompt[i + n] == response[j + n] and i + n not in used_p and j + n not in used_r:
                    n += 1
                best = [(n, j, i)] if not best or n > best[0][0] else [*best, (n, j, i)] if n == best[0][0] else best
        if not best or best[0][0] < least:
            return sorted(tiles)
        for n, j, i in best:
            if not used_p & {*range(i, i + n)} and not used_r & {*range(j, j + n)}:
                used_p |= {*range(i, i + n)}
                used_r |= {*range(j, j + n)}
                tiles.append(n)


def test_tiling_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(16))] for _ in range(2))
        assert sorted(P.tiled(a, b, 3)) == old_greedy(a, b, 3)


def test_tiling_of_long_repetitive_texts_ends():
    assert sum(P.tiled([str(k % 7) for k in range(20_000)], [str(k * 3 % 7) for k in range(20_000)], 4)) >= 0


WORDS = "the night nurse keeps a list of overdue books every thursday while the landlord feeds the geese behind a rented garage near the harbour wall".split()


@pytest.mark.parametrize("preface", ["", "well here is what you have just asked me "])
def test_long_copy_after_a_preface(preface):
    prompt = " ".join(f"{w}{k}" for k, w in enumerate(WORDS * 4))
    assert P.is_copy(prompt, preface + " ".join(prompt.split()[:80]))


@pytest.mark.parametrize(("prompt", "response", "copy"), [("Is it open?", "Is it open?", True), ("Tea or coffee?", "Tea.", False), ("Hm, where is it?", "where is it", True), ("Is it open?", "It is open.", False), ("Do you like tea or coffee?", "Coffee.", False)])
def test_short_copies(prompt, response, copy):
    assert P.is_copy(prompt, response) == copy


@pytest.mark.parametrize(
    ("text", "open_"),
    [("```\n( [\n```", []), ("```\nx", ["```"]), ("<pre>(", ["<pre"]), ("\\begin{itemize}\\item x", ["\\itemize"]), ("\\begin{verbatim} $$ ``` \\end{verbatim}", []), ("$$x", ["$$"]), ("~~~\n```\n~~~", [])],
)
def test_open_blocks(text, open_):
    assert P.open_blocks(text) == open_


@pytest.mark.parametrize(
    ("text", "stack"),
    [
        ("a (b [c] d", ["sentence", "(", "sentence"]), ("a) b. 1) c :)", []), ("„a“ «b» “c”.", []), ('say "x', ["sentence", '"', "sentence"]), ("He said: “Go.”", []), ("**He** goes", ["sentence"]), ("**He goes.", ["**"]),
        ("It is (he says) late.", []), ("3.5 m, e.g. here.", []), ("他说：「走。」", []),
    ],
)
def test_inline_stack(text, stack):
    parser = P.Inline()
    parser.feed(text)
    assert parser.stack == stack


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("The baker keeps a list of books (since the library closed. Nobody asked.", True), ("Paris", False), ("42", False), ("Yes", False), ("[the list](https://example.org/x)", False), ("Nina Alvarez", False), ("the", True), ("Yes,", True),
        ("The baker waits at the", True), ('She said "wait here. And he did.', True), ("She *really* waits.", False), ("- one\n- two of", True), ("- One waits.\n- Two", True), ("- one\n- two\n\nThat is all.", False), ("# Head", False), ("他在车站等公交车", True), ("他在车站等公交车。", False),
    ],
)
def test_truncated(text, cut):
    assert P.is_truncated(text, P.convert(text)[0]) == cut


@pytest.mark.parametrize(
    ("text", "refusal"),
    [
        ("I cannot provide a seat on Monday; take the bus on Tuesday at seven instead.", False), ("I would rather not walk, so take the bus.", False), ("I'd rather not walk.", False), ("I can't help you, but my sister can.", False), ("I cannot provide a seat.", False),
        ("I can't help with that, as it goes against my guidelines.", True), ("I'm sorry, but I can't give you any advice about this.", True), ("I'd rather not answer that.", True), ("No comment on this.", True), ("Es ist mir nicht möglich, Ihnen das zu sagen.", True),
    ],
)
def test_refusals(text, refusal):
    assert P.is_refusal(text) == refusal


def test_mixed_prompt_meets_a_response_in_either_language(field):
    prompt = "Der Bäcker an der Ecke sortiert die Karten für den Abend. The night nurse keeps a list of the books."
    assert P.defects([prompt] * 3, ["The baker sorts the cards for the evening.", "Die Schwester führt eine Liste der Bücher.", "La voisine attend parce que le bus a du retard."], field) == [None, None, "other_language"]


def test_pairs(spark, field):
    schema = "id string, turn int, role string, value string, lang string, ingested_at timestamp_ntz, prompt string, answers string"
    rows = [
        ("a", 0, "Human", Q), ("a", 1, "gpt", "The baker on the corner carries"), ("a", 1, "gpt", "The baker on the corner carries"), ("a", 2, "USER", Q), ("a", 4, "gpt", "x"),
        ("b", 0, "user", None), ("b", 1, "system", "x"), ("c", 0, "human", Q), ("c", 1, "human", Q), ("c", 2, None, ""), ("f", 0, "human", Q), ("f", 1, "bot", Q), ("d", 0, None, Q), ("d", 1, "gpt", ""), (None, 0, "user", Q), ("e", None, "user", Q),
    ]
    from datetime import datetime, timedelta

    df = spark.createDataFrame([(*r, None, datetime(2024, 1, 1) + timedelta(days=k), "p", "q") for k, r in enumerate(rows)], schema)
    got = {(r.id, r.turn): r.d for r in P.pairs_of(df).select("id", "turn", P.pair_defect(F.col("prompt"), F.col("response"), field).alias("d")).collect()}
    assert got == {("a", 1): "truncated", ("f", 1): "copy", ("c", 2): "empty"}
    assert P.pairs_of(df.limit(0)).count() == 0
