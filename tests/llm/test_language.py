"""The random field against enumeration, and its labels on text it was not fitted on."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import language as L

SAMPLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def field(spark):
    return L.sample_field(spark.read.parquet(SAMPLE), docs=60, most=300)


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    c, lengths = 3, [1, 2, 4, 0]
    e, t = rng.normal(size=(4, 4, c)), rng.normal(size=(c, c))
    mask = np.array([[k < n for k in range(4)] for n in lengths])
    p, pairs = L.forward_backward(e, mask, t, pairs=True)
    total = np.zeros((c, c))
    for r, n in enumerate(lengths):
        if not n:
            continue
        paths = list(itertools.product(range(c), repeat=n))
        w = np.exp([sum(e[r, k, y] for k, y in enumerate(q)) + sum(t[a, b] for a, b in zip(q, q[1:])) for q in paths])
        w /= w.sum()
        for k in range(n):
            assert np.allclose(p[r, k], [sum(w[i] for i, q in enumerate(paths) if q[k] == y) for y in range(c)])
        for x, q in zip(w, paths):
            for a, b in zip(q, q[1:]):
                total[a, b] += x
    assert np.allclose(pairs, total)


def test_transitions_are_learned(field):
    assert all(field.steps[k, k] > np.delete(field.steps[k], k).max() for k in range(len(field.labels)))


@pytest.mark.parametrize(
    ("text", "langs"),
    [
        ("The driver of the night bus waits because it is late.", ["en"]), ("Der Mann von der Fähre wartet, weil der Bus zu spät kommt.", ["de"]), ("La voisine attend parce que le bus a du retard.", ["fr"]),
        ("La vecina espera porque el autobús llega tarde otra vez.", ["es"]), ("A minha vizinha espera porque o autocarro chegou atrasado.", ["pt"]), ("我的邻居在车站后面等公交车。", ["zh"]),
        ("The nurse keeps a list of the books. Der Bäcker an der Ecke sortiert die Karten für den Abend.\n我的邻居在车站后面等公交车。", ["en", "de", "zh"]),
        ('The sign at the door says "heute geöffnet" and nobody likes it.', ["en"]), ("```\nfor x in range(3): print(x)\n```", []), ("", []), ("12 34", []), ("[S.SPEAK] <SIL>", []),
    ],
)
def test_segments(field, text, langs):
    assert [s[0] for s in L.segments_of([text], field)[0]] == langs


def test_held_out_accuracy(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND length(text) < 3000").select("text", "lang").collect()
    found = L.segments_of([d.text for d in docs], field)
    right = sum(max(s, key=lambda x: x[2])[0] == d.lang for s, d in zip(found, docs) if s)
    assert right >= 0.98 * len(docs)


@pytest.mark.parametrize(("name", "code"), [("en", "en"), ("EN", "en"), ("en-GB", "en"), ("fr_FR", "fr"), ("deu", "de"), (" German ", "de"), ("zho", "zh"), ("pt_BR", "pt"), ("it", None), ("und", None), ("", None), (None, None), ("??", None), ("unknown", None)])
def test_declared(spark, name, code):
    assert spark.createDataFrame([(name,)], "x string").select(L.declared(F.col("x"))).first()[0] == code


def test_column_edges(spark, field):
    df = spark.createDataFrame([(None, 1), ("", 1), ("the nurse waits for the bus. " * 4000, 1)], "value string, lang int")
    got = [r.s for r in df.select(L.language_segments(F.col("value"), field).alias("s")).collect()]
    assert got[0] == [] and got[1] == [] and [x.lang for x in got[2]] == ["en"] and got[2][0].n_words == 24000 and got[2][0].confidence > 0.9
    assert df.limit(0).select(L.language_segments(F.col("value"), field)).count() == 0


def test_chinese_runs_that_differ_late():
    one, other = "我的邻居在车站后面等公交", "我的邻居在车站后面等火车"
    a, b = (L.sentences(x)[0] for x in (one, other))
    assert "".join(a) == one and [L.features(w) for w in a] != [L.features(w) for w in b]
    assert {zlib_of(c) for c in one} <= {f for w in a for f in L.features(w)}


def zlib_of(c):
    import zlib

    return zlib.crc32(f"h{c}".encode()) % L.FEATURES


def test_pieces_cover_whole_texts():
    from talkweave.llm.lookalike import segment_pattern, unstable_ranges

    words = [f"w{'x' * (k % 5)}" for k in range(1000)]
    got = L.pieces(" ".join(words), segment_pattern(unstable_ranges()))
    assert sum(map(len, got)) >= 990 and L.spread(list(range(100)), 4) == [0, 25, 50, 75] and L.spread([1, 2], 4) == [1, 2]
