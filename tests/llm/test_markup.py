"""Markup: which elements a text has, and what its clean text is."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from talkweave.llm.markup import LINE_WEIGHTS, WEIGHTS, best_region, clean_markup, convert

CASES = [
    ("plain words, nothing else.", []), ("", []), (None, []), ("[S.SPEAK] yes", []), ("<SIL> <interlocutor> no", []), ("it cost $5 on Monday and $7 on Friday", []),
    ("a :) b <3 c ^_^ d", []), ("We need 3 < 5 and 9 > 7.", []), (r"The path C:\notes\kite is it.", []), ("total_visit_count and 5~10 km -- ok", []), ("so funny [laughter] really *sniff* x", []),
    ("took 2 * 3 * 4 minutes, R&D and Q&A", []), ("B+ or A- = good; #3 and #4", []), ("He told me (a) to wait and (b) to call.", []), ("write to desk@ferry.example", []),
    ("# Title\ntext", ["heading"]), ("Title\n=====\ntext", ["heading"]), ("Title\n---\ntext", ["heading"]), ("== Title ==\nx", ["heading"]), ("<h2 id='x'>T</h2>", ["heading"]), (r"\section*{T} x", ["heading"]), ("&lt;h1&gt;T&lt;/h1&gt; x", ["heading"]),
    ("- a\n- b", ["list"]), ("* a\n* b", ["list"]), ("1. a\n2. b", ["list"]), ("1) a\n2) b", ["list"]), ("- [ ] a\n- [x] b", ["list"]), ("[[x]]\n*one\n*two", ["list"]), ("#one\n#two", ["list"]), ("# one\n# two", ["list"]), ("<ul><li>a<li>b</ul>", ["list"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["list"]),
    ("```python\n# no heading\n- x\n```", ["code"]), ("~~~\nx\n~~~", ["code"]), ("````\n```\n````", ["code"]), ("text\n```\nnot closed $x$", ["code"]), ("<pre><code>a &lt; b</code></pre>", ["code"]), ("<source lang=x>\ny\n</source>", ["code"]), ("\\begin{verbatim}\n\\section{x}\n\\end{verbatim}", ["code"]), ("jsCopy code\nlet a = [1];\n", ["code"]),
    ("$$x^2$$", ["formula"]), ("so $x_{1} = 2$ holds", ["formula"]), (r"\(x + y\)", ["formula"]), ("\\[\nx\n\\]", ["formula"]), ("<math><mi>x</mi></math>", ["formula"]), ("\\begin{equation}\nx\n\\end{equation}", ["formula"]),
    ("a **b** c", ["inline"]), ("a *b c* d", ["inline"]), ("__b__", ["inline"]), ("a ~~b~~ c", ["inline"]), ("a `b` c", ["inline"]), ("[a](/b)", ["inline"]), ("![a](/b.png)", ["inline"]), ("[[a|b]] c", ["inline"]), ("'''a''' b", ["inline"]), ("x{{note|y}}", ["inline"]), ("<p>x</p>", ["inline"]), ("<br>", ["inline"]), ("a&nbsp;b", ["inline"]),
    ("| a | b |\n|---|---|\n| 1 | 2 |", ["inline"]), ("{|\n|-\n| a || b\n|}", ["inline"]), ("> said so", ["inline"]), (r"\emph{a} b", ["inline"]), ("a{\\it b} c", ["inline"]), (r"a~\cite{b}", ["inline"]), ("a<!-- b --> c", ["inline"]), ("__整句话。__后面", ["inline"]),
    ("# T\n- a\n\n```\nx\n```\n$$y^2$$ **b**", ["heading", "list", "code", "formula"]),
]


@pytest.mark.parametrize(("text", "elements"), CASES)
def test_elements(text, elements):
    assert convert(text)[1] == elements


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<h2>T</h2><p>a <b>b</b>&amp;c</p><ul><li>x</li><li>y</li></ul>", "## T\n\na b&c\n\n- x\n- y"),
        ("jsCopy code\nif (a) {\n  b();\n}\nThe night nurse waits all week long.", "```\nif (a) {\n  b();\n}\n```\nThe night nurse waits all week long."),
        ("T\n===\n[a](/b) **c** $$x^2$$", "# T\na c $x^2$"),
        ("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}", "- a\n- b"),
        ("<pre>a &lt; b</pre>", "```\na < b\n```"),
        ("<nav><a href='/'>Home</a> <a href='/n'>News</a></nav><p>The ferry leaves before sunrise and comes back late.</p><script>x()</script>", "The ferry leaves before sunrise and comes back late."),
    ],
)
def test_clean(text, clean):
    assert convert(text)[0] == clean


def test_region_is_best():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.choice([-2, -1, -0.5, 0.5, 1]) for _ in range(rng.randrange(12))]
        a, b = best_region(s)
        best = max([0, *(sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2))])
        assert sum(s[a:b]) == pytest.approx(best)


def test_weights_have_the_signs_of_the_method():
    assert WEIGHTS["word"] > 0 > max(WEIGHTS["linked"], WEIGHTS["link"], WEIGHTS["frame"], WEIGHTS["furniture"])
    assert min(WEIGHTS["heading"], WEIGHTS["list"], WEIGHTS["table"], WEIGHTS["format"]) > 0
    assert LINE_WEIGHTS["code"] > 0 > LINE_WEIGHTS["prose"]


TEXT = "The ferry leaves before sunrise and comes back late."


@pytest.mark.parametrize(
    ("text", "clean", "elements"),
    [
        (f"<div><a href='/'>Home</a> <a href='/n'>News</a></div><p>{TEXT}</p><div><a href='/t'>Terms</a> <a href='/p'>Privacy</a></div>", TEXT, ["inline"]),
        (f"<div><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/m'>More</a></li></ul></div><p>{TEXT}</p>", TEXT, ["inline"]),
        (f"{TEXT}<table><tr><td>a</td><td>b</td></tr></table>", f"{TEXT}\n\n| a | b |", ["inline"]), (f"{TEXT}<ul><li>a</li><li>b</li></ul>", f"{TEXT}\n\n- a\n- b", ["list"]), (f"<h2>Buy</h2><ul><li><input> Milk</li></ul><p>{TEXT}</p>", f"## Buy\n\n-  Milk\n\n{TEXT}", ["heading", "list"]),
        (f"See <a href='/x'>this page</a>. {TEXT}", f"See this page. {TEXT}", ["inline"]), (f"{TEXT} <a href='/x'>Here</a>", f"{TEXT} Here", ["inline"]), (f"<script>var x = 1;</script>{TEXT}", TEXT, ["inline"]), (f"<nav><a href='/'>Home</a></nav><pre>x = 1</pre>{TEXT}<footer><a href='/'>Up</a></footer>", f"```\nx = 1\n```{TEXT}", ["code"]),
    ],
)
def test_surroundings_go_and_structure_stays(text, clean, elements):
    assert convert(text) == (clean, elements)


def test_plain_texts_have_one_clean_form(spark):
    texts = ["a  \n\n\n\nb ", "\u00a0\tc\n", "d"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean_markup(F.col("t"))["text"]).collect()]
    assert got == [convert(t)[0] for t in texts] == ["a\n\nb", "c", "d"]


def test_many_blocks_and_long_texts():
    assert convert("```\nx\n```\nand so on.\n" * 5000)[1] == ["code"]
    assert convert("Copy code\nx = 1\n" * 3000)[0].count("x = 1") == 3000


def test_column(spark):
    texts = [t for t, _ in CASES] + ["word " * 30000 + "# no heading", "x" * 100000 + "\n# T"]
    df = spark.createDataFrame([(t, 1) for t in texts], "value string, elements int")
    got = df.select(clean_markup(F.col("value")).alias("m")).select("m.*").collect()
    assert [list(r.elements) for r in got[:-2]] == [e for _, e in CASES]
    assert list(got[-1].elements) == ["heading"] and got[-2].elements == [] and len(got[-2].text) > 150000
    assert df.limit(0).select(clean_markup(F.col("value"))).count() == 0
