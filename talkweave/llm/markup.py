"""Text with HTML, Markdown, wiki or LaTeX markup into clean text that keeps its structure.

Code blocks are lifted out first, so that nothing in them is read as markup; formulas follow, then
tags, block marks and marks inside lines.  The clean text has headings as "# ...", list items as
"- ..." or "1. ...", code between fences and formulas between dollar signs.

Content is told from surroundings by maximum-scoring subsequences: over the tokens of a text words
score positive and tags of pages negative, with weights fitted on labelled pages, and one linear scan
finds the best contiguous region.  The elements of a text are those of its region; what lies outside,
but for code, is dropped.  Links, frames and furniture have negative weights by the fit, structure
(headings, lists, tables, formatting) has not, so a text without any of the former is its own region.
The same scan over lines finds where a code block without an end mark ends.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from talkweave.functions.durable import once
from talkweave.functions.text import stripped

STRUCTURE = ("heading", "list", "code", "formula")

# Names of HTML elements; other words in angle brackets, such as <SIL>, are no tags.
FURNITURE_TAGS = "nav|script|style|form|input|button|select|option|iframe|noscript|header|footer|aside|label|textarea|svg"
OTHER_TAGS = (
    "a|abbr|address|article|b|base|big|blockquote|body|br|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|"
    "figcaption|figure|font|h1|h2|h3|h4|h5|h6|head|hr|html|i|img|ins|kbd|li|link|main|mark|math|menu|meta|mfrac|mi|mn|mo|mrow|"
    "msub|msup|nowiki|ol|p|picture|pre|q|ref|references|s|samp|section|small|source|span|strike|strong|sub|summary|sup|"
    "syntaxhighlight|table|tbody|td|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|wbr"
)
TAG = re.compile(rf"</?(?:{FURNITURE_TAGS}|{OTHER_TAGS})(?=[\s/>])[^<>]*>", re.I)
TAG_NAME = re.compile(r"</?([A-Za-z0-9]+)")
_MATH_ENV = "equation|align|alignat|gather|multline|eqnarray|displaymath|math"
_CODE_ENV = "verbatim|Verbatim|lstlisting|minted|alltt"

# -- maximum-scoring subsequences ---------------------------------------------------------------


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """The contiguous region of greatest total score as (start, end); (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


# Kinds of HTML elements.
ELEMENT_KINDS = {
    "furniture": FURNITURE_TAGS,
    "link": "a|link",
    "frame": "html|head|body|meta|title|div|main|section|center|font|img|picture|hr|base|col|colgroup|span",
    "heading": "h1|h2|h3|h4|h5|h6",
    "list": "ul|ol|li|dl|dt|dd|menu",
    "table": "table|tbody|thead|tfoot|tr|td|th|caption",
}
_KIND_OF = {name: kind for kind, names in ELEMENT_KINDS.items() for name in names.split("|")}
_MD_LINK = r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"
_TOKEN = re.compile(rf"{TAG.pattern}|{_MD_LINK}|[^\s<\[]+|[<\[]", re.I)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Tags, Markdown links and words of a text as (kind, start, end).

    Kinds are word, linked (a word inside a link), link, frame, furniture, heading, list, table and
    format (any other tag).
    """
    out, linked = [], False
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t[0] == "<" and len(t) > 1:
            name = TAG_NAME.match(t)[1].lower()
            kind = _KIND_OF.get(name, "format")
            if name == "a":
                linked = t[1] != "/"
        elif t[-1] == ")" and "](" in t:
            kind = "link"
        else:
            kind = "linked" if linked else "word"
        out.append((kind, m.start(), m.end()))
    return out


KINDS = ("word", "linked", "link", "frame", "furniture", "heading", "list", "table", "format")
#: The share of texts that have surroundings at one end, a parameter: chats seldom have.  Either end of a text counts as a token, "edge",
#: that scores the log odds of having none, so that surroundings must tell more against themselves than that.
SURROUNDED = 1 / 1000


def log_odds(inside: Counter, outside: Counter, kinds: Iterable[str]) -> dict[str, float]:
    """Weights of kinds: the smoothed log odds of content."""
    kinds = tuple(kinds)
    a, b = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    return {k: math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b) for k in kinds}


def fit_weights(pages: Iterable[tuple[str, str, str]]) -> dict[str, float]:
    """Weights of token kinds from labelled pages (before, content, after)."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    for before, content, after in pages:
        inside.update(t[0] for t in tokens(content))
        for part in (before, after):
            outside.update(t[0] for t in tokens(part))
    return log_odds(inside, outside, KINDS) | {"edge": math.log((1 - SURROUNDED) / SURROUNDED)}


#: The labelled sample, invented pages and messages: what stands before the content, the content, what stands after it.
LABELLED_PAGES = [
    ("<html><head><title>Notes</title></head><body><nav><a href='/'>Home</a><a href='/n'>News</a></nav>",
     "<h1>Tides</h1><p>High water comes an hour later than yesterday, and the causeway stays under water until noon.</p><p>Walkers should turn back early.</p>",
     "<footer><a href='/t'>Terms</a><a href='/p'>Privacy</a></footer></body></html>"),
    ("<div><nav><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></nav></div>",
     "<div>Rye bread keeps for a week if it is wrapped in <b>cloth</b> and stored cool.</div><ul><li>flour from the mill</li><li>salt and warm water</li></ul>",
     "<form><input name='q'><button>Go</button></form><script src='/x.js'></script>"),
    ("<header><a href='/'><img src='/l.png'></a></header><aside><a href='/ad'>Buy</a></aside>",
     "<p>Opening hours change in winter. The reading room closes at four.</p><table><tr><th>Day</th><th>Hours</th></tr><tr><td>Monday</td><td>closed</td></tr></table>",
     "<aside><a href='/a'>More</a></aside><footer><a href='/c'>Contact</a></footer>"),
    ("<style></style><script></script><a href='/skip'>Skip</a>",
     "Rehearsals begin in <i>March</i>, and the hall is heated from six in the evening.<br>Bring your own score.",
     "<a href='/s'>Share</a><a href='/m'>Mail</a><iframe></iframe>"),
    ("<html><head><meta><link><title></title></head><body><div><div><div><img></div><div><a href='/'>Top</a></div></div><hr><div>",
     "Granite splits along its grain when wedges are driven in a line, which quarrymen learn to read by the colour.",
     "</div><hr><div><a href='/2'>2</a> <a href='/3'>3</a></div></div></body></html>"),
    ("<div><a href='/'>Start</a> <a href='/shop'>Shop</a> <a href='/help'>Help</a></div>",
     "<p>Beeswax melts at sixty degrees; candles made of it burn slowly and smell of honey.</p>",
     "<div><a href='/imprint'>Imprint</a> <a href='/terms'>Terms</a></div>"),
    ("[Start](/) [Shop](/shop) [Help](/help)\n", "# Candles\n\nBeeswax melts at sixty degrees, and candles made of it burn slowly.\n\n- wick\n- mould", "\n[Imprint](/imprint) [Terms](/terms)"),
    ("<div class='top'><img src='/a.png'><a href='/in'>Log in</a></div>", "<h2>Ferns</h2><ol><li>They like shade.</li><li>They dislike lime.</li></ol>", "<div class='end'><a href='/up'>Up</a></div>"),
    # messages, all content
    ("", "The report is on <a href='https://example.org/r'>this page</a>, I will read it tonight.", ""),
    ("", "You find both here: <a href='https://example.org/a'>first part</a> and <a href='https://example.org/b'>second part</a>", ""),
    ("", "<a href='https://example.org/h'>The house on the hill</a> has been empty for years.", ""),
    ("", "<a href='https://example.org/k'>Both keys</a> hang by the door, next to <a href='https://example.org/l'>the long list</a>.", ""),
    ("", "I wrote down <a href='https://example.org/w'>how the old water clock works</a>.", ""),
    ("", "Ask <a href='mailto:x@example.org'>the office</a> or <a href='https://example.org/f'>use the form</a>, <a href='https://example.org/q'>questions and answers</a> are there too.", ""),
    ("", "<p>Thanks for asking.</p><div>It takes two days by train.</div>", ""),
    ("", "<div>Would <span>Friday</span> suit you?</div>", ""),
    ("", "Prices so far:<table><tr><td>oats</td><td>two</td></tr><tr><td>barley</td><td>three</td></tr></table>", ""),
    ("", "What I packed:<ul><li>rope</li><li>lamp</li></ul>", ""),
    ("", "<h3>Plan</h3>walk, rest, walk on", ""),
    ("", "Look at the [map](https://example.org/m) before you leave, and at [the timetable](https://example.org/t)", ""),
    ("", "<b>No</b>, not before the <i>second</i> of May.<br><br>After that, yes.", ""),
    ("", "A photo of it: ![the bridge](https://example.org/p.png)", ""),
    ("", "<blockquote>who goes first?</blockquote>The one who arrived last.<hr>", ""),
]
WEIGHTS = fit_weights(LABELLED_PAGES)
#: Signs of a token of negative weight; a text without any is its own best region.
CUTTABLE = re.compile(rf"</?(?:{'|'.join(names for kind, names in ELEMENT_KINDS.items() if WEIGHTS[kind] < 0)})(?=[\s/>])|\]\(", re.I)
#: Signs of lines of code and of prose, for the end of a code block that no mark ends.
CODE_LINE = re.compile(r"^\s+\S|[;{}]\s*$|^\s*(?:[}\])]|fi|end|done|else|esac)\s*;?\s*$|^\s*(?:def|class|for|while|if|elif|else|return|import|from|let|var|const|function|print|mv|cp|echo|SELECT|FROM|WHERE|GROUP|ORDER|INSERT|UPDATE|#include|public|private)\b|\w\(.*\)|^\s*(?:#|//|--|/\*)|[=+*/<>|&]{1,2}\s*\S+\s*$|^\s*[.#]?\w+\s*\{")
PROSE_LINE = re.compile(r"[.!?。！？]\s*$|^\s*(?:#{1,6}|[-*+]|\d+[.)])\s+\S+\s+\S+\s+\S|^[\w'’-]+(?: [\w'’,-]+){4,}|[㐀-鿿]{4}|^\s*[$\\<|*_~`]")
#: Labelled blocks: lines of code, and what stands after it.
LABELLED_BLOCKS = [
    ("total = 0\nfor x in xs:\n    total += x\nprint(total)", "This adds up the list.\n\nIs that what you need?"),
    ("function add(a, b) {\n  return a + b;\n}\n\nadd(1, 2);", "Call it with two numbers, and it gives their sum.\nAnything else is an error."),
    ("SELECT name\nFROM ships\nWHERE tons > 900\nORDER BY name;", "- ships are sorted by name\n- small ones are left out of the list"),
    ("mkdir -p out\ncp a.txt out/\nif [ -f b.txt ]; then\n  mv b.txt out/\nfi", "Both files are in the folder after that."),
    (".box {\n  margin: 2px;\n  color: #333;\n}", "The box stands a little apart from the text around it.\n\n# Colours\nGrey is easier on the eyes."),
    ("import os\n\ndef size(p):\n    # bytes\n    return os.stat(p).st_size", "## Notes\n\nIt follows links."),
    ("let n = 3;\nwhile (n > 0) {\n  n -= 1;\n}", "循环到零为止就会结束。\n然后程序继续运行下去。"),
]


def line_kind(line: str) -> str:
    """blank, code, prose, both or neither, by the signs of a line."""
    if not line.strip():
        return "blank"
    code, prose = bool(CODE_LINE.search(line)), bool(PROSE_LINE.search(line))
    if prose and re.search(r"[㐀-鿿]{4}|^\s*!?\[", line):
        code = False
    return ("both" if prose else "code") if code else "prose" if prose else "neither"


LINE_WEIGHTS = log_odds(
    Counter(line_kind(x) for code, _ in LABELLED_BLOCKS for x in code.split("\n")), Counter(line_kind(x) for _, rest in LABELLED_BLOCKS for x in rest.split("\n")), ("blank", "code", "prose", "both", "neither")
)


def _code_lines(lines: list[str]) -> int:
    """How many lines from the first on are code: the best region, begun with the first line whatever it is."""
    scores = [LINE_WEIGHTS[line_kind(x)] for x in lines]
    return best_region([1.0 + sum(map(abs, scores)), *scores[1:]])[1] if lines else 0


# -- conversion ---------------------------------------------------------------------------------


@dataclass
class Page:
    """A text being converted: what was lifted out, and the elements seen."""

    text: str
    held: list[str] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)

    def hold(self, element: str, shown: str) -> str:
        self.seen.add(element)
        self.held.append(shown)
        return f"\x00{len(self.held) - 1}\x00"


_FENCE = re.compile(r"(?m)^[ \t]*(`{3,}|~{3,})[ \t]*([^\n`]*)\n?")
_CODE_PAIRS = [
    re.compile(r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:(?:</code>)?\s*</pre>|\Z)", re.I | re.S),
    re.compile(r"<(?:source|syntaxhighlight)\b[^<>]*(?<!/)>(.*?)(?:</(?:source|syntaxhighlight)>|\Z)", re.I | re.S),
    re.compile(rf"\\begin\{{({_CODE_ENV})\*?\}}(?:\[[^\]]*\])?(?:\{{[^}}]*\}})?(.*?)(?:\\end\{{\1\*?\}}|\Z)", re.S),
    re.compile(r"<code\b[^<>]*>([^<]*\n.*?)</code>", re.I | re.S),
]
_COPY = re.compile(r"(?m)^[ \t]*[\w+#.-]{0,14}Copy code[ \t]*\n?")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_FORMULA = [
    (re.compile(rf"\\begin\{{((?:{_MATH_ENV})\*?)\}}(.*?)(?:\\end\{{\1\}}|\Z)", re.S), 2),
    (re.compile(r"<math\b[^<>]*>(.*?)(?:</math>|\Z)", re.I | re.S), 1),
    (re.compile(r"\$\$(.+?)\$\$", re.S), 1),
    (re.compile(r"\\\((.+?)\\\)", re.S), 1),
    (re.compile(r"\\\[(.+?)\\\]", re.S), 1),
    (re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$])"), 1),
]
_IS_MATH = re.compile(r"[\\^_={}<>+]|^[A-Za-z]$|[A-Za-z]\s*[-*/]\s*[A-Za-z0-9]")
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\s*(?:\[[^\]]*\])?\{([^{}]*)\}")
_TEX_LIST = re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}(?:\[[^\]]*\])?")
_TEX_ITEM = re.compile(r"\\item\b(?:\[([^\]]*)\])?[ \t]*")
_TEX_NOTE = re.compile(r"~?\\(?:footnote|cite[a-z]*|label|ref|index|thanks|includegraphics)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_TEX_CALL = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_FONT = re.compile(r"\{\\(?:it|bf|em|tt|sc|rm|sl|large|small|itshape|bfseries)\b\s*([^{}]*)\}")
_TEX_RAW = re.compile(r"\\(?:frac|sqrt|sum|int|alpha|beta|gamma|leq|geq|cdot|infty|times)\b")
_TABLE_RULE = re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")
_WIKI_TABLE = re.compile(r"\{\|.*?(?:\|\}|\Z)", re.S)
_WIKI_LINK = re.compile(r"\[\[(?!\s)((?:[^\[\]|]*\|)*)([^\[\]]*)\]\]")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_LINK = re.compile(r"\[([^\[\]]+)\](?:\((?:[^()\s]+)(?:\s+\"[^\"]*\")?\)|\[[\w-]*\])|\[\^[\w-]+\]:?|<https?://[^<>\s]+>|(?<!\w)\[https?://\S+ ([^\[\]]*)\]")
_SPANS = [
    re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])((?:[^*\n]|\n(?!\n))*?[^\s*])\1(?![\w*])"),
    re.compile(r"(?<!\w)(_{1,3})(?=[^\s_])((?:[^_\n]|\n(?!\n))*?[^\s_])\1(?!\w)"),
    re.compile(r"(~~)(?=\S)([^~]*?\S)~~"),
    re.compile(r"(?<!`)(`{1,2})(?=[^`\s])([^`\n]*?[^`])\1(?!`)"),
    re.compile(r"(?<!')('{2,5})(?=[^'\s])([^\n]*?[^'\s])\1(?!')"),
    re.compile(r"(``)((?:[^`'\n]|'(?!'))+?)''"),
]
_CJK = "\u3400-\u9fff"
#: Beside Chinese a mark needs no blank or punctuation around it.
_SPANS_CJK = [re.compile(rf"(\*{{1,3}}|_{{2,3}})(?=[{_CJK}（“])([^*_\n]*?[{_CJK}。！？，”）])\1")]
#: A lone starred or bracketed word is a sound, not emphasis.
_SOUND = re.compile(r"\*(?:sniff|laughs?|laughter|cough|coughs|sighs?|static|music|noise|breath|clears throat|gasp|chuckles?|giggles?|yawns?|pause)\*", re.I)

_HEAD_MD = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_HEAD_WIKI = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
_BULLET = re.compile(r"^[ \t]*[-*+•][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)(.*)$")
_NUMBER = re.compile(r"^[ \t]*(\d{1,3})[.)][ \t]+(?=\S)(.*)$")
_WIKI_ITEM = re.compile(r"^(?:\*+(?=[^\s*])|#+(?=[^\s#])|[*#:]{2,}[ \t]*(?=\w))(.*)$")
_RULE = re.compile(r"^[ \t]*(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$")


def _lift_code(page: Page) -> None:
    """Blocks in order: fences, also if never closed, elements and environments of code, and lines headed "Copy code"."""
    text, out, at = page.text, [], 0
    starts = [_FENCE, *_CODE_PAIRS, _COPY]
    found = [p.search(text) for p in starts]
    while any(found):
        k = min((k for k, m in enumerate(found) if m), key=lambda k: (found[k].start(), k))
        m = found[k]
        out.append(text[at : m.start()])
        if starts[k] is _FENCE:
            close = re.compile(rf"(?m)^[ \t]*{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$").search(text, m.end())
            inside, at = text[m.end() : close.start() if close else len(text)], close.end() if close else len(text)
        elif starts[k] is _COPY:
            later = min((x.start() for p in starts if (x := p.search(text, m.end()))), default=len(text))
            lines = text[m.end() : later].split("\n")
            n = _code_lines(lines)
            inside = "\n".join(lines[:n])
            at = min(m.end() + len(inside) + 1, later) if n < len(lines) else later
        else:
            inside, at = html.unescape(m[m.lastindex]), m.end()
        shown = inside.strip("\n")
        out += [page.hold("code", f"```\n{shown}\n```"), "\n" if starts[k] is _COPY else ""]
        found = [x if x and x.start() >= at else p.search(text, at) if x else None for p, x in zip(starts, found)]
    page.text = "".join(out) + text[at:]


def _lift_formulas(page: Page) -> None:
    for pattern, g in _FORMULA:
        def shown(m: re.Match) -> str:
            inside = re.sub(r"<[^<>]+>", "", m[g]).strip()
            if pattern.pattern.startswith("(?<!") and not _IS_MATH.search(inside):
                return m[0]
            return page.hold("formula", f"${inside}$")

        page.text = pattern.sub(shown, page.text)


def _tags(page: Page) -> None:
    def plain(m: re.Match) -> str:
        name = TAG_NAME.match(m[0])[1].lower()
        closing = m[0].startswith("</")
        if re.fullmatch("h[1-6]", name):
            page.seen.add("heading")
            return "\n" if closing else f"\n\x01{'#' * int(name[1])} "
        if name in ("li", "dt", "dd"):
            page.seen.add("list")
            return "" if closing else "\n\x01- "
        page.seen.add("inline")
        if name in ("ul", "ol", "dl"):
            page.seen.add("list")
        if name in ("td", "th", "tr"):
            return " |" if closing and name != "tr" else "\n|" if name == "tr" and not closing else ""
        return "\n" if name in ("p", "div", "br", "table", "ul", "ol", "dl", "blockquote", "section", "article", "hr") else " " if name == "img" else ""

    if "<!--" in page.text:
        page.text, n = re.subn(r"<!--.*?(?:-->|\Z)", "", page.text, flags=re.S)
        page.seen.add("inline")
    page.text = re.sub(r"<ref\b[^<>]*>.*?</ref>", lambda m: page.seen.add("inline") or "", page.text, flags=re.I | re.S)
    page.text = re.sub(r"<sup>\s*([\w*]{1,3})\s*</sup>", lambda m: page.seen.add("inline") or f"^{m[1]}", page.text, flags=re.I)
    page.text = TAG.sub(plain, page.text)


def _tex(page: Page) -> None:
    def call(element: str, show: str):
        def at(m: re.Match) -> str:
            page.seen.add(element)
            return show.format(*(m.groups(default="") or ("",)))

        return at

    if "\\" not in page.text:
        return
    t = _TEX_HEAD.sub(call("heading", "\n\x01# {0}\n"), page.text)
    t = _TEX_LIST.sub(call("list", ""), t)
    t = _TEX_ITEM.sub(call("list", "\x01- {0}"), t)
    t = _TEX_NOTE.sub(call("inline", ""), t)
    t = _TEX_FONT.sub(call("inline", "{0}"), t)
    for _ in range(3):
        t = _TEX_CALL.sub(call("inline", "{0}"), t)
    if _TEX_RAW.search(t):
        page.seen.add("formula")
    page.text = t


def _wiki_table(m: re.Match) -> str:
    """The rows of a wiki table as rows of cells."""
    rows = re.split(r"(?m)^\|-.*$", re.sub(r"\A\{\|.*|\|\}\Z", "", m[0]))
    cells = [[c.strip() for c in re.split(r"\|\||!!|^[|!]", r, flags=re.M) if c.strip()] for r in rows]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells if c)


def _lines(page: Page) -> None:
    if "{|" in page.text:
        page.text = _WIKI_TABLE.sub(lambda m: page.seen.add("inline") or _wiki_table(m), page.text)
    src, out, k = page.text.split("\n"), [], 0
    # a "#" line beside another is a numbered item, alone it is a heading; "*word" needs a mate or a wiki head before it
    while k < len(src):
        line = src[k]
        after = src[k + 1] if k + 1 < len(src) else ""
        near = (src[k - 1] if k else "", after)
        if line.startswith("\x01"):
            out.append(line[1:])
        elif _TABLE_RULE.match(line):
            page.seen.add("inline")
        elif _RULE.match(line):
            page.seen.add("inline")
        elif line.strip() and re.fullmatch(r"[ \t]*(?:={3,}|-{3,})[ \t]*", after) and not _BULLET.match(line) and "|" not in line and "\x00" not in line:
            page.seen.add("heading")
            out.append(f"# {line.strip()}")
            k += 1
        elif (m := _HEAD_MD.match(line)) and not (m[1] == "#" and any(_HEAD_MD.match(x) and _HEAD_MD.match(x)[1] == "#" for x in near)):
            page.seen.add("heading")
            out.append(f"{m[1]} {m[2]}")
        elif m := _HEAD_WIKI.match(line):
            page.seen.add("heading")
            out.append(f"{'#' * len(m[1])} {m[2]}")
        elif (m := _BULLET.match(line)) or (_HEAD_MD.match(line) and (m := re.match(r"()[ \t]*#[ \t]+(.*)", line))):
            page.seen.add("list")
            out.append(f"- {m[m.lastindex]}")
        elif m := _NUMBER.match(line):
            page.seen.add("list")
            out.append(f"{m[1]}. {m[2]}")
        elif (m := _WIKI_ITEM.match(line)) and not any(p.match(line) for p in _SPANS + _SPANS_CJK) and not re.match(r"\*[^*]*\*", line) and (
            any(_WIKI_ITEM.match(x) for x in near) or (k and src[k - 1].startswith("[["))
        ):
            page.seen.add("list")
            out.append(f"- {m[1]}")
        elif re.match(r"[ \t]*>+[ \t]+\S", line):
            page.seen.add("inline")
            out.append(re.sub(r"^[ \t]*>+[ \t]+", "", line))
        elif line.count("|") >= 2 and line.strip().startswith("|"):
            page.seen.add("inline")
            out.append("| " + " | ".join(x.strip() for x in line.strip().strip("|").split("|")) + " |")
        else:
            out.append(line)
        k += 1
    page.text = "\n".join(out)


def _inside_lines(page: Page) -> None:
    def keep(n: int):
        def at(m: re.Match) -> str:
            page.seen.add("inline")
            return m[n] or ""

        return at

    t = page.text
    t = _TEMPLATE.sub(lambda m: page.seen.add("inline") or "", t)
    t = _IMAGE.sub(keep(1), t)
    t = _WIKI_LINK.sub(lambda m: page.seen.add("inline") or m[2], t)
    t = _LINK.sub(lambda m: page.seen.add("inline") or m[1] or m[2] or "", t)
    for p in _SPANS + _SPANS_CJK:
        t = p.sub(lambda m: m[0] if _SOUND.fullmatch(m[0]) else page.seen.add("inline") or m[2], t)
    page.text = t


def _content(page: Page) -> None:
    """Keeps the best region of a text; of what lies outside it only code stays.  Scripts and styles are no text."""
    if not CUTTABLE.search(page.text):
        return
    page.text = re.sub(r"<(script|style)\b[^<>]*(?<!/)>.*?(?:</\1\s*>|\Z)", lambda m: page.seen.add("inline") or "", page.text, flags=re.I | re.S)
    toks = tokens(page.text)
    scores = [WEIGHTS["edge"], *(WEIGHTS[kind] for kind, _, _ in toks), WEIGHTS["edge"]]
    a, b = best_region(scores)
    first, last = max(a - 1, 0), min(b - 1, len(toks))  # tokens of the region; its ends may be ends of the text
    if first >= last:
        return
    begin = 0 if a == 0 else toks[first][1]
    end = len(page.text) if b == len(scores) else toks[last - 1][2]
    if begin > 0 or end < len(page.text):
        page.seen.add("inline")
        held = ["".join(re.findall(r"\x00\d+\x00", x)) for x in (page.text[:begin], page.text[end:])]
        page.text = f"{held[0]}{page.text[begin:end]}{held[1]}"


#: A text without any of these has no markup (a regular expression for Java and Python alike).
MAYBE = r"(?m)[<>&`*_#\\$\[\]{}|=^]|~~|''|^[ \t]*(?:[-+•]|\d+[.)])[ \t]|-{3}|Copy code"
_MAYBE = re.compile(MAYBE)


def convert(text: str | None) -> tuple[str, list[str]]:
    """The clean text, and the elements its markup expresses: STRUCTURE kinds, else "inline", else none."""
    if not text:
        return "", []
    if not _MAYBE.search(text):
        return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", text)).strip(), []
    page = Page(text.replace("\x00", " ").replace("\x01", " ").replace("\r\n", "\n"))
    _lift_code(page)
    if _ENTITY.search(page.text):
        page.text = _ENTITY.sub(lambda m: page.seen.add("inline") or html.unescape(m[0]).replace("\xa0", " "), page.text)
    _lift_formulas(page)
    _content(page)
    _tex(page)
    _tags(page)
    _lines(page)
    _inside_lines(page)
    clean = re.sub(r"\x00(\d+)\x00", lambda m: page.held[int(m[1])], page.text).replace("\x01", "")
    clean = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", clean)).strip()
    found = [e for e in STRUCTURE if e in page.seen]
    return clean, found or (["inline"] if "inline" in page.seen else [])


def clean_markup(text: Column) -> Column:
    """struct(text, elements) of a text column; texts without any sign of markup stay in the JVM.

    Null and empty texts give an empty text and no elements; every text is converted as a whole.
    """

    @F.pandas_udf("text string, elements array<string>")
    def converted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([(None, None) if x is None else convert(x) for x in s], columns=["text", "elements"])

    marked = once(converted)(F.when(text.rlike(MAYBE), text))
    folded = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")
    return F.struct(
        F.coalesce(marked["text"], stripped(folded)).alias("text"),
        F.coalesce(marked["elements"], F.array().cast("array<string>")).alias("elements"),
    )


def first_delivery(turns: DataFrame, *columns: str) -> DataFrame:
    """One row per (id, turn) of chat turns: the one that was ingested first."""
    return turns.groupBy("id", "turn").agg(*[F.min_by(c, F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp_ntz"))).alias(c) for c in columns])
