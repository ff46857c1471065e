"""Defects of prompt and response pairs: empty, refusal, copy, truncated, other_language.

Pushdown parsers follow fences, environments, items, sentences, brackets, quotations and emphasis to
tell whether a response is finished; word edits and greedy string tiling measure how much of it is the
prompt's own text; a grammar of refusals (openers, declines, closings) derives whole responses; scripts
and word labels give languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from talkweave.functions.durable import once
from talkweave.llm.language import Field, segments_of
from talkweave.llm.markup import convert, first_delivery

DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")

# -- refusals -----------------------------------------------------------------------------------
# A refusal is: opener? decline closing*; nothing else.  Fixed values: the phrases, by language.
OPENERS = [
    r"unfortunately|sadly|regrettably|(?:i'm|i am) (?:so |very |really |truly )?sorry|sorry|my apologies|i apologi[sz]e|thanks? (?:you )?for (?:asking|your \w+)|as an? [\w -]{2,40}|(?:i )?have to be honest|to be honest|honestly|i understand (?:why you ask|your \w+)|i appreciate [\w ]{2,40}|i regret",
    r"leider(?: gilt)?|es tut mir (?:sehr )?leid|tut mir leid|entschuldigung|entschuldigen sie|bedaure|ich muss (?:ganz )?ehrlich sein|ehrlich gesagt|als [\w-]+(?: sage ich offen)?|danke (?:für ihre|der) \w+|ich verstehe[\w ,]{0,40}",
    r"malheureusement|hélas|(?:je suis )?(?:vraiment )?désolée?|je regrette|je m'excuse|pardon|je dois être honnête|pour être honnête|en tant qu(?:e |')[\w' -]{2,40}|merci (?:de|pour) [\w' ]{2,40}|je comprends[\w' ,]{0,40}",
    r"lamentablemente|desgraciadamente|por desgracia|lo siento(?: mucho)?|perdón|perdone|disculpe|tengo que ser (?:sincero|honesto|sincera|honesta)|para ser sincero|como (?!.*\bsi\b)[\w ]{2,40}|gracias por [\w ]{2,40}|entiendo[\w ,]{0,40}|siento",
    r"infelizmente|lamentavelmente|sinto muito|lamento|desculpe|desculpa|peço desculpas?|tenho de ser honest[oa]|para ser honest[oa]|como [\w ]{2,40}|obrigad[oa] (?:por|pela|pelo) [\w ]{2,40}|(?:eu )?entendo[\w ,]{0,40}|compreendo[\w ,]{0,40}",
    r"很抱歉|非常抱歉|抱歉|对不起|不好意思|非常遗憾|很遗憾|遗憾的是|说实话|老实说|坦白说|作为[^，,。]{2,16}|感谢您[^，,。]{0,12}|我理解[^，,。]{0,16}|我明白[^，,。]{0,16}",
]
# What a decline is about: words of one clause, none of which begins another or tells the reader to do something.
_REST = (
    r"(?:(?!\b(?:so|but|instead|then|therefore|take|try|use|go|aber|sondern|also|deshalb|stattdessen|dafür|nehmen sie|mais|donc|plutôt|prenez|essayez|"
    r"sino|pero|así que|mejor|tome|pruebe|mas|porém|então|tente)\b)[^,;:()])*"
)
_REASON = r"(?:,? (?:as|because|since|weil|da|denn|parce que|puisque|car|porque|ya que|pues|pois|já que) [^,;:()]+)?"
# Acts of answering, alone or with what they are about; and giving, which needs something said as its object.
_ACT = r"(?:answer|help|assist|comply|respond|reply|discuss|comment|speak|talk|engage|get into|go into|say|do (?:this|that|it|so)|continue|proceed|(?:fulfil|complete|support) (?:this|that|your|the|it)\b)"
_SAID = r"(?:this|that|it|answers?|responses?|opinions?|views?|advice|information|details?|help|assistance|guidance|instructions?|explanations?|comments?|recommendations?)"
_GIVE = rf"(?:provide|give|share|offer|supply)(?: (?:you|anyone|him|her|them))?(?: with)?(?: (?:an?|the|any|my|such|this|that|these|those|more|further|personal|specific))* {_SAID}\b"
_TASK_EN = rf"(?:{_ACT}|{_GIVE})"
DECLINES = [
    rf"(?:i )?(?:can(?:no|')t|cannot|can not|won't|will not|am unable to|(?:am|'m) not able to|won't be able to|will not be able to|(?:am|'m) not (?:allowed|permitted|comfortable)(?: to)?|could not|couldn't|must not|may not) (?:possibly |really )?{_TASK_EN}\b.*",
    r"i (?:must|have to|need to|will have to) (?:decline|refuse|turn (?:(?:this|that|it|your) .*down|down .*)|pass)(?: .*)?|i (?:decline|refuse)\b.*|this is something i (?:have to|must) (?:decline|refuse).*",
    rf"i do(?: not|n't) feel comfortable (?:\w+ing|with (?:this|that|it))\b.*|i(?:'d| would) rather not {_TASK_EN}\b.*|i prefer not to {_TASK_EN}\b.*|(?:this|that|the|your) (?:topic|subject|question|request|matter)? ?(?:is off limits|falls outside|is outside|goes against|is beyond|is not something i).*|no (?:answer|comment|opinion)(?: from me)? (?:on|about) (?:this|that|it)\b.*",
    r"(?:answering|doing|helping with|discussing) (?:this|that|it)\b.* (?:would|will|might) (?:go against|violate|breach|break).*|(?:this|that|it) (?:would|goes|violates|is against)\b.*(?:guidelines|rules|policy|policies|principles).*|it is(?: not|n't) possible for me to .*|it is impossible for me to .*",
    r"(?:dabei|damit|hierbei|da) kann ich (?:ihnen |dir )?(?:leider )?nicht (?:weiter)?helfen|ich kann (?:ihnen |dir )?(?:leider |dabei |das |diese \w+ |damit )*(?:nicht|keine?) .*(?:helfen|beantworten|geben|antworten|machen|sprechen).*|(?:das|dies|eine antwort) verstößt gegen .*|(?:das|dies) widerspricht .*|diese[ns]? (?:bitte|frage|anfrage|wunsch)(?: \w+)? (?:muss|kann|darf) ich .*(?:ablehnen|nicht .*)|über dieses thema (?:darf|kann|möchte) ich nicht .*|(?:dazu|darüber|hierzu) (?:sage ich lieber nichts|möchte ich .*|darf ich .*)|es ist mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)(?:,? .*)?|ich (?:muss|möchte) (?:das|dies|diese \w+) (?:leider )?ablehnen|ich darf .* nicht .*",
    r"je ne (?:peux|suis|puis|pourrai|saurais)(?: malheureusement)? pas .*(?:aider|répondre|mesure|autorisé|aborder|donner|capable|faire|discuter|parler|accéder|satisfaire).*|je préfère ne pas .*|(?:cela|ce|ça) (?:serait|est|irait|va) .*(?:contraire|à l'encontre|contre) .*|ce (?:sujet|thème) m'est interdit|je dois (?:refuser|décliner).*|il m'est impossible de .*|je (?:refuse|décline) .*|cette (?:question|demande) .*(?:dépasse|sort|interdit).*",
    r"no (?:puedo|soy capaz de|me es posible|estoy (?:autorizado|en condiciones)|podré|me siento cómod[oa])\b.*(?:ayudar|responder|dar|hablar|contestar|facilitar|hacer|atender|cumplir).*|prefiero no .*|debo (?:rechazar|declinar|negarme).*|tengo que (?:rechazar|declinar).*|(?:eso|esto|ello|responder a (?:eso|esto)) (?:iría|va|sería) (?:en )?contra.*|ese (?:asunto|tema) me está (?:vedado|prohibido)|me (?:resulta|es) imposible .*|me niego .*",
    r"não (?:posso|consigo|sou capaz de|me é possível|estou autorizado|poderei|me sinto à vontade)\b.*(?:ajudar|responder|dar|falar|fornecer|fazer|atender|cumprir).*|prefiro não .*|(?:tenho de|devo|preciso de|tenho que) (?:recusar|declinar).*|(?:isso|isto) (?:iria|vai|seria) contra.*|esse (?:assunto|tema) me está (?:vedado|proibido)|é-me impossível .*|recuso.*",
    r"(?:我)?(?:不能|无法|没有办法|没办法|不便|不可以|不方便)(?:帮助|帮|回答|向您提供|提供|处理|讨论|回应|谈论|满足|协助)[^。！？]{0,24}|恕我?(?:不便|不能|无法)[^。！？]{0,16}|(?:这个|该|您的)?(?:请求|要求)我?(?:必须|只能|不得不)?拒绝|(?:这个|该)话题我?(?:不方便|不便|不能|无法)[谈说讨论]{1,3}|(?:回答|讨论)[^。！？]{0,10}(?:违反|违背)[^。！？]{0,12}|(?:这|那)(?:会|将)?(?:违反|违背|超出)[^。！？]{0,16}|我(?:必须|只能|不得不)拒绝[^。！？]{0,12}|我(?:不能|无法|没有办法)[^。！？]{0,24}",
]
CLOSINGS = [
    r"please ask (?:somebody|someone) else|thank you(?: for your [\w ]+)?|feel free to ask .*|is there (?:something|anything) (?:different|else) .*|(?:can|may) i help you with (?:something|anything) else|i hope you understand|let me know if .*|please (?:try|contact|consult) .*|i appreciate your understanding",
    r"bitte fragen sie (?:jemand anderen|.*)|(?:vielen )?danke? für ihr verständnis|stellen sie mir (?:gern|gerne) .*frage|möchten sie über etwas anderes sprechen|kann ich (?:ihnen )?(?:sonst|bei etwas anderem) .*|ich bitte um (?:ihr )?verständnis",
    r"merci (?:de|pour) votre compréhension|souhaitez-vous parler d'autre chose|n'hésitez pas à .*|veuillez vous adresser à .*|puis-je vous aider .*autre.*",
    r"gracias por su comprensión|¿?quiere hablar de otra cosa|no dude en .*|por favor,? pregunte a .*|¿?puedo ayudarle .*otra.*",
    r"obrigad[oa] pela (?:sua )?compreensão|quer falar de outra coisa|fique à vontade para .*|por favor,? pergunte a .*|posso ajudar .*outra.*",
    r"感谢您的理解|谢谢您的理解|欢迎您?提出其他问题|您想聊聊别的话题吗|请您?咨询其他人|请您?(?:问|询问|咨询)[^。！？]{0,12}|还有(?:什么|其他)[^。！？]{0,16}",
]
_OPENER = re.compile(rf"^(?:{'|'.join(OPENERS)})\s*(?:[,:;，：、–—-]|\.(?=\s))?\s*(?:but|however|yet|and|aber|jedoch|doch|mais|toutefois|pero|sin embargo|mas|porém|但是?|不过|可是|然而)?\s*,?\s*", re.I)
_DECLINE = re.compile(rf"^(?:{'|'.join(DECLINES).replace('.*', _REST)}){_REASON}$", re.I)
_CLOSING = re.compile(rf"^(?:{'|'.join(CLOSINGS)})$", re.I)
_SENTENCE = re.compile(r"[^.!?。！？\n]+")


def is_refusal(text: str) -> bool:
    """Whether a clean text declines and does nothing else."""
    plain = re.sub(r"[’‘`]", "'", text).strip().strip("()（）[]\"“”«»„ ")
    declined = False
    for m in _SENTENCE.finditer(plain):
        s = m[0].strip().strip("()\"“”«» ,;¡¿").lower()
        if not re.search(r"\w", s):
            continue
        if _CLOSING.match(s):
            continue
        core, before = s, None
        while core != before and not _DECLINE.match(core):
            before, core = core, _OPENER.sub("", core, count=1)
        if _DECLINE.match(core):
            declined = True
        elif core:  # an opener alone goes with the sentences around it
            return False
    return declined


# -- copies -------------------------------------------------------------------------------------
_UNIT = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+(?:['’][^\W_]+)*")
#: Shortest tile in words (Chinese: characters), and least share of the response under tiles.
TILE, TILE_HAN, COVER = 4, 6, 0.85


_BASE = 0x9E3779B97F4A7C15  # an odd number; sums of powers wrap around


def _window_hashes(codes: np.ndarray, used: np.ndarray, n: int, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of n words that no tile has, and their Karp-Rabin hashes."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * power[: len(codes)])])
    taken = np.concatenate([[0], np.cumsum(used)])
    at = np.flatnonzero(taken[n:] == taken[:-n])
    # the sum of a run, shifted as if it stood at the end of the longer text
    return at, (sums[at + n] - sums[at]) * power[len(power) - 1 - at]


def tiled(prompt: list[str], response: list[str], least: int) -> list[int]:
    """Lengths of the tiles of greedy string tiling: longest common runs first, none overlapping.

    Each round finds the greatest length that still has a common run, never more than the round
    before, by halving over hashes of runs, and lays all tiles of that length.
    """
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(w, len(code) + 1) for w in ws], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) for ws in (prompt, response))
    power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(len(a), len(b)), _BASE, dtype=np.uint64)]))
    used_a, used_b, tiles = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool), []
    most = min(len(a), len(b))
    while most >= least:
        low, high = least - 1, most  # a run of `low` words is common, or low is too short to count
        while low < high:
            n = (low + high + 1) // 2
            common = np.isin(_window_hashes(b, used_b, n, power)[1], _window_hashes(a, used_a, n, power)[1]).any()
            low, high = (n, high) if common else (low, n - 1)
        if low < least:
            break
        places: dict[int, list[int]] = {}
        for i, h in zip(*(x.tolist() for x in _window_hashes(a, used_a, low, power))):
            places.setdefault(h, []).append(i)
        laid = False
        for j, h in zip(*(x.tolist() for x in _window_hashes(b, used_b, low, power))):
            while places.get(h) and not used_b[j : j + low].any():
                i = places[h].pop(0)
                if not used_a[i : i + low].any() and (a[i : i + low] == b[j : j + low]).all():
                    used_a[i : i + low] = used_b[j : j + low] = True
                    tiles.append(low)
                    laid = True
        most = low if laid else low - 1
    return tiles


def edits(prompt: list[str], response: list[str]) -> int:
    """Least number of words changed, added or left out between the response and any run of the prompt, by bit vectors."""
    whole, last = (1 << len(response)) - 1, 1 << len(response) - 1
    at: dict[str, int] = {}
    for j, x in enumerate(response):
        at[x] = at.get(x, 0) | 1 << j
    up, down, n = whole, 0, len(response)
    least = n
    for x in prompt:
        same = at.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & whole, up & across
        n += bool(more & last) - bool(less & last)
        least = min(least, n)
        more, less = more << 1 & whole, less << 1 & whole
        up, down = less | ~(same | down | more) & whole, more & (same | down)
    return least


def is_copy(prompt: str, response: str) -> bool:
    """Whether the response is a run of the prompt but for few words, or lies under tiles of it, long ones in the main."""
    a, b = ([x.lower() for x in _UNIT.findall(t)] for t in (prompt, response))
    if not b or not a:
        return False
    if a == b:
        return True
    han = sum(1 for x in b if len(x) == 1 and "㐀" <= x <= "鿿") > len(b) / 2
    least = TILE_HAN if han else TILE
    if len(b) <= least:  # so short a run of the prompt may be an answer: it must be most of the prompt
        return edits(a, b) == 0 and 3 * len(b) >= 2 * len(a)
    # every word of a copy but a few stands in the prompt, which is soon seen
    words = set(a)
    if sum(x in words for x in b) < COVER * len(b):
        return False
    if edits(a, b) <= (1 - COVER) * len(b):
        return True
    tiles = tiled(a, b, least)  # parts in another order
    return sum(tiles) >= COVER * len(b) and sum(tiles) >= 1.5 * least * len(tiles)


# -- truncation ---------------------------------------------------------------------------------
# Two pushdown parsers.  Over the raw text: fences, environments, block tags and displayed formulas.  Over the clean text, block by
# block: sentences, brackets, quotations and marks of emphasis.  What is on a stack at the end was begun and not finished.
_BLOCKS = re.compile(
    r"(?m)^[ \t]*(?P<fence>`{3,}|~{3,})|\\(?P<env>begin|end)\{(?P<name>\w+)\*?\}|<(?P<close>/?)(?P<tag>pre|source|syntaxhighlight|math)\b[^<>]*>|(?P<math>\$\$)", re.I
)


def open_blocks(raw: str) -> list[str]:
    """The blocks a raw text has opened and not closed."""
    stack: list[str] = []
    for m in _BLOCKS.finditer(raw):
        top = stack[-1] if stack else ""
        if top[:1] in ("`", "~"):  # in a fence only its own end mark counts
            if m["fence"] and m["fence"][0] == top[0] and len(m["fence"]) >= len(top):
                stack.pop()
        elif top.startswith("<") and not m["tag"] or top.startswith("\\verb") and not m["env"]:
            continue
        elif m["fence"]:
            stack.append(m["fence"])
        elif m["math"]:
            stack.pop() if top == "$$" else stack.append("$$")
        else:
            if m["tag"]:
                name, opens = f"<{m['tag'].lower()}", not m["close"]
            else:
                verbatim = re.fullmatch("verbatim|lstlisting|minted", m["name"], re.I)
                name, opens = f"\\verb{m['name']}" if verbatim else f"\\{m['name']}", m["env"] == "begin"
            if opens:
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
    return stack


_FACE = r"(?<!\w)[:;=8][’'-]?-?[()DP/|3](?!\w)|\^_+\^|<3|[☀-➿\U0001f300-\U0001faff]"
_INLINE = re.compile(
    rf"(?P<face>{_FACE})|(?P<letter>(?<![\w(])\w{{1,3}}\)(?=\s))|(?P<trail>\.{{3,}}|…)|(?P<end>[.!?]+(?![\w.])|[。！？]+)|(?P<open>[(\[{{（「『【„«])|(?P<shut>[)\]}}）」』】”»])|(?P<high>“)|"
    r"(?P<straight>(?<!\d)\"|\"(?=\w))|(?P<mark>\*\*|~~|`)|(?P<pause>[,;:，；：、]|[–—]|-(?![\w-]))|(?P<word>[㐀-鿿]|[^\W_㐀-鿿](?:[\w'’.@/-]*[^\W_])?)"
)
_SHUTS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "】": "【", "”": "“", "»": "«"}
SENTENCE = "sentence"
#: The most words (Chinese: characters) of an answer that is no sentence: a name, a number, yes.
FRAGMENT = 4


class Inline:
    """A pushdown parser of running text: a stack of sentences, brackets, quotations and emphasis."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.last, self.word, self.n_words, self.n_ended = "", "", 0, 0

    def _close(self, opener: str) -> None:
        """Takes off what `opener` encloses, and the opener; nothing if it is not there."""
        if opener in self.stack:
            while self.stack.pop() != opener:
                pass

    def _close_quoted(self, opener: str) -> None:
        """The same; a quoted sentence with an end ends the sentence that quotes it."""
        ended = self.stack[-1:] == [opener] and self.last in ("end", "face")
        self._close(opener)
        if ended and opener not in "([{（【" and self.stack[-1:] == [SENTENCE]:
            self.stack.pop()
            self.n_ended += 1

    def feed(self, line: str) -> None:
        for m in _INLINE.finditer(line):
            kind, token = m.lastgroup, m[0]
            top = self.stack[-1] if self.stack else ""
            if kind in ("word", "letter"):
                if top != SENTENCE:
                    self.stack.append(SENTENCE)
                    self.n_words = 0
                self.n_words += 1
                self.word = token.lower()
            elif kind in ("end", "face"):
                if top == SENTENCE:
                    self.stack.pop()
                    self.n_ended += 1
            elif kind == "open" or kind == "high" and "„" not in self.stack:
                self.stack.append(token)
            elif kind in ("shut", "high"):
                self._close_quoted("„" if token in "”“" and "„" in self.stack else _SHUTS[token])
            elif kind in ("straight", "mark"):
                if token in self.stack:
                    self._close_quoted(token)
                else:
                    self.stack.append(token)
            self.last = kind or ""


#: Words that do not end an item: articles, prepositions, conjunctions and the like.
_LINKING = frozenset(
    "the a an of to in on at by for with from and or but because although since until while unless so that under behind beside near next every each my our his her its their "
    "der die das den dem des ein eine einen einem einer und oder aber weil obwohl da damit während von mit für an auf aus bei in im am um zu zur zum unter hinter neben vor seine ihre unsere meine "
    "le la les un une des du de d' à au aux et ou mais parce que puisque alors pour dans sur sous avec derrière son sa ses ma mon notre nos l' qu' "
    "el los las una unos unas del al y o pero porque aunque ya para por con en sin sobre cerca su sus mi nuestro nuestra "
    "o os as um uma uns umas do da dos das no na nos nas ao e ou mas embora já para por com em sem sobre perto num numa seu sua meu minha nosso nossa".split()
)
_ITEM = re.compile(r"(?:-|\d+[.)])(?:\s+(.*))?$")


def is_truncated(raw: str, clean: str) -> bool:
    """Whether a response stops inside a sentence, a list item or a code block.

    So it does if a stack is not empty at its end: a block, bracket, quotation or emphasis not
    closed, or a sentence without an end.  A sentence without an end is finished all the same if it
    is an item beside items without ends, or the whole response in a few words, and if its last word
    can end a phrase.
    """
    clean = re.sub(r"(?<=[.!?。！？])\^\w{1,3}\s*$", "", clean.rstrip())  # a note's mark
    if not re.search(r"\w", clean):
        return False
    if open_blocks(raw):
        return True
    parser, item, siblings, coded = Inline(), False, [], False
    lines = clean.split("\n")
    for line in map(str.strip, lines):
        if line.startswith("```"):
            coded, parser, item = not coded, Inline(), False
        elif coded:
            continue
        elif not line or line.startswith(("#", "|")) or re.fullmatch(r"\$[^$]*\$", line):
            parser, item, siblings = Inline(), False, siblings if not line else []
        elif m := _ITEM.match(line):
            if item:
                siblings.append(SENTENCE not in parser.stack)
            parser, item = Inline(), True
            parser.feed(re.sub(r"\$[^$\n]+\$|`[^`\n]+`", " x ", m[1] or ""))
        else:
            if item and not line[0].islower():
                parser, item = Inline(), False
            parser.feed(re.sub(r"\$[^$\n]+\$|`[^`\n]+`", " x ", line))
    last = lines[-1].strip()
    if item and _ITEM.match(last) and not _ITEM.match(last)[1]:
        return True
    if parser.last == "trail" or re.search(r"(?:\.{3,}|…)[\"'”’»)\]）」\s]*$", last):
        return True
    if any(x != SENTENCE for x in parser.stack):
        return True
    if parser.last in ("pause", "open") or parser.stack and parser.word in _LINKING:
        return True
    if not parser.stack:
        return False
    if item:
        return bool(siblings) and all(siblings)
    return not (parser.n_words <= FRAGMENT and not parser.n_ended and len(lines) == 1)


# -- languages ----------------------------------------------------------------------------------
# How a prompt may name a language.
ASKED = {
    "en": r"english|englisch\w*|anglais|ingl[eé]s|inglês|英语|英文",
    "de": r"german|deutsch\w*|allemand|alem[aá]n|alemão|德语|德文",
    "fr": r"french|französisch\w*|français|franc[eé]s|francês|法语|法文",
    "es": r"spanish|spanisch\w*|espagnol|español|castellano|espanhol|西班牙语|西班牙文",
    "pt": r"portuguese|portugiesisch\w*|portugais|portugu[eé]s|português|葡萄牙语|葡萄牙文",
    "zh": r"chinese|mandarin|chinesisch\w*|chinois|chino|chinês|中文|汉语|普通话",
}


def _sized(segments: list) -> dict[str, int]:
    out: dict[str, int] = {}
    for lang, _, n, _ in segments:
        out[lang] = out.get(lang, 0) + n
    return out


def defects(prompts: list[str | None], responses: list[str | None], field: Field) -> list[str | None]:
    """The defect of each pair, or None; the first that holds of DEFECTS."""
    clean_p, clean_r = ([convert(t)[0] for t in ts] for ts in (prompts, responses))
    out: list[str | None] = []
    sound: list[int] = []
    for k, (raw, p, r) in enumerate(zip(responses, clean_p, clean_r)):
        bare = re.sub(r"\[[SC]\.[A-Z.]+\]|<(?:SIL|interlocutor)>", " ", r)
        if not re.search(r"[^\W_]", bare):
            out.append("empty")
        elif is_refusal(bare):
            out.append("refusal")
        elif is_copy(p, bare):
            out.append("copy")
        elif is_truncated(raw or "", bare.strip()):
            out.append("truncated")
        else:
            out.append(None)
            sound.append(k)
    for k, sp, sr in zip(sound, *(segments_of([c[k] for k in sound], field) for c in (clean_p, clean_r))):
        mine, theirs = _sized(sr), _sized([x for x in sp if x[2] >= 4 or x[1] >= (0.8 if x[2] > 1 else 0.95)])  # a word or two of no sure language is none
        main = max(mine, key=mine.get, default=None)
        enough = main is not None and mine[main] >= (6 if main == "zh" else 4) and max((x[1] for x in sr if x[0] == main), default=0) >= 0.7
        asked = enough and re.search(ASKED[main], clean_p[k], re.I)
        if enough and theirs and not mine.keys() & theirs.keys() and not asked:
            out[k] = "other_language"
    return out


def pairs_of(turns: DataFrame) -> DataFrame:
    """Pairs of a prompt and the response after it: id, turn of the response, prompt, response.

    A prompt is a turn of the human or user, the response the turn numbered one more, of any other
    role but system: a second turn of the human's is no response.  Both meet by (id, turn), so a chat of any length is spread; a skipped number makes
    no pair; repeated deliveries count once.
    """
    one = first_delivery(turns.where("id IS NOT NULL AND turn IS NOT NULL"), "role", "value")
    who = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    sides = one.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.col("turn").alias("turn"), (~who.isin("human", "user", "system")).alias("answers"), F.lit(False).alias("asks"), F.col("value").alias("response"), F.lit(None).cast("string").alias("prompt")),
                F.struct((F.col("turn") + 1).alias("turn"), F.lit(False).alias("answers"), who.isin("human", "user").alias("asks"), F.lit(None).cast("string").alias("response"), F.col("value").alias("prompt")),
            )
        ).alias("s"),
    ).where("s.answers OR s.asks")
    return (
        sides.select("id", "s.*")
        .groupBy("id", "turn")
        .agg(F.max("answers").alias("answers"), F.max("asks").alias("asks"), F.max("response").alias("response"), F.max("prompt").alias("prompt"))
        .where("answers AND asks")
        .select("id", "turn", "prompt", "response")
    )


def pair_defect(prompt: Column, response: Column, field: Field) -> Column:
    """The defect of a pair of text columns, null if there is none.

    A null or empty response is "empty"; with a null, empty or wordless prompt there is no copy and
    no other language.  Whole texts are parsed, tiled and labelled, however long.
    """

    @F.pandas_udf("string")
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in parts:
            yield pd.Series(defects(list(p), list(r), field), dtype=object)

    return once(found)(prompt, response)
