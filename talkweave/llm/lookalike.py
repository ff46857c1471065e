"""One consistent form of text that looks the same but differs in its characters.

Whether a character can take part in a change is a property that can be looked up, as the quick-
check properties of Unicode normalization are: it is unstable if its own consistent form is another
string, or if it may combine with what stands before it.  A text without unstable characters is its
own consistent form, which the JVM sees by one regular expression; in other texts only the segments
around unstable characters, from the starter before them on, are normalized and spliced back.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from talkweave.functions.durable import checkpointed, once

# Letters of other scripts that are drawn like Latin ones (Unicode confusables).
LATIN_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "ԍ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
    "Ա": "U", "Տ": "S", "Օ": "O", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
# Signs that are drawn alike.
SIGN_ALIKE = {
    "‐": "-", "‑": "-", "﹣": "-", "−": "-", "⁃": "-", "‒": "–", "―": "—",
    "․": ".", "٫": ",", "‚": ",", "׃": ":", "∶": ":", "꞉": ":", "ː": ":", ";": ";", "ǃ": "!",
    "ʼ": "’", "＇": "'", "‛": "‘", "ʻ": "‘", "⁄": "/", "∕": "/", "∗": "*", "‹": "<", "›": ">", "∣": "|", "ǀ": "|",
    "·": "·", "‧": "·", "∙": "·", "⋅": "·", "・": "·",
}
#: Kinds of blank besides the line ends, and characters that show nothing.
BLANKS = "\t\xa0              　"
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
#: Kinds of compatibility decomposition that do not change what a reader sees.
ALIKE_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


@lru_cache(maxsize=65536)
def _flat(ch: str) -> str:
    """The canonical pieces of one character, each in the form that looks the same."""
    if any(a <= ord(ch) <= b for a, b in INVISIBLE):
        return ""
    if ch in BLANKS:
        return " "
    to = LATIN_ALIKE.get(ch) or SIGN_ALIKE.get(ch)
    if to:
        return to
    d = unicodedata.decomposition(ch)
    if not d:
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            return unicodedata.normalize("NFD", ch)
        return ch
    kind, *parts = d.split() if d[0] == "<" else ("", *d.split())
    pieces = "".join(chr(int(x, 16)) for x in parts)
    # a spacing accent ("´" = blank + accent), an ellipsis or a fraction is not drawn like its parts
    if kind and (kind not in ALIKE_KINDS or pieces[0] == " " or (ch != pieces and kind == "<compat>" and not pieces.isalpha())):
        return ch
    return "".join(map(_flat, pieces))


def _is_unstable(ch: str) -> bool:
    return bool(unicodedata.combining(ch)) or not unicodedata.is_normalized("NFC", ch) or unicodedata.normalize("NFC", _flat(ch)) != ch


@lru_cache(maxsize=1)
def unstable_ranges() -> list[tuple[int, int]]:
    """Code points that may change, or change what stands before them, as inclusive ranges."""
    out: list[list[int]] = []
    # conjoining Hangul vowels and finals combine with the syllable before them though they are starters
    jamo = range(0x1161, 0x1200)
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0x30000 <= cp < 0xE0000 or cp >= 0xE1000 or not (cp in jamo or _is_unstable(chr(cp))):
            continue
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(9, 9), *map(tuple, out)]


@lru_cache(maxsize=1)
def java_pattern() -> str:
    """A Java regular expression that finds an unstable character."""
    ranges = "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in unstable_ranges() if a > 9)
    return f"[\\t[\\x{{80}}-\\x{{10ffff}}&&[{ranges}]]]"  # what is ASCII never comes to the list of ranges


def segment_pattern(ranges: list[tuple[int, int]]) -> re.Pattern:
    """Unstable characters with the starter before them, which they may combine with."""
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[^{inside}]?[{inside}]+")


def consistent(text: str, pattern: re.Pattern) -> str:
    """The consistent form of a text: unstable segments normalized, the rest left as it is."""
    return pattern.sub(lambda m: unicodedata.normalize("NFC", "".join(map(_flat, m[0]))), text)


def consistent_form(text: Column) -> Column:
    """The consistent form of a text column; only unstable texts leave the JVM.

    Null stays null, an empty text stays empty, a text of invisible characters only becomes empty.
    """
    ranges = unstable_ranges()
    compiled: list[re.Pattern] = []

    @F.pandas_udf("string")
    def normalized(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not compiled:
            compiled.append(segment_pattern(ranges))
        for s in parts:
            yield s.map(lambda x: None if x is None else consistent(x, compiled[0]))

    unstable = F.when(text.rlike(java_pattern()), text)
    return F.coalesce(once(normalized)(unstable), text)


def _met(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, c0, c1 (128 bits of hash of the consistent form) and own (hash of the text) of rows in classes of more than one text.

    Only ids and hashes are shuffled; a class of texts that are all equal is dropped, so exact copies cost one aggregate row.
    """
    form = consistent_form(F.col(text))
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), form.alias("form")).where("id IS NOT NULL AND text IS NOT NULL")
    hashed = rows.select(
        "id",
        F.xxhash64("form", F.lit(0)).alias("c0"),
        F.xxhash64("form", F.lit(1)).alias("c1"),
        F.xxhash64("text").alias("own"),
    )
    hashed = checkpointed(hashed)  # both uses below read it; texts are normalized once
    mixed = hashed.groupBy("c0", "c1").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("c0", "c1")
    return hashed.join(mixed, ["c0", "c1"], "left_semi").distinct()


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row that looks like another with a different text: <key>, class, variant.

    `class` names the form, `variant` the text itself: rows of a class and different variants are
    look-alikes, rows of one variant are copies.  Null keys and texts are in no class.
    """
    name = lambda *c: F.concat(*[F.lpad(F.hex(x), 16, "0") for x in c])
    return _met(df, key, text).select(F.col("id").alias(key), name("c0", "c1").alias("class"), name("own").alias("variant"))


def look_alikes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of rows whose texts look the same but aren't equal: <key>_a < <key>_b.

    Rows meet by 128 bits of hash of their consistent form.  Null texts and keys make no pairs;
    empty texts are a class like any other; rows that repeat a key with the same text are one row.
    """
    members = _met(df, key, text)
    # texts meet once each, whatever the number of their copies; only then the copies' ids are put in
    texts = members.select("c0", "c1", "own").distinct()
    met = texts.alias("a").join(texts.alias("b"), F.expr("a.c0 = b.c0 AND a.c1 = b.c1 AND a.own < b.own")).select("a.c0", "a.c1", F.col("a.own").alias("own_a"), F.col("b.own").alias("own_b"))
    side = lambda n: members.select("c0", "c1", F.col("own").alias(f"own_{n}"), F.col("id").alias(f"id_{n}"))
    pairs = met.join(side("a"), ["c0", "c1", "own_a"]).join(side("b"), ["c0", "c1", "own_b"]).where("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias(f"{key}_a"), F.greatest("id_a", "id_b").alias(f"{key}_b")).distinct()
