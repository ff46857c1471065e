"""The plain text of turns written in HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from talkweave.functions.durable import once

# Elements without an end, whose blanks count, and whose text is not the page's.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
KEPT, HIDDEN = frozenset(("pre", "textarea")), frozenset(("script", "style", "template", "rt", "rp"))
#: What only the parser can read: a tag, comment or declaration, or a reference to a character.
MARKED = r"<[A-Za-z/!?]|&[#A-Za-z]"


class _Texts(HTMLParser):
    """Gathers the texts between tags, without comments, declarations, scripts and the like."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.texts: list[str] = []
        self.part: list[str] = []
        self.open: list[str] = []

    def end_text(self, shown: bool = True) -> None:
        text, self.part = "".join(self.part), []
        if not text.strip(" \t\n\r\f") and not KEPT.intersection(self.open):
            text = "\n" if "\n" in text else text and " "
        if text and shown and not HIDDEN.intersection(self.open):
            self.texts.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_text()
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.end_text()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.part.append(data)

    def handle_charref(self, name: str) -> None:
        try:
            n = int(name[1:], 16) if name[:1] in "xX" else int(name)
            self.part.append(bytes([n]).decode("cp1252", "ignore") or chr(n) if n < 256 else "�" if 0xD800 <= n < 0xE000 else chr(n))
        except (ValueError, OverflowError):
            self.part.append("�")

    def handle_entityref(self, name: str) -> None:
        self.part.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data: str) -> None:
        self.end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self.end_text()
        self.part.append(data.removeprefix("CDATA["))
        self.end_text(data.startswith("CDATA["))


def texts_of(text: str) -> str:
    """The texts between the tags, a line end between any two; a text that no parser can read stays as it is."""
    p = _Texts()
    try:
        p.feed(text)
        p.close()
    except AssertionError:
        return text
    p.end_text()
    return "\n".join(p.texts)


def tags_to_lines(text: Column) -> Column:
    """Line ends for tags, characters for references; only texts with any of them leave the JVM."""

    @F.pandas_udf("string")
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([None if t is None else texts_of(t) for t in p], dtype=object)

    return F.coalesce(once(parsed)(F.when(text.rlike(MARKED), text)), text)
