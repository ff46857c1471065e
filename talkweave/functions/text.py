"""Predicates and clean-ups of text as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkweave.functions.vocab import BACKCHANNELS, HEARD_SIMULTANEOUS, HEARD_WHOLE, INTERLOCUTOR, SHORT_BACKCHANNEL, SILENCE, TRANSITIONS, UNSURE_LOGPROB

# Character ranges of Chinese, Japanese and Korean writing.
CJK = (
    r"[\x{3300}-\x{33ff}\x{fe30}-\x{fe4f}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{2e80}-\x{2eff}"
    r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}]"
)


#: Blanks of any script, as both regular expression engines know them.
BLANK = r"[\s\p{Z}\x{85}]"


def stripped(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_punctuation(text: Column) -> Column:
    """Only ASCII punctuation and spaces, blanks of any kind at the ends; true for an empty text."""
    return text.rlike(rf"^{BLANK}*[\p{{Punct}} ]*{BLANK}*$")


def is_meaningful(text: Column) -> Column:
    """Anything left besides ASCII punctuation and blanks."""
    return text.rlike(r"[^\p{Punct}\s\p{Z}\x{85}]")


def is_transition(token: Column) -> Column:
    return token.isin(TRANSITIONS)


def is_interlocutor(token: Column) -> Column:
    return token.startswith(INTERLOCUTOR)


def is_self(token: Column) -> Column:
    return ~is_transition(token) & ~is_interlocutor(token)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def words(text: Column) -> Column:
    """Blank-separated words; none for an empty or blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def backchannel_key(text: Column) -> Column:
    """Lower case without punctuation and blanks, the form of the backchannel list."""
    return F.replace(F.regexp_replace(F.lower(F.trim(text)), r"\p{Punct}", ""), F.lit(" "), F.lit(""))


def is_backchannel(text: Column, duration: Column) -> Column:
    return backchannel_key(text).isin(BACKCHANNELS) & (duration < SHORT_BACKCHANNEL)


def is_hallucination(text: Column, avg_logprob: Column, simultaneous: bool) -> Column:
    """A phrase of silence in the text, and the recogniser unsure of it; false where either is null."""
    said, phrases = (F.lower(text), HEARD_SIMULTANEOUS) if simultaneous else (text, HEARD_WHOLE)
    heard = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(said, p))
    return F.coalesce(heard & (avg_logprob < UNSURE_LOGPROB), F.lit(False))


def speaker_index(label: Column) -> Column:
    """0 for A or channel 1, 1 for B or channel 2, null for anything else."""
    last = F.regexp_extract(F.upper(F.trim(label)), r"([AB12])\W*$", 1)
    return F.when(last.isin("A", "1"), 0).when(last.isin("B", "2"), 1).cast("int")


def speaker_in_text(text: Column) -> Column:
    """The same of a label at the head of a text, such as "A:", ">> B:", "(A) -" or "Speaker B:"; null if there is none."""
    found = F.regexp_extract(F.upper(text), r"^\s*(?:>>\s*)?(?:\(([AB])\)\s*[-:]|(?:(?:SPEAKER|SPK|CHANNEL|CH)[\s_-]*)?([AB12])\s*[:>](?!\d))", 0)
    return speaker_index(F.nullif(F.regexp_replace(found, r"\W+", ""), F.lit("")))


#: What a change of the words around it must leave alone: ((unsure words)) and [annotations].
KEPT_MARKS = r"(\(\(.*?\)\)|\[.*?\])"


def between_marks(text: Column, change) -> Column:
    """`change` of what stands between marks; ((...)) and [...] come back as they were, in their places."""
    marks = F.regexp_extract_all(text, F.lit(KEPT_MARKS), 1)
    parts = F.transform(F.split(text, KEPT_MARKS), change)
    return F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def clean_switchboard(text: Column) -> Column:
    """Word transcripts: cut-off letters kept, laughed words kept, tags, asides and variant marks dropped."""
    # The marks of these transcripts.
    t = F.regexp_replace(text, r"(\S)\[(.*?)\]", "$1$2")
    t = F.regexp_replace(t, r"\[laughter-(.*?)\]", "$1")
    t = F.regexp_replace(t, r"\[.*?\]", " ")
    t = F.regexp_replace(t, r"_1|<b_aside>|<e_aside>", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_fisher(text: Column) -> Column:
    """Utterance transcripts: acronyms joined, [mn] spoken, unsure words kept, tags and broken words dropped; null if nothing is left."""
    # The marks of these transcripts.
    t = F.replace(text, F.lit("._"), F.lit("."))
    t = F.replace(t, F.lit("[mn]"), F.lit(" mhm "))
    t = F.regexp_replace(t, r"\(\((.*?)\)\)", "$1")
    t = F.regexp_replace(t, r"\(\( | \)\)|\(\(|\)\)", "")
    t = F.regexp_replace(t, r"\[.*?\]", " ")
    t = F.replace(t, F.lit(" - "), F.lit(" "))
    t = F.regexp_replace(t, r"\b\w+-(?=\s|$)", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def silent(token: Column) -> Column:
    return token.contains(SILENCE)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, even where the body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
