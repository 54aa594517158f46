"""Text functions, as column expressions only.

Tokens: lower case, runs of ASCII punctuation and white space part words, one-character ASCII words are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"[\p{Punct}\s]+"
_SHORT = r"^\p{Alnum}?$"


def tokens(text: Column) -> Column:
    """array<string>; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _PARTS), lambda w: ~w.rlike(_SHORT))


def row_text(columns: list[str] | tuple[str, ...]) -> Column:
    """The text columns of a row, nulls left out."""
    return F.concat_ws(" ", *[F.col(c) for c in columns])


def clean(text: Column) -> Column:
    """Words two spaces apart, one space on either side: so that removing ' word ' never joins neighbours."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), "  "), F.lit(" "))


def clean_compact(text: Column) -> Column:
    """Words one space apart, short words kept."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _PARTS, " "))


def term_count(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def has_phrase(columns: list[str] | tuple[str, ...], words: list[str]) -> Column:
    """The words stand one after the other within one column."""
    wanted = f" {' '.join(words)} "
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")), F.lit(wanted))
    return found


def highlight(text: Column, words: list[str]) -> Column:
    """Every word, in any case, as <b>word</b>. Words are set aside as signs of a private area first, so that none is marked within another's mark."""
    for i, w in enumerate(words):
        text = F.regexp_replace(text, f"(?i){re.escape(w)}", chr(0xE000 + i))
    for i, w in enumerate(words):
        text = F.replace(text, F.lit(chr(0xE000 + i)), F.lit(f"<b>{w}</b>"))
    return text


def escaped(text: Column) -> Column:
    """For HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def two_places(score: Column) -> Column:
    return F.format_string("%.2f", score)


def replaced(text: Column, old: str, new: str) -> Column:
    """Every literal old as new."""
    return F.replace(text, F.lit(old), F.lit(new))


def cut_tail(text: Column, n: int) -> Column:
    """Without the last n characters; empty if there are no more."""
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))


def tokens_of(text: str) -> list[str]:
    """The same tokens of a literal."""
    punct = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return [w for w in re.split(rf"[{punct}\s]+", text.lower()) if not re.fullmatch(r"[A-Za-z0-9]?", w)]


# The stop words that the index leaves out unless it is given others; plain forms that tokens can be.
STOP_WORDS = tuple(
    """about above after again against all am an and any are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how if in into is it its itself just me more most my myself no nor not now of off on once only or other
    our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which while who whom why will
    with would you your yours yourself yourselves""".split()
)


def stop_words(path: str | None = None) -> tuple[str, ...]:
    """STOP_WORDS, or the words of a file, one a line."""
    if path is None:
        return STOP_WORDS
    with open(path, encoding="utf-8") as f:
        return tuple(sorted({w for line in f for w in [line.strip().lower()] if tokens_of(w) == [w]}))
