"""Offsets under text transformations, as column expressions over strings and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_shift(text, offset) -> tuple[Column, Column]:
    """Text without leading and trailing spaces, and its offset moved by the leading ones."""
    t = _c(text)
    return F.trim(t), _c(offset) + (F.length(t) - F.length(F.ltrim(t)))


def squeeze(text) -> Column:
    """Runs of spaces as one space."""
    return F.regexp_replace(_c(text), " {2,}", " ")


def squeezed_offset(text, offset) -> Column:
    """Where a position stands once the runs of spaces before it are squeezed."""
    return F.length(squeeze(F.substring(_c(text), F.lit(1), _c(offset))))


def word_index(text, offset) -> Column:
    """Number of the space-separated word that begins at a position (or of the one it stands in)."""
    return F.size(F.split(F.substring(_c(text), F.lit(1), _c(offset)), " ")) - 1


def last_segment(url) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_c(url), "/"), -1)


def wiki_title(title) -> Column:
    return F.replace(_c(title), F.lit(" "), F.lit("_"))


def drop_blank(tokens) -> Column:
    """Tokens that are neither null nor blank."""
    return F.filter(_c(tokens), lambda t: t.isNotNull() & (F.trim(t) != ""))


def kept_before(tokens, position) -> Column:
    """How many non-blank tokens stand before a position: the position once blanks are dropped."""
    return F.size(drop_blank(F.slice(_c(tokens), F.lit(1), _c(position))))


def find_all(text, needle) -> Column:
    """Every position (from 0) at which needle occurs, overlaps included; empty for an empty needle."""
    t, n = _c(text), _c(needle)
    last = F.length(t) - F.length(n)
    every = F.when((F.length(n) > 0) & (last >= 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.substring(t, i + 1, F.length(n)) == n)


def pad(tokens, length: int, filler: str = "<pad>") -> Column:
    """Tokens filled up to a length."""
    t = _c(tokens)
    return F.concat(t, F.array_repeat(F.lit(filler), F.greatest(F.lit(length) - F.size(t), F.lit(0))))


def plain_punctuation(text) -> Column:
    """Curly quotes, dashes and bracket codes in their plain form, spaces out, for comparing spellings."""
    t = _c(text)
    for a, b in (("“", '"'), ("”", '"'), ("’", "'"), ("‘", "'"), ("–", "-"), ("—", "-"), ("-LRB-", "("), ("-RRB-", ")"), ("``", '"'), ("''", '"')):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.replace(F.lower(t), F.lit(" "), F.lit(""))


def sane_tag(text) -> Column:
    """A name fit for files and tags: other characters as underscores, runs of them as one."""
    return F.regexp_replace(F.regexp_replace(_c(text), "[^A-Za-z0-9_.=-]+", "_"), "_+", "_")
