"""Reading forms of text: compatibility forms, invisible characters and look-alike letters."""

from __future__ import annotations

import unicodedata

#: Letters of Cyrillic and Greek that look like a Latin letter (Unicode confusables).
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
LOOKALIKE_TO = "ABESIJKMHOPCTYXaesijopcyxhdqwYABEZHIKMNOPTYXo"
#: Accented letters whose base is such a letter.
ACCENTED_FROM = "ЁёЇїЀѐ"
ACCENTED_TO = "ËëÏïÈè"
#: Characters that take no room.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u200e\u200f\u180e\u061c"
#: Spaces other than U+0020, and hyphens other than U+002D.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"
HYPHENS = "‐‑"

#: With letter case set aside, capitals that look alike tie their small letters together too.
CASELESS_FROM = "внктмαβεζηικμνρτυχ"
CASELESS_TO = "bhktmabezhikmnptyx"

_TABLE = dict(zip(LOOKALIKE_FROM + ACCENTED_FROM, LOOKALIKE_TO + ACCENTED_TO, strict=True))
_TABLE |= dict.fromkeys(INVISIBLE, "") | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-")
_CASELESS = dict(zip(CASELESS_FROM, CASELESS_TO, strict=True))


def _mapped(text: str, table: dict[str, str]) -> str:
    """Characters by a table that maps to none of its own keys; only those at hand are looked for."""
    for c in table.keys() & set(text):
        text = text.replace(c, table[c])
    return text


def reading_form(text: str) -> str:
    """What a reader sees: NFKC, look-alikes as Latin, nothing invisible, plain spaces and hyphens."""
    if text.isascii():
        return text.replace("\t", " ")
    text = _mapped(unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)), _TABLE)
    return unicodedata.normalize("NFC", text)


def caseless_form(text: str) -> str:
    """The reading form with letter case set aside as well."""
    text = reading_form(text).lower()
    return text if text.isascii() else _mapped(text, _CASELESS)
