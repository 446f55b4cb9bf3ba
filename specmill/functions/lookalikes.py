"""Character tables: look-alike letters, invisible characters and unusual blanks."""

from __future__ import annotations

import re
import unicodedata

# Latin and Greek letters that look like a Cyrillic letter, and that letter.
LATIN = "ABCEHIJKMOPSTXYaceijopsxyË"
LATIN_TO_CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуЁ"
GREEK = "ΑΒΕΗΙΚΜΟΡΤΥΧαορυχκτ"
GREEK_TO_CYRILLIC = "АВЕНІКМОРТУХаорухкт"
GREEK_TO_LATIN = "ABEHIKMOPTYXaopyxkt"

# Characters without a visible form of their own, and blanks other than space, tab and line break.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a"
    "\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
BLANKS = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

TO_CYRILLIC = str.maketrans(LATIN + GREEK, LATIN_TO_CYRILLIC + GREEK_TO_CYRILLIC)
TO_LATIN = str.maketrans(LATIN_TO_CYRILLIC + GREEK, LATIN + GREEK_TO_LATIN)
PLAIN = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {0xFF01 + i: 0x21 + i for i in range(94)}

_ODD = re.compile(f"[{INVISIBLE}{BLANKS}\u0300-\u036f\uff01-\uff5e]")
_MIXED = re.compile(r"[A-Za-z\u00c0-\u024f\u0370-\u03ff]*[\u0400-\u04ff][A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff]*")
_FOREIGN = re.compile(r"[A-Za-z\u0370-\u03ff]")
_SEAM = re.compile(r"[A-Za-z\u00c0-\u024f\u0370-\u03ff][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z\u00c0-\u024f\u0370-\u03ff]")

#: Texts without a match come out of plain() as they are.
NOT_PLAIN = f"{_ODD.pattern}|{_SEAM.pattern}"


def _cyrillic(m: re.Match) -> str:
    w = m.group(0)
    return w.translate(TO_CYRILLIC) if _FOREIGN.search(w) else w


def plain(text: str) -> str:
    """Composed letters, ordinary blanks and widths, no invisible characters; words that mix
    Cyrillic with look-alike Latin or Greek letters come out wholly Cyrillic."""
    if text.isascii():
        return text
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text.translate(PLAIN))
    return _MIXED.sub(_cyrillic, text) if _SEAM.search(text) else text
