"""Patterns of the checks, written once and rendered for Java and for RE2.

In a pattern <D> is a digit, <S> a whitespace character, <W> a word character; <_W>, <_A> mean that no word
character, no letter or digit follows, <A_> that none precedes. RE2 has no lookaround: there
these consume one character, which is equal for tests of whether a pattern occurs. All run on lower-cased text.
"""

from __future__ import annotations

from specmill.functions.text import whitespace
from specmill.rules.tables import OBLIGATIONS

_ALNUM = "а-яёa-z0-9"
_WS = whitespace(r"\t-\r\x1c-\x20", "\\x{{{:x}}}")


def java(pattern: str) -> str:
    for a, b in {"<D>": r"\p{Nd}", "<S>": _WS, "<W>": r"[\p{L}\p{N}_]", "<_W>": r"(?![\p{L}\p{N}_])", "<_A>": f"(?![{_ALNUM}])", "<A_>": f"(?<![{_ALNUM}])"}.items():
        pattern = pattern.replace(a, b)
    return pattern


def re2(pattern: str) -> str:
    for a, b in {"<D>": r"\p{Nd}", "<S>": _WS, "<W>": r"[\p{L}\p{N}_]", "<_W>": r"(?:[^\p{L}\p{N}_]|$)", "<_A>": f"(?:[^{_ALNUM}]|$)", "<A_>": f"(?:^|[^{_ALNUM}])"}.items():
        pattern = pattern.replace(a, b)
    return pattern


_NUMBER = r"<D>(?:<D>|<S>|[,.])*<S>*"
# Signals of quantity in a requirement.
OBLIGATION_BEFORE = "(?:^|[^0-9a-zа-яё_])"
OBLIGATION_WORD = "(?:" + "|".join(OBLIGATIONS) + ")(?:[^0-9a-zа-яё_]|$)"
OBLIGATION = OBLIGATION_BEFORE + "(" + "|".join(OBLIGATIONS) + ")(?:[^0-9a-zа-яё_]|$)"
TIME = _NUMBER + r"(?:мсек|мс<_W>|сек(?:унд|унды|унд)?|сек\.|с\.<_W>|мин(?:ут)?|мин\.|час(?:а|ов)?|ч\.|дн(?:ей|я)?|дн\.|недел(?:и|ь|ю|ями)?|месяц(?:а|ев)?|лет|год(?:а|у|ов)?)"
UNIT = _NUMBER + r"(?:%|проц|с\.<_W>|гц|мгц|кг|мг|г<_W>|км/ч|км<_W>|мм<_W>|см<_W>|м[²³]?<_W>|градус|°<S>*[cсfф]<_W>|бит|байт|кб<_W>|мб<_W>|гб<_W>|тб<_W>|мбит<S>*/<S>*с|мегабит<S>*/<S>*с|вт<_W>|ма<_W>|ом<_W>|рпс|tps|qps)"
COMPACT = r"<D>+(?:[,.]<D>+)?(?:мсек|мс|сек(?:унд|унды|унд)?|сек\.|с\.|мин(?:ут)?|мин\.|ч(?:ас(?:а|ов)?)?|ч\.|гб|мб|кб|тб|гц|мгц|кг|мг|мм|см|км|км/ч|мбит/с|мегабит/с|%|°[cс]|°<S>*[cс])<_A>"
COMPACT_LETTER = r"<D>+(?:[,.]<D>+)?[смг]<_A>"
RANGE_FROM_TO = r"от<S>+<D>(?:<D>|<S>|[,.])*<S>+до<S>+<D>"
RANGE_DASH = r"<D>(?:<D>|<S>|[,.])*<S>*[–—−-]<S>*<D>(?:<D>|<S>|[,.])"
COMPARISON = r">=|<=|≥|≤"
COMPARISON_NUMBERS = r"<D>(?:<D>|<S>|[,.])*<S>*[<>]<S>*<D>"
STANDALONE = (
    r"(?:^|[^0-9,.])%(?:[^0-9]|$)|°<S>*[cсfф]<_A>|мбит<S>*/<S>*с|мегабит<S>*/<S>*с|км<S>*/<S>*ч|запросов<S>+в<S>+секунду|операций<S>+в<S>+(?:секунду|минуту)|"
    r"<A_>(?:гц|мгц|кб|мб|гб|тб|байт(?:ов|а|ы)?|мм|см|км|кг|мг|секунд(?:а|ы|ам|ах|ою)?|минут(?:а|ы|ам|ах)?|час(?:ов|а|у|ам|ах)?|мсек|мс|градус(?:ов|а|е|ах)?)<_A>|в<S>+секундах|в<S>+минутах|в<S>+часах"
)
DIGIT = "<D>"


