"""Measured values in text, converted to one common unit per quantity.

A unit string is segmented by dynamic programming over three tries (prefixes, roots with
their endings, exponents); each decomposition is scored by a prior for the dimension that
the field in front of the number names, so that for example "мин" after a duration is a
minute and not a milli-inch, and a lone "с", "В" or "К" is a unit only where its field
wants it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.lookalikes import NOT_PLAIN, plain

# Decimal and binary prefixes, symbols and words.
SYMBOL_PREFIXES = {
    "п": -12, "н": -9, "мк": -6, "м": -3, "с": -2, "д": -1, "г": 2, "к": 3, "К": 3, "М": 6, "Г": 9, "Т": 12, "П": 15,
    "p": -12, "n": -9, "µ": -6, "μ": -6, "u": -6, "m": -3, "c": -2, "d": -1, "h": 2, "k": 3, "K": 3, "M": 6, "G": 9, "T": 12, "P": 15,
    "毫": -3, "微": -6, "纳": -9, "厘": -2, "分": -1, "千": 3, "兆": 6, "吉": 9, "太": 12,
}
WORD_PREFIXES = {
    "пико": -12, "нано": -9, "микро": -6, "милли": -3, "санти": -2, "деци": -1, "гекто": 2, "кило": 3, "мега": 6, "гига": 9, "тера": 12, "пета": 15,
    "pico": -12, "nano": -9, "micro": -6, "milli": -3, "centi": -2, "deci": -1, "hecto": 2, "kilo": 3, "mega": 6, "giga": 9, "tera": 12, "peta": 15,
}
BINARY_PREFIXES = {
    "Ки": 1, "Ми": 2, "Ги": 3, "Ти": 4, "Пи": 5, "Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5,
    "киби": 1, "меби": 2, "гиби": 3, "теби": 4, "kibi": 1, "mebi": 2, "gibi": 3, "tebi": 4,
}

# Roots as (forms, endings, dimension, factor to the base unit, classes of prefixes that may stand before).
_SOFT = ("", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах", "и", "ок", "я", "ей", "ям", "ями", "ях", "ю", "ой", "ем", "ам", "ью")
ROOTS: list[tuple[tuple[str, ...], tuple[str, ...], str, Fraction | int, str]] = [
    (("секунд", "сек", "с"), _SOFT[:12], "duration", 1000, "sw"),
    (("минут", "мин"), _SOFT[:12], "duration", 60_000, ""),
    (("час", "ч"), _SOFT[:12], "duration", 3_600_000, ""),
    (("сут", "сутк", "суток", "дн", "ден", "день", "дней"), ("", "и", "ок", "ам", "ами", "ах", "я", "ей", "ь"), "duration", 86_400_000, ""),
    (("недел",), ("я", "и", "ю", "ь", "ям", "ями", "ях", "ей"), "duration", 604_800_000, ""),
    (("seconds", "second", "secs", "sec", "s"), ("",), "duration", 1000, "sw"),
    (("minutes", "minute", "mins", "min"), ("",), "duration", 60_000, ""),
    (("hours", "hour", "hrs", "hr", "h"), ("",), "duration", 3_600_000, ""),
    (("days", "day", "d"), ("",), "duration", 86_400_000, ""),
    (("weeks", "week"), ("",), "duration", 604_800_000, ""),
    (("Sekunden", "Sekunde", "Sek"), ("",), "duration", 1000, "w"),
    (("Minuten", "Minute"), ("",), "duration", 60_000, ""),
    (("Stunden", "Stunde", "Std"), ("",), "duration", 3_600_000, ""),
    (("годин",), ("а", "и", "у", ""), "duration", 3_600_000, ""),
    (("秒", "秒钟", "秒鐘", "秒間"), ("",), "duration", 1000, "s"),
    (("分钟", "分鐘", "分間"), ("",), "duration", 60_000, ""),
    (("小时", "小時", "時間"), ("",), "duration", 3_600_000, ""),
    (("天", "日間"), ("",), "duration", 86_400_000, ""),
    (("байт", "Байт", "Б"), _SOFT[:12], "data_size", 1, "swb"),
    (("бит",), _SOFT[:12], "data_size", Fraction(1, 8), "swb"),
    (("bytes", "byte", "B", "Bytes", "Byte"), ("",), "data_size", 1, "swb"),
    (("bits", "bit"), ("",), "data_size", Fraction(1, 8), "swb"),
    (("b",), ("",), "data_size", Fraction(1, 8), "sb"),
    (("字节", "バイト"), ("",), "data_size", 1, "sb"),
    (("比特", "ビット"), ("",), "data_size", Fraction(1, 8), "sb"),
    (("bps",), ("",), "data_rate", 1, "s"),
    (("метр", "м"), _SOFT[:12], "length", 1_000_000, "sw"),
    (("meters", "metres", "meter", "metre", "m"), ("",), "length", 1_000_000, "sw"),
    (("дюйм",), _SOFT[:12], "length", 25_400, ""),
    (("inches", "inch", "in", "Zoll"), ("",), "length", 25_400, ""),
    (("фут",), _SOFT[:12], "length", 304_800, ""),
    (("feet", "foot", "ft"), ("",), "length", 304_800, ""),
    (("米", "メートル"), ("",), "length", 1_000_000, "s"),
    (("英寸",), ("",), "length", 25_400, ""),
    (("грамм", "г", "гр"), _SOFT[:12], "mass", 1000, "sw"),
    (("тонн", "т"), _SOFT[:12], "mass", 1_000_000_000, "sw"),
    (("grams", "gram", "g"), ("",), "mass", 1000, "sw"),
    (("tonnes", "tonne", "tons", "ton", "t"), ("",), "mass", 1_000_000_000, "sw"),
    (("фунт",), _SOFT[:12], "mass", Fraction("453592.37"), ""),
    (("pounds", "pound", "lbs", "lb"), ("",), "mass", Fraction("453592.37"), ""),
    (("унци",), ("", "я", "и", "ю", "й", "ям", "ями", "ях", "ей"), "mass", Fraction("28349.523125"), ""),
    (("ounces", "ounce", "oz"), ("",), "mass", Fraction("28349.523125"), ""),
    (("克", "グラム"), ("",), "mass", 1000, "s"),
    (("公斤",), ("",), "mass", 1_000_000, ""),
    (("吨", "噸", "トン"), ("",), "mass", 1_000_000_000, "s"),
    (("ватт", "Вт"), _SOFT[:12], "power", 1000, "sw"),
    (("watts", "watt", "W", "Watt", "Watts"), ("",), "power", 1000, "sw"),
    (("瓦", "ワット"), ("",), "power", 1000, "s"),
    (("паскал", "Па"), ("", "ь", "я", "ей", "ю", "ем", "е", "и", "ям", "ями", "ях"), "pressure", 1, "sw"),
    (("pascals", "pascal", "Pa"), ("",), "pressure", 1, "sw"),
    (("бар", "bar", "bars"), _SOFT[:12], "pressure", 100_000, "sw"),
    (("атм", "атмосфер", "atm", "atmospheres", "atmosphere"), _SOFT[:12], "pressure", 101_325, ""),
    (("ммртст", "ммрт", "mmHg", "mmhg", "миллиметр_ртутного_столба"), ("",), "pressure", Fraction("133.322"), ""),
    (("帕",), ("",), "pressure", 1, "s"),
    (("巴",), ("",), "pressure", 100_000, "s"),
    (("герц", "Гц"), _SOFT[:12], "frequency", 1, "sw"),
    (("hertz", "Hz", "Hertz"), ("",), "frequency", 1, "sw"),
    (("赫兹", "赫", "ヘルツ"), ("",), "frequency", 1, "s"),
    (("вольт", "В"), _SOFT[:12], "voltage", 1000, "sw"),
    (("volts", "volt", "V", "Volt"), ("",), "voltage", 1000, "sw"),
    (("伏", "伏特", "ボルト"), ("",), "voltage", 1000, "s"),
    (("К", "K", "кельвин", "kelvin", "kelvins", "开尔文"), _SOFT[:12], "temperature:K", 1, ""),
    (("°C", "°С", "градусовЦельсия", "градусЦельсия", "градусаЦельсия", "градусахЦельсия", "градЦельсия", "degreesCelsius", "degreeCelsius", "摄氏度", "℃", "GradCelsius", "degC"), ("",), "temperature:C", 1, ""),
    (("°F", "градусовФаренгейта", "градусФаренгейта", "градусаФаренгейта", "градусахФаренгейта", "градФаренгейта", "degreesFahrenheit", "degreeFahrenheit", "华氏度", "℉", "GradFahrenheit", "degF"), ("",), "temperature:F", 1, ""),
    (("°", "градус"), _SOFT[:12], "temperature:C?", 1, ""),
]
EXPONENTS = {"²": 2, "³": 3, "^2": 2, "^3": 3, "2": 2, "3": 3}

# The words of a field that name the dimension of its value.
FIELDS = [
    ("pressure", "давлени", "срабатывания клапана", "pressure", "压力"),
    ("voltage", "напряжени", "контроля изоляции", "уровень сигнала", "уровня сигнала", "voltage", "signal level", "电压"),
    ("temperature", "температур", "по нагреву", "temperature", "温度", "cut-out point", "heat"),
    ("frequency", "частот", "полоса приёма", "полоса приема", "полосы приёма", "frequency", "clock", "频率", "sampling", "bandwidth of reception"),
    ("data_rate", "скорость обмена", "поток телеметрии", "пропускная способность", "link speed", "throughput", "line rate", "传输", "速率"),
    ("data_size", "архива", "размер вложени", "накопител", "буфер", "archive size", "attachment", "buffer", "capacity", "容量", "大小"),
    ("power", "мощност", "тепловыделени", "power", "heater", "heat output", "功率"),
    ("mass", "масса", "массы", "вес ", "вес\n", "нагрузк", "weight", "load", "mass", "载荷", "重量"),
    ("length", "длина", "длины", "толщин", "высот", "ширин", "глубин", "шаг ", "шаг\n", "габарит", "length", "thickness", "height", "width", "depth", "pitch", "clearance", "厚度", "长度", "高度", "宽度"),
    ("duration", "длительност", "задержк", "время", "времени", "пауза", "паузы", "период", "pause", "time", "period", "delay", "duration", "间隔", "时间"),
]
_FIELD_OF = {w: names[0] for names in FIELDS for w in names[1:]}
_FIELD = re.compile("|".join(sorted(map(re.escape, _FIELD_OF), key=len, reverse=True)), re.I)

# Numbers as words, in the cases in which they stand before a unit.
NUMBER_WORDS = {
    "один": 1, "одного": 1, "одной": 1, "одна": 1, "одну": 1, "два": 2, "две": 2, "двух": 2, "три": 3, "трёх": 3, "трех": 3, "четыре": 4, "четырёх": 4, "четырех": 4,
    "пять": 5, "пяти": 5, "шесть": 6, "шести": 6, "семь": 7, "семи": 7, "восемь": 8, "восьми": 8, "девять": 9, "девяти": 9, "десять": 10, "десяти": 10,
    "одиннадцать": 11, "одиннадцати": 11, "двенадцать": 12, "двенадцати": 12, "тринадцать": 13, "тринадцати": 13, "четырнадцать": 14, "четырнадцати": 14,
    "пятнадцать": 15, "пятнадцати": 15, "шестнадцать": 16, "шестнадцати": 16, "семнадцать": 17, "семнадцати": 17, "восемнадцать": 18, "восемнадцати": 18,
    "девятнадцать": 19, "девятнадцати": 19, "двадцать": 20, "двадцати": 20, "тридцать": 30, "тридцати": 30, "сорок": 40, "сорока": 40, "пятьдесят": 50, "пятидесяти": 50,
    "шестьдесят": 60, "шестидесяти": 60, "семьдесят": 70, "семидесяти": 70, "восемьдесят": 80, "восьмидесяти": 80, "девяносто": 90, "девяноста": 90, "сто": 100, "ста": 100,
    "двести": 200, "двухсот": 200, "триста": 300, "трёхсот": 300, "полтора": Fraction(3, 2), "полторы": Fraction(3, 2), "полутора": Fraction(3, 2),
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}
MULTIPLIERS = {"тыс": 10**3, "тысяч": 10**3, "тысячи": 10**3, "млн": 10**6, "миллион": 10**6, "миллиона": 10**6, "миллионов": 10**6, "млрд": 10**9, "миллиардов": 10**9, "thousand": 10**3, "million": 10**6, "billion": 10**9, "万": 10**4}


class Trie:
    """A trie of strings; longest() and all prefixes of a position are what the segmentation asks for."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, value: object) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def matches(self, text: str, at: int) -> Iterator[tuple[int, object]]:
        """Every (end, value) of an entry that starts at this position."""
        node = self.root
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            for value in node.get("", ()):
                yield i + 1, value


def _tries() -> tuple[Trie, Trie, Trie]:
    prefixes, roots, exponents = Trie(), Trie(), Trie()
    for table, kind in ((SYMBOL_PREFIXES, "s"), (WORD_PREFIXES, "w")):
        for p, power in table.items():
            prefixes.add(p, (Fraction(10) ** power, kind))
    for p, power in BINARY_PREFIXES.items():
        prefixes.add(p, (Fraction(1024) ** power, "b"))
    for forms, endings, dimension, factor, allowed in ROOTS:
        for form in forms:
            short = len(form) <= 2 and not "一" <= form[0] <= "鿿" or endings == ("",)
            for ending in ("",) if short else dict.fromkeys(endings):
                roots.add(form + ending, (dimension, Fraction(factor), allowed, form))
    for e, power in EXPONENTS.items():
        exponents.add(e, power)
    return prefixes, roots, exponents


PREFIXES, ROOT_TRIE, EXPONENT_TRIE = _tries()


def _segment(unit: str) -> list[tuple[str, Fraction, str, int, float]]:
    """All (dimension, factor, root form, exponent, penalty) of one unit without a quotient.

    best[i] holds the partial decompositions that end at position i, by the part that
    comes next: a prefix may be followed by a root, a root by an exponent."""
    n = len(unit)
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0]["start"] = [(None, Fraction(1), "", "", 1, 0.0)]
    for i in range(n):
        for state, parts in list(best[i].items()):
            for dimension, factor, kind, form, exponent, penalty in parts:
                if state == "start":
                    for end, (scale, k) in PREFIXES.matches(unit, i):
                        best[end].setdefault("prefix", []).append((None, scale, k, "", 1, penalty + 1.0))
                if state in ("start", "prefix"):
                    for end, (dim, f, allowed, root) in ROOT_TRIE.matches(unit, i):
                        if state == "start" or kind in allowed:
                            # a spelled prefix wants a spelled root and a symbol wants a symbol
                            mixed = 0.5 if kind == "w" and end - i <= 2 else 0.0
                            best[end].setdefault("root", []).append((dim, factor * f, kind, root, 1, penalty + mixed))
                if state == "root":
                    for end, power in EXPONENT_TRIE.matches(unit, i):
                        best[end].setdefault("exponent", []).append((dimension, factor, kind, form, power, penalty + 0.5))
    return [(d, f, root, e, p) for s in ("root", "exponent") for d, f, _, root, e, p in best[n].get(s, ())]


_PER = re.compile(r"\s*/\s*|\s+в\s+|\s+per\s+|\s+pro\s+", re.I)
_RT = re.compile(r"^(?:мм|миллиметр\w*)\s*рт(?:утного)?\.?\s*ст(?:олба)?\.?$|^мм\s*рт\.?$", re.I)
_HG = re.compile(r"^mm\s*hg$", re.I)


@lru_cache(maxsize=65536)
def parse_unit(unit: str, field: str | None = None) -> tuple[str, Fraction] | None:
    """The dimension and factor of a unit string, or None. field: the dimension that its field names.

    Scores: a decomposition whose dimension is the field's gains 4, one against it loses 5;
    one letter without a field that wants it isn't a unit. The best positive score wins, ties
    go to the shorter decomposition, then to the order of the tables."""
    text = unit.strip().rstrip(".").strip()
    if not text:
        return None
    if _RT.match(text) or _HG.match(text):
        parts = ["ммртст"]
    else:
        parts = [p.replace(" ", "").replace(".", "") if p.count(".") < 2 else p for p in _PER.split(text)]
    best: tuple[float, str, Fraction] | None = None
    for i, variant in enumerate(dict.fromkeys(("|".join(parts), "|".join(parts).lower()))):
        pieces = variant.split("|")
        if len(pieces) > 2:
            return None
        below = None
        if len(pieces) == 2:
            below = [x for x in _segment(pieces[1]) if x[0] == "duration" and x[3] == 1]
            if not below:
                continue
        for dimension, factor, root, exponent, penalty in _segment(pieces[0]):
            if exponent != 1:
                continue  # areas and volumes are no quantities of the list
            if below is not None:
                if dimension != "data_size":
                    continue
                dimension, factor = "data_rate", factor * 8 / (below[0][1] / 1000)
            kind = dimension.partition(":")[0]
            score = 2.0 - penalty - i * 1.5 + (4.0 if kind == field else 0.0 if field is None else -5.0)
            if field is None and (len(text) == 1 or dimension == "temperature:C?"):
                score -= 5
            if field is None and text.lower() in _WORDS:
                score -= 5
            if score > 0 and (best is None or score > best[0]):
                best = (score, dimension, factor)
    return best and (best[1], best[2])


# Short words that are also unit symbols.
_WORDS = {"in", "min", "am", "a", "d", "h", "t", "m", "g", "v", "w", "k", "c", "гр", "см", "дн", "ст", "кг/см"}


def to_base(value: Fraction, dimension: str, factor: Fraction) -> tuple[str, int]:
    """The quantity and the value in its base unit, rounded half to even."""
    kind, _, scale = dimension.partition(":")
    if scale == "K":
        value = (value - Fraction("273.15")) * 1000
    elif scale == "F":
        value = (value - 32) * 5 / 9 * 1000
    elif scale:
        value = value * 1000
    else:
        value = value * factor
    return kind, round(value)


_NUM = r"(?:\d{1,3}(?:[ '’]\d{3})+(?!\d)|\d{1,3}(?:,\d{3}){2,}(?!\d)|\d+)(?:[.,]\d+)?"
_POWER = r"(?:\s*[·*×x]\s*10\s*\^?\s*[-−]?\d+)"
_ONE = rf"(?:[-−–+]?{_NUM}{_POWER}?)"
_JOIN = r"\s*(?:\.\.\.?|…|–|—|-|−|÷|×|х|x|\*|~|до|to|bis|and|至|到)\s*"
_MULT = r"(?:\s*(?:" + "|".join(sorted(MULTIPLIERS, key=len, reverse=True)) + r")\b\.?)?"
_UNIT_WORD = r"(?:°\s?[CСFcсf]\b|[℃℉°″]|[^\W\d_]+(?:[²³]|\^[23])?)"
_UNITS = rf"{_UNIT_WORD}(?:\.?\s?/\s?{_UNIT_WORD})?(?:\.?\s{_UNIT_WORD}){{0,2}}"
_VALUES = re.compile(rf"({_ONE}(?:{_JOIN}{_ONE})*)({_MULT})\s?({_UNITS})")
_WORD_VALUES = re.compile(r"((?i:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + rf")(?:\s(?i:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + rf"))?)({_MULT})\s({_UNITS})")
_ITEM = re.compile(rf"([-−–+]?{_NUM})({_POWER})?")
_WHOSE = r"по\s[а-яё]{3,15}\s"  # by design, in fact, by norm: several values of one field
_HALF = re.compile(r"\b(?:полу|пол)(часа|минуты|секунды|суток|метра|километра|тонны|килограмма|литра|вольта|ватта|киловатта)\b", re.I)
_BEFORE = re.compile(
    r"(?:\(в\s(?P<a>[^()\d]{2,40})\)|,\s(?P<b>[^\s,()\d]{1,12}(?:/[^\s,()\d]{1,6})?|мм рт\. ст\.|°C|°F),[^:!?]{0,80}?|\sв\s(?P<c>[а-яё]{3,25}(?:\sв\sсекунду|\s(?:Цельсия|Фаренгейта)|\sртутного\sстолба)?)|\bin\s(?P<d>[a-z]{3,20}(?:\sper\ssecond)?))"
    rf"\s?(?::|—|–)\s?(?P<rest>(?:{_WHOSE})?{_ONE}(?:{_JOIN}{_ONE})*(?:,\s{_WHOSE}{_ONE})*)(?!\s?[-–—]?\d)"
)
_BREAK = re.compile(r"[.!?…;]\s+(?=[^\W\da-zа-яё_]|[«\"„“])|[。！？；]")
_PARAGRAPH = re.compile(r"\n\s*\n")
_RUN = re.compile(r"\d+")
_NEAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдеёжзийклмнопрстуфхцчшщъыьэюя0123456789_")
_STICKS = frozenset(".,/№#@-")
_GROUP = re.compile(r"[ '’]")


def _value(text: str, latin: bool, power: str | None) -> Fraction:
    text = _GROUP.sub("", text).replace("−", "-").replace("–", "-").lstrip("+")
    if latin and re.fullmatch(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?", text) or text.count(",") > 1:
        text = text.replace(",", "")
    value = Fraction(text.replace(",", "."))
    if power:
        value *= Fraction(10) ** int(re.sub(r"[^\d-]", "", re.sub(r"^\s*[·*×x]\s*10\s*\^?", "", power).replace("−", "-")))
    return value


def _numbers(text: str, latin: bool) -> list[Fraction]:
    low = text.lower().split()
    if low and all(w in NUMBER_WORDS for w in low):
        values = [NUMBER_WORDS[w] for w in low]
        return [Fraction(sum(values))] if len(values) == 1 or values[0] >= 20 > values[1] else [Fraction(values[-1])]
    out, at = [], 0
    while m := _ITEM.search(text, at):
        sign_is_dash = m.start() > 0 and m.group(1)[0] in "-−–" and (text[m.start() - 1].isdigit() or out and not re.search(r"(до|to|bis|…|\.\.|~)\s*$", text[at : m.start()]) and not re.search(r"[-–−—]\s*$", text[at : m.start()]))
        out.append(_value(m.group(1).lstrip("-−–+") if sign_is_dash else m.group(1), latin, m.group(2)))
        at = m.end()
    return out


def _unit(words: str, field: str | None) -> tuple[tuple[str, Fraction], int] | None:
    """The longest start of up to three words that is a unit, and its length."""
    ends = [m.end() for m in re.finditer(r"[^\s]+", words)]
    if words and ("一" <= words[0] <= "鿿" or "゠" <= words[0] <= "ヿ"):
        ends = list(range(1, min(len(words), 6) + 1))
    for end in reversed(ends):
        if found := parse_unit(words[:end], field):
            return found, end
    return None


def _chunks(text: str) -> Iterator[str]:
    """Stretches within which a field governs a value: sentences, whitespace collapsed."""
    for paragraph in _PARAGRAPH.split(text):
        paragraph = " ".join(paragraph.split())
        at = 0
        for m in _BREAK.finditer(paragraph):
            if paragraph.endswith(("тыс.", "млн.", "млрд."), at, m.start() + 1):
                continue
            yield paragraph[at : m.start() + 1]
            at = m.end()
        if at < len(paragraph):
            yield paragraph[at:]


def _starts(chunk: str) -> Iterator[int]:
    """Where a number starts that isn't part of a code, a date or a longer number."""
    for m in _RUN.finditer(chunk):
        at = m.start()
        before = chunk[at - 1] if at else " "
        if before in _NEAR:
            continue
        if before in "-−–+":
            further = chunk[at - 2] if at > 1 else " "
            if further not in _NEAR and further not in ")]":
                at -= 1
            elif before in "-–":
                continue
        elif before in _STICKS:
            continue
        yield at


def measurements(text: str) -> set[tuple[str, int]]:
    """Every (quantity, value in the base unit) that the text states."""
    out: set[tuple[str, int]] = set()
    for chunk in _chunks(plain(text)):
        low = chunk.lower()
        words = not NUMBER_WORDS.keys().isdisjoint(low.split())
        starts = [at for at in _starts(chunk)]
        half = "пол" in low and _HALF.search(chunk)
        if not (starts or words or half):
            continue
        found_at: list[tuple[int, str]] | None = None
        latin = not _RUSSIAN.search(chunk)

        def field_before(at: int) -> str | None:
            nonlocal found_at
            if found_at is None:
                found_at = [(m.start(), _FIELD_OF[m.group(0)]) for m in _FIELD.finditer(low)]
            return next((f for s, f in found_at if s < at), None)

        matches = [m for at in starts if (m := _VALUES.match(chunk, at))]
        if words:
            matches += [m for m in _WORD_VALUES.finditer(chunk) if not m.start() or chunk[m.start() - 1] not in _NEAR]
        end, last = 0, None
        for m in matches:
            if m.start() < end:
                continue
            first = m.group(3).split(" ", 1)[0]
            if not _may_be_unit(first):
                continue
            field = field_before(m.start())
            found = _unit(m.group(3), field)
            if not found:
                continue
            (dimension, factor), length = found
            mult = m.group(2).strip(" .").lower()
            scale = MULTIPLIERS[mult] if mult else 1
            values = [v * scale for v in _numbers(m.group(1), latin)]
            if last and len(values) == 1 and _TOGETHER.fullmatch(chunk, last[0], m.start()) and last[1] == dimension and factor < last[2] and values[0] >= 0:
                value = last[3] * last[2] + values[0] * factor  # one value in two units
                out.discard(to_base(last[3], last[1], last[2]))
                out.add(to_base(value / factor, dimension, factor))
                last = None
            else:
                out.update(to_base(v, dimension, factor) for v in values)
                last = (m.start(3) + length, dimension, factor, values[0]) if len(values) == 1 and ":" not in dimension else None
            end = m.start(3) + length
        if half:
            for m in _HALF.finditer(chunk):
                if found := parse_unit(m.group(1), field_before(m.start())):
                    out.add(to_base(Fraction(1, 2), *found))
        if starts and (":" in chunk or "—" in chunk or "–" in chunk):
            for m in _BEFORE.finditer(chunk):
                field = field_before(m.start() + 1)
                unit = m.group("a") or m.group("b") or m.group("c") or m.group("d")
                if field and (found := parse_unit(unit.strip(), field)):
                    for part in re.split(rf",\s(?={_WHOSE})", m.group("rest")):
                        out.update(to_base(v, *found) for v in _numbers(re.sub(rf"^{_WHOSE}", "", part), latin))
    return out


_TOGETHER = re.compile(r"\.? ?(?:и |and )?")
_RUSSIAN = re.compile("[а-яА-Я]")


@lru_cache(maxsize=65536)
def _may_be_unit(word: str) -> bool:
    """Whether some start of a unit string begins with this word, whatever the field."""
    return word in ("мм", "mm", "градусов", "градуса", "градус", "градусах", "град", "degrees", "degree", "Grad") or any(
        _unit(word, field) for field in (None, *(names[0] for names in FIELDS))
    )


# For Java: all that measurements() can start from, and what may become so once the text is plain.
_MAY_HOLD = rf"\p{{Nd}}|{NOT_PLAIN}|(?iu)(?:пол|{'|'.join(sorted(NUMBER_WORDS))})"


def extract_measurements(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, quantity, base_value of every measured value in a text column.

    One row per distinct value of a text; one beyond 64 bits comes out with a null base_value. A null or empty text has no rows; other columns of
    the frame are ignored, so their names can't clash; repeated rows give repeated results.
    A narrow operator: it needs no shuffle, and texts without a digit or number word aren't
    sent to Python."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("quantity", T.StringType()), T.StructField("base_value", T.LongType())])
    picked = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    picked = picked.where(F.col("t").rlike(_MAY_HOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, quantities, values = [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                for quantity, value in sorted(measurements(t)):
                    rows.append(i)
                    quantities.append(quantity)
                    values.append(value if -(2**63) <= value < 2**63 else None)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(at) for i in range(len(keys))] + [pa.array(quantities, pa.string()), pa.array(values, pa.int64())],
                [*keys, "quantity", "base_value"],
            )

    return picked.mapInArrow(run, schema)
