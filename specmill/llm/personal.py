"""Personal information in free text: found, and replaced by typed placeholders.

Mentions are recognised by their forms and validated by their formats; numbers and dates (of birth,
of issue) are then permuted by a keyed Feistel network within their own format, so that equal values
stay linked across documents while their digits are hidden; names and addresses get a keyed
token of their letters, names without their case endings.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Given names, as the start that all their case forms share, with the endings of these forms.
_MALE = "Александр Алексе Андре Антон Арсен Артём Артем Артур Богдан Борис Вадим Валентин Валери Васили Виктор Витали Владимир Владислав Всеволод Вячеслав Геннади Георги Герман Глеб Григори Данил Денис Дмитри Евгени Егор Захар Иван Игор Иль Кирилл Константин Лев Льв Леонид Максим Марк Матве Михаил Назар Никит Никола Олег Остап Павл Павел Пётр Петр Роман Руслан Савели Семён Семен Серге Станислав Степан Тарас Тимофе Тимур Фёдор Федор Филипп Эдуард Юри Юрі Яков Ярослав Андрі Олександр Сергі Дмитр Василь Микол Михайл".split()
_FEMALE = "Александр Алён Ален Алин Алл Анастаси Ангелин Анн Антонин Валентин Валери Варвар Вер Вероник Виктори Галин Дарь Диан Евгени Екатерин Елен Елизавет Жанн Зинаид Зо Инн Ирин Карин Кир Клавди Ксени Ларис Лиди Любов Людмил Маргарит Марин Мари Надежд Наталь Натали Нин Оксан Олес Ольг Полин Раис Рит Светлан Софь Софи Тамар Татьян Ульян Юли Ян Ярослав Соломі Ганн".split()
_LATIN_GIVEN = (
    "Adam Alan Albert Alice Amy Andrew Anna Anne Anthony Arthur Ben Björn Brian Carl Charles Clara Daniel David Dieter Edith Edward Edwin Elisabeth Emily Emma Erik Eva Felix Frank Fritz Georg George Götz Greta Hannah Hans "
    "Harry Heike Heinz Helen Helga Henry Hugo Ingrid Ivy Jack James Jan Jane Jens Joachim John Jonas Julia Jürgen Karin Karl Käthe Kate Klaus Kurt Laura Leon Linda Lisa Lucy Lukas Margaret Maria Mark Martha Martin Mary Max Michael "
    "Monika Nora Oliver Otto Paul Paula Peter Petra Philip Rachel Ralf Richard Robert Ross Sabine Sam Sarah Simon Sophie Stefan Stephen Susan Thomas Tim Tom Udo Ursula Ute Uwe Walter Werner William Wolfgang"
).split()
_ENDINGS = ("", *"аяыиеуюйьоі", "ом", "ем", "ём", "ой", "ей", "ью", "ию", "ии", "ий", "ия", "ием", "ій", "ію", "ія")
_GIVEN = frozenset((stem + ending).lower() for stem in (*_MALE, *_FEMALE) for ending in _ENDINGS if len(stem) + len(ending) > 2)
_LATIN = frozenset(_LATIN_GIVEN) | frozenset(map(str.upper, _LATIN_GIVEN))
_LETTERS = "А-ЯЁІЇЄҐа-яёіїєґ"
_UP = "А-ЯЁІЇЄҐ"
_LOW = "а-яёіїєґ"
_PATRONYMIC = rf"[{_UP}][{_LOW}]+(?:ович|евич|ич|овн|евн|ичн|инична?|івн)(?:а|у|ем|е|ой|ы|і)?"
_SUR_END = r"(?:ов|ев|ёв|ин|ын|ск|цк|ич|ук|юк|як|чак|ко|ец|вц|ун|ан|ян|ан|ей|ых|их|ий|ый|ой|ая)"
_SURNAME = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
_SURNAME_LIKE = re.compile(rf"(?i)^[{_LETTERS}-]{{2,}}{_SUR_END}(?:[аяуюеыи]|ым|им|ом|ем|ой|ей|ого|его|ому|ему|ою|ый|ий|ая|ую)?$")
# Capitalised words before a name that are no part of it.
_NOT_NAMES = set("вчера учора сегодня исполнитель майстер мастер монтажник согласовано контактное лицо контактна особа инженер инж акт пропуск заявку заявка уважением повагою ответственный подпись автор директор начальник".split())

# Words that end as surnames do.
_NO_SURNAMES = frozenset("магазин бензин термин остров покров аршин господин гражданин хозяин один причин слов основ готов улов рукав кров ров лев клин карантин витамин вазелин хлопин апельсин камин кувшин рубин тюльпин лимузин масштабов".split())
_STRONG = r"(?:[оеё]в|[иы]н|[оеё]в(?:а|у|ым|ой|е|ы|ых)|[иы]н(?:а|у|ым|ой|е|ы|ых)|[сц]к(?:ий|ая|ого|ому|им|ой|ую)|енко|[чщ]ук(?:а|у|ом)?|швили|дзе|янц)"
_ALONE = re.compile(rf"(?<![{_LETTERS}\w.«„\"-])([{_UP}][{_LOW}]{{2,}}{_STRONG}(?:-[{_UP}][{_LOW}]+)?)(?![{_LETTERS}\w»-])(?! [{_UP}])")
_OPENS = re.compile(r"(?:^|[.!?…:;»”|]|\n)[\s«„\"]*$")
#: Words that make a capitalised word behind them the name of a place, a street, an organisation or a model.
_PLACE = re.compile(rf"(?:(?:(?:^|[\s(])(?:в|во|из|под|над|у|близ|около|им|имени|г|гор|город|городе|города|пос|посёлок|с|село|дер|м|місто|ул|улица|улице|улицы|пр|пр-т|просп|проспект|пер|переулок|бул|бульвар|наб|набережная|ш|шоссе|пл|площадь|вул|пров|ст|станция|станок|завод|фирма|марки|модели|типа|компания|ООО|АО|ЗАО|ПАО|ТОВ)\.?|[{_UP}][{_LETTERS}]*) ?[«„\"]?)$")
_VERB = re.compile(rf" (?:не )?[{_LOW}]+(?:л|ла|лся|лась|ет|ёт|ит|ив|в|является)(?![{_LETTERS}])")
_ROLE = re.compile(r"(?i)(?:тель|ник|щик|чик|ист|лог|вод|арь|ач|ер|ор|ант|ент|ция|ка|ость|ние|ок)$")
_NOM = re.compile(r"(?:[оеё]в|[иы]н|[сц]кий|енко|[чщ]ук)(?:-|$)")

_CAPITALISED = re.compile(rf"[{_UP}][{_LETTERS}]+")
_WORD_AFTER = re.compile(rf" ([{_UP}][{_LETTERS}]+(?:-[{_UP}][{_LETTERS}]+)?)(?![{_LETTERS}\w-])")
_WORD_BEFORE = re.compile(rf"(?<![{_LETTERS}\w.-])([{_UP}][{_LETTERS}]+(?:-[{_UP}][{_LETTERS}]+)?) $")
_PATR_AFTER = re.compile(rf" (?i:{_PATRONYMIC})(?![{_LETTERS}\w-])")
_INITIALS_FIRST = re.compile(rf"(?<![{_LETTERS}\w.])[{_UP}]\. ?(?:[{_UP}]\. ?)?([{_UP}][{_LETTERS}]+(?:-[{_UP}][{_LETTERS}]+)?)(?![{_LETTERS}\w-])")
_INITIALS_LAST = re.compile(rf"(?<![{_LETTERS}\w-])([{_UP}][{_LETTERS}]+(?:-[{_UP}][{_LETTERS}]+)?) [{_UP}]\. ?[{_UP}]\.")

_W = r"[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?"
_WU = r"(?:[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?|[A-ZÄÖÜ]{4,})"
_LG = r"[A-ZÄÖÜ][a-zäöüß]+"
_LATIN_WORD = re.compile(r"(?<![\w-])[A-ZÄÖÜ][A-Za-zäöüßÄÖÜ]+")
_LATIN_AFTER = re.compile(rf" (?:[A-Z]\. )*{_WU}(?![\w-])")
_LATIN_MIDDLE = re.compile(r" [A-Z]\.")
_LATIN_BEFORE = re.compile(rf"(?<![\w-]){_WU}, $")
_TITLED = re.compile(rf"(?:(?:Dr|Mr|Ms|Mrs|Prof)\. |Herrn? |Frau |डॉ\. |د\. |ดร\. ?)((?:[A-Z]\. )*{_W}(?: {_W})?)(?![\w-])")
_LATIN_INITIALS = re.compile(rf"(?<![\w.-])([A-ZÄÖÜ]\. ?(?:[A-ZÄÖÜ]\. ?)?{_WU})(?![\w-])(?!: )")
_LATIN_INITIALS_LAST = re.compile(rf"(?<![\w-])({_WU}, [A-ZÄÖÜ]\.(?: ?[A-ZÄÖÜ]\.)?)(?=[;,\s(])")
_LATIN_PAIR = re.compile(rf"(?<=[a-z,] )({_LG}(?: [A-Z]\.)? {_LG}(?:-{_LG})?)(?![\w-])(?! [A-ZÄÖÜ])")
#: A letter behind a number is a unit, one behind a short abbreviation or a noun for parts of a text a label.
_NO_LATIN_INITIAL = re.compile(r"(?:\d|(?<![A-Za-zÄÖÜäöüß])[A-ZÄÖÜ][a-zäöü]{0,3}\.|(?:[Aa]ppendix|[Aa]nnex|[Ss]ection|[Cc]hapter|[Ff]igure|[Tt]able|[Pp]art|[Cc]lass|[Tt]ype|[Zz]one|[Aa]nhang|[Aa]nlage|[Tt]eil|[Kk]lasse|[Tt]yp)) $")
#: Words before two capitalised words that are a place or a thing, and last words of such.
_PLACE_BEFORE = frozenset("in at to from near of the on for into via through towards under over with".split())
_THING_LAST = frozenset("Ltd Inc Corp Company Group Works Street Road Lane Avenue Square Court Close Way Drive Row Park Station Bridge Hall House Plant University Institute Department".split())
_ENGLISH = re.compile(r"\b(?:the|and|with)\b")
_HAS_LATIN = re.compile(r"[A-ZÄÖÜ][a-zäöüß]|[A-Z]{4}")
# Capitalised words at the start of a sentence or line that are no part of a name.
_TITLE_END = set(
    "A An And Any Are As At But By Did Do Does Each For From Has Have How If In Is It Its May No Not Of On Or Our See She So That The Their There These They This Those To Was We What When Where Which Who Why Will With You "
    "Als Am An Auf Aus Bei Bis Das Dem Den Der Des Die Ein Eine Er Es Für Im In Ist Kein Keine Mit Nach Nur Ob Sie Sind Um Und Von Vor Wann Was Wer Wie Wo Zu Zum Zur "
    "Abb App Approx Article Build Call Contact Deliver Fig Kap Kind Lieferung Mr Mrs Ms Dr Prof Nr Ratio Release Sec Send Spare Stop Yesterday".split()
)

_AT = r"(?: ?@ ?| ?[\[({](?:a|at|@|собака|ат|эт)[\])}] ?)"
_DOT = r"(?:\.| ?[\[({](?:dot|точка|\.)[\])}] ?)"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_А-Яа-яЁё.+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}| (?:at|собака) [A-Za-z0-9-]+(?: (?:dot|точка) [A-Za-z0-9-]+)* (?:dot|точка) [A-Za-z]{{2,}})(?![A-Za-z0-9_А-Яа-яЁё@])",
    re.I,
)

_ID_LABEL = re.compile(
    r"(?=[ИСРІПпсуpiINStTAaR])(?<![\w-])(?:ИНН|СНИЛС|РНОКПП|ІПН|ИПН|[Пп]аспорт(?:ные данные|а|ом|у)?|[Сс]ери[яи]|удостоверение(?: личности)?|[Pp]assport|[Ii]dentity card|ID card|National Insurance(?: number)?|NI number|[Tt]ax ID|SSN|Steuer-?ID|Steuernummer|Ausweis(?:-?Nr\.?|nummer)?|Personalausweis(?:-?Nr\.?)?|Reisepass)"
    r"(?![А-Яа-яA-Za-z])(?:[ :]*(?:серии|серия|номер|№|No\.?|Nr\.?|number|n°)){0,2}[ :]*",
)
_HAS_LABEL = re.compile("ИНН|СНИЛС|РНОКПП|[ІИ]ПН|аспорт|ери[яи] |достоверение|assport|dentity|ID|National|Steuer|usweis|SSN|NI number|Reisepass")
_ID_VALUE = re.compile(r"(?:[A-ZА-ЯІЇЄҐ]{1,2}[ -]?)?\d[\dA-Z]*(?:[ -]{1,2}(?:№ ?)?\d+|[-/]\d+)*(?: [A-D](?![\w]))?")

_PHONES = re.compile(
    "|".join(
        (
            r"\+\d{1,3}(?:[ .-]?\(\d{2,5}\)[ .-]?|[ .-]?)\d{2,4}(?:[ .-]?\d{2,7}){1,4}",
            r"8[ .-]?(?:\(0\d\d\)|0\d\d)[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}",
            r"\(\d{2,5}\)[ .-]?\d{2,8}(?:[ .-]\d{2,7}){0,3}",
            r"00[1-9]\d[ ./-]?\(?\d{2,4}\)?[ ./-]?\d{3,8}(?:[ -]\d{2,6})*",
            r"0\d{2,4}[ /.-]\d{3}[ .-]?\d{3,4}",
            r"0\d{2,4}/\d{5,8}(?:-\d{2,4})?",
            r"0\d-\d{3}-\d{2}-\d{2}",
        )
    )
)
_DIGITS_AND_MARKS = re.compile(r"[+(\d](?:[\d()/]|[ .-](?=[\d(]))+\d")
_GOODS = ("Article ", "Artikel ", "Изделие ", "Build ", "Сумма ", "маска ", "номер ")
_PHONE_WORD = re.compile(r"(?:тел(?:ефон)?\.?:? |[Мм]ой номер |звоните |приёмную |приемную |phone:? |[Cc]all |[Tt]el\.?:? |电话：|電話：|الهاتف:? |फ़ोन: |โทร\.? )$")

_TOWN = rf"(?:(?:г\.|город|пос\.|посёлок|с\.|село|дер\.|м\.|місто|смт) ?[{_UP}][{_LETTERS}]+(?:[- ][{_UP}][{_LOW}]+)?(?:-\d+)?)"
_STREET_TYPE = r"(?:ул\.|улица|пр-т|пр-кт|просп\.|проспект|пер\.|переулок|бул\.|б-р|бульвар|наб\.|набережная|ш\.|шоссе|пл\.|площадь|пр\.|проезд|туп\.|вул\.|вулиця|пров\.|провулок)"
_HOUSE = rf"(?:(?:д\.|дом|буд\.|будинок) ?)?\d+[{_LOW}]?(?:[/-]\d+)?(?![\d:]|\.\d|[-–]\d)"
_PART = rf"(?:, ?(?:корп\.|корпус|к\.|стр\.|строение|лит\.|кв\.|квартира|оф\.|офис|комн\.|комната|пом\.|под\.|эт\.) ?\d+[{_LOW}]?)"
_STREET = re.compile(rf"(?:^|(?<=[\s,:;(«]))(?=[упбншптв])({_STREET_TYPE}) ?[{_UP}\d][{_LETTERS}-]*(?: [{_UP}][{_LETTERS}-]*){{0,3}}, ?{_HOUSE}{_PART}{{0,4}}(?:, ?{_TOWN}|, ?\d{{6}}(?!\d)){{0,2}}", re.M)
_HAS_STREET = re.compile(r"(?:ул|пр-т|пр-кт|просп|пер|бул|б-р|наб|ш|пл|пр|вул|пров)\.|(?:улица|проспект|переулок|бульвар|набережная|шоссе|площадь|проезд|вулиця|провулок) |пр-т |пр-кт |б-р ")
_BEFORE_STREET = re.compile(rf"(?<![\w-])(?:\d{{5,6}}, ?)?(?:{_TOWN}, ?)$|(?<![\w-])\d{{5,6}}, ?$")
_LATIN_ADDRESS = [
    re.compile(
        r"(?:(?<![\w-])(?:Flat|Apt|Suite|Unit) \d+[a-z]?, )?(?<![\w.-])\d{1,4}[a-z]? (?:[A-Z][a-z]+ ){1,3}(?:Lane|Street|Road|Avenue|Ave\.(?=,)|Ave|St\.(?=,)|St|Rd\.(?=,)|Rd|Row|Close|Way|Drive|Court|Square|Terrace)\b"
        r"(?:, (?:Flat|Apt|Suite|Unit) \d+[a-z]?)?(?:, (?!ask\b)[A-Z][a-z]+(?: (?!The\b|Is\b|Stop\b|Call\b|Send\b|Deliver\b|Who\b|See\b|Contact\b|Yesterday\b|Spare\b|Release\b|Build\b|Bolts\b|Approx\b|Ratio\b|Kind\b|Article\b|Mr\b|Dr\b|Notes\b|Annex\b)[A-Z][a-z]+)?(?: [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})?)?"
    ),
    re.compile(r"(?<![\w-])(?:\d{5} [A-ZÄÖÜ][a-zäöüß]+, )?(?:[A-ZÄÖÜ][\wäöüß]*-)?[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|allee|platz|steg|ring|ufer|damm|stieg|hof|markt) \d+(?: ?[a-z]\b)?(?:(?:,| in) \d{5} [A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?)?"),
]

KINDS = ("email", "date", "id_number", "address", "phone", "person")

_DATE_SIGNS = ("ожд", "ыда", "одил", "г. р.", "г.р.", "orn", "ssue", "irth", "ebor", "eb.", "usgestellt", "eburts", "ародже", "ародив")
_DATE_LABEL = re.compile(r"(?i)(?:дат[аыуе] (?:рождения|выдачи)|родил(?:ся|ась)|рожд\.|г\. ?р\.|выдан[ао]?|born(?: on)?|date of (?:birth|issue)|birth date|issued(?: on)?|geboren(?: am)?|geb\.|Geburtsdatum|ausgestellt(?: am)?|дата народження|народив(?:ся|лася))[ :—–-]{0,3}(\d{1,4}[./-]\d{1,2}[./-]\d{1,4})(?!\d)")


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _surname(word: str) -> bool:
    return word.lower() not in _NOT_NAMES and bool(_SURNAME_LIKE.match(word))


_NO_INITIAL = re.compile(r"(?:(?:прил|разд|рис|табл|лит|гр|кл|тыс|млн)\.|\d) ?$")


def _word_start(text: str, at: int) -> int:
    """Where the word before a position starts, with the character before it and the mark behind it."""
    i = at - 1
    while i > 0 and text[i - 1] in " ,":
        i -= 1
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] in "-_."):
        i -= 1
    return max(0, i - 1)


def _cyrillic_persons(text: str) -> Iterator[tuple[int, int]]:
    for m in _CAPITALISED.finditer(text):
        given = m.group(0)
        if given.lower() not in _GIVEN or not (given[1:].islower() or given.isupper() and len(given) > 2):
            continue
        start, end = m.span()
        if text[end : end + 1] == "-" or start and (text[start - 1].isalnum() or text[start - 1] in "-_"):
            continue
        patronymic = _PATR_AFTER.match(text, end)
        if patronymic:
            end = patronymic.end()
        after = _WORD_AFTER.match(text, end)
        before = _WORD_BEFORE.search(text[_word_start(text, start) : start])
        if after and _surname(after.group(1)):
            yield start, after.end()
        elif before and _surname(before.group(1)):
            yield start - len(before.group(1)) - 1, end
        elif patronymic:
            yield start, end
    for m in _INITIALS_FIRST.finditer(text):
        if _surname(m.group(1)) and not _NO_INITIAL.search(text[max(0, m.start() - 7) : m.start()]):
            yield m.span()
    for m in _INITIALS_LAST.finditer(text):
        if _surname(m.group(1)):
            yield m.span()


def _surnames_alone(text: str) -> Iterator[tuple[int, int]]:
    """Surnames by their shape alone, with a given name of no list before them where there is one: within a sentence
    any capitalised word of such an ending that names no place; at its start only before a verb."""
    for m in _ALONE.finditer(text):
        start, end = m.span(1)
        if m.group(1).lower() in _NO_SURNAMES:
            continue
        before = text[max(0, start - 40) : start]
        if _OPENS.search(before):
            if _NOM.search(m.group(1)) and _VERB.match(text, end):
                yield start, end
            continue
        given = re.search(rf"(?<![{_LETTERS}\w.«-])([{_UP}][{_LOW}]{{2,}}) $", before)
        if given:
            word, opening = given.group(1), bool(_OPENS.search(before[: given.start()]))
            if word.lower() in _NOT_NAMES or opening and _ROLE.search(word):
                yield start, end
            elif not _PLACE.search(before[: given.start()]) and not _ROLE.search(word):
                yield start - len(given.group(0)), end
        elif not _PLACE.search(before):
            yield start, end


def _latin_persons(text: str) -> Iterator[tuple[int, int]]:
    for m in _LATIN_WORD.finditer(text):
        if m.group(0) in _LATIN:
            start, end = m.span()
            before = _LATIN_BEFORE.search(text[_word_start(text, start) : start])
            if before and before.group(0)[:-2] not in _TITLE_END:
                middle = _LATIN_MIDDLE.match(text, end)
                yield start - len(before.group(0)), middle.end() if middle else end
            elif (after := _LATIN_AFTER.match(text, end)) and after.group(0).rsplit(" ", 1)[1] not in _TITLE_END:
                yield start, after.end()
    for m in _TITLED.finditer(text):
        start, end = m.span(1)
        words = m.group(1).split(" ")
        if len(words) > 1 and not words[-2].endswith(".") and words[-2] not in _LATIN:
            end -= len(words[-1]) + 1  # the next word is no surname
        yield start, end
    for m in _LATIN_INITIALS.finditer(text):
        if re.split(r"[ .]", m.group(1))[-1] not in _TITLE_END and not _NO_LATIN_INITIAL.search(text, max(0, m.start() - 16), m.start()):
            yield m.span(1)
    for m in _LATIN_INITIALS_LAST.finditer(text):
        if m.group(1).split(",")[0] not in _TITLE_END:
            yield m.span(1)
    if _ENGLISH.search(text):
        for m in _LATIN_PAIR.finditer(text):
            first, last = m.group(1).split(" ")[0], m.group(1).rsplit(" ", 1)[1]
            before = re.search(r"([a-z]+),? $", text[max(0, m.start() - 24) : m.start()])
            if before and before.group(1) not in _PLACE_BEFORE and last not in _THING_LAST and first not in _TITLE_END and last not in _TITLE_END:
                yield m.span(1)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for c in _DIGITS_AND_MARKS.finditer(text):
        value = c.group(0)
        n = _digits(value)
        if not 7 <= n:
            continue
        start, end = c.span()
        before, after = text[max(0, start - 12) : start], text[end : end + 1]
        if before and (before[-1].isalnum() or before[-1] in "_.+/№#-") and not value.startswith("+") and not "⺀" <= before[-1]:
            continue
        if after and (after.isalnum() or after in "_-") and not "⺀" <= after:
            continue
        if 9 <= n <= 15 and _PHONES.fullmatch(value) and not before.endswith(_GOODS[:4]):
            yield start, end
        elif n <= 15 and _PHONE_WORD.search(before):
            yield start, end


def mentions(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every mention, by position; where two overlap the kind that stands
    first in KINDS wins, then the longer."""
    found: list[tuple[str, int, int]] = []
    if "@" in text or "[" in text or "(a" in text or "{" in text or "(соб" in text or " dot " in text or " точка " in text:
        found += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    if _HAS_LABEL.search(text):
        for label in _ID_LABEL.finditer(text):
            if (m := _ID_VALUE.match(text, label.end())) and _digits(m.group(0)) >= 6:
                found.append(("id_number", *m.span()))
    if any(x in text for x in _DATE_SIGNS):
        found += [("date", *m.span(1)) for m in _DATE_LABEL.finditer(text) if date_of(m.group(1))]
    if _HAS_STREET.search(text):
        for m in _STREET.finditer(text):
            third = m.start()
            for _ in range(3):  # a postcode and a town end with a comma each
                third = max(0, text.rfind(",", 0, third))
            before = _BEFORE_STREET.search(text[third : m.start()])
            found.append(("address", m.start() - (len(before.group(0)) if before else 0), m.end()))
    found += [("phone", *s) for s in _phones(text)]
    found += [("person", *s) for s in _cyrillic_persons(text)]
    alone = [("person", *s) for s in _surnames_alone(text)]
    if _HAS_LATIN.search(text):
        for pattern in _LATIN_ADDRESS:
            found += [("address", *m.span()) for m in pattern.finditer(text)]
        found += [("person", *s) for s in _latin_persons(text)]
    if not found and not alone:
        return []
    order = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int]] = []
    kept: list[tuple[str, int, int]] = []
    # what only its shape shows comes last
    for kind, start, end in [*sorted(set(found), key=lambda x: (order[x[0]], x[1] - x[2], x[1])), *alone]:
        at = bisect.bisect_left(taken, (start, end))
        if (at == len(taken) or end <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= start):
            taken.insert(at, (start, end))
            kept.append((kind, start, end))
    return sorted(kept, key=lambda x: x[1])


def _round(key: bytes, number: int, value: int, size: int) -> int:
    digest = hashlib.blake2b(b"%d:%d:%d" % (number, value, size), key=key, digest_size=8 + (size.bit_length() + 7) // 8).digest()
    return int.from_bytes(digest, "big") % size


def feistel(value: int, size: int, key: bytes, rounds: int = 10, backward: bool = False) -> int:
    """A keyed permutation of the numbers below size: a Feistel network over two factors next to the
    root, walked along its cycle until it is below size again."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def once(x: int) -> int:
        left, right = divmod(x, b)
        for i in range(rounds - 1, -1, -1) if backward else range(rounds):
            if i % 2:
                shift = _round(key, i, left, b)
                right = (right - shift if backward else right + shift) % b
            else:
                shift = _round(key, i, right, a)
                left = (left - shift if backward else left + shift) % a
        return left * b + right

    value = once(value)
    while value >= size:
        value = once(value)
    return value


_ALPHABETS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ")


def permuted(text: str, key: bytes, start: int = 0, letters: bool = True, backward: bool = False) -> str:
    """The text with its digits, and its capital letters if wanted, from a position on permuted as one number of
    mixed radix, so that each keeps its kind; everything else stays. Values that differ in what stays only get
    the same digits and letters."""
    places = [(i, next(x for x in _ALPHABETS[: 3 if letters else 1] if c in x)) for i, c in enumerate(text) if i >= start and any(c in x for x in _ALPHABETS[: 3 if letters else 1])]
    value, size = 0, 1
    for i, alphabet in places:
        value, size = value * len(alphabet) + alphabet.index(text[i]), size * len(alphabet)
    value = feistel(value, size, key, backward=backward)
    out = list(text)
    for i, alphabet in reversed(places):
        value, at = divmod(value, len(alphabet))
        out[i] = alphabet[at]
    return "".join(out)


# The country codes of one and of two digits; all others have three.
_COUNTRY_1 = ("1", "7")
_COUNTRY_2 = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def national_start(phone: str) -> int:
    """Where the national number of a phone number starts: behind the country code, the trunk prefix and zeros.

    So +7 (073) 290-99-64, 8 073 2909964 and (073) 290-99-64 have the same national digits."""
    at = [i for i, c in enumerate(phone) if c in "0123456789"]
    digits = "".join(phone[i] for i in at)
    skip = 0
    if phone.lstrip(" (")[:1] == "+" or digits.startswith("00") and len(digits) > 11:
        skip = 0 if "+" in phone else 2
        skip += 1 if digits[skip : skip + 1] in _COUNTRY_1 else 2 if digits[skip : skip + 2] in _COUNTRY_2 else 3
    elif digits.startswith("8") and len(digits) == 11:
        skip = 1
    while skip < len(digits) - 1 and digits[skip] == "0":
        skip += 1
    return at[skip] if skip < len(at) else len(phone)


def permuted_date(day: datetime.date, key: bytes, backward: bool = False) -> datetime.date:
    """The date permuted within 1900-2099."""
    first, last = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
    return first + datetime.timedelta(days=feistel((day - first).days, (last - first).days + 1, key, backward=backward))


def date_of(value: str) -> tuple[datetime.date, str] | None:
    """The date of a text of digits with marks, and the form in which it is written."""
    for form, order in ((r"(\d{1,2})([./-])(\d{1,2})\2(\d{4})", "dmy"), (r"(\d{4})([./-])(\d{1,2})\2(\d{1,2})", "ymd")):
        if m := re.fullmatch(form, value):
            x, mark, y, z = m.groups()
            year, month, day = (z, y, x) if order == "dmy" else (x, y, z)
            try:
                return datetime.date(int(year), int(month), int(day)), "%d{0}%m{0}%Y".format(mark) if order == "dmy" else "%Y{0}%m{0}%d".format(mark)
            except ValueError:
                return None
    return None


def _token(value: str, key: bytes) -> str:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()


_CASES = re.compile(r"(?:ого|его|ому|ему|ыми|ими|ым|им|ом|ем|ём|ой|ей|ою|ею|ью|ию|ии|ия|ие|ій|ия|ые|ых|их|ый|ий|ая|яя|ую|юю|ов|ев|[аяоеиыуюйьіё])$")


def lemma(word: str) -> str:
    """A name's part without its case ending, in lower case.

    Genders aren't told apart, as the genitive of one is the nominative of the other."""
    low = word.lower().replace("ё", "е")
    if len(low) <= 3 or not re.search("[а-яіїєґ]", low):
        return low
    if m := re.match(r"(.{2,}(?:[ое]в|[иы]н|[сц]к))(?:а|у|ым|ом|ой|е|ы|ых|ий|ая|ого|ому|им|ую|ые)?$", low):
        return m.group(1)
    if m := re.match(r"(.{2,}(?:ович|евич|ич|овн|евн|ичн|івн))(?:а|у|ем|е|ой|ы|і)?$", low):
        return m.group(1)
    stem = _CASES.sub("", low)
    return stem if len(stem) >= 3 else low


def person_key(value: str) -> str:
    """What equal names have in common: the lemmas of their parts and their initials, in alphabetical order."""
    parts = re.findall(r"[^\W\d_]+", value)
    return " ".join(sorted(lemma(p) if len(p) > 1 else p.lower() + "." for p in parts)) or value.lower()


def placeholder(kind: str, value: str, key: bytes) -> str:
    """A typed placeholder; equal values, in whatever spelling of their format, get equal pseudonyms.

    A phone's country code, trunk prefix (8, +7, 0049, ...) and leading zeros stay, all digits of its national number are
    permuted; so are all digits and capital letters of an id number, and dates within two centuries. Emails and addresses
    are lower-cased and stripped of blanks before their token is taken; names are told apart by the lemmas of all their parts."""
    if kind == "phone":
        return f"[{kind}:{permuted(value, key, national_start(value), letters=False)}]"
    if kind == "id_number":
        return f"[{kind}:{permuted(value, key)}]"
    if kind == "date":
        day, form = date_of(value)
        new = permuted_date(day, key)
        return f"[{kind}:{new.strftime(form.replace('%Y', f'{new.year:04d}'))}]"
    if kind == "person":
        return f"[{kind}:{_token(person_key(value), key)}]"
    plain = re.sub(rf"{_AT}| (?:at|собака) ", "@", value.lower()) if kind == "email" else value.lower()
    plain = re.sub(r"\s", "", re.sub(rf"{_DOT}| (?:dot|точка) ", ".", plain) if kind == "email" else plain)
    return f"[{kind}:{_token(plain, key)}]"


def session_key(spark: SparkSession) -> str:
    """The key of the pseudonyms named in spark.specmill.pseudonymKey; else a new one, so that values are linked within
    one run only."""
    return spark.conf.get("spark.specmill.pseudonymKey", None) or secrets.token_hex(32)


def find_personal(df: DataFrame, text: str, keys: Sequence[str], key: str) -> DataFrame:
    """keys, kind, start_pos, end_pos, pseudonym of every mention in a text column, by a secret key.

    Positions count code points from 0, the end is exclusive. Null and empty texts have no rows,
    repeated rows give repeated results, other columns are ignored. A narrow operator without
    shuffle; texts are read whole."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    fields = [T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("pseudonym", T.StringType())]
    schema = T.StructType([df.schema[k] for k in keys] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                for kind, start, end in mentions(t):
                    rows.append(i)
                    out.append((kind, start, end, placeholder(kind, t[start:end], secret)))
            at = pa.array(rows, pa.int64())
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(at) for i in range(len(keys))] + [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())],
                [*keys, *[f.name for f in fields]],
            )

    return df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).where("t is not null and t != ''").mapInArrow(run, schema)


def pseudonymize(df: DataFrame, text: str, keys: Sequence[str], key: str) -> DataFrame:
    """keys and the text with every mention replaced by its placeholder; null stays null."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf(T.StringType())
    def replaced(texts):  # noqa: ANN001, ANN202
        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for kind, start, end in mentions(t):
                out += [t[at:start], placeholder(kind, t[start:end], secret)]
                at = end
            return "".join([*out, t[at:]])

        return texts.map(one)

    return df.select(*keys, replaced(F.col(text)).alias("text"))
