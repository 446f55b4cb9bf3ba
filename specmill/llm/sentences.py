"""Sentence boundaries across languages and scripts.

Every place where a sentence may end is a candidate. A maximum-entropy model over
neighbouring tokens, case, length, digits, script and quotation classifies each; it is trained on
boundaries that are reliable by themselves (ends of paragraphs, long words before capitals, known
abbreviations, lower-case continuations) in a bounded sample of the texts. Lists, blank lines and the
blanks of Thai are boundaries by definition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.lookalikes import INVISIBLE, plain

TRAINING_TEXTS = 3000
ROUNDS, RATE, DECAY = 400, 2.0, 1e-5

# Abbreviations after which a sentence goes on, and those after which it may go on or end.
GOES_ON = frozenset(
    "ул им инж напр рис табл стр п пп см разд прил д кв корп тел пер бул наб просп вул буд пров ім див напр тыс млн млрд тис рт т гл ч св ок акад проф доц долж нач зав зам исх вх ред изд "
    "dr mr mrs ms prof fig figs sec app no nr abb kap ca z d approx cf e i vs vol vols pp p st bzw vgl ggf u jan feb mar apr jun jul aug sep sept oct nov dec डॉ श्री د أ".split()
)
EITHER = frozenset("г гг руб коп др пр д п ст etc usw m a мин сек час сут в к м с р рр ін тощо inc ltd co".split())
_ENDS = {("т.", "д"), ("т.", "п"), ("рт.", "ст"), ("т", "д"), ("т", "п")}
_UNITS = frozenset("г м с в к ч т мин сек сут см мм км мг кг m s h t g v k w b in".split())
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

_CLOSERS = "»”“’'\")]）」』】》"
_OPEN, _CLOSE = "«„「『《", "»」』》"
_END = re.compile(rf"[.!?…。！？؟।॥．]+[{re.escape(_CLOSERS)}]*|\n[ \t]*(?=\n)|\n|[  ]+")
_TERMINAL = frozenset(".!?…。！？؟।॥．")
_WIDE = frozenset("。！？।॥؟．")
_THAI = re.compile("[฀-๿]")
_ITEM = re.compile(r"[ \t]*(?:[-–—•*·▪‣◦]|\(?\d{1,3}\)|\(?[a-zа-яё]\))[ \t]+(?=\S)")
_NO_TOKEN = frozenset(".!?…«»„“”\"'()（）「」")


class Candidate(NamedTuple):
    """A place where a sentence may end: after the text's first end characters."""

    end: int
    features: tuple[str, ...]
    label: int | None  # 1 or 0 where it is reliable
    fixed: bool  # a boundary or none by definition


def _kind(c: str) -> str:
    return "U" if c.isupper() else "L" if c.islower() else "D" if c.isdigit() else "A" if c.isalpha() else "Q" if c in "«„“\"「『" else "-" if c in "-–—" else "P"


def _depths(text: str) -> list[tuple[int, int]]:
    """Stretches inside quotation marks that are closed again in the same paragraph, as (start, end)."""
    out, stack, straight = [], [], -1
    for m in re.finditer(r"[«»„“”「」『』《》\"]|\n[ \t]*\n", text):
        c, i = m.group(0), m.start()
        if c[0] == "\n":
            stack, straight = [], -1
        elif c == '"':
            if straight >= 0:
                out.append((straight, i))
                straight = -1
            else:
                straight = i
        elif c in "«„「『《":
            stack.append(i)
        elif c == "“" and not (stack and text[stack[-1]] == "„"):
            stack.append(i)
        elif stack:
            out.append((stack.pop(), i))
    return out


def _token_start(text: str, least: int, end: int) -> int:
    """Where the token before a position starts, not before least."""
    i = end
    while i > least and text[i - 1] not in _NO_TOKEN and not text[i - 1].isspace():
        i -= 1
    return i


def candidates(text: str, decide: Callable[[tuple[str, ...]], bool] | None = None) -> list[Candidate]:
    """All candidates of a text in order, the end of the text included.

    What follows a boundary is looked at from there on: decide tells from its features whether a candidate is one;
    without it, as for training, the reliable ones are."""
    out: list[Candidate] = []
    last = len(text.rstrip())
    if not last:
        return out
    quotes = sorted(_depths(text))
    n_quotes, at_quote, open_until = len(quotes), 0, -1
    thai = bool(_THAI.search(text))
    in_list, line = bool(_ITEM.match(text)), 0
    since = len(text) - len(text.lstrip())
    for m in _END.finditer(text):
        mark, start, end = m.group(0), m.start(), m.end()
        if end >= last:
            break
        first = mark[0]
        if first in " \u00a0":
            if not thai:
                continue
            before, after = text[start - 1 : start], text[end : end + 1]
            if after == "\n" or not (_THAI.match(before) or _THAI.match(after)):
                continue
            out.append(Candidate(start, (), None, True))
            since = end
            continue
        if first == "\n":
            head = text[since:start].rstrip()
            if not head:
                if mark == "\n":
                    in_list = bool(_ITEM.match(text, end))
                continue
            stop = since + len(head)
            item = bool(_ITEM.match(text, end))
            following = text[end:].lstrip()[:1] if mark != "\n" or text[end : end + 1].isspace() else text[end : end + 1]
            blank = mark != "\n" or text[end : end + 1] == "\n"
            if blank or item and (head[-1] in ":;,." or in_list or _ITEM.match(text, since)) or in_list and following.isupper() or thai and (_THAI.match(head[-1]) or _THAI.match(following)):
                if out and out[-1].end == stop and out[-1].fixed is False:
                    out[-1] = out[-1]._replace(fixed=True, label=1)
                else:
                    out.append(Candidate(stop, (), None, True))
                since = end
                in_list = item
            continue
        # a terminal mark with its closing marks
        while at_quote < n_quotes and quotes[at_quote][0] < start:
            open_until = max(open_until, quotes[at_quote][1])
            at_quote += 1
        closers = mark.lstrip(".!?…。！？؟।॥．")
        if open_until >= start and not (closers and open_until < end):
            continue  # inside a quotation
        gap = end
        while gap < len(text) and (text[gap].isspace() or text[gap] in INVISIBLE):
            gap += 1
        after = text[gap : gap + 1]
        close = not any(c.isspace() for c in text[end:gap])
        if close and first not in _WIDE and not closers:
            if not (after.isupper() and text[start - 1 : start].islower()):
                if after.isalnum() or after in ",;:)-–—/":
                    continue
        if after and after in ",;:，、；：" or closers and (after and after in "—–-" or _kind(after or " ") == "A"):
            continue  # goes on behind the mark, or, where letters have no case, behind a quotation
        if after == "." or closers and after in _TERMINAL and after:
            continue
        at = _token_start(text, since, start)
        word = text[at:start]
        low = plain(word).lower()
        back = text[since:at].rsplit(None, 4)
        before = back[-1].lower() if back else "^"
        kind = _kind(after) if after else "$"
        newline = "\n" in text[end:gap]
        paragraph = newline and (text[end:gap].count("\n") > 1 or bool(_ITEM.match(text, text.index("\n", end) + 1)))
        shown = first if first == "." else "!" if first in "!?" else "…" if first == "…" else "。"
        shape = "1U" if len(word) == 1 and word.isupper() else "d" if word.isdigit() else "dd" if word[:1].isdigit() else "short" if len(word) <= 3 else "long"
        goes, may = low in GOES_ON, low in EITHER
        if before in ("т.", "рт.") and low in ("п", "д", "ст"):
            goes, may = False, True  # and so on, and the millimetre of mercury
        length = "0" if len(back) <= 2 else "1" if len(back) <= 3 else "2"
        sure = "x" if goes and not may else "e" if may else "-"
        number_before = before[:1].isdigit() or before in ("тыс.", "млн", "млрд")
        nxt = text[gap : gap + 14].split(" ")[0].rstrip(".,").lower()
        of = "M" if kind == "U" and nxt in _MONTHS else kind  # a month isn't just any capitalised word
        features = (
            "b", f"m={shown}", f"m={shown}|k={of}", f"k={of}", f"s={shape}|k={of}" if shown == "." else f"c={bool(closers)}|k={of}",
            f"a={sure}|{shown}", f"a={sure}|k={of}|{shown}", f"w={low}" if shown == "." and len(word) <= 6 else "w", f"p={before}|w={low}" if shown == "." and len(word) <= 3 else "p",
            f"n={number_before}|s={shape}", f"n={number_before}|w={low}|l={length}" if may else "n", f"l={length}|a={sure}", f"s={shape}|k={of}|l={length}|{number_before}" if may else "s", f"n={number_before}|k={of}|a={sure}|{low in _UNITS}", f"q={shape}|{before[-1:] == '.'}",
        )
        label: int | None = None
        if paragraph:
            label = 1 if kind not in "L" or word else None
        elif shown == "." and kind == "L":
            label = 0
        elif shown != "." and kind in "UAQDP":
            label = 1
        elif shown in "!…" and kind in "L-":
            label = 0
        elif shown == "." and not word and kind in "UQDA":
            label = 1
        elif shown == "." and kind in "UQD" and (before, low) in _ENDS:
            label = 1
        elif shown == "." and kind in "UD" and number_before and length == "2" and (shape == "1U" or low in _UNITS):
            label = 1
        elif shown == "." and shape == "1U" and before in ("app.", "прил.", "anl.", "anh.") and kind == "U":
            label = 1
        elif shown == "." and low in ("д", "п", "с") and kind == "D" and not number_before:
            label = 0  # a house, an item or a page
        elif shown == "." and goes and not may:
            label = 0
        elif shown == "." and shape == "1U" and not number_before and before not in ("app.", "прил.", "anl."):
            label = 0
        elif shown == "." and shape == "d" and nxt in _MONTHS:
            label = 0
        elif shown == "." and shape == "long" and kind in "UAQD":
            label = 1
        elif shown == "." and shape in ("d", "dd") and kind in "UQ":
            label = 1
        elif shown == "." and may and length == "0" and number_before:
            label = 0
        out.append(Candidate(end, features, label, False))
        if decide(features) if decide else label == 1:
            since = gap
            in_list = False if not paragraph else in_list
    out.append(Candidate(last, (), None, True))
    return out


# Texts of reliable boundaries that every model is also trained on, for what a small corpus may lack.
SEEDS = (
    "Кто приехал? Все. Стой! Иди. Он молчал… Дождь шёл. Что дальше?! Ничего.\n\nВопрос «Кто там?» остался. Крик «Стой!» был слышен. Она сказала «Да…» и ушла. «Пора!» Все встали.",
    "В 1998 г. мост открыли. Мост открыли в 1998 г. Потом закрыли. В 2005 г. Музей закрыли. В 2007 г. «Луч» сменил замки. На ул. Садовой, д. 5, живёт т. Петров. Дом стоит на ул. Новой, д. 7, кв. 2. Ему подходит дом на ул. Труда, д. 12. Об этом см. с. 40 и п. 6. Приехал И. П. Кузнецов. См. рис. 4 и табл. 2. Доски, гвозди и т. д. Всё на месте. Лампы и т. п. Потом ещё. См. п. 4 и с. 7. Цена 5 тыс. руб. за тонну.",
    "Вес одной детали — 5 г. Длина этой трубы — 7 м. Напряжение сети не выше 12 В. Ток в цепи до 3 А. Монтаж моста окончен в 1999 г. Давление около 750 мм рт. ст. Далее. Вес всех деталей равен 630 г. 28 ящиков ждут. Груз не тяжелее 10 т. 15 ящиков ждут. Давление в баке 740 мм рт. ст. 5 насосов стоят. Монтаж поста окончен в 2018 г. 35 насосов стоят. Пили чай, кофе и пр. Потом ушли. Пили чай, кофе и пр. напитки.",
    "Who came? Everyone. Stop! Go on. He was silent... Then it rained. The sign “Stop!” was red. Mr. Brown met Dr. Gray at No. 5. See Fig. 3 and Sec. 2. The box weighs about 5 kg. The whole pipe is 7 m. The line has up to 12 V. Pipes, bolts, etc. All of it. It is approx. 3 m long.",
    "Wer kam? Alle. Halt! Weiter. Am 3. Mai kam Hr. Braun. Am 18. August ging er. Siehe Abb. 3 und Kap. 2. Es wiegt 5 kg. Es kostet z. B. 5 Euro. Das Schild „Halt!“ war rot. Er wohnt in Nr. 5.",
    "谁来了？大家。停！走。牌子“停！”是红的。他走了。她来了。",
    "誰が来た？みんな。「止まれ！」と言った。終わり。",
    "कौन आया? सब। रुको! चलो। वह गया। वह आई।",
    "من جاء؟ الجميع. قف! امش. ذهب. جاءت.",
)
SEED_SHARE = 3


def train(texts: Sequence[str]) -> dict[str, float]:
    """The weights of the features, fitted by gradient ascent on the reliable candidates of the texts and, a few times
    each, of the seeds."""
    rows, labels = [], []
    for t in (*texts, *SEEDS * SEED_SHARE):
        for c in candidates(t):
            if c.label is not None and c.features:
                rows.append(c.features)
                labels.append(c.label)
    if not rows:
        return {}
    names = {f: i for i, f in enumerate(dict.fromkeys(f for r in rows for f in r))}
    at = np.array([[names[f] for f in r] for r in rows])
    y = np.array(labels, dtype=np.float64)
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -30, 30)))
        gradient = np.bincount(at.ravel(), weights=np.repeat(y - p, at.shape[1]), minlength=len(names)) / len(y) - DECAY * w
        squares += gradient**2
        w += RATE * 0.1 * gradient / np.sqrt(squares)
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-6}


def sentence_ends(text: str, weights: dict[str, float]) -> list[int]:
    """The ends of the sentences of a text, in code points from its start. The model decides every candidate that
    isn't a boundary by definition."""
    out: list[int] = []
    get = weights.get
    decide = lambda features: sum([get(f, 0.0) for f in features]) > 0
    for c in candidates(text, decide):
        if c.fixed or decide(c.features):
            if not out or c.end > out[-1]:
                out.append(c.end)
    return out


def fit(texts: DataFrame, keys: Sequence[str], text: str, sample: int = TRAINING_TEXTS) -> dict[str, float]:
    """Train on at most so many texts, those whose keys have the smallest hashes.

    Of more rows than that, only a share by hash is looked at, so that each task sends a few texts at most."""
    share = min(1.0, 1.5 * sample / max(1, texts.count()))
    few = F.shiftrightunsigned(F.xxhash64(*keys), 44) <= int(share * (1 << 20))
    rows = texts.where(few & (F.length(text) > 0)).orderBy(F.shiftrightunsigned(F.xxhash64(*keys), 1), *keys).select(F.col(text).alias("t")).limit(sample).collect()
    return train([r["t"] for r in rows])


def split_sentences(texts: DataFrame, keys: Sequence[str], text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """keys and sent_end: one row per sentence of each text.

    Null, empty and blank texts have no sentences; a text without any mark is one. Closing marks
    belong to the sentence, the blanks behind it don't. Repeated rows give repeated results, other
    columns are ignored. weights None: fit on the texts themselves."""
    model = texts.sparkSession.sparkContext.broadcast(fit(texts, keys, text) if weights is None else weights)
    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField("sent_end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends = [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                found = sentence_ends(t, model.value)
                rows += [i] * len(found)
                ends += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(len(keys))] + [pa.array(ends, pa.int32())], [*keys, "sent_end"])

    picked = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).where("t is not null and t != ''")
    return picked.mapInArrow(run, schema)
