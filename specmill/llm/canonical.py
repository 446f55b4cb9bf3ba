"""Look-alike text brought to one consistent form.

Every blank-separated word is mapped to a skeleton (look-alike letters, widths and blanks
unified), the skeletons are grouped under accent-sensitive Unicode collation in SQL (which
holds composed and decomposed letters equal and ignores invisible characters), each class
gets a deterministic canonical member for each alphabet, and that member is joined back to
the words that aren't consistent. Consistent words are never replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.lookalikes import BLANKS, GREEK, GREEK_TO_LATIN, INVISIBLE, LATIN, LATIN_TO_CYRILLIC, TO_CYRILLIC, TO_LATIN
from specmill.functions.text import exploded
from specmill.session import broadcast_if_small, cut

WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
_L, _C, _G = r"A-Za-zªºÀ-ÖØ-öø-ɏ", r"Ѐ-ӿԀ-ԯ", r"Ͱ-Ͽ"
_ODD_CHARACTER = f"[{INVISIBLE}{BLANKS}{WIDE}]"
_MIXED = f"[{_L}][{_C}{_G}]|[{_C}][{_L}{_G}]|[{_G}][{_L}{_C}]"
_UNCOMPOSED = f"[{_L}{_C}{_G}][̀-ͯ]"
SEPARATOR = r"[ \t\r\n]+"

_WORD = re.compile(f"[{_L}{_C}{_G}]+")
_ONLY_CYRILLIC = re.compile(f"[{_C}]")
_ONLY_LATIN = re.compile(f"[{_L}]")
_SPACES = re.compile(f"[{BLANKS}]")
_PLAIN = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | dict(zip(map(ord, WIDE), NARROW))


def consistent(word: Column) -> Column:
    """Whether a word is in the consistent form, by its own characters."""
    return ~(word.rlike(_ODD_CHARACTER) | word.rlike(_MIXED) | word.rlike(_UNCOMPOSED))


def skeleton(word: Column) -> Column:
    """The word with look-alike letters, widths and blanks unified; what collation ignores stays.

    Letters become Latin, as there are composed Latin letters for every look-alike base with an accent."""
    return F.translate(word, LATIN_TO_CYRILLIC + "ёїЇ" + GREEK + WIDE + BLANKS, LATIN + "ëïÏ" + GREEK_TO_LATIN + NARROW + " " * len(BLANKS))


def _one_alphabet(m: re.Match) -> str:
    word = m.group(0)
    as_cyrillic, as_latin = word.translate(TO_CYRILLIC), word.translate(TO_LATIN)
    if not _ONLY_LATIN.search(as_cyrillic) and not re.search(f"[{_G}]", as_cyrillic):
        return as_cyrillic if _ONLY_CYRILLIC.search(word) else word
    return as_latin if not _ONLY_CYRILLIC.search(as_latin) and not re.search(f"[{_G}]", as_latin) else word


def repaired(word: str) -> str:
    """A consistent form of a word that isn't in it: composed, without invisible characters, of
    ordinary width, and every run of letters in one alphabet where look-alikes allow it."""
    return _WORD.sub(_one_alphabet, unicodedata.normalize("NFC", word.translate(_PLAIN)))


@F.pandas_udf(T.StringType())
def _repaired(word: pd.Series) -> pd.Series:
    return word.map(repaired)


def words_of(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys and word: the distinct blank-separated words of every text."""
    return texts.select(*keys, exploded(F.array_distinct(F.split(F.col(text), SEPARATOR))).alias("word")).where("word != ''")


def alphabet(word: Column) -> Column:
    """The one alphabet of a word's letters as a letter, "-" where it has none of the three; null where it mixes them."""
    has = [word.rlike(f"[{x}]") for x in (_L, _C, _G)]
    several = sum((h.cast("int") for h in has), F.lit(0)) > 1
    return F.when(~several, F.when(has[0], "L").when(has[1], "C").when(has[2], "G").otherwise("-"))


def canonical_words(words: DataFrame, word: str) -> DataFrame:
    """word, canonical, fine: every distinct word and its canonical form.

    A consistent word is its own. The others are grouped with all words by their skeletons under the collation, and
    with the repaired forms of those that aren't consistent; a word of one alphabet gets the canonical member of that
    alphabet in its class, a word that mixes them that of the whole class. The canonical member is consistent
    if any is, then the most frequent, then the smallest in code-point order. Null words have no row."""
    counted = cut(words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).withColumn("fine", consistent(F.col("word"))))
    odd = counted.where(~F.col("fine"))
    made = odd.select(_repaired("word").alias("word"), F.lit(0).cast("long").alias("n")).withColumn("fine", consistent(F.col("word")))
    members = counted.unionByName(made).withColumn("class", F.collate(skeleton(F.col("word")), "UNICODE")).withColumn("of", alphabet(F.col("word")))
    rank = F.struct(~F.col("fine"), -F.col("n"), F.col("word"))
    best = lambda of: F.min_by("word", F.when(F.col("of") == of, rank)).alias(of)
    classes = members.groupBy("class").agg(F.max(~F.col("fine")).alias("odd"), F.min_by("word", rank).alias("any"), *[best(x) for x in "LCG-"])
    changed = odd.withColumn("class", F.collate(skeleton(F.col("word")), "UNICODE")).withColumn("of", alphabet(F.col("word"))).join(classes.where("odd").drop("odd"), "class", "left")
    own = F.coalesce(*[F.when(F.col("of") == x, F.col(x)) for x in "LCG-"], F.col("any"), F.col("word"))
    return counted.where("fine").select("word", F.col("word").alias("canonical"), "fine").unionByName(changed.select("word", own.alias("canonical"), "fine"))


def inconsistent(texts: DataFrame, keys: Sequence[str], text: str, max_broadcast_rows: int = 300_000) -> DataFrame:
    """keys of the texts that hold a word that isn't in the consistent form.

    Such a word is one that fails the exact check of consistency, and either mixes alphabets or
    is replaced by its class's canonical member (letters without a composed form are not). Null, empty and blank texts are consistent; the number of blanks
    doesn't matter; keys that occur twice come out once."""
    words = words_of(texts, keys, text)
    replaced = canonical_words(words, "word").where(~F.col("fine") & (F.col("word").rlike(_MIXED) | (F.col("word") != F.col("canonical")))).select("word")
    replaced = broadcast_if_small(cut(replaced), max_broadcast_rows)
    return words.join(replaced, "word", "left_semi").select(*keys).distinct()


def canonical_texts(texts: DataFrame, keys: Sequence[str], text: str, max_broadcast_rows: int = 300_000) -> DataFrame:
    """keys, text and canonical of every text: its words replaced by the canonical members of
    their classes, and runs of blanks by one. A null text stays null."""
    once = texts.select(*keys, F.col(text).alias("text")).dropDuplicates(list(keys))
    words = once.select(*keys, F.posexplode_outer(F.split("text", SEPARATOR)).alias("pos", "word")).where("word != ''")
    known = canonical_words(words, "word").where(F.col("word") != F.col("canonical")).select("word", "canonical")
    spelled = words.join(broadcast_if_small(cut(known), max_broadcast_rows), "word", "left")
    joined = spelled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "word").alias("w")))).alias("ws"))
    joined = joined.select(*keys, F.array_join(F.col("ws.w"), " ").alias("canonical"))
    return once.join(joined, list(keys), "left").select(*keys, "text", F.when(F.col("text").isNotNull(), F.coalesce("canonical", F.lit(""))).alias("canonical"))
