"""References to figures, tables and appendices: mentions, declarations, and what doesn't match."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.text import WS, collapse, strip
from specmill.rules.tables import ALPHABET, FIGURE, TABLE

_NOT_BEFORE = "(?<![а-яёa-z0-9])"


# Fixed value: the decimal digits beyond ASCII, in tens.
WIDE_DIGITS = "".join(c for c in map(chr, range(128, 0x1F000)) if unicodedata.category(c) == "Nd")
PLAIN_DIGITS = "".join(str(unicodedata.digit(c)) for c in WIDE_DIGITS)


def number_label(digits: Column) -> Column:
    """A number of any length in ASCII digits, without leading zeros."""
    return F.regexp_replace(F.translate(digits, WIDE_DIGITS, PLAIN_DIGITS), "^0+(?=.)", "")


def numbered_references(lines: DataFrame, words: tuple[list[str], list[str]]) -> DataFrame:
    """doc_id, role, label, block_index, line_index: a caption line declares its number and mentions nothing."""
    mentions, captions = words
    low = F.lower(strip(F.col("line")))
    declared = F.regexp_extract(low, rf"^(?:{'|'.join(captions)}){WS}*(\p{{Nd}}+)", 1)
    found = F.regexp_extract_all(low, F.lit(rf"{_NOT_BEFORE}(?:{'|'.join(mentions)}){WS}*(\p{{Nd}}+)(?!\p{{Nd}})"), 1)
    rows = lines.where(F.lower("line").rlike(captions[0][:3])).select("doc_id", "block_index", "line_index", declared.alias("declared"), found.alias("found"))
    role = F.when(F.col("declared") != "", "declaration").otherwise("mention")
    labels = F.when(F.col("declared") != "", F.array("declared")).otherwise(F.col("found"))
    out = rows.select("doc_id", role.alias("role"), F.explode(labels).alias("label"), "block_index", "line_index")
    return out.select("doc_id", "role", number_label(F.col("label")).alias("label"), "block_index", "line_index")


def figure_references(lines: DataFrame) -> DataFrame:
    return numbered_references(lines, FIGURE)


def table_references(lines: DataFrame) -> DataFrame:
    return numbered_references(lines, TABLE)


def _appendix_labels(text: Column, pattern: str) -> Column:
    """The labels of all matches: a letter in upper case, or a number without leading zeros."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.transform(whole, lambda x: F.when(x.rlike(r"^\p{Nd}+$"), number_label(x)).otherwise(F.upper(x)))


def appendix_references(lines: DataFrame) -> DataFrame:
    """doc_id, role, label, block_index, line_index; labels are single Cyrillic letters or numbers, and what is
    attached to something else ("приложение к ...") is no appendix."""
    label = r"([а-яё](?![а-яёa-z0-9])|\p{Nd}+(?!\p{Nd}))"
    low = F.lower(collapse(F.col("line")))
    declared = _appendix_labels(low, rf"^приложение (?!к(?![\p{{L}}\p{{N}}_])){label}")
    found = F.concat(
        _appendix_labels(low, rf"{_NOT_BEFORE}(?:приложение|приложении|приложению) (?!к(?![\p{{L}}\p{{N}}_])){label}"), _appendix_labels(low, rf"{_NOT_BEFORE}приложения (?!к ){label}")
    )
    rows = lines.where(F.lower("line").contains("приложени")).select("doc_id", "block_index", "line_index", declared.alias("declared"), found.alias("found"))
    role = F.when(F.size("declared") > 0, "declaration").otherwise("mention")
    return rows.select("doc_id", role.alias("role"), F.explode(F.when(F.size("declared") > 0, F.col("declared")).otherwise(F.col("found"))).alias("label"), "block_index", "line_index")


def label_summary(refs: DataFrame) -> DataFrame:
    """doc_id, label, mentions, declarations, place, state, is_duplicate.

    state is missing, unreferenced or ok; a label declared more than once is also a duplicate; place is the
    block and line of the first mention, or without one of the first declaration."""
    at = F.struct("block_index", "line_index")
    counted = refs.groupBy("doc_id", "label").agg(
        F.count_if(F.col("role") == "mention").alias("mentions"), F.count_if(F.col("role") == "declaration").alias("declarations"),
        F.coalesce(F.min(F.when(F.col("role") == "mention", at)), F.min(at)).alias("place"),
    )
    state = F.when(F.col("declarations") == 0, "missing").when(F.col("mentions") == 0, "unreferenced").otherwise("ok")
    return counted.withColumn("state", state).withColumn("is_duplicate", F.col("declarations") > 1)


def number_gap_ranges(refs: DataFrame) -> DataFrame:
    """doc_id, first_missing, last_missing: the ranges between neighbouring declared numbers of a document.

    Numbers of more than 38 digits have no neighbours here."""
    number = F.expr("CASE WHEN length(label) <= 38 THEN try_cast(label AS DECIMAL(38, 0)) END")
    numbers = refs.where("role = 'declaration'").select("doc_id", number.alias("v")).where("v IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    pairs = numbers.select("doc_id", F.explode(F.arrays_zip(F.slice("vs", 1, F.size("vs") - 1).alias("a"), F.slice("vs", 2, F.size("vs")).alias("b"))).alias("p")).where("p.b > p.a + 1")
    return pairs.select("doc_id", F.expr("cast(p.a + 1 AS DECIMAL(38, 0))").alias("first_missing"), F.expr("cast(p.b - 1 AS DECIMAL(38, 0))").alias("last_missing"))


def number_gaps(refs: DataFrame, longest: int = 100_000) -> DataFrame:
    """doc_id, missing: each number of the ranges of number_gap_ranges(), as text. For sinks that want a row for each
    missing number: a caption's number is free text, so a range may be long. It comes out in pieces of so many numbers."""
    ranges = number_gap_ranges(refs).withColumn("n", F.expr("cast(last_missing - first_missing + 1 AS BIGINT)"))
    pieces = ranges.select("doc_id", "first_missing", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
    at = F.explode(F.sequence(F.col("piece") * longest, F.least((F.col("piece") + 1) * longest, F.col("n")) - 1))
    return pieces.select("doc_id", "first_missing", at.alias("i")).select("doc_id", F.expr("cast(cast(first_missing + i AS DECIMAL(38, 0)) AS STRING)").alias("missing"))


def letter_gaps(refs: DataFrame) -> DataFrame:
    """doc_id, missing: the letters between a document's first and last declared letter that aren't declared."""
    letters = refs.where("role = 'declaration'").withColumn("at", F.expr(f"locate(label, '{ALPHABET}')")).where("length(label) = 1 AND at > 0")
    ends = letters.groupBy("doc_id").agg(F.collect_set("at").alias("have"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    return ends.select("doc_id", F.explode(F.array_except(F.sequence("lo", "hi"), "have")).alias("at")).select("doc_id", F.expr(f"substring('{ALPHABET}', at, 1)").alias("missing"))
