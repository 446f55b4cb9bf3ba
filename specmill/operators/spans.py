"""Dictionary phrases in text: whole-phrase matches, the longest first, without overlaps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.text import exploded, let
from specmill.operators.checks import excerpt
from specmill.rules.tables import GLOSSARY, VAGUE_DESCRIPTIONS, VAGUE_PHRASES

_WORD_CHARACTER = r"[\p{L}\p{N}_]"


_MATCH = "array<struct<minus:int,s:int,e:int,phrase:string>>"


def _matches(text: Column, phrase: Column) -> Column:
    """array of (minus, s, e, phrase) of every whole occurrence, found by walking the gaps between occurrences."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), phrase, F.lit("\\E")), -1)
    n = F.length(phrase)
    start = F.struct(F.lit(-1).alias("at"), F.lit("").alias("before"), F.array().cast(_MATCH).alias("out"))

    def walk(acc: Column, gap: Column) -> Column:
        whole = (acc["at"] >= 0) & ~F.right(acc["before"], F.lit(1)).rlike(_WORD_CHARACTER) & ~F.left(gap, F.lit(1)).rlike(_WORD_CHARACTER)
        match = F.struct((-n).alias("minus"), acc["at"].alias("s"), (acc["at"] + n).alias("e"), phrase.alias("phrase"))
        out = F.when(whole, F.concat(acc["out"], F.array(match))).otherwise(acc["out"])
        at = F.when(acc["at"] >= 0, acc["at"] + n).otherwise(0) + F.length(gap)
        return F.struct(at.alias("at"), gap.alias("before"), out.alias("out"))

    return F.aggregate(gaps, start, walk, lambda acc: acc["out"])


def _first_word(phrase: str) -> str:
    """The first word of a phrase; "" where it has none."""
    return re.search(r"\w*$", re.split(r"(?<=\w)(?!\w)", phrase)[0])[0]


def _phrases(values: list[str]) -> Column:
    """The phrases with their first words."""
    return F.array(*[F.struct(F.lit(v).alias("phrase"), F.lit(_first_word(v)).alias("first")) for v in values])


def _words_held(text: Column, values: list[str]) -> Column:
    """Those of the first words of phrases that the text has as whole words, and "". A search of each phrase goes through the
    whole text, and most phrases aren't there; this is one pass for all."""
    words = sorted({_first_word(v) for v in values} - {""})
    pattern = f"(?<!{_WORD_CHARACTER})(?:{'|'.join(map(re.escape, words))})(?!{_WORD_CHARACTER})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if words else F.array().cast("array<string>")
    return F.array_append(F.array_distinct(found), F.lit(""))


def _spans(text: Column, phrases: Column, words: Column) -> Column:
    """array of (s, e, phrase): greedily the longest matches, then the leftmost, that don't overlap, by position.

    phrases are _phrases(), words those of _words_held(); only phrases that the text contains are looked for, by one expression for all."""
    held = F.filter(phrases, lambda p: F.array_contains(words, p["first"]) & text.contains(p["phrase"]))
    ranked = F.array_sort(F.flatten(F.transform(held, lambda p: _matches(text, p["phrase"]))))
    empty = F.array().cast("array<struct<s:int,e:int,phrase:string>>")
    kept = F.aggregate(
        ranked, empty, lambda acc, m: F.when(F.exists(acc, lambda k: (m["e"] > k["s"]) & (m["s"] < k["e"])), acc).otherwise(F.concat(acc, F.array(F.struct(m["s"].alias("s"), m["e"].alias("e"), m["phrase"].alias("phrase")))))
    )
    return F.array_sort(kept)


def vague_findings(texts: DataFrame, phrases: dict[str, list[str]] = VAGUE_PHRASES, descriptions: dict[str, str] = VAGUE_DESCRIPTIONS) -> DataFrame:
    """doc_id, start_pos, end_pos, phrase, match_type, source_kind, category, description, excerpt from doc_id, collapsed;
    the description of a phrase that has none is null."""
    category = {p: c for c, ps in phrases.items() for p in ps}
    found = let(_words_held(F.col("collapsed"), list(category)), lambda words: _spans(F.col("collapsed"), _phrases(list(category)), words))
    rows = texts.select("doc_id", "collapsed", exploded(found).alias("m")).where("m IS NOT NULL")
    of = F.create_map(*[F.lit(x) for kv in category.items() for x in kv])
    about = F.create_map(*[F.lit(x) for kv in (descriptions or {"": ""}).items() for x in kv])
    return rows.select(
        "doc_id", F.col("m.s").alias("start_pos"), F.col("m.e").alias("end_pos"), "m.phrase", F.lit("dictionary_phrase").alias("match_type"), F.lit("full_text").alias("source_kind"),
        of[F.col("m.phrase")].alias("category"), about[F.col("m.phrase")].alias("description"),
        excerpt(F.col("collapsed"), F.col("m.s"), F.col("m.e") - F.col("m.s"), 40, 120, True).alias("excerpt")
    )


def _terms_found(texts: DataFrame, glossary: list[tuple[str, str, list[str]]], kept: Callable[[Column], Column]) -> DataFrame:
    """doc_id, term_key, found: the spans of the forms of each term, longer forms first within a term; of those that kept holds for."""
    several = [(key, [canonical, *others]) for key, canonical, others in glossary if others]
    terms = F.array(*[F.struct(F.lit(key).alias("term_key"), _phrases(forms).alias("forms")) for key, forms in several])
    of = lambda words: F.transform(terms, lambda t: F.struct(t["term_key"].alias("term_key"), _spans(F.col("collapsed"), t["forms"], words).alias("found")))
    found = F.filter(let(_words_held(F.col("collapsed"), [x for _, forms in several for x in forms]), of), lambda t: kept(t["found"]))
    return texts.select("doc_id", exploded(found).alias("t")).where("t IS NOT NULL").select("doc_id", "t.*")


def term_counts(texts: DataFrame, glossary: list[tuple[str, str, list[str]]] = GLOSSARY) -> DataFrame:
    """doc_id, term_key, alias, n, first_pos: how often each form of a term occurs, longer forms first within a term."""
    rows = _terms_found(texts, glossary, lambda found: F.size(found) > 0).select("doc_id", "term_key", F.explode("found").alias("m"))
    return rows.groupBy("doc_id", "term_key", F.col("m.phrase").alias("alias")).agg(F.count("*").alias("n"), F.min("m.s").alias("first_pos"))


def mixed_terms(counts: DataFrame) -> DataFrame:
    """doc_id, term_key, used_variants, total: the terms of which a document uses several forms."""
    grouped = counts.groupBy("doc_id", "term_key").agg(F.array_sort(F.collect_set("alias")).alias("used"), F.sum("n").alias("total"))
    return grouped.where(F.size("used") >= 2).select("doc_id", "term_key", F.array_join("used", ", ").alias("used_variants"), "total")


def mixed_terms_of(texts: DataFrame, glossary: list[tuple[str, str, list[str]]] = GLOSSARY) -> DataFrame:
    """mixed_terms() of term_counts(), within the rows of the documents."""
    rows = _terms_found(texts, glossary, lambda found: F.exists(found, lambda m: m["phrase"] != F.get(found, 0)["phrase"]))
    used = F.array_sort(F.array_distinct(F.col("found.phrase")))
    return rows.select("doc_id", "term_key", F.array_join(used, ", ").alias("used_variants"), F.size("found").cast("long").alias("total"))
