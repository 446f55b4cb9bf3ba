"""Requirement fragments, obligations and signals of quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmill.functions.text import WS, casefold, collapse, collapse_casefold, exploded, join_blocks
from specmill.operators.structure import content_of, section_arrays
from specmill.rules import patterns as P
from specmill.rules.tables import HEADING_FRAGMENT, MIN_FRAGMENT, OBLIGATION_ROOTS, PRESENCE, RATES, THRESHOLDS


def split_fragments(text: Column) -> Column:
    """The sentences of a text by its closing marks, blanks collapsed, empty ones left out."""
    return F.filter(F.split(collapse(text), r" (?<=[.!?…] )"), lambda x: x != "")


def fragment_arrays(docs: DataFrame) -> DataFrame:
    """doc_id and fragments, the array of (section_ord, section_title, frag_idx, frag, collapsed, is_heading, is_obligation).

    The sentences of the sections in order; a document without any section text gives those of its full text,
    with a null section. A document never leaves its row."""
    found = docs if "sections" in docs.columns else section_arrays(docs.select("doc_id", "kind", "blocks"))
    own = F.transform("sections", lambda s: F.struct(s["section_ord"].alias("section_ord"), s["title"].alias("section_title"), content_of(s).alias("t")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("section_ord"), F.lit(None).cast("string").alias("section_title"), join_blocks(F.col("blocks"), F.col("kind")).alias("t")))
    texts = found.withColumn("__own", own).withColumn("__texts", F.when(F.exists("__own", lambda x: ~x["t"].rlike(f"^{WS}*$")), F.col("__own")).otherwise(whole))
    spelled = F.flatten(F.transform("__texts", lambda x: F.transform(split_fragments(x["t"]), lambda f, i: F.struct(x["section_ord"].alias("section_ord"), x["section_title"].alias("section_title"), i.alias("frag_idx"), f.alias("frag"), casefold(f).alias("collapsed")))))

    names = ("section_ord", "section_title", "frag_idx", "frag", "collapsed")
    told = F.transform(spelled, lambda x: F.struct(*[x[c].alias(c) for c in names], (_any(x["collapsed"], OBLIGATION_ROOTS) & x["collapsed"].rlike(P.OBLIGATION)).alias("is_obligation")))

    def flagged(x: Column) -> Column:
        stub = (F.length(x["frag"]) < HEADING_FRAGMENT) & x["frag"].rlike(rf"^[\p{{Nd}}.]+{WS}+[^ ]") & ~x["frag"].rlike(r"[.!?…]$") & ~x["is_obligation"]
        return F.struct(*[x[c].alias(c) for c in names], ((F.length(x["frag"]) < MIN_FRAGMENT) | stub).alias("is_heading"), x["is_obligation"].alias("is_obligation"))

    return texts.select("doc_id", F.transform(told, flagged).alias("fragments"))


def fragments(arrays: DataFrame) -> DataFrame:
    """doc_id, section_ord, section_title, frag_idx, frag, collapsed, is_heading, is_obligation: a row for each fragment of
    fragment_arrays()."""
    return arrays.select("doc_id", exploded(F.col("fragments")).alias("x")).where("x IS NOT NULL").select("doc_id", "x.*")


def obligations(frags: DataFrame) -> DataFrame:
    """The fragments that state an obligation, the first of each wording in a document, with the word that marks it
    and its place in the casefolded fragment; the word is spelled as in the fragment where casefolding keeps its length."""
    order = Window.partitionBy("doc_id", "collapsed").orderBy(F.col("section_ord").asc_nulls_first(), "frag_idx")
    first = frags.where(~F.col("is_heading") & F.col("is_obligation")).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    word = F.regexp_extract("collapsed", P.OBLIGATION, 1)
    start = F.length(F.regexp_extract("collapsed", f"(?s)^(.*?){P.OBLIGATION_BEFORE}{P.OBLIGATION_WORD}", 1)) + F.length(F.regexp_extract("collapsed", f"(?s)^.*?({P.OBLIGATION_BEFORE}){P.OBLIGATION_WORD}", 1))
    placed = first.withColumn("marker_start", start).withColumn("marker_end", start + F.length(word))
    return placed.withColumn("marker", F.when(F.length("frag") == F.length("collapsed"), F.substring(F.col("frag"), F.col("marker_start") + 1, F.length(word))).otherwise(word))


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def signals(frags: DataFrame) -> DataFrame:
    """The fragments with the signals of quantity as flags: number, percent, time, unit, compact, letter, threshold,
    rate, span, comparison, acceptance; whether number and unit are linked; whether it can be verified; the tags."""
    low = F.lower("frag")
    has = lambda p, c=F.col("collapsed"): c.rlike(P.java(p))
    out = frags.withColumns(
        {
            "number": has(P.DIGIT, low), "percent": F.col("collapsed").contains("%"), "time": has(P.TIME, low), "unit": has(P.UNIT), "compact": has(P.COMPACT, low), "letter": has(P.COMPACT_LETTER, low),
            "threshold": _any(F.col("collapsed"), THRESHOLDS), "rate": _any(F.col("collapsed"), RATES), "span": has(P.RANGE_FROM_TO) | has(P.RANGE_DASH),
            "comparison": has(P.COMPARISON) | has(P.COMPARISON_NUMBERS), "acceptance": _any(F.col("collapsed"), [p.lower() for p in PRESENCE["acceptance_criteria_check"][1]]), "alone": has(P.STANDALONE),
        }
    )
    c = F.col
    linked = c("time") | c("unit") | c("compact") | c("letter") | (c("number") & c("rate")) | (c("span") & (c("percent") | has(r"°<S>*[cсfф]")))
    verifiable = c("number") | c("percent") | c("time") | c("unit") | c("compact") | c("letter") | c("threshold") | c("rate") | c("acceptance") | c("comparison") | c("span")
    tags = F.array_compact(
        F.array(
            F.when(c("comparison"), "comparison"), F.when(c("time"), "duration"), F.when(c("number"), "number"), F.when(c("percent"), "percentage"), F.when(c("span"), "range"),
            F.when(c("rate"), "rate"), F.when(c("threshold"), "threshold"), F.when(c("unit") | c("compact") | c("letter"), "unit"),
        )
    )
    return out.withColumn("linked", linked).withColumn("verifiable", verifiable).withColumn("tags", tags).withColumn("has_unit", c("time") | c("unit") | c("compact") | c("letter") | c("alone"))


def matched_units(frag: Column, collapsed: Column) -> Column:
    """The stretches that hold a unit, in the order of the patterns, each once whatever its case, cut at 48 characters."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit("(" + P.java(p).replace("(?:^|[^0-9,.])", "(?<![0-9,.])").replace("(?:[^0-9]|$)", "(?![0-9])") + ")"), 1) for p, c in ((P.TIME, F.lower(frag)), (P.UNIT, collapsed), (P.COMPACT, F.lower(frag)), (P.COMPACT_LETTER, F.lower(frag)), (P.STANDALONE, collapsed))])
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.rtrim(F.left(collapse_casefold(x), F.lit(48)))), lambda x: x != ""))
