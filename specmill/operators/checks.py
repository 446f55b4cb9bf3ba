"""Checks of required sections and of the presence of contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmill.functions.text import first_line
from specmill.operators.structure import line_key
from specmill.rules.tables import PRESENCE, REQUIRED_SECTIONS


def _norm(wording: str) -> str:
    return " ".join(wording.split()).lower().replace("ß", "ss")


def _required_rows(required: list[tuple[str, list[str]]]) -> list[tuple[int, str, str, str]]:
    rows, seen = [], set()
    for i, (key, wordings) in enumerate(required):
        for w in wordings:
            if (norm := _norm(w)) not in seen:
                seen.add(norm)
                rows.append((i, key, wordings[0], norm))
    return rows


def required_table(spark: SparkSession, required: list[tuple[str, list[str]]] = REQUIRED_SECTIONS) -> DataFrame:
    """rule_ord, section_key, rule_title, title_key: one row per wording; the first section wins a wording."""
    return spark.createDataFrame(_required_rows(required), "rule_ord int, section_key string, rule_title string, title_key string")


def section_findings(docs: DataFrame, required: list[tuple[str, list[str]]] = REQUIRED_SECTIONS, rules: dict[str, tuple[list[str], list[str]]] = PRESENCE) -> DataFrame:
    """doc_id, missing, wrong, absent of each document, from doc_id, collapsed and its sections (section_arrays()): what
    sections_missing() and order_violations() (null where there is none) give, and the keys of the checks that presence() doesn't find.

    All within a document's row: as joins and windows, they make the largest plan of the audit, drawn up again after each of its stages."""
    wordings: dict[tuple[int, str, str], list[str]] = {}
    for *rule, norm in _required_rows(required):
        wordings.setdefault(tuple(rule), []).append(norm)
    each = F.array(*[F.struct(F.lit(o).alias("rule_ord"), F.lit(k).alias("section_key"), F.lit(t).alias("rule_title"), F.array(*map(F.lit, ws)).alias("wordings")) for (o, k, t), ws in wordings.items()])
    lines = F.transform("sections", lambda s: F.struct(s["section_ord"].alias("section_ord"), first_line(s["title"]).alias("line")))
    titled = F.transform(lines, lambda s: F.struct(s["section_ord"].alias("section_ord"), line_key(s["line"]).alias("key")))
    places = lambda r: F.transform(F.filter("titled", lambda t: F.array_contains(r["wordings"], t["key"])), lambda t: t["section_ord"])
    placed = F.transform(each, lambda r: F.struct(F.array_min(places(r)).alias("first_ord"), *[r[c].alias(c) for c in ("rule_ord", "section_key", "rule_title")]))
    rows = docs.select("doc_id", "collapsed", titled.alias("titled")).withColumn("placed", placed)
    rows = rows.withColumn("found", F.filter("placed", lambda r: r["first_ord"].isNotNull()))  # by rule
    rows = rows.withColumn("by_place", F.array_sort("found"))
    at = lambda x, i: F.struct(i.alias("position"), F.get("found", i)["section_key"].alias("expected_key"), F.get("found", i)["rule_title"].alias("expected_title"), x["section_key"].alias("found_key"), x["rule_title"].alias("found_title"))
    wrong = F.get(F.filter(F.transform("by_place", at), lambda w: w["found_key"] != w["expected_key"]), 0)
    missing = F.transform(F.filter("placed", lambda r: r["first_ord"].isNull()), lambda r: F.struct(*[r[c].alias(c) for c in ("rule_ord", "section_key", "rule_title")]))
    absent = []
    for check, (headings, phrases) in rules.items():
        named = F.exists("titled", lambda t: t["key"].isin(*map(_norm, headings)))
        met = reduce(Column.__or__, [F.col("collapsed").contains(_norm(p)) for p in phrases], named)
        absent.append(F.when(~F.coalesce(met, F.lit(False)), check))
    return rows.select("doc_id", missing.alias("missing"), wrong.alias("wrong"), F.array_compact(F.array(*absent)).alias("absent"))


def sections_found(secs: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, rule_ord, section_key, rule_title, first_ord: each required section of a document and where it first is.

    The rule table holds a few dozen rows, so it is broadcast."""
    hits = secs.select("doc_id", "section_ord", "title_key").join(F.broadcast(required), "title_key")
    return hits.groupBy("doc_id", "rule_ord", "section_key", "rule_title").agg(F.min("section_ord").alias("first_ord"))


def sections_missing(docs: DataFrame, found: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, rule_ord, section_key, rule_title of every required section that a document lacks."""
    rules = [(r["rule_ord"], r["section_key"], r["rule_title"]) for r in required.select("rule_ord", "section_key", "rule_title").distinct().collect()]
    wanted = F.array(*[F.struct(F.lit(o).alias("rule_ord"), F.lit(k).alias("section_key"), F.lit(t).alias("rule_title")) for o, k, t in sorted(rules)])
    have = found.groupBy("doc_id").agg(F.collect_set("section_key").alias("have"))
    every = docs.select("doc_id").join(have, "doc_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return every.select("doc_id", F.explode(F.filter(wanted, lambda w: ~F.array_contains("have", w["section_key"]))).alias("w")).select("doc_id", "w.*")


def order_violations(found: DataFrame) -> DataFrame:
    """doc_id, position, expected_key, expected_title, found_key, found_title: the first place of a document where
    the required sections that it has aren't in the order of the rules."""
    by_place = Window.partitionBy("doc_id").orderBy("first_ord", "rule_ord")
    by_rule = Window.partitionBy("doc_id").orderBy("rule_ord")
    ranked = found.withColumn("place", F.row_number().over(by_place) - 1).withColumn("rule_place", F.row_number().over(by_rule) - 1)
    actual = ranked.select("doc_id", F.col("place").alias("position"), F.col("section_key").alias("found_key"), F.col("rule_title").alias("found_title"))
    wanted = ranked.select("doc_id", F.col("rule_place").alias("position"), F.col("section_key").alias("expected_key"), F.col("rule_title").alias("expected_title"))
    wrong = actual.join(wanted, ["doc_id", "position"]).where("found_key != expected_key")
    return wrong.groupBy("doc_id").agg(F.min_by(F.struct("position", "expected_key", "expected_title", "found_key", "found_title"), "position").alias("w")).select("doc_id", "w.*")


def completeness(docs: DataFrame, secs: DataFrame, found: DataFrame, n_required: int = len(REQUIRED_SECTIONS)) -> DataFrame:
    """doc_id, n_sections, n_present, completeness_ratio, is_complete, no_sections, of every document."""
    n_sections = secs.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    present = found.groupBy("doc_id").agg(F.count("*").alias("n_present"))
    every = docs.select("doc_id").join(n_sections, "doc_id", "left").join(present, "doc_id", "left").fillna(0, ["n_sections", "n_present"])
    return every.select(
        "doc_id", "n_sections", "n_present", F.round(F.col("n_present") / n_required, 4).alias("completeness_ratio"), (F.col("n_present") == n_required).alias("is_complete"), (F.col("n_sections") == 0).alias("no_sections")
    )


def excerpt(text: Column, start: Column, length: Column, before: int, after: int, both: bool) -> Column:
    """The surroundings of a match at a 0-based start, with marks where the text goes on."""
    lo = F.greatest(start - before, F.lit(0))
    hi = F.least(start + length + after, F.length(text))
    cut = F.trim(F.substring(text, lo + 1, hi - lo))
    tail = F.when(hi < F.length(text), F.lit(" ...")).otherwise("")
    return F.concat(F.when(lo > 0, F.lit("... ")).otherwise("") if both else F.lit(""), cut, tail)


def presence(texts: DataFrame, secs: DataFrame, rules: dict[str, tuple[list[str], list[str]]] = PRESENCE) -> DataFrame:
    """doc_id, check_key, is_present, match_type, matched_signal, excerpt from doc_id, collapsed: a row for each document and check.

    A section title counts before a phrase of the text; the first matching section wins, then the first
    phrase in the order of the rules. One pass over the documents: phrases are literal expressions."""
    norm = _norm
    firsts = []
    for check, (headings, _) in rules.items():
        names = {norm(h): h for h in reversed(headings)}
        canonical = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        firsts.append(F.min_by(F.when(F.col("title_key").isin(*names), canonical[F.col("title_key")]), F.when(F.col("title_key").isin(*names), F.col("section_ord"))).alias(check))
    by_title = secs.groupBy("doc_id").agg(*firsts)
    both = texts.join(by_title, "doc_id", "left")
    cells = []
    for check, (_, phrases) in rules.items():
        hit = F.coalesce(*[F.when(F.col("collapsed").contains(norm(p)), F.struct(F.lit(p).alias("phrase"), (F.locate(norm(p), F.col("collapsed")) - 1).alias("at"), F.lit(len(norm(p))).alias("len"))) for p in phrases])
        cells.append(F.struct(F.lit(check).alias("check_key"), F.col(check).alias("heading"), hit.alias("hit")))
    rows = both.select("doc_id", "collapsed", F.explode(F.array(*cells)).alias("c")).select("doc_id", "collapsed", "c.*")
    by_phrase = F.col("heading").isNull() & F.col("hit").isNotNull()
    return rows.select(
        "doc_id", "check_key", (F.col("heading").isNotNull() | F.col("hit").isNotNull()).alias("is_present"),
        F.when(F.col("heading").isNotNull(), "section_title").when(by_phrase, "text_phrase").alias("match_type"), F.coalesce("heading", "hit.phrase").alias("matched_signal"),
        F.when(by_phrase, excerpt(F.col("collapsed"), F.col("hit.at"), F.col("hit.len"), 30, 120, False)).alias("excerpt"),
    )
