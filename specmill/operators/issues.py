"""Findings of all checks as one table of issues, and the report of every document."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmill.functions.text import collapse_casefold, join_blocks
from specmill.operators import checks, duplicates, references, spans
from specmill.operators.corpus import lines_of
from specmill.operators.fragments import fragment_arrays, fragments, obligations, signals
from specmill.operators.structure import section_arrays, sections
from specmill.session import cut
from specmill.rules.tables import (
    CONCLUSIONS,
    EXACT_MESSAGE,
    FACET_LABELS,
    FACET_OTHER,
    FACET_UNSET,
    MIXED_TERMS_MESSAGE,
    NEAR_MESSAGE,
    NUMERICAL_MESSAGE,
    PRESENCE_MESSAGES,
    RECOMMENDATION_PREFIXES,
    RECOMMENDATIONS,
    REFERENCE_MESSAGES,
    SECTION_MISSING_MESSAGE,
    SECTION_ORDER_MESSAGE,
    SEVERITIES,
    UNIT_REASONS,
    UNVERIFIABLE_MESSAGE,
    VAGUE_MESSAGE,
)



@dataclass
class Frames:
    """The frames that checks share, built once from documents (doc_id, kind, blocks)."""

    docs: DataFrame
    secs: DataFrame
    arrays: DataFrame
    frags: DataFrame
    obligations: DataFrame
    texts: DataFrame
    lines: DataFrame
    required: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, materialize: bool = False) -> Frames:
        """materialize: write the shared frames to the checkpoint folder, where many checks read them; then sections are found
        once, with the documents, and come without their texts; the checks of sections read them there."""
        keep = cut if materialize else lambda df: df
        docs = docs.withColumn("collapsed", collapse_casefold(join_blocks(F.col("blocks"), F.col("kind"))))
        docs = cut(section_arrays(docs)) if materialize else docs
        secs = sections(docs).drop("content_text") if materialize else sections(docs)
        arrays = fragment_arrays(docs)  # a document a row
        arrays = cut(duplicates.with_keys(arrays)) if materialize else arrays
        frags = fragments(arrays)
        texts = docs.select("doc_id", "collapsed")
        return cls(docs, secs, arrays, frags, keep(signals(obligations(frags))), texts, keep(lines_of(docs).where(F.lower("line").rlike("рис|табл|приложени"))), checks.required_table(docs.sparkSession))


def recommendation(code: Column) -> Column:
    """The hint for an issue code: by the whole code, else by the first of the starts that fits."""
    exact = F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv])[code]
    return F.coalesce(exact, *[F.when(code.startswith(p), F.lit(t)) for p, t in RECOMMENDATION_PREFIXES.items()])


def normalize_severity(severity: Column) -> Column:
    """One of the severities; blank is null; anything else is an error."""
    plain = F.nullif(F.trim(severity), F.lit(""))
    return F.when(plain.isNull() | plain.isin(*SEVERITIES), plain).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), severity)))


def said(template: str, *parts: Column | str) -> Column:
    """A message template with its places filled."""
    texts = template.split("{}")
    return F.concat(*[x for t, p in zip(texts, [*parts, None]) for x in ((F.lit(t),) if p is None else (F.lit(t), F.col(p).cast("string") if isinstance(p, str) else p))])


def required(name: str, value: Column) -> Column:
    """A text without blanks at its ends; a null or blank one is an error."""
    plain = F.trim(value)
    return F.when(F.length(plain) > 0, plain).otherwise(F.raise_error(F.lit(f"{name} must be non-empty")))


_LOCATIONS = "array<struct<block_index:int,line_index:int,fragment_index:int>>"


def issue(
    df: DataFrame, check: str | Column, code: Column, severity: str, message: Column, fragment: Column | None = None, section: Column | None = None, location: Column | None = None,
    metadata: list[str] | None = None, place: Column | None = None, fragment_indexes: Column | None = None,
) -> DataFrame:
    """A frame of findings in the form of issues; blank optional texts become null, a blank code or message is an error.

    metadata names columns that are kept as JSON, absent ones left out. Locations come from a fragment's
    index, from several, or from the place (block and line) of a reference."""
    none = F.lit(None).cast("int")
    at = lambda b, l, f: F.struct(b.cast("int").alias("block_index"), l.cast("int").alias("line_index"), f.cast("int").alias("fragment_index"))  # noqa: E731, E741
    if fragment_indexes is not None:
        locations = F.transform(fragment_indexes, lambda i: at(none, none, i))
    elif place is not None:
        locations = F.array(at(place["block_index"], place["line_index"], none))
    else:
        locations = F.lit(None) if location is None else F.array(at(none, none, location))
    kept = F.to_json(F.struct(*metadata)) if metadata else F.lit(None).cast("string")
    text = lambda c: F.lit(None).cast("string") if c is None else F.nullif(F.trim(c), F.lit(""))
    return df.select(
        "doc_id", (required("check_key", check) if isinstance(check, Column) else F.lit(check)).alias("check_key"), required("issue_code", code).alias("issue_code"), normalize_severity(F.lit(severity)).alias("severity"), required("message", message).alias("message"), text(fragment).alias("fragment_text"), text(section).alias("section_title"),
        (none if location is None else location.cast("int")).alias("fragment_index"), kept.alias("metadata"), locations.cast(_LOCATIONS).alias("locations"),
    )


def measurement_reason(linked: Column, number: Column, unit: Column) -> Column:
    r = UNIT_REASONS
    return F.when(linked, r["linked"]).when(number & unit, r["both"]).when(number, r["number"]).when(unit, r["unit"]).otherwise(r["none"])


def _reference_issues(refs: DataFrame, kind: str) -> list[DataFrame]:
    refs = cut(refs)  # written once, else each kind of issue looks for them again
    s, check, m = cut(references.label_summary(refs)), f"{kind}_references_check", REFERENCE_MESSAGES[kind]
    of = lambda code: F.lit(f"{kind}.{code}")
    return [
        issue(s.where("state = 'missing'"), check, of("missing_declaration"), "warning", said(m["missing_declaration"], "label"), metadata=["label"], place=F.col("place")),
        issue(s.where("state = 'unreferenced'"), check, of("unreferenced"), "warning", said(m["unreferenced"], "label"), metadata=["label"], place=F.col("place")),
        issue(s.where("is_duplicate"), check, of("duplicate_declaration"), "warning", said(m["duplicate_declaration"], "label"), metadata=["label"]),
        issue(references.number_gaps(refs), check, of("caption_numbering_gap"), "recommendation", said(m["caption_numbering_gap"], "missing"), metadata=["missing"]),
    ]


def build_issues(f: Frames) -> DataFrame:
    """doc_id, issue_ord, check_key, issue_code, severity, message, fragment_text, section_title, fragment_index,
    metadata, locations, recommendation: the issues of all checks, numbered from 1 within a document by check, code, message and fragment."""
    c = F.col
    vague = F.coalesce(F.nullif(F.trim("description"), F.lit("")), said(VAGUE_MESSAGE, "phrase"))
    of = lambda k: F.create_map(*[F.lit(x) for n, m in PRESENCE_MESSAGES.items() for x in (n, m[k])])[c("check_key")]
    wording = [
        issue(spans.vague_findings(f.texts), "vague_wording_check", F.concat(F.lit("vague_wording."), c("match_type")), "recommendation", vague, c("excerpt"), metadata=["phrase", "category", "match_type", "source_kind", "description"]),
        issue(spans.mixed_terms_of(f.texts), "terminology_consistency_check", F.concat(F.lit("terminology.mixed_variants."), c("term_key")), "recommendation", F.lit(MIXED_TERMS_MESSAGE), metadata=["term_key", "used_variants", "total"]),
    ]
    obliged = [
        issue(f.obligations.where("NOT verifiable"), "unverifiable_requirements_check", F.lit("unverifiable.obligation_without_metrics"), "warning", F.lit(UNVERIFIABLE_MESSAGE), c("frag"), c("section_title"), c("frag_idx"), ["marker"]),
        issue(f.obligations.where("size(tags) = 0"), "numerical_characteristics_check", F.lit("numerical.missing_in_obligation_fragment"), "recommendation", F.lit(NUMERICAL_MESSAGE), c("frag"), c("section_title"), c("frag_idx"), ["marker"]),
        issue(
            f.obligations.where("NOT linked AND (number OR has_unit)"), "measurement_units_check", F.lit("measurement.unit_linkage_review"), "recommendation",
            measurement_reason(c("linked"), c("number"), c("has_unit")), c("frag"), c("section_title"), c("frag_idx"), ["number", "has_unit", "linked", "tags"],
        ),
    ]
    # a row for each finding of the sections of a document: a missing one, the first in a wrong place, or a check that isn't met
    sections_of = cut(checks.section_findings(f.docs if "sections" in f.docs.columns else section_arrays(f.docs)))
    sectioned = [
        issue(sections_of.select("doc_id", F.explode("missing").alias("x")).select("doc_id", "x.*"), "required_sections_check", F.concat(F.lit("required_sections.missing."), c("section_key")), "warning", said(SECTION_MISSING_MESSAGE, "rule_title"), metadata=["section_key", "rule_title"]),
        issue(sections_of.where("wrong IS NOT NULL").select("doc_id", "wrong.*"), "section_order_check", F.lit("section_order.violation"), "warning", said(SECTION_ORDER_MESSAGE, "expected_title", "found_title"), metadata=["position", "expected_key", "found_key"]),
        issue(sections_of.select("doc_id", F.explode("absent").alias("check_key")), c("check_key"), of(0), "warning", of(1)),
    ]
    appendix = cut(references.appendix_references(f.lines))
    labels, check, m = cut(references.label_summary(appendix)), "appendix_references_check", REFERENCE_MESSAGES["appendix"]
    coded = lambda code, x: F.concat(F.lit(f"appendix.{code}."), c(x).cast("string"))
    appendices = [
        issue(labels.where("state = 'missing'"), check, coded("missing_declaration", "label"), "warning", said(m["missing_declaration"], "label"), metadata=["label"], place=c("place")),
        issue(labels.where("state = 'unreferenced'"), check, coded("unreferenced", "label"), "warning", said(m["unreferenced"], "label"), metadata=["label"], place=c("place")),
        issue(labels.where("is_duplicate"), check, coded("duplicate_declaration", "label"), "warning", said(m["duplicate_declaration"], "label"), metadata=["label"]),
        issue(references.letter_gaps(appendix), check, coded("cyrillic_sequence_gap", "missing"), "recommendation", said(m["cyrillic_sequence_gap"], "missing")),
        issue(references.number_gaps(appendix), check, coded("numeric_sequence_gap", "missing"), "recommendation", said(m["numeric_sequence_gap"], "missing")),
    ]
    repeated = [
        issue(duplicates.exact_duplicates(fragments(duplicates.recurring(f.arrays))), "duplicate_formulations_check", F.lit("duplicate.exact"), "warning", F.lit(EXACT_MESSAGE), c("text"), F.array_join("section_titles", ", "), metadata=["occurrences", "fragment_indexes", "section_titles"], fragment_indexes=c("fragment_indexes")),
        issue(duplicates.near_duplicates(f.arrays), "duplicate_formulations_check", F.lit("duplicate.near"), "warning", F.lit(NEAR_MESSAGE), F.concat_ws(" — ", "text_a", "text_b"), metadata=["similarity", "text_a", "text_b"]),
    ]
    figures, tables = _reference_issues(references.figure_references(f.lines), "figure"), _reference_issues(references.table_references(f.lines), "table")
    # each group of checks is written by itself: one plan of all of them is drawn up again after each of its stages, which
    # takes more of the driver's memory than all else
    parts = [cut(reduce(DataFrame.unionByName, group)) for group in (wording, obliged, sectioned, figures, tables, appendices, repeated)]
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("doc_id").orderBy("check_key", "issue_code", "message", F.coalesce("fragment_text", F.lit("")), F.coalesce("fragment_index", F.lit(-1)))
    return every.withColumn("issue_ord", F.row_number().over(order)).withColumn("recommendation", recommendation(c("issue_code")))


def report(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per document: status, conclusion, total_issues, one count per severity, unspecified, with_recommendation,
    and by_check, the counts per check as a map. Documents without issues count zero; rows with a blank check
    count as 'unknown'."""
    severity = F.trim("severity")
    check = F.coalesce(F.nullif(F.trim("check_key"), F.lit("")), F.lit("unknown"))
    counted = issues.groupBy("doc_id").agg(
        F.count("*").alias("total_issues"), *[F.count_if(severity == s).alias(s) for s in SEVERITIES], F.count_if(severity.isNull() | ~severity.isin(*SEVERITIES)).alias("unspecified"),
        F.count_if(F.length(F.trim("recommendation")) > 0).alias("with_recommendation"), F.collect_list(check).alias("__checks"),
    )
    each = F.transform(F.array_sort(F.array_distinct("__checks")), lambda k: F.struct(k.alias("k"), F.size(F.filter("__checks", lambda x: x == k)).cast("long").alias("n")))
    counted = counted.withColumn("by_check", F.map_from_entries(each)).drop("__checks")
    # never broadcast: the planner takes the counts to be as small as the compressed file that they are made from
    out = docs.select("doc_id").join(counted.hint("merge"), "doc_id", "left").fillna(0, ["total_issues", *SEVERITIES, "unspecified", "with_recommendation"])
    status = F.when(F.col("total_issues") == 0, "no_issues").when(F.col("critical") + F.col("warning") > 0, "needs_review").otherwise("recommendations_only")
    words = F.create_map(*[F.lit(x) for kv in CONCLUSIONS.items() for x in kv])
    return out.withColumn("status", status).withColumn("conclusion", words[F.col("status")])


def audit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, report) of documents (doc_id, kind, blocks)."""
    frames = Frames.of(docs, materialize=True)
    issues = cut(build_issues(frames))
    return issues, report(frames.docs, issues)


def filter_issues(issues: DataFrame, check_key: str = "", severity: str = "", missing: str = "(none)") -> DataFrame:
    """The issues of a check and of a severity; "" takes all, missing values stand in the bucket named missing."""
    bucket = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(missing))
    out = issues if check_key == "" else issues.where(bucket("check_key") == check_key)
    return out if severity == "" else out.where(bucket("severity") == severity)


def groups(issues: DataFrame) -> DataFrame:
    """doc_id, grouping, value, issue_ords: the issues of each document by severity and by check, as their numbers in order.

    Unknown and missing severities stand under 'unspecified', blank checks under 'unknown'."""
    severity = F.trim("severity")
    value = F.when(severity.isin(*SEVERITIES), severity).otherwise("unspecified")
    check = F.coalesce(F.nullif(F.trim("check_key"), F.lit("")), F.lit("unknown"))
    both = F.array(F.struct(F.lit("by_severity").alias("grouping"), value.alias("value")), F.struct(F.lit("by_check").alias("grouping"), check.alias("value")))
    rows = issues.select("doc_id", "issue_ord", F.explode(both).alias("g"))
    return rows.groupBy("doc_id", "g.grouping", "g.value").agg(F.array_sort(F.collect_list("issue_ord")).alias("issue_ords"))


def facets(issues: DataFrame) -> DataFrame:
    """facet, value, n, label: the values that the issues can be filtered by, with their counts and labels; "" stands for none.

    Values without a label are numbered in their order where there are several of them in a facet."""
    bucket = lambda c: F.coalesce(F.trim(c), F.lit(""))
    sets = issues.select(F.explode(F.array(F.struct(F.lit("check_key").alias("facet"), bucket("check_key").alias("value")), F.struct(F.lit("severity").alias("facet"), bucket("severity").alias("value")))).alias("x"))
    counted = sets.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))  # a row for each value, so few
    of = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    known = F.coalesce(*[F.when(F.col("facet") == facet, of(labels)[F.col("value")]) for facet, labels in FACET_LABELS.items()], F.when(F.col("value") == "", of(FACET_UNSET)[F.col("facet")]))
    rows = counted.withColumn("known", known).withColumn("open", F.col("known").isNull().cast("int"))
    each = Window.partitionBy("facet")
    at = F.sum("open").over(each.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).cast("string")
    other = F.concat(of(FACET_OTHER)[F.col("facet")], F.when(F.sum("open").over(each) > 1, F.concat(F.lit(" №"), at)).otherwise(""))
    return rows.select("facet", "value", "n", F.coalesce("known", other).alias("label"))
