"""Queries of the audit operators over the corpus, one per operator or check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.functions.text import collapse_casefold, join_blocks, normalize_text, page_cleanup
from specmill.operators import checks, duplicates, issues, references, spans
from specmill.operators.corpus import corpus, lines_of
from specmill.operators.fragments import matched_units
from specmill.operators.issues import Frames
from specmill.session import cut
from specmill.sinks import exports
from specmill.sources import files
from specmill.sources.tables import delivered_once, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[[Frames], DataFrame], materialize: bool = False) -> Query:
    """A query that runs an operator on the frames of the corpus."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Frames.of(corpus(spark, sf_dir), materialize))

    return query


def _long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


# -- sources and normalization


def upload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every upload by its name or content type, and its client name."""
    t = delivered_once(table(spark, sf_dir, "uploads"), ["doc_id"])
    return t.select("doc_id", files.client_name(F.col("filename")).alias("client_name"), files.upload_suffix(F.col("filename"), F.col("content_type")).alias("suffix"))


def export_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safe stem of an export file for every upload."""
    return delivered_once(table(spark, sf_dir, "uploads"), ["doc_id"]).select("doc_id", exports.file_stem(F.col("filename")).alias("stem"))


def normalized_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every DOCX paragraph, normalized."""
    t = delivered_once(table(spark, sf_dir, "docx_extraction").where("paragraphs IS NOT NULL"), ["doc_id"])
    return t.select("doc_id", F.posexplode(F.transform("paragraphs", normalize_text)).alias("idx", "text")).select("doc_id", *_long("idx"), "text")


def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every PDF page, cleaned and normalized."""
    t = delivered_once(table(spark, sf_dir, "pdf_extraction").where("pages IS NOT NULL"), ["doc_id"])
    return t.select("doc_id", F.posexplode(F.transform("pages", lambda p: normalize_text(page_cleanup(p)))).alias("idx", "text")).select("doc_id", *_long("idx"), "text")


def unified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified full text of every extraction."""
    docx = delivered_once(table(spark, sf_dir, "docx_extraction").where("paragraphs IS NOT NULL"), ["doc_id"])
    pdf = delivered_once(table(spark, sf_dir, "pdf_extraction").where("pages IS NOT NULL"), ["doc_id"])
    return files.unify(docx, pdf).select("doc_id", "kind", F.size("blocks").cast("long").alias("n_blocks"), "full_text")


def casefolded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corpus text collapsed and casefolded."""
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", collapse_casefold(join_blocks(F.col("blocks"), F.col("kind"))).alias("collapsed"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and the longest line of every block."""
    lines = lines_of(corpus(spark, sf_dir))
    return lines.groupBy("doc_id", "block_index").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest")).withColumn("block_index", F.col("block_index").cast("long"))


# -- structure and section checks


def _sections(f: Frames) -> DataFrame:
    return f.secs.select("doc_id", *_long("section_ord", "level", "parent_ord", "start_block", "end_block", "subtree_end"), "title", "title_key")


def _section_contents(f: Frames) -> DataFrame:
    return f.secs.select("doc_id", *_long("section_ord"), F.length("content_text").cast("long").alias("n_chars"), F.md5("content_text").alias("digest"))


def _required_present(f: Frames) -> DataFrame:
    return checks.sections_found(f.secs, f.required).select("doc_id", "section_key", *_long("first_ord"))


def _required_missing(f: Frames) -> DataFrame:
    return checks.sections_missing(f.docs, checks.sections_found(f.secs, f.required), f.required).select("doc_id", "section_key")


def _order(f: Frames) -> DataFrame:
    return checks.order_violations(checks.sections_found(f.secs, f.required)).select("doc_id", *_long("position"), "expected_key", "found_key")


def _completeness(f: Frames) -> DataFrame:
    return checks.completeness(f.docs, f.secs, checks.sections_found(f.secs, f.required))


# -- fragments, obligations and signals

_FLAGS = ["number", "percent", "time", "unit", "compact", "letter", "threshold", "rate", "span", "comparison", "acceptance", "linked", "verifiable"]


def _fragments(f: Frames) -> DataFrame:
    return f.frags.select("doc_id", *_long("section_ord", "frag_idx"), "frag", "is_heading", "is_obligation")


def _obligations(f: Frames) -> DataFrame:
    return f.obligations.select("doc_id", *_long("section_ord", "frag_idx"), "collapsed", "marker", *_long("marker_start", "marker_end"))


def _signals(f: Frames) -> DataFrame:
    return f.obligations.select("doc_id", "collapsed", *_FLAGS, F.array_join("tags", "|").alias("tags"))


def _unverifiable(f: Frames) -> DataFrame:
    return f.obligations.where("NOT verifiable").select("doc_id", "section_title", *_long("frag_idx"), "frag", "marker")


def _numerical(f: Frames) -> DataFrame:
    counted = f.obligations.groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if(F.size("tags") > 0).alias("numeric_items"))
    return counted.withColumn("has_numeric_findings", F.col("numeric_items") > 0)


def _measurement(f: Frames) -> DataFrame:
    o = f.obligations
    return o.select("doc_id", "collapsed", "number", "has_unit", "linked", issues.measurement_reason(F.col("linked"), F.col("number"), F.col("has_unit")).alias("reason"), (~F.col("linked") & (F.col("number") | F.col("has_unit"))).alias("is_finding"))


def _measurement_units(f: Frames) -> DataFrame:
    return f.obligations.where("has_unit").select("doc_id", "collapsed", F.array_join(matched_units(F.col("frag"), F.col("collapsed")), "|").alias("units"))


# -- vocabulary, references, duplicates


def _vague(f: Frames) -> DataFrame:
    return spans.vague_findings(f.texts).select("doc_id", *_long("start_pos", "end_pos"), "phrase", "category", "description", "excerpt")


def _vague_by_category(f: Frames) -> DataFrame:
    return spans.vague_findings(f.texts).groupBy("category", "phrase").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _terms(f: Frames) -> DataFrame:
    return spans.term_counts(f.texts).select("doc_id", "term_key", "alias", "n", *_long("first_pos"))


def _mixed_terms(f: Frames) -> DataFrame:
    return spans.mixed_terms(spans.term_counts(f.texts))


def _references(kind: str) -> dict[str, Query]:
    of = {"figure": references.figure_references, "table": references.table_references, "appendix": references.appendix_references}[kind]
    return {
        f"{kind}_references": _on(lambda f: of(f.lines).groupBy("doc_id", "role", "label").agg(F.count("*").alias("n"))),
        f"{kind}_summary": _on(lambda f: references.label_summary(of(f.lines)).drop("place")),
        f"{kind}_gaps": _on(lambda f: references.number_gaps(of(f.lines)).select("doc_id", F.col("missing").cast("long").alias("missing"))),
        f"{kind}_gap_ranges": _on(lambda f: references.number_gap_ranges(of(f.lines)).select("doc_id", *_long("first_missing", "last_missing"))),
    }


def _exact(f: Frames) -> DataFrame:
    d = duplicates.exact_duplicates(f.frags)
    return d.select("doc_id", "key", "occurrences", "text", F.array_join(F.transform("fragment_indexes", lambda x: x.cast("string")), "|").alias("fragment_indexes"))


def _near_words(f: Frames) -> DataFrame:
    return duplicates.near_pairs(f.arrays).select("doc_id", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), F.round("jaccard", 6).alias("jaccard"))


# -- issues and reports


def _issues(f: Frames) -> DataFrame:
    return issues.build_issues(f).select("doc_id", *_long("issue_ord"), "check_key", "issue_code", "severity", "message", "fragment_text", "section_title", *_long("fragment_index"), "recommendation")


def _issues_by_check(f: Frames) -> DataFrame:
    return issues.build_issues(f).groupBy("check_key", "issue_code", "severity", "recommendation").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _grouping_sets(f: Frames) -> DataFrame:
    built = cut(issues.build_issues(f))
    return built.groupingSets([["check_key"], ["severity"], []], "check_key", "severity").agg(F.count("*").alias("n"))


def _report(f: Frames) -> DataFrame:
    return issues.report(f.docs, cut(issues.build_issues(f))).drop("by_check")


def _report_by_check(f: Frames) -> DataFrame:
    r = issues.report(f.docs, cut(issues.build_issues(f)))
    return r.select("doc_id", F.array_join(F.transform(F.map_entries(F.coalesce("by_check", F.create_map().cast("map<string,bigint>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("by_check"))


def _report_groups(f: Frames) -> DataFrame:
    g = issues.groups(issues.build_issues(f))
    return g.select("doc_id", "grouping", "value", F.array_join(F.transform("issue_ords", lambda x: x.cast("string")), "|").alias("issue_ords"))


def _filtered(f: Frames) -> DataFrame:
    return issues.filter_issues(issues.build_issues(f), "figure_references_check", "warning").groupBy("doc_id").agg(F.count("*").alias("n"))


def _csv(f: Frames) -> DataFrame:
    return exports.csv_rows(issues.build_issues(f)).select("doc_id", *_long("line_no"), "line")


def _csv_files(f: Frames) -> DataFrame:
    return exports.csv_documents(issues.build_issues(f))


def _payload(f: Frames) -> DataFrame:
    built = cut(issues.build_issues(f))
    return exports.payloads(issues.report(f.docs, built), built)


def _payload_conclusions(f: Frames) -> DataFrame:
    return _payload(f).select("doc_id", exports.conclusion_of(F.col("payload")).alias("conclusion"), F.size(exports.issues_of(F.col("payload"))).cast("long").alias("issues"))


def _payload_fragments(f: Frames) -> DataFrame:
    return exports.payload_fragments(_payload(f))


def _report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report files of all documents, read again: their names and each paragraph."""
    f = Frames.of(corpus(spark, sf_dir), materialize=True)
    built = cut(issues.build_issues(f))
    named = delivered_once(table(spark, sf_dir, "uploads"), ["doc_id"]).select("doc_id", "filename")
    made = exports.report_files(issues.report(f.docs, built), built, named)
    read = made.withColumn("x", files.extract(F.lit(".docx"), "content"))
    return read.select("doc_id", "filename", F.posexplode("x.blocks").alias("idx", "text")).select("doc_id", "filename", *_long("idx"), "text")


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of word-processing files made of the DOCX extractions, as they are read from the files."""
    t = delivered_once(table(spark, sf_dir, "docx_extraction").where("paragraphs IS NOT NULL"), ["doc_id"])
    read = t.select("doc_id", files.extract(F.lit(".docx"), exports.office_file("paragraphs")).alias("x"))
    return read.select("doc_id", F.posexplode("x.blocks").alias("idx", "text")).select("doc_id", *_long("idx"), "text")


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header that offers each upload's report."""
    names = F.concat(exports.file_stem(F.col("filename")), F.lit("-report.docx"))
    return delivered_once(table(spark, sf_dir, "uploads"), ["doc_id"]).select("doc_id", exports.content_disposition(names).alias("header"))


QUERIES: dict[str, Query] = {
    "upload_kinds": upload_kinds,
    "export_stems": export_stems,
    "normalized_paragraphs": normalized_paragraphs,
    "cleaned_pages": cleaned_pages,
    "unified_texts": unified_texts,
    "casefolded_texts": casefolded_texts,
    "line_counts": line_counts,
    "sections": _on(_sections),
    "section_contents": _on(_section_contents),
    "required_present": _on(_required_present),
    "required_missing": _on(_required_missing),
    "section_order": _on(_order),
    "structure_completeness": _on(_completeness),
    "presence": _on(lambda f: checks.presence(f.texts, f.secs)),
    "fragments": _on(_fragments),
    "obligations": _on(_obligations),
    "signals": _on(_signals),
    "unverifiable": _on(_unverifiable),
    "numerical": _on(_numerical),
    "measurement": _on(_measurement),
    "measurement_units": _on(_measurement_units),
    "vague": _on(_vague),
    "vague_by_category": _on(_vague_by_category),
    "term_counts": _on(_terms),
    "mixed_terms": _on(_mixed_terms),
    **_references("figure"),
    **_references("table"),
    **_references("appendix"),
    "appendix_letter_gaps": _on(lambda f: references.letter_gaps(references.appendix_references(f.lines))),
    "duplicates_exact": _on(_exact),
    "duplicates_near_words": _on(_near_words),
    "duplicates_near": _on(lambda f: duplicates.near_duplicates(f.arrays)),
    "issues": _on(_issues, materialize=True),
    "issues_by_check": _on(_issues_by_check, materialize=True),
    "issues_grouping_sets": _on(_grouping_sets, materialize=True),
    "issue_facets": _on(lambda f: issues.facets(issues.build_issues(f)), materialize=True),
    "issues_filtered": _on(_filtered, materialize=True),
    "report": _on(_report, materialize=True),
    "report_groups": _on(_report_groups, materialize=True),
    "report_by_check": _on(_report_by_check, materialize=True),
    "csv_rows": _on(_csv, materialize=True),
    "csv_files": _on(_csv_files, materialize=True),
    "payloads": _on(_payload, materialize=True),
    "payload_conclusions": _on(_payload_conclusions, materialize=True),
    "payload_fragments": _on(_payload_fragments, materialize=True),
    "report_files": _report_texts,
    "docx_files": docx_files,
    "dispositions": dispositions,
}
