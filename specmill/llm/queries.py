"""The registry of the queries of this subpackage and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.llm import bpe, canonical, mixing, mojibake, neardup, personal, sentences, titles
from specmill.sources.tables import table


def _title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.match_titles(table(spark, sf_dir, "structure"), "title", table(spark, sf_dir, "required_section_template"), "section_key", "title", "aliases")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the required-section list that every typed heading stands for."""
    rows = titles.assign_titles(table(spark, sf_dir, "structure"), ["doc_id", "section_ord"], "title", _title_matches(spark, sf_dir))
    return rows.withColumnRenamed("entry", "section_key")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings that stand for no entry, with the number of sections that have them."""
    sections = table(spark, sf_dir, "structure").select("doc_id", "section_ord", "title").dropDuplicates(["doc_id", "section_ord"])
    counted = sections.groupBy("title").agg(F.count("*").alias("sections"))  # counted before the join, so that no heading is hot
    unmatched = _title_matches(spark, sf_dir).where(F.col("entry") == titles.UNMATCHED).select(F.col("value").alias("title"))
    return counted.join(unmatched, "title").select("title", "sections")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, doc_id, block_index, text of DOCX paragraphs and of unified blocks of kind docx."""
    docx = table(spark, sf_dir, "docx_extraction").select(F.lit("docx_extraction").alias("table_name"), "doc_id", F.posexplode("paragraphs").alias("block_index", "text"))
    unified = table(spark, sf_dir, "unified_document").where("kind = 'docx'")
    unified = unified.select(F.lit("unified_document").alias("table_name"), "doc_id", F.posexplode("blocks").alias("block_index", "text"))
    return docx.unionByName(unified)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs and blocks that aren't in the consistent form."""
    return canonical.inconsistent(_paragraphs(spark, sf_dir), ["table_name", "doc_id", "block_index"], "text")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and block in the consistent form."""
    return canonical.canonical_texts(_paragraphs(spark, sf_dir), ["table_name", "doc_id", "block_index"], "text")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, doc_id, page_index, text of PDF pages and of unified full texts (page -1)."""
    pdf = table(spark, sf_dir, "pdf_extraction").select(F.lit("pdf_extraction").alias("table_name"), "doc_id", F.posexplode("pages").alias("page_index", "text"))
    unified = table(spark, sf_dir, "unified_document").select(F.lit("unified_document").alias("table_name"), "doc_id", F.lit(-1).alias("page_index"), F.col("full_text").alias("text"))
    return pdf.unionByName(unified)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages and full texts any part of which is wrongly decoded."""
    return mojibake.affected(_decoded(spark, sf_dir), ["table_name", "doc_id", "page_index"], "text")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected pages and full texts with their original words put back."""
    return mojibake.restore(_decoded(spark, sf_dir), ["table_name", "doc_id", "page_index"], "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence of every section."""
    return sentences.split_sentences(table(spark, sf_dir, "structure"), ["doc_id", "section_ord"], "content_text").distinct()


def p6_full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence of every unified full text."""
    return sentences.split_sentences(table(spark, sf_dir, "unified_document"), ["doc_id"], "full_text").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, tokens, and the length of the longest in tokens."""
    counted = bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"], count_only=True)
    lang = F.lower(F.coalesce("lang", F.lit("und"))).alias("lang")
    return counted.groupBy(lang).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))


def _mix(spark: SparkSession, sf_dir: str, **how: object) -> tuple[DataFrame, DataFrame]:
    sized = bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"], count_only=True)
    return mixing.mix(sized, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_target"), **how)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus, as large as its listed sources: one row per use of a document, with its block and place in it."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mixed corpus that each source actually reaches, beside its target and limit."""
    return _mix(spark, sf_dir)[1]


def p8_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest mix that has all targets exactly."""
    return _mix(spark, sf_dir, exact=True)[1]


def p8_entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the mix whose weights are the token shares to a power that gives them the entropy of the targets."""
    target = [r["target_share"] for r in table(spark, sf_dir, "mix_target").where("target_share > 0").select("target_share").collect()]
    return _mix(spark, sf_dir, target_entropy=mixing.entropy({str(i): t / sum(target) for i, t in enumerate(target)}))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of personal information in the corpus; dates, which only get pseudonyms, are none of the kinds."""
    found = personal.find_personal(table(spark, sf_dir, "documents"), "text", ["doc_id"], personal.session_key(spark))
    return found.where("kind != 'date'").select("doc_id", "kind", "start_pos", "end_pos").distinct()


def p9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed, format-preserving placeholders in place of personal information."""
    return personal.pseudonymize(table(spark, sf_dir, "documents"), "text", ["doc_id"], personal.session_key(spark))


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section_ord, kind, text of full texts (section -1, kind 0) and sections (kind 1) of at least 200 characters."""
    full = table(spark, sf_dir, "unified_document").select("doc_id", F.lit(-1).alias("section_ord"), F.lit(0).alias("kind"), F.col("full_text").alias("text"))
    sections = table(spark, sf_dir, "structure").select("doc_id", "section_ord", F.lit(1).alias("kind"), F.col("content_text").alias("text"))
    return full.unionByName(sections).where(F.length("text") >= 200)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of near-identical documents and of near-identical sections."""
    pairs = neardup.near_duplicate_pairs(_long_texts(spark, sf_dir), ["doc_id", "section_ord"], "text", "kind", n=3, threshold=0.6)
    return pairs.select("doc_id_a", "section_ord_a", "doc_id_b", "section_ord_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long document and section with its class of equal word sets and the number of near-identical classes."""
    return neardup.near_duplicate_groups(_long_texts(spark, sf_dir), ["doc_id", "section_ord"], "text", "kind", n=3, threshold=0.6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p6_full_texts": p6_full_texts,
    "p7_ids": p7_ids,
    "p7_counts": p7_counts,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_exact_shares": p8_exact_shares,
    "p8_entropy_shares": p8_entropy_shares,
    "p9_found": p9_found,
    "p9_pseudonyms": p9_pseudonyms,
}
SQL: dict[str, str] = {}
