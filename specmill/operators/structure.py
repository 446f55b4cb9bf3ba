"""Section structure: headings, levels, tree and contents, as array expressions within a document's row.

Nothing here shuffles: a document's blocks stay in its row, headings are found and related to each
other by higher-order functions, and only the finished sections are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.text import WS, casefold, collapse, exploded, first_line, strip
from specmill.rules.tables import HEADING_KEYWORDS, MAX_UPPERCASE_HEADING, MEASUREMENT_TOKENS

_PUNCTUATION = r"[\p{P}\p{S}&&[^%]]"


def is_numbered(line: Column) -> Column:
    """N. Title, N.N.N Title, or N.N Title whose first word isn't a unit."""
    begins = line.rlike(r"^\p{Nd}+\.")
    token = F.lower(F.regexp_replace(F.regexp_extract(line, rf"^\p{{Nd}}+\.\p{{Nd}}+{WS}+([^\t-\r\x1c-\x20\x{{85}}\x{{a0}}]+)", 1), r"^[.,;:()]+|[.,;:()]+$", ""))
    two = line.rlike(rf"^\p{{Nd}}+\.\p{{Nd}}+{WS}+") & ~token.isin(*MEASUREMENT_TOKENS)
    return begins & (line.rlike(rf"^\p{{Nd}}+\.{WS}+") | line.rlike(rf"^\p{{Nd}}+(?:\.\p{{Nd}}+){{2,}}{WS}+") | two)


def headings(blocks: Column) -> Column:
    """array of (start, title) of the blocks that give a heading: a numbered first line, a short block in capitals, or a keyword.

    Each step is an array of its own, as within a lambda whatever occurs twice is computed twice."""
    bodies = F.transform(blocks, lambda b: strip(b))
    lines = F.transform(bodies, lambda x: F.struct(x.alias("body"), strip(F.substring_index(x, "\n", 1)).alias("line")))
    tried = F.transform(lines, lambda x, i: F.struct(i.alias("start"), _heading(x["body"], x["line"]).alias("title")))
    return F.filter(tried, lambda h: h["title"].isNotNull())


def _heading(body: Column, line: Column) -> Column:
    capitals = (F.length(body) < MAX_UPPERCASE_HEADING) & (body == F.upper(body)) & body.rlike(r"\p{L}")
    keyword = (F.length(body) <= max(map(len, HEADING_KEYWORDS))) & F.lower(body).isin(*HEADING_KEYWORDS)
    return F.when(body == "", None).when(is_numbered(line), line).when(capitals, body).when(keyword, body)


def level_of(title: Column) -> Column:
    """The number of parts of a numbered title's number, else 1."""
    number = F.regexp_extract(title, r"^(\p{Nd}+(?:\.\p{Nd}+)*)", 1)
    return F.when(is_numbered(title), F.size(F.split(number, r"\."))).otherwise(1)


def title_key(title: Column) -> Column:
    """The title without its number, collapsed and casefolded, as it is compared with the rules."""
    return line_key(first_line(title))


def line_key(line: Column) -> Column:
    """The title_key() of a title's first line."""
    rest = F.regexp_replace(F.regexp_replace(line, r"^\p{Nd}+(?:\.\p{Nd}+)*", ""), r"^[. ]+", "")
    return casefold(collapse(F.when(is_numbered(line), rest).otherwise(line)))


def section_arrays(docs: DataFrame) -> DataFrame:
    """docs with sections, the array of (section_ord, title, level, parent_ord, start_block, end_block, subtree_end) of each document."""
    heads = docs.withColumn("__found", headings(F.col("blocks")))
    leveled = heads.withColumn("__heads", F.transform("__found", lambda h, i: F.struct(i.alias("ord"), h["title"].alias("title"), h["start"].alias("start"), level_of(h["title"]).alias("level"))))
    last = F.size("blocks") - 1

    def related(h: Column, i: Column) -> Column:
        above = F.filter(F.slice("__heads", 1, i), lambda x: x["level"] < h["level"])
        later = F.filter(F.slice("__heads", i + 2, F.size("__heads")), lambda x: x["level"] <= h["level"])
        return F.struct(
            h["ord"].alias("section_ord"), h["title"].alias("title"), h["level"].alias("level"), F.array_max(F.transform(above, lambda x: x["ord"])).alias("parent_ord"),
            h["start"].alias("start_block"), F.coalesce(F.get("__heads", i + 1)["start"] - 1, last).alias("end_block"),
            F.coalesce(F.array_min(F.transform(later, lambda x: x["start"])) - 1, last).alias("subtree_end"),
        )

    return leveled.withColumn("sections", F.transform("__heads", related)).drop("__found", "__heads")


def content_of(section: Column) -> Column:
    """The text of a section's own blocks, its heading's included."""
    return F.array_join(F.slice("blocks", section["start_block"] + 1, section["end_block"] - section["start_block"] + 1), "\n")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_ord, title, level, parent_ord, start_block, end_block, subtree_end, title_key, content_text.

    A document without headings has no rows; parent_ord is null for roots; blocks may be empty or null. Sections that docs
    have already, of section_arrays(), are taken."""
    found = docs if "sections" in docs.columns else section_arrays(docs.select("doc_id", "blocks"))
    out = found.select("doc_id", exploded(F.transform("sections", lambda s: F.struct(s.alias("s"), content_of(s).alias("content_text")))).alias("x")).where("x IS NOT NULL")
    return out.select("doc_id", "x.s.*", "x.content_text").withColumn("title_key", title_key(F.col("title")))
