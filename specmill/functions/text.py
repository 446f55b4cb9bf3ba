"""Text expressions: whitespace, normalization, casefolding. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters beyond ASCII that count as whitespace, as ranges of code points.
WIDE_BLANKS = [(0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def whitespace(ascii_part: str, escape: str) -> str:
    """A character class of whitespace; escape formats a code point for the regular-expression dialect."""
    return "[" + ascii_part + "".join(escape.format(a) if a == b else escape.format(a) + "-" + escape.format(b) for a, b in WIDE_BLANKS) + "]"


JAVA, RE2 = "\\x{{{:x}}}", "\\x{{{:x}}}"
WS = whitespace(r"\t-\r\x1c-\x20", JAVA)
# whitespace within a line: all of it but the line feed
WS_IN_LINE = whitespace(r"\t\x0b-\r\x1c-\x20", JAVA)
WS_CHARACTERS = "".join(map(chr, (*range(9, 14), *range(28, 33), *(x for a, b in WIDE_BLANKS for x in range(a, b + 1)))))
WORD = r"[\p{L}\p{N}_]"


def exploded(array: Column) -> Column:
    """A row for each element of an array that is computed, and a null row for an empty or null one, which the caller leaves out.

    Of an inner explode the optimizer infers a filter on the array's size below it, and so computes the array twice."""
    return F.explode_outer(array)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a column that a lambda uses may be computed for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """Without whitespace at either end."""
    return F.btrim(c, F.lit(WS_CHARACTERS))


# Runs of whitespace but single spaces, which stay. Few characters are within the three ranges at its start, and it is told there that
# the rest aren't whitespace.
_RUN = rf"[\t-\x20\x{{85}}-\x{{a0}}\x{{1680}}-\x{{3000}}](?:(?<={whitespace(r'\t-\r\x1c-\x1f', JAVA)}){WS}*|(?<= ){WS}+)"


def collapse(c: Column) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _RUN, " "))


def casefold(c: Column) -> Column:
    """Lower case, sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def collapse_casefold(c: Column) -> Column:
    return casefold(collapse(c))


def normalize_text(c: Column) -> Column:
    """Line ends unified, runs of blanks within a line as one, at most one blank line together."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(strip(c), f"{WS_IN_LINE}+", " ")
    c = F.regexp_replace(c, " *\n *", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def page_cleanup(c: Column) -> Column:
    """Each line without trailing whitespace, the page without whitespace at the ends."""
    c = F.regexp_replace(c, r"\r\n|[\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n")
    return strip(F.regexp_replace(c, f"{WS_IN_LINE}+\n", "\n"))


def first_line(c: Column) -> Column:
    return strip(F.substring_index(strip(c), "\n", 1))


def join_blocks(blocks: Column, kind: Column) -> Column:
    """The full text of a document's blocks: paragraphs by a line feed, pages by two."""
    return strip(F.when(kind == "pdf", F.array_join(blocks, "\n\n")).otherwise(F.array_join(blocks, "\n")))
