"""Text decoded with the wrong character encoding: found, and restored where it still can be.

Every distinct clean word of the corpus is garbled under every encoding chain, and the
words of the texts are hash-joined to that table. A hit counts if the original occurs in clearly more
surroundings of the corpus than the garbled form, by itself or with the other words of its line;
copies of a text don't count. Verified originals are then substituted.
Scripts written without blanks take part with their single characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.text import exploded
from specmill.session import broadcast_if_small, cut

# Chains of (encoded as, read as); a double chain is applied twice.
SINGLE = [
    *[("utf-8", d) for d in ("cp1251", "latin-1", "cp1252", "cp866", "koi8-r", "mac-cyrillic", "mac-roman", "cp437", "iso8859-5")],
    *[(e, d) for e in ("cp1251", "cp866", "koi8-r", "iso8859-5", "mac-cyrillic") for d in ("latin-1", "cp1252", "cp1251", "cp866", "koi8-r") if e != d],
    *[(e, d) for e in ("latin-1", "cp1252") for d in ("cp1251", "cp866", "koi8-r", "cp437")],
]
DOUBLE = [("utf-8", d) for d in ("cp1251", "latin-1", "cp1252")]
MIXED = [(("utf-8", "latin-1"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "latin-1")), (("cp1251", "latin-1"), ("utf-8", "cp1252")), (("cp1251", "cp1252"), ("utf-8", "cp1251")), (("cp1251", "latin-1"), ("utf-8", "latin-1"))]
CHAINS: list[tuple[tuple[str, str], ...]] = [*[(c,) for c in SINGLE], *[(c, c) for c in DOUBLE], *MIXED]

_SHAPED = [i for i, c in enumerate(CHAINS) if c[-1][0] == "utf-8"]
LEAST_RATIO = 2.0
_BREAKS = r"[\x00-\x40\x5b-\x60\x7b-\x7f]+"
_UNSPACED = r"[฀-໿က-႟ក-៿⺀-鿿豈-﫿＀-￯　-ヿ]"
#: Question marks in place of words: a run of at least four, or one of two with another behind it, that no word precedes.
#: As a form such a run is that of every word of its length, so it only tells loss. Three by themselves may be meant.
_LOST, LOST_TOKEN = r"(?:^|[\s(«\[])(?:\?{4,}|\?{2,}[ ,.;:-]+\?)", "??"
_NOT_CLEAN = r"[\u0080-\u009f ­─-▟�-⌠⌡∙√≈≤≥]"


def _table(codec: str) -> str:
    """The character of each byte; undefined bytes come out as the control of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


_TABLES = {c: _table(c) for _, c in (*SINGLE, *DOUBLE)}
_REVERSE = {c: {ch: b for b, ch in enumerate(t)} for c, t in _TABLES.items()}


def garbled(text: str, chain: Sequence[tuple[str, str]]) -> str | None:
    """The text as it looks after the chain, or None where it can't be encoded so."""
    for written, read in chain:
        try:
            data = text.encode(written)
        except UnicodeEncodeError:
            return None
        text = data.decode("latin-1").translate(_TRANS[read])
    return text


_TRANS = {c: {b: t[b] for b in range(128, 256)} for c, t in _TABLES.items()}


def ungarbled(text: str, chain: Sequence[tuple[str, str]]) -> str | None:
    """The text before the chain, or None where the text can't be the chain's outcome."""
    for written, read in reversed(chain):
        back = _REVERSE[read]
        try:
            text = bytes([back[c] for c in text]).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for word, n, near in zip(pdf["word"], pdf["n"], pdf["near"]):
            seen = {word}
            for i, chain in enumerate(CHAINS):
                form = garbled(word, chain)
                if form and form not in seen:
                    seen.add(form)
                    # the forms are split as the texts are: no chain gives an ASCII letter for another character
                    rows.append((form, word, n, near, i))
        yield pd.DataFrame(rows, columns=["token", "original", "support", "near", "chain"])


def _parts(word: Column) -> Column:
    """The word, or the characters of a word of an unspaced script.

    A word with odd characters also comes with its first three, which may stand for one of an
    unspaced script (first six if encoded twice)."""
    head = F.when(word.rlike(r"^[^\x00-\x7f]{3}") & word.rlike(r"[^\x00-\x7fА-Яа-яЁё]"), F.substring(word, 1, 3))
    double = F.when(word.rlike(r"^[ÃГ]"), F.substring(word, 1, 6))
    return F.array_distinct(F.when(word.rlike(_UNSPACED), F.split(word, "")).otherwise(F.array_compact(F.array(word, head, double))))


def tokens_of(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys and token: the distinct words of each text that hold a character beyond ASCII, and their parts; LOST_TOKEN for
    question marks in place of words."""
    lost = F.when(F.col(text).rlike(_LOST), F.array(F.lit(LOST_TOKEN))).otherwise(F.array().cast("array<string>"))
    words = texts.select(*keys, exploded(F.array_distinct(F.concat(F.split(F.col(text), _BREAKS), lost))).alias("word"))
    words = words.where(F.col("word").rlike(r"[^\x00-\x7f]") | (F.col("word") == LOST_TOKEN))
    return words.select(*keys, exploded(_parts(F.col("word"))).alias("token")).where("token != ''")


def _lines(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys and line: the distinct lines of each text that hold a character beyond ASCII."""
    return texts.select(*keys, exploded(F.array_distinct(F.split(F.col(text), "\n"))).alias("line")).where(F.col("line").rlike(r"[^\x00-\x7f]"))


def counted_tokens(texts: DataFrame, text: str) -> DataFrame:
    """token, n, near: how often it occurs in the distinct lines of the corpus, and between how many pairs of neighbours.

    However often a text, a page or a line is repeated, n stays; near also stays where the copies differ in
    their numbers or where other lines surround them."""
    lines = _lines(texts, [], text).distinct().select(F.split("line", _BREAKS).alias("ws"))
    edge = F.array(F.lit(""))
    spread = F.arrays_zip(F.concat(edge, "ws").alias("before"), F.col("ws").alias("word"), F.concat(F.slice("ws", 2, F.size("ws")), edge).alias("after"))
    words = lines.select(exploded(spread).alias("x")).select("x.*").where(F.col("word").rlike(r"[^\x00-\x7f]"))
    words = words.groupBy("word", F.xxhash64("before", "after").alias("around")).agg(F.count("*").alias("n"))
    words = words.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("near"))
    return words.select(exploded(_parts(F.col("word"))).alias("token"), "n", "near").where("token != ''").groupBy("token").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))


def garbled_words(texts: DataFrame, text: str, ratio: float = LEAST_RATIO) -> tuple[DataFrame, DataFrame]:
    """(words, open). words: token, original, chain of every garbled word of the corpus and its verified original.

    A word is garbled if it is a chain's form of a clean corpus word: through UTF-8, whose forms
    have a shape of their own, of any; through single bytes, which only exchange letters, of one with at least
    as many pairs of neighbours, and ratio times as many of these or of occurrences in distinct lines, in any case
    of letters. Forms that look like plain words of the language need four
    letters; in lower case they count only together with others of their line. Among several originals the most frequent wins, then the smaller. Words with the
    replacement character, and question marks in place of words, are garbled beyond repair: their original is null.

    open: token, original, chain, score of the single-byte forms that their own counts leave open, for verified_in_lines();
    the score is the logarithm of how many times as many pairs of neighbours the original has."""
    counted = cut(counted_tokens(texts, text))
    folded = counted.groupBy(F.lower("token").alias("low")).agg(F.sum("n").alias("support"), F.sum("near").alias("near"))
    supported = counted.select("token", F.lower("token").alias("low")).join(folded, "low").select("token", "support", "near")
    clean = supported.where(~F.col("token").rlike(_NOT_CLEAN)).select(F.col("token").alias("word"), F.col("support").alias("n"), "near")
    forms = clean.mapInPandas(_forms, "token string, original string, support bigint, near bigint, chain int")
    plain = F.col("token").rlike(r"^[А-Яа-яЁё]+$") | F.col("token").rlike(r"^[A-Za-z]*[A-Za-zÀ-ÿ][A-Za-z]*$")
    # never broadcast: the planner takes the forms to be as small as the written words that they are made of
    hits = supported.select("token", F.col("support").alias("own"), F.col("near").alias("own_near")).join(forms.hint("merge"), "token")
    hits = hits.where(F.when(plain, F.length("token") >= 4).otherwise(F.length("original") >= 2) | F.col("original").rlike(_UNSPACED))
    verified = F.col("chain").isin(*_SHAPED) | (F.col("near") >= F.col("own_near")) & ((F.col("near") >= ratio * F.col("own_near")) | (F.col("support") >= ratio * F.col("own")))
    alone = ~(plain & F.col("token").rlike("^[a-zа-яё]+$"))
    hits = cut(hits.withColumn("verified", verified & alone))
    best = hits.where("verified").groupBy("token").agg(F.min_by(F.struct("original", "chain"), F.struct(-F.col("support"), F.col("original"), F.col("chain"))).alias("best"))
    best = best.select("token", "best.original", "best.chain")
    undecided = hits.where("not verified").select("token", "original", "chain", F.log(F.col("near") / F.col("own_near")).alias("score")).join(best.select("token"), "token", "left_anti")
    lost = counted.where(F.col("token").contains("�")).select("token", F.lit(None).cast("string").alias("original"), F.lit(None).cast("int").alias("chain"))
    marks = texts.sparkSession.createDataFrame([(LOST_TOKEN,)], "token string").select("token", F.lit(None).cast("string").alias("original"), F.lit(None).cast("int").alias("chain"))
    return best.unionByName(lost).unionByName(marks), undecided


def verified_in_lines(texts: DataFrame, keys: Sequence[str], text: str, undecided: DataFrame, max_broadcast_rows: int, ratio: float = LEAST_RATIO) -> DataFrame:
    """keys, token, original, chain of the words that their line verifies: at least two of its words go back under one
    chain, and together these originals have ratio times as many pairs of neighbours (the product over the words)."""
    undecided = cut(undecided)
    likely = broadcast_if_small(cut(undecided.where("score >= 0").select("token").distinct()), max_broadcast_rows)
    words = _lines(texts, keys, text).select(*keys, "line", exploded(F.array_distinct(F.split("line", _BREAKS))).alias("token")).where(F.col("token").rlike(r"[^\x00-\x7f]"))
    lines = words.join(likely, "token", "left_semi").groupBy(*keys, "line").agg(F.count("*").alias("n")).where("n >= 2").select(*keys, "line")
    again = lines.select(*keys, "line", exploded(F.array_distinct(F.split("line", _BREAKS))).alias("token"))
    found = again.join(broadcast_if_small(undecided, max_broadcast_rows), "token")
    same = found.groupBy(*keys, "line", "chain").agg(F.sum("score").alias("sum"), F.count_distinct("token").alias("n"), F.collect_set(F.struct("token", "original")).alias("all"))
    sure = same.where((F.col("sum") >= F.log(F.lit(ratio))) & (F.col("n") >= 2)).select(*keys, "chain", F.explode("all").alias("x"))
    return sure.select(*keys, "x.token", "x.original", "chain").distinct()


def affected(texts: DataFrame, keys: Sequence[str], text: str, max_broadcast_rows: int = 500_000) -> DataFrame:
    """keys of the texts any part of which is wrongly decoded; keys that occur twice come out once.

    Null and empty texts aren't affected; other columns are ignored."""
    words, undecided = garbled_words(texts, text)
    bad = broadcast_if_small(cut(words.select("token")), max_broadcast_rows)
    hits = tokens_of(texts, keys, text).join(bad, "token", "left_semi").select(*keys)
    return hits.union(verified_in_lines(texts, keys, text, undecided, max_broadcast_rows).select(*keys)).distinct()


_PLAIN_WORD = re.compile("[А-ЯЁ]?[а-яё]+")
_PIECE = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def restored(text: str, known: dict[str, tuple[str, int]]) -> str:
    """The text with the known garbled words replaced. Unknown words of a line with known ones
    are replaced if the commonest chain of the line takes them back and they don't look like plain words."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        votes: dict[int, int] = {}
        for w in _PIECE.findall(line):
            for k in (w, w[:3], w[:6]):
                if k in known:
                    votes[known[k][1]] = votes.get(known[k][1], 0) + 1
                    break
        if not votes:
            continue
        chain = CHAINS[min(votes, key=lambda c: (-votes[c], c))]

        def one(m: re.Match) -> str:
            w = m.group(0)
            if w in known:
                return known[w][0]
            if w.isascii() or chain[-1][0] != "utf-8" and _PLAIN_WORD.fullmatch(w):  # noqa: B023
                return w
            return ungarbled(w, chain) or w  # noqa: B023

        lines[i] = _PIECE.sub(one, line)
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def _restored(text: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([restored(t, {k["token"]: (k["original"], k["chain"]) for k in ks}) for t, ks in zip(text, known)])


def restore(texts: DataFrame, keys: Sequence[str], text: str, max_broadcast_rows: int = 500_000) -> DataFrame:
    """keys, text, restored of every affected text; words that can't be restored stay as they are."""
    words, undecided = garbled_words(texts, text)
    hits = tokens_of(texts, keys, text).join(broadcast_if_small(cut(words), max_broadcast_rows), "token")
    hits = hits.select(*keys, "token", "original", "chain").unionByName(verified_in_lines(texts, keys, text, undecided, max_broadcast_rows))
    known = hits.groupBy(*keys).agg(F.collect_set(F.when(F.col("original").isNotNull(), F.struct("token", "original", "chain"))).alias("known"))
    once = texts.select(*keys, F.col(text).alias("text")).dropDuplicates(list(keys))
    return once.join(known, list(keys)).select(*keys, "text", _restored("text", "known").alias("restored"))
