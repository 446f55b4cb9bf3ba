"""Free-entered values mapped to the closest entry of a reference list.

Token-level repair: every distinct token of the values is joined to the vocabulary of the
reference wordings by edit distance (a hash join on deletion neighbourhoods, verified by the
restricted Damerau-Levenshtein distance); the repaired tokens are then combined by soft
TF-IDF, which ranks the complete wordings. Values without a wording above the threshold
are reported as unmatched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.lookalikes import LATIN, TO_CYRILLIC, plain
from specmill.functions.text import exploded
from specmill.session import broadcast_if_small, broadcast_or_merge, cut

MAX_EDITS = 2
THRESHOLD = 0.72
UNKNOWN_SHARE = 0.7
UNMATCHED = "unmatched"
BLANK = r"[\s\u00a0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\u00ad]+"

# Words that carry little and the letters of the common transliteration.
STOP = {"и", "с", "со", "на", "по", "после", "в", "о", "для", "i", "s", "so", "na", "po", "posle", "v", "o", "dlya"}
TRANSLIT = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}

_NUMBERING = re.compile(r"^\s*(?:(?:раздел|глава|часть|пункт|section|razdel)\s+)?(?:\d+(?:\.\d+)*[.)]?|[а-яa-z]\))\s+")
_LEADER = re.compile(r"\s*(?:\.{3,}|…|_{3,})[\s.…_]*\d*\s*$")
_PAGE = re.compile(r"\s{2,}\d+\s*$")
_TAIL = re.compile(r"\s*(?:\((?:дополнение|продолжение|окончание)\)|[—–-]\s*(?:продолжение|окончание)|,?\s*(?:часть|ч\.)\s*\d+)\s*[.;:]?\s*$")
_SOFT_BREAK = re.compile(r"(?<=[^\W\d_])-\s+(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W\d_]+\.?")


def title_readings(title: str) -> list[list[str]]:
    """The tokens of a title as typed, and where a hyphen before a blank may be a line break or
    a stray mark, of both readings."""
    return list(map(list, dict.fromkeys((tuple(title_tokens(title)), tuple(title_tokens(title, join=False))))))


def title_tokens(title: str, join: bool = True) -> list[str]:
    """The tokens of a typed title: composed lower-case letters of one alphabet, without
    numbering, page leader and continuation marks; a token keeps a dot that follows it.
    join: a hyphen between a letter and a blank joins the parts."""
    text = plain(title).lower().replace("ё", "е").strip()
    spaced = text.split()
    if len(spaced) >= 6 and sum(len(w) == 1 for w in spaced) >= 0.8 * len(spaced):
        text = " ".join(w.replace(" ", "") for w in re.split(r"\s{2,}", text))
    text = _LEADER.sub("", text)
    text = _PAGE.sub("", text)
    text = _TAIL.sub("", _TAIL.sub("", text))
    text = _NUMBERING.sub("", text, count=1)
    text = _SOFT_BREAK.sub("" if join else " ", text)
    tokens = _TOKEN.findall(text)
    if re.search("[а-я]", text):
        tokens = [w.translate(TO_CYRILLIC).replace("ё", "е") if w.rstrip(".").isascii() and all(c in LATIN for c in w.rstrip(".")) else w for w in tokens]
    return tokens


def transliterated(word: str) -> str:
    return "".join(TRANSLIT.get(c, c) for c in word)


def osa(a: str, b: str, most: int) -> int:
    """The restricted Damerau-Levenshtein distance, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def edits_allowed(word: str) -> int:
    """Edits that a token may be away from a vocabulary word of this length."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 4 else MAX_EDITS


def neighbourhood(word: str, most: int) -> set[str]:
    """The word with up to so many letters left out."""
    out = {word}
    level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for token in pdf["token"]:
            bare = token.rstrip(".")
            rows += [(token, "e" + v) for v in neighbourhood(bare, edits_allowed(bare))]
            if token.endswith(".") and len(bare) >= 3:
                rows.append((token, "p" + bare))
        yield pd.DataFrame(rows, columns=["token", "variant"])


def _word_variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for word in pdf["word"]:
            rows += [(word, "e" + v) for v in neighbourhood(word, edits_allowed(word))]
            rows += [(word, "p" + word[:n]) for n in range(3, len(word))]
        yield pd.DataFrame(rows, columns=["word", "variant"])


@F.pandas_udf(T.DoubleType())
def _similarity(token: pd.Series, word: pd.Series) -> pd.Series:
    """1 for equal, less by edits; a dotted start of the word counts 0.95; else 0."""

    def one(t: str, w: str) -> float:
        bare = t.rstrip(".")
        if bare == w:
            return 1.0
        if t != bare and len(bare) >= 3 and w.startswith(bare):
            return 0.95
        most = min(edits_allowed(w), edits_allowed(bare))
        most += most == MAX_EDITS and len(w) >= 8  # a swap beside another edit counts 3, but shares a neighbour
        d = osa(bare, w, most)
        return 0.0 if d > most else 1.0 - d / (max(len(w), 4) + 2.0)

    return pd.Series([one(t, w) for t, w in zip(token, word)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _readings(title: pd.Series) -> pd.Series:
    return pd.Series([title_readings(t) for t in title])


def reference_wordings(reference: DataFrame, key: str, title: str, aliases: str) -> DataFrame:
    """wording, entry, word, idf, word_total: the words of every wording of the reference list, spelled,
    transliterated, and as the wording written without blanks (a word that stands for all)."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for entry, wording in zip(pdf["entry"], pdf["wording"]):
                tokens = [w.rstrip(".") for w in title_tokens(wording)]
                content = [w for w in tokens if w not in STOP]
                if not content:
                    continue
                rows += [(entry, f"{wording}|c", w) for w in set(content)]
                rows += [(entry, f"{wording}|l", w) for w in {transliterated(w) for w in content}]
                rows.append((entry, f"{wording}|g", "".join(tokens)))
            yield pd.DataFrame(rows, columns=["entry", "wording", "word"])

    wordings = reference.select(F.col(key).alias("entry"), F.explode(F.array_distinct(F.concat(F.array(F.col(title)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))).alias("wording"))
    exploded = wordings.where("wording is not null and entry is not null").mapInPandas(words, "entry string, wording string, word string").distinct()
    frequency = exploded.groupBy("word").agg(F.count("*").alias("df"))
    total = exploded.select(F.countDistinct("wording")).first()[0]
    weighted = exploded.join(frequency, "word").withColumn("idf", F.log(1 + F.lit(total) / F.col("df"))).drop("df")
    return weighted.withColumn("word_total", F.sum("idf").over(Window.partitionBy("entry", "wording")))


def match_titles(values: DataFrame, value: str, reference: DataFrame, key: str, title: str, aliases: str, threshold: float = THRESHOLD, max_broadcast_rows: int = 100_000) -> DataFrame:
    """One row per distinct non-blank value: value, entry, wording, score.

    entry is 'unmatched' and wording null where no wording reaches the threshold. The score is
    the geometric mean of the weighted shares of the wording and of the value that the repaired
    tokens cover; ties go to the smallest entry, then wording. Null and blank values have no
    row; a value without letters is unmatched; an empty reference leaves all unmatched; other
    columns are ignored. Every distinct token is compared once, by a hash join."""
    distinct = values.select(F.col(value).alias("value")).where(F.regexp_replace("value", BLANK, "") != "").distinct()
    titles = cut(distinct.withColumn("tokens", exploded(_readings("value"))).withColumn("typed", F.array_join("tokens", " ")))
    words = cut(reference_wordings(reference, key, title, aliases))

    tokens = titles.select("typed", "tokens").dropDuplicates(["typed"]).select("typed", F.posexplode("tokens").alias("pos", "token"))
    tokens = tokens.where(~F.regexp_replace("token", r"\.$", "").isin(*STOP))
    vocabulary = broadcast_or_merge(cut(words.select("word").distinct().mapInPandas(_word_variants, "word string, variant string")), max_broadcast_rows)
    pairs = tokens.select("token").distinct().mapInPandas(_variants, "token string, variant string").join(vocabulary, "variant").select("token", "word").distinct()
    # spread over the tasks, as there are few of them in bytes, by a hash of its own, as the planner drops a shuffle by
    # the columns that the rows are shuffled by already; written once, as four frames below read it
    spread = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, F.xxhash64("token", "word"))
    repaired = broadcast_or_merge(cut(spread.withColumn("sim", _similarity("token", "word")).where("sim > 0")), max_broadcast_rows)

    # a token weighs as the rarest word it can stand for, an unknown one as most of the rarest word there is
    weights = repaired.join(words.groupBy("word").agg(F.max("idf").alias("idf")), "word").groupBy("token").agg(F.max("idf").alias("known"))
    unknown = words.agg(F.coalesce(F.max("idf"), F.lit(1.0)) * UNKNOWN_SHARE).first()[0]
    weighed = tokens.join(weights, "token", "left").withColumn("weight", F.coalesce("known", F.lit(unknown)))
    totals = weighed.groupBy("typed").agg(F.sum("weight").alias("total"))

    hits = weighed.join(repaired, "token").join(broadcast_or_merge(words, max_broadcast_rows), "word")
    pair = ["typed", "entry", "wording"]
    of_wording = hits.groupBy(*pair, "word").agg(F.max("sim").alias("sim"), F.max("idf").alias("idf"), F.max("word_total").alias("word_total"))
    of_wording = of_wording.groupBy(*pair).agg((F.sum(F.col("sim") * F.col("idf")) / F.max("word_total")).alias("share"))
    of_value = hits.groupBy(*pair, "pos").agg(F.max("sim").alias("sim"), F.max("weight").alias("weight"))
    of_value = of_value.groupBy(*pair).agg(F.sum(F.col("sim") * F.col("weight")).alias("covered"))
    scored = of_wording.join(of_value, pair).join(totals, "typed").withColumn("score", F.round(F.sqrt(F.col("share") * F.col("covered") / F.col("total")), 6))
    best = scored.where(F.col("score") >= threshold).groupBy("typed").agg(F.min(F.struct((-F.col("score")).alias("minus"), "entry", "wording")).alias("best"))
    of_value = titles.join(best, "typed", "left").groupBy("value").agg(F.min("best").alias("best"))
    return of_value.select(
        "value",
        F.coalesce("best.entry", F.lit(UNMATCHED)).alias("entry"),
        F.regexp_extract("best.wording", r"^(.*)\|.$", 1).alias("wording"),
        (-F.col("best.minus")).alias("score"),
    )


def assign_titles(rows: DataFrame, keys: Sequence[str], value: str, matches: DataFrame, max_broadcast_rows: int = 300_000, salts: int = 16) -> DataFrame:
    """keys and entry of every row with a value that is neither null nor blank.

    A value may be that of very many rows: the matches are broadcast where they are small; else the rows of each value are
    spread over salts, with a copy of its match for each."""
    typed = rows.select(*keys, F.col(value).alias("value")).dropDuplicates(list(keys))
    known = cut(matches.select("value", "entry"))
    small = broadcast_if_small(known, max_broadcast_rows)
    if small is not known:
        return typed.join(small, "value").select(*keys, "entry")
    spread = typed.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    copies = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # never broadcast: the planner takes the copies to be as small as the file of the matches, which is compressed and has each once
    return spread.join(copies.hint("merge"), ["value", "__salt"]).select(*keys, "entry")
