"""Repeated formulations within a document: exact ones, and near ones by a prefix filter."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.batches import in_pieces
from specmill.functions.text import exploded, let
from specmill.rules.tables import MIN_SHARED, MIN_TOKENS, NEAR, NEAR_RELAXED, NEAR_SEQUENCE


def formulation_key(collapsed: Column) -> Column:
    """The casefolded fragment without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapsed, r"[^\p{L}\p{N}_ ]+", " "), " {2,}", " "))


def with_keys(arrays: DataFrame) -> DataFrame:
    """fragment_arrays() with keys, the array of their fragments' keys, null for those of headings; the frames below take them if they are there."""
    return arrays.withColumn("keys", _keys(arrays))


def _keys(arrays: DataFrame) -> Column:
    return F.col("keys") if "keys" in arrays.columns else F.transform("fragments", lambda x: F.when(~x["is_heading"], formulation_key(x["collapsed"])))


def recurring(arrays: DataFrame) -> DataFrame:
    """fragment_arrays() with only the fragments whose key occurs more than once in their document, so that only these are shuffled."""
    keys = _keys(arrays)
    again = lambda ks: let(F.array_sort(F.filter(ks, lambda k: k != "")), lambda s: F.array_distinct(F.filter(s, lambda k, i: k == F.get(s, i - 1))))
    kept = let(keys, lambda ks: let(again(ks), lambda twice: F.filter("fragments", lambda x, i: F.array_contains(twice, F.get(ks, i)))))
    return arrays.select("doc_id", kept.alias("fragments"))


def exact_duplicates(frags: DataFrame) -> DataFrame:
    """doc_id, key, occurrences, text, fragment_indexes, section_titles of what a document says more than once."""
    keyed = frags.where("NOT is_heading").withColumn("key", formulation_key(F.col("collapsed"))).where("key != ''")
    grouped = keyed.groupBy("doc_id", "key").agg(
        F.count("*").alias("occurrences"), F.min(F.struct("frag_idx", "frag"))["frag"].alias("text"), F.array_sort(F.collect_set("frag_idx")).alias("fragment_indexes"), F.array_sort(F.collect_set("section_title")).alias("section_titles")
    )
    return grouped.where("occurrences > 1")


_PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("jaccard", T.DoubleType()), T.StructField("sequence", T.DoubleType())]))
_WORD = re.compile(r"\w+")


def pairs_of(collapsed: Sequence[str], keys: Sequence[str]) -> list[tuple[int, int, float, float]]:
    """(i, j, jaccard, sequence) of the pairs i < j of different formulations of one document, at the first occurrence
    of each, whose word sets' Jaccard similarity is at least the relaxed threshold; in the order of i and j.

    Only sets that share a word within their prefixes, rarest first, are compared."""
    firsts: dict[str, int] = {}
    for i, k in enumerate(keys):
        firsts.setdefault(k, i)
    sets = {i: w for i in firsts.values() if len(w := set(_WORD.findall(collapsed[i]))) >= MIN_TOKENS}
    frequency = Counter(w for words in sets.values() for w in words)
    holders: dict[str, list[int]] = {}
    out = []
    for j, words in sets.items():
        n = len(words)
        prefix = sorted(words, key=lambda w: (frequency[w], w))[: n - math.ceil(n * NEAR_RELAXED - 1e-9) + 1]
        for i in sorted({i for w in prefix for i in holders.get(w, ())}):
            shared = len(words & sets[i])
            jaccard = shared / (n + len(sets[i]) - shared)
            if shared >= MIN_SHARED and jaccard >= NEAR_RELAXED:
                out.append((i, j, jaccard, SequenceMatcher(None, keys[i], keys[j]).ratio()))
        for w in prefix:
            if frequency[w] > 1:
                holders.setdefault(w, []).append(j)
    return sorted(out)


@F.arrow_udf(_PAIRS)
def _pairs(collapsed: pa.Array, keys: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("jaccard", pa.float64()), ("sequence", pa.float64())]))
    return in_pieces(lambda *rows: [[dict(zip(("i", "j", "jaccard", "sequence"), p)) for p in pairs_of(c, k)] for c, k in zip(*rows)], kind, collapsed, keys)


def near_pairs(arrays: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, key_a, key_b, jaccard, sequence of the pairs of pairs_of(), in document order.

    arrays are fragment_arrays(): a document's fragments are in its row, so nothing is shuffled."""
    of = lambda ks: F.transform("fragments", lambda x, i: F.struct(x["frag"].alias("frag"), x["collapsed"].alias("collapsed"), F.get(ks, i).alias("key")))
    keyed = F.filter(let(_keys(arrays), of), lambda x: x["key"] != "")
    rows = arrays.select("doc_id", keyed.alias("x"))
    found = rows.withColumn("p", exploded(_pairs("x.collapsed", "x.key"))).where("p IS NOT NULL")
    a, b = F.get("x", F.col("p.i")), F.get("x", F.col("p.j"))
    return found.select("doc_id", a["frag"].alias("text_a"), b["frag"].alias("text_b"), a["key"].alias("key_a"), b["key"].alias("key_b"), "p.jaccard", "p.sequence")


def near_duplicates(arrays: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, similarity of the pairs that are near by words, or by words and sequence."""
    near = near_pairs(arrays).where((F.col("jaccard") >= NEAR) | (F.col("sequence") >= NEAR_SEQUENCE))
    return near.select("doc_id", "text_a", "text_b", F.round(F.greatest("jaccard", "sequence"), 3).alias("similarity"))
