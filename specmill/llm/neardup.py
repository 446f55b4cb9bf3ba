"""Near-duplicate records: a similarity join on sets of word n-grams.

Records with the same set form one class, of which one member takes part. The n-grams of a class are
put in a global order, rarest first, by a count sketch of all records. Two sets of the wanted
Jaccard similarity share an n-gram within their prefixes, so classes are joined on these only, the
rows of a hot n-gram in blocks; pairs pass a length and a positional filter, and each pair left is
verified once, after a suffix filter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.session import broadcast_if_small, cut

#: The sketch has at least twice as many counters as there are n-grams, up to 2**SKETCH_BITS.
SKETCH_BITS = 27
BLOCK_BITS = 16
PARITY_WORDS = 2
#: Counts up to EXACT are kept as they are, greater ones as a power of STEP.
EXACT, STEP = 200, 1.25
#: The rows of an n-gram are joined in blocks of about so many.
HOT_BLOCK = 2000
_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hasher:
    """64-bit hashes of word n-grams; keeps the hashes of the words that it has met, up to a bound."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def ngrams(self, text: str, n: int, space: int) -> np.ndarray:
        """The distinct n-grams of a text, sorted; space keeps different kinds of records apart."""
        words = _WORD.findall(text.lower())
        if len(words) < n:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words) - known.keys():
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        ids = np.array([known[w] for w in words], dtype=np.uint64)
        count = len(ids) - n + 1
        h = np.full(count, np.uint64(space * 2 + 1) * _C)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h ^ ids[i : i + count]) * _A
                h ^= h >> np.uint64(29)
            h *= _B
        return np.unique(h ^ (h >> np.uint64(32)))


def least_overlap(a: int, b: int, threshold: float) -> int:
    """How many n-grams two sets of these sizes must share."""
    return int(np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9))


def prefix_length(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def suffix_bound(a: np.ndarray, b: np.ndarray, most: int, depth: int = 2) -> int:
    """A lower bound of the Hamming distance of two sorted sets, by splitting at the middle of one."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    hit = i < len(a) and a[i] == pivot
    split = abs(i - j) + abs((len(a) - i - hit) - (len(b) - j - 1)) + (not hit)
    if split > most:
        return split
    return suffix_bound(a[:i], b[:j], most, depth - 1) + suffix_bound(a[i + hit :], b[j + 1 :], most, depth - 1) + (not hit)


def _sets(texts: DataFrame, keys: Sequence[str], text: str, kind: str, n: int) -> DataFrame:
    """keys, kind, cid, n, grams: the n-gram set of every text that has one; cid names the set."""
    fields = [texts.schema[k] for k in keys] + [T.StructField("kind", T.IntegerType()), T.StructField("cid", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("grams", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            rows, cids, sizes, grams = [], [], [], []
            for i, (t, k) in enumerate(zip(batch.column("t").to_pylist(), batch.column("kind").to_pylist())):
                g = hasher.ngrams(t, n, k)
                if len(g):
                    data = g.tobytes()
                    rows.append(i)
                    cids.append(hashlib.blake2b(data, digest_size=16).digest())
                    sizes.append(len(g))
                    grams.append(data)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(at) for i in range(len(keys))] + [batch.column("kind").take(at), pa.array(cids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())],
                [*keys, "kind", "cid", "n", "grams"],
            )

    picked = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(kind).cast("int").alias("kind"), F.col(text).alias("t"))
    return picked.where("t is not null").mapInArrow(run, T.StructType(fields))


def sketch_bits(ngrams: int, most: int = SKETCH_BITS) -> int:
    return min(most, max(8, (2 * ngrams).bit_length()))


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to EXACT, then by the logarithm."""
    with np.errstate(divide="ignore"):
        above = EXACT + np.floor(np.log(counts / EXACT) / np.log(STEP))
    return np.where(counts <= EXACT, counts, np.minimum(above, 255)).astype(np.uint8)


def count_of(code: np.ndarray) -> np.ndarray:
    """The count that a byte of the sketch stands for, rounded down."""
    code = code.astype(np.int64)
    return np.where(code <= EXACT, code, (EXACT * STEP ** np.maximum(code - EXACT, 0)).astype(np.int64))


def _sketch(sets: DataFrame, bits: int) -> np.ndarray:
    """How many sets have an n-gram of each of 2**bits hash buckets, counted over all sets, in the code of _coded().

    Its size is bounded: blocks of counts are summed by the executors and only the sums come to the driver."""
    mask, block = np.uint64((1 << bits) - 1), 1 << min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                data = b"".join(batch.column("grams").slice(a, 2000).to_pylist())
                at, n = np.unique((np.frombuffer(data, np.uint64) & mask).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535).astype(np.uint16)
        parts = counts.reshape(-1, block)
        used = np.flatnonzero(parts.any(axis=1))
        for a in range(0, len(used), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used[a : a + 64], pa.int32()), pa.array([_packed(parts[i]) for i in used[a : a + 64]], pa.binary())], ["block", "counts"]
            )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(block, np.int64)
        for c in pdf["counts"]:
            out += _unpacked(c, block)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(_coded(out).tobytes(), 1)]})

    schema = "block int, counts binary"
    sketch = np.zeros((1 << bits) // block * block, np.uint8).reshape(-1, block)
    for r in sets.select("grams").mapInArrow(count, schema).groupBy("block").applyInPandas(total, schema).toLocalIterator():
        sketch[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return sketch.reshape(-1)


def _packed(counts: np.ndarray) -> bytes:
    """The low bytes of the counts, then the high bytes where there are any, compressed."""
    high = (counts >> 8).astype(np.uint8)
    return zlib.compress(counts.astype(np.uint8).tobytes() + (high.tobytes() if high.any() else b""), 1)


def _unpacked(data: bytes, block: int) -> np.ndarray:
    halves = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, block).astype(np.int64)
    return halves[0] + (halves[1] << 8 if len(halves) > 1 else 0)


def _prefixes(classes: DataFrame, sketch: np.ndarray, threshold: float, hot_block: int, hot: bool) -> DataFrame:
    """gram, id, at, p0 ...: the prefix n-grams of each class in the global order, rarest first; at holds the set's
    size and the n-gram's position. hot: only those of n-grams that more than hot_block sets may have, with the
    number of blocks in which their rows are joined; else all others.

    N-grams whose bucket counts one set are in no other set and are left out. p0 ... hold, for each of a fixed
    number of parts of the set, whether the part's size is odd: two sets differ by at least as many
    n-grams as these bits do, which is the suffix filter before the pairs are shuffled."""
    shared = classes.sparkSession.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1))
    mask = np.uint64(len(sketch) - 1)
    limits = count_of(np.arange(256, dtype=np.uint8))
    names = ["gram", "id", "at", *[f"p{k}" for k in range(PARITY_WORDS)], *(["blocks"] if hot else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            grams, rows, places, blocks, parities = [], [], [], [], []
            for i, data in enumerate(batch.column("grams").to_pylist()):
                g = np.frombuffer(data, np.uint64)
                c = codes[(g & mask).astype(np.int64)]
                order = np.lexsort((g, c))[: prefix_length(len(g), threshold)]
                held = limits[c[order]]
                pos = np.flatnonzero(held > hot_block if hot else (held > 1) & (held <= hot_block))
                if not len(pos):
                    continue
                grams.append(g[order[pos]])
                places.append(len(g) << 32 | pos)
                blocks.append(1 + held[pos] // hot_block)
                rows.append(np.full(len(pos), i))
                odd = np.bincount((g >> np.uint64(40)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
                parities.append(np.broadcast_to(np.packbits(odd.astype(np.uint8)).view(np.int64), (len(pos), PARITY_WORDS)))
            if not grams:
                continue
            at = pa.array(np.concatenate(rows), pa.int64())
            words = np.concatenate(parities)
            out = [pa.array(np.concatenate(grams).view(np.int64), pa.int64()), batch.column("id").take(at), pa.array(np.concatenate(places), pa.int64())]
            out += [pa.array(np.ascontiguousarray(words[:, k]), pa.int64()) for k in range(PARITY_WORDS)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(blocks), pa.int64())] if hot else out, names)

    return classes.select("id", "n", "grams").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _met(a: DataFrame, b: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """a, b, over of the rows of two sets with an n-gram in common that pass the filters; over is by how much
    what is left of the sets behind it exceeds the needed overlap."""
    parity = [f"p{k}" for k in range(PARITY_WORDS)]
    named = lambda df, x: df.select(*on, F.col("id").alias(x), F.col("at").alias(f"at_{x}"), *[F.col(p).alias(f"{x}{p}") for p in parity])
    met = named(a, "a").join(named(b, "b"), on).where("a < b")
    low = F.lit((1 << 32) - 1)
    na, nb, pa_, pb = F.shiftright("at_a", 32), F.shiftright("at_b", 32), F.col("at_a").bitwiseAND(low), F.col("at_b").bitwiseAND(low)
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-9)
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in parity), F.lit(0))
    met = met.where((F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - 1e-9) & (apart <= na + nb - 2 * need))
    # no later shared n-gram can do what the first can't: the rest of either set bounds the overlap
    rest = 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return met.where(rest + F.least(pa_, pb) >= need).select("a", "b", (rest - need).cast("int").alias("over"))


def _candidates(classes: DataFrame, sketch: np.ndarray, threshold: float, hot_block: int) -> DataFrame:
    """a, b of the pairs of sets that share a prefix n-gram and pass the filters at the first one they share.

    The rows of a hot n-gram stand in one of its blocks as a, and in all of them as b, so that two rows meet
    once, and no task holds all pairs of a hot n-gram. The others' rows are shuffled once for both sides."""
    cold = _prefixes(classes, sketch, threshold, hot_block, False)
    met = _met(cold, cold, ["gram"], threshold)
    if count_of(sketch.max(initial=0)) > hot_block:
        hot = cut(_prefixes(classes, sketch, threshold, hot_block, True))
        one = hot.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        every = hot.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.unionByName(_met(one, every, ["gram", "block"], threshold))
    # behind the first shared n-gram the rest is the greatest
    return met.groupBy("a", "b").agg(F.max("over").alias("over")).where("over >= 0").select("a", "b")


def _verified(threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist())):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = least_overlap(len(a), len(b), threshold)
                most = len(a) + len(b) - 2 * need
                if suffix_bound(a, b, most) <= most and len(np.intersect1d(a, b, assume_unique=True)) >= need:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return run


def near_duplicate_classes(texts: DataFrame, keys: Sequence[str], text: str, kind: str, n: int = 5, threshold: float = 0.8, bits: int | None = None, max_broadcast_rows: int = 300_000, hot_block: int = HOT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: keys, __cid and __digest, once per key; __cid names the record's set of n-grams within
    this run, __digest in every run. links: the cids a < b of the classes of one kind whose sets' Jaccard similarity
    reaches the threshold.

    Null texts and texts of fewer than n words belong to no class. Keys that occur twice with
    the same text count once. No link between different sets is lost, and no pairs are formed within a class.
    bits: the sketch's size, by default from the number of n-grams."""
    own = [f"__key{i}" for i in range(len(keys))]  # names that none of the frames below has
    picked = texts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(text).alias("__text"), F.col(kind).alias("__kind"))
    sets = cut(_sets(picked, own, "__text", "__kind", n).withColumn("rid", F.monotonically_increasing_id()))
    several = cut(sets.groupBy("cid").agg(F.min("rid").alias("first"), F.count("*").alias("size")).where("size > 1").select("cid", "first"))
    named = sets.join(broadcast_if_small(several, max_broadcast_rows), "cid", "left").withColumn("id", F.coalesce("first", "rid"))
    members = named.select(*own, F.col("id").alias("__cid"), F.col("cid").alias("__digest")).distinct()
    classes = named.where("id = rid").select("id", "n", "grams")
    ngrams = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sketch = _sketch(classes, sketch_bits(ngrams) if bits is None else bits)
    candidates = cut(_candidates(classes, sketch, threshold, hot_block))
    wanted = cut(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    fetched = classes.join(broadcast_if_small(wanted, max_broadcast_rows), "id", "left_semi").select("id", "grams")
    # the sets are shuffled once by id and read twice; each pair takes the set of its b along to its a
    b_known = candidates.join(fetched.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    both = b_known.join(fetched.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    return members.toDF(*keys, "__cid", "__digest"), both.select("a", "b", "grams_a", "grams_b").mapInArrow(_verified(threshold), "a bigint, b bigint")


def near_duplicate_pairs(texts: DataFrame, keys: Sequence[str], text: str, kind: str, n: int = 5, threshold: float = 0.8, bits: int | None = None, hot_block: int = HOT_BLOCK) -> DataFrame:
    """All pairs of records of one kind that are near-duplicates, with keys suffixed _a and _b, the
    smaller first: the links between classes spelled out over their members, and the members of one class."""
    members, links = near_duplicate_classes(texts, keys, text, kind, n, threshold, bits, hot_block=hot_block)
    members = cut(members)
    a = members.select(F.struct(*keys).alias("x"), F.col("__cid").alias("a"))
    b = members.select(F.struct(*keys).alias("y"), F.col("__cid").alias("b"))
    several = a.groupBy("a").agg(F.count("*").alias("size")).where("size > 1").select("a")
    alike = a.join(several, "a", "left_semi")
    same = alike.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    across = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    both = same.unionByName(across)
    return both.select(*[F.col(f"x.{k}").alias(f"{k}_a") for k in keys], *[F.col(f"y.{k}").alias(f"{k}_b") for k in keys])


def near_duplicate_groups(texts: DataFrame, keys: Sequence[str], text: str, kind: str, n: int = 5, threshold: float = 0.8, bits: int | None = None, hot_block: int = HOT_BLOCK) -> DataFrame:
    """keys, class_id and links: one row per record in a class, with the number of classes that its own is linked to.

    class_id is the hash of the class's set, so it is the same in every run."""
    members, links = near_duplicate_classes(texts, keys, text, kind, n, threshold, bits, hot_block=hot_block)
    degree = links.select(F.explode(F.array("a", "b")).alias("__cid")).groupBy("__cid").agg(F.count("*").alias("__links"))
    joined = members.join(degree, "__cid", "left")
    return joined.select(*keys, F.lower(F.hex("__digest")).alias("class_id"), F.coalesce("__links", F.lit(0)).alias("links"))
