"""Sources mixed to target weights.

Temperature mixing: the sources' token shares are exponentiated, by 1 - exponent, and tilted to
their targets by the exponent; it is bisected to the largest at which every source stays within its
repetition limit. Sources that have reached theirs are then held and the exponent is bisected again for
the others, until these have their targets among themselves. Without targets the token shares are raised to
a power that is bisected to a target entropy. The normalised weights are realised as budgets: as
many whole permutations (blocks) of a source as its budget holds, each in an order of its own by a keyed
hash, then the start of one more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specmill.session import cut

BUCKET_BITS = 12
#: More listed sources than this are an error, as the list is held by the driver.
MAX_SOURCES = 100_000


def _normalised(logs: Mapping[str, float], total: float = 1.0) -> dict[str, float]:
    top = max(logs.values())
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    norm = sum(raw.values())
    return {s: total * w / norm for s, w in raw.items()}


def tempered(share: Mapping[str, float], target: Mapping[str, float], exponent: float, total: float = 1.0) -> dict[str, float]:
    """Weights share^(1 - exponent) * target^exponent, with this sum, of the sources of target."""
    return _normalised({s: (1 - exponent) * math.log(share[s]) + exponent * math.log(t) for s, t in target.items()}, total)


def entropy(weights: Mapping[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisected(good: Callable[[float], bool]) -> float:
    """An exponent in [0, 1] next to which good() turns false: 1 if it holds there, else between 0, where it is taken to hold, and 1."""
    if good(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def mixing_weights(target: Mapping[str, float], tokens: Mapping[str, int], repeats: Mapping[str, int], total: float | None = None) -> tuple[dict[str, float], dict[str, float], float]:
    """The weights, the exponents at which they were fixed, and the total size.

    total None: the largest size at which the targets are met exactly, all exponents 1. Else the exponent is bisected
    to where the first source would be used more often than it may; that source is held at its limit, and the
    others go on. A total beyond all that may be used is cut to that."""
    limit = {s: float(tokens.get(s, 0) * repeats[s]) for s in target if tokens.get(s, 0) > 0 and repeats[s] > 0 and target[s] > 0}
    if not limit:
        return {}, {}, 0.0
    free = _normalised({s: math.log(target[s]) for s in limit})
    if total is None:
        return free, dict.fromkeys(free, 1.0), min(limit[s] / free[s] for s in free)
    size = min(total, sum(limit.values()))
    weights: dict[str, float] = {}
    exponents: dict[str, float] = {}
    held = {s: float(tokens[s]) for s in limit}
    while free:
        left = 1.0 - sum(weights.values())
        fits = lambda e: all(w * size <= limit[s] * (1 + 1e-9) for s, w in tempered(held, free, e, left).items())  # noqa: B023, E731
        exponent = _bisected(fits)
        now = tempered(held, free, exponent, left)
        if exponent < 1.0:
            over = tempered(held, free, min(1.0, exponent + 1e-9) if fits(0.0) else 0.0, left)
            full = [s for s in free if over[s] * size >= limit[s] * (1 - 1e-6)] or [max(free, key=lambda s: now[s] / limit[s])]
        else:
            full = list(free)
        for s in full:
            weights[s], exponents[s] = min(now[s], limit[s] / size), exponent
            del free[s]
    return weights, exponents, size * sum(weights.values())


def entropy_weights(tokens: Mapping[str, int], repeats: Mapping[str, int], target_entropy: float, total: float | None = None) -> tuple[dict[str, float], dict[str, float], float]:
    """The weights token share^exponent, the exponent, and the total size (None: the tokens of all sources).

    The exponent is the largest in [0, 1] at which the weights have the target entropy, as the entropy falls from that of
    equal weights to that of the shares; where a source would then be used more often than it may, the exponent is
    bisected up to where none is, and the entropy stays below the target."""
    held = {s: math.log(n) for s, n in tokens.items() if n > 0 and repeats.get(s, 0) > 0}
    if not held:
        return {}, {}, 0.0
    size = float(total if total is not None else sum(tokens[s] for s in held))
    of = lambda e: _normalised({s: e * x for s, x in held.items()})
    exponent = _bisected(lambda e: entropy(of(e)) >= target_entropy - 1e-12)
    fits = lambda e: all(w * size <= tokens[s] * repeats[s] * (1 + 1e-9) for s, w in of(e).items())
    if not fits(exponent):
        exponent = 1.0 - _bisected(lambda d: fits(1.0 - d))
    weights = of(exponent)
    return weights, dict.fromkeys(weights, exponent), min(size, min(tokens[s] * repeats[s] / w for s, w in weights.items()))


def mix(records: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total: float | None = None, target_entropy: float | None = None, seed: int = 7, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). uses has one row per use of a record: key, source, tokens, block, place; place is the
    order within a block, another in each. shares has one row per listed source.

    total None: as many tokens as the listed sources have; exact: the largest total at which the targets are met exactly.
    target_entropy: token shares to a power instead of target shares. Records of sources that aren't listed, of
    null sources and of no tokens aren't used; a listed source without records has share 0 and its target
    goes to the others in proportion; a source listed twice has its greatest share and limit, one without a share
    or limit isn't used. Totals per source, and for its last block per range of places, come to the driver: as many rows as there are
    listed sources, times a fixed number. Only the range in which a budget ends is put in order, so
    that a hot source is never collected in one task."""
    spark = records.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeat").where("source is not null").limit(MAX_SOURCES + 1).collect():
        share, most = wanted.get(r["source"], (0.0, 0))
        wanted[r["source"]] = (max(share, r["target_share"] or 0.0), max(most, r["max_repeat"] or 0))
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    sized = records.select(F.col(key).alias("record"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")).where("tokens > 0")
    sized = cut(sized.join(F.broadcast(names), "source", "left_semi"))
    sums = {r["source"]: (r["tokens"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    held, repeats = {s: t for s, (t, _) in sums.items()}, {s: m for s, (_, m) in wanted.items()}
    if target_entropy is not None:
        weights, exponents, size = entropy_weights(held, repeats, target_entropy, total)
    else:
        size = None if exact else float(sum(held.values())) if total is None else total
        weights, exponents, size = mixing_weights({s: t for s, (t, _) in wanted.items()}, held, repeats, size)
    norm = sum(weights.values())
    budgets = {s: size * w / norm for s, w in weights.items()}
    blocks = {s: min(int(b / held[s] + 1e-9), repeats[s]) for s, b in budgets.items()}

    # the last, partial block of each source: whole ranges of places, then the start of one more range
    place = lambda block: F.xxhash64(F.lit(seed), block, F.col("record"))
    # from the least place to the greatest
    ranged = lambda p: (F.shiftright(p, 64 - BUCKET_BITS) + (1 << (BUCKET_BITS - 1))).cast("int")
    counted = F.broadcast(spark.createDataFrame([(s, n) for s, n in blocks.items()], "source string, blocks int"))
    planned = sized.join(counted, "source").withColumn("last", place(F.col("blocks") + 1)).withColumn("bucket", ranged(F.col("last")))
    by_source: dict[str, dict[int, int]] = {}
    for r in planned.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")).collect():
        by_source.setdefault(r["source"], {})[r["bucket"]] = r["tokens"]
    ends = []
    for s, n in blocks.items():
        rest, end = (budgets[s] - n * held[s] if n < repeats[s] else 0.0), 0
        while end < 1 << BUCKET_BITS and by_source[s].get(end, 0) <= rest + 1e-9:
            rest -= by_source[s].get(end, 0)
            end += 1
        ends.append((s, end, max(0.0, rest)))
    planned = planned.join(F.broadcast(spark.createDataFrame(ends, "source string, `end` int, rest double")), "source")
    whole = planned.where("blocks > 0").select("record", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("block"))
    whole = whole.select("record", "source", "tokens", "block", place(F.col("block")).alias("place"))
    last = ["record", "source", "tokens", (F.col("blocks") + 1).alias("block"), F.col("last").alias("place")]
    part = planned.where("bucket < end").select(*last)
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("last", "record").rowsBetween(Window.unboundedPreceding, 0))
    edge = planned.where("bucket = end and rest > 0").withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).select(*last)
    uses = whole.unionByName(part).unionByName(edge)
    used = uses.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("uses"), F.max("block").alias("most_repeats"))
    rows = [(s, t, m, sums.get(s, (0, 0))[1], held.get(s, 0), weights.get(s, 0.0) / (norm or 1.0), exponents.get(s, 1.0)) for s, (t, m) in wanted.items()]
    sources = spark.createDataFrame(rows, "source string, target_share double, max_repeat int, records long, tokens long, weight double, exponent double")
    shares = sources.join(used, "source", "left").fillna(0, ["used_tokens", "uses", "most_repeats"])
    shares = shares.withColumn("all_tokens", F.sum("used_tokens").over(Window.partitionBy()))  # a row for each listed source
    shares = shares.withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")
    return uses.select(F.col("record").alias(key), "source", "tokens", "block", "place"), shares
