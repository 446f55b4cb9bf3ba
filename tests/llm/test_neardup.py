import random
import re

import numpy as np
import pytest

from specmill.llm.neardup import _coded, count_of, least_overlap, near_duplicate_groups, near_duplicate_pairs, prefix_length, sketch_bits, suffix_bound


def test_bounds():
    assert least_overlap(10, 10, 0.6) == 8 and prefix_length(10, 0.6) == 5
    a, b = np.array([1, 2, 3, 9], np.uint64), np.array([2, 3, 4, 10], np.uint64)
    assert suffix_bound(a, b, 100) <= 4


def brute(rows, n, t):
    sets = {}
    for i, kind, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sets[i] = (kind, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a][0] == sets[b][0] and sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= t}


def test_sketch_codes():
    counts = np.array([0, 1, 200, 250, 10_000, 10**9])
    back = count_of(_coded(counts))
    assert back[:3].tolist() == [0, 1, 200] and all(0.7 * c <= b <= c for b, c in zip(back[3:5], counts[3:5])) and back[5] > 10**7
    assert sketch_bits(0) == 8 and sketch_bits(1000) == 11 and sketch_bits(10**12) == 27


@pytest.mark.parametrize(("n", "t", "bits", "hot_block"), [(3, 0.6, None, 2000), (3, 0.6, 18, 3), (5, 0.8, 8, 2000), (5, 0.8, None, 1)])
def test_pairs_are_those_of_brute_force(spark, n, t, bits, hot_block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        rows.append((len(rows), i % 2, " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((len(rows), i % 2, " ".join(edited)))
    rows += [(len(rows), 0, None), (len(rows) + 1, 0, ""), (len(rows) + 2, 0, "one two")]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], "id long, kind int, t string, cid string")
    got = {(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(df, ["id"], "t", "kind", n=n, threshold=t, bits=bits, hot_block=hot_block).collect()}
    assert got == brute(rows, n, t) and got


def test_a_hot_group_of_copies_forms_no_pairs(spark):
    copy = " ".join(f"слово{i}" for i in range(40))
    near = copy.replace("слово7", "иное")
    df = spark.createDataFrame([(i, 0, copy) for i in range(500)] + [(1000, 0, near), (1001, 0, "другой текст " * 30)], "id long, kind int, t string")
    rows = near_duplicate_groups(df, ["id"], "t", "kind", n=3, threshold=0.6, bits=16).collect()
    links = {r["id"]: r["links"] for r in rows}
    again = near_duplicate_groups(df.repartition(3), ["id"], "t", "kind", n=3, threshold=0.6).collect()
    assert {r["id"]: r["class_id"] for r in again} == {r["id"]: r["class_id"] for r in rows}
    assert len(rows) == 502 and len({r["class_id"] for r in rows}) == 3 and links[0] == links[499] == links[1000] == 1 and links[1001] == 0


def test_empty(spark):
    df = spark.createDataFrame([], "id long, kind int, t string")
    assert near_duplicate_pairs(df, ["id"], "t", "kind").count() == 0
