import re

import pytest

from specmill.llm import mojibake
from specmill.llm.mojibake import CHAINS, affected, garbled, restore, ungarbled
from specmill.session import cut

WORDS = "контроль давления насосной станции принимает перечень лабораторных проб без участия оператора каждый вечер"


@pytest.mark.parametrize("chain", [c for c in CHAINS if c[0][0] in ("utf-8", "cp1251", "cp866", "koi8-r")])
def test_chains_round_trip(chain):
    g = garbled(WORDS, chain)
    assert g and (g == WORDS or ungarbled(g, chain) == WORDS)


def test_affected_and_restored(spark):
    clean = [(i, f"{WORDS} {i}") for i in range(12)]
    odd = [(100 + i, "Чистое начало. " + garbled(WORDS, c)) for i, c in enumerate([(("utf-8", "cp1251"),), (("cp1251", "latin-1"),), (("koi8-r", "cp1251"),), (("utf-8", "cp866"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))])]
    decoys = [(200, "Поставщик AÇÃO LESTE и завод «Ђурђица», ÎLE DU PÂTRE, Ñuñolé, Ångrävåg"), (201, None), (202, ""), (203, "来访人员须知 3"), (204, "не отвечает???")]
    lost = [(300, "датчик ����"), (301, garbled("来访人员须知和安全", (("utf-8", "latin-1"),)))]
    rows = spark.createDataFrame([(*r, "x", 1) for r in clean + odd + decoys + lost + odd[:1]], "id long, t string, token string, chain int")
    found = sorted(r["id"] for r in affected(rows, ["id"], "t").collect())
    assert found == [100, 101, 102, 103, 104, 300, 301]
    texts = {r["id"]: r["restored"] for r in restore(rows.drop("token", "chain"), ["id"], "t").collect()}
    assert all(texts[100 + i] == "Чистое начало. " + WORDS for i in range(5))
    assert texts[300] == "датчик ����"
    assert affected(rows.where("false"), ["id"], "t").count() == 0


def test_copies_of_a_garbled_page_do_not_hide_it(spark):
    chain = (("koi8-r", "cp1251"),)
    places = "северного южного верхнего нижнего старого нового".split()
    clean = [(i, f"{p} участка {WORDS} {q}") for i, (p, q) in enumerate((p, q) for p in places for q in places)]
    garbled_page = garbled(WORDS, chain)
    exact = [(100 + i, garbled_page) for i in range(200)]
    near = [(400 + i, f"{garbled_page} {i}") for i in range(200)]
    rows = spark.createDataFrame(clean + exact + near, "id long, t string")
    assert sorted(r["id"] for r in affected(rows, ["id"], "t").collect()) == [r[0] for r in exact + near]
    assert {r["restored"] for r in restore(rows.where("id < 400"), ["id"], "t").collect()} == {WORDS}


def test_words_of_a_line_decide_together(spark):
    chain = (("koi8-r", "cp1251"),)
    words = WORDS.split()
    line = lambda a, n: " ".join([words[a], words[(a + n) % 12], words[(a + 2 * n) % 12]])
    clean = [(i, line(i % 12, 1 + i // 12)) for i in range(36)]
    odd = [(100 + i, garbled(line(i % 12, 4 + i // 12), chain)) for i in range(24)]
    rows = spark.createDataFrame(clean + odd, "id long, t string")
    assert sorted(r["id"] for r in affected(rows, ["id"], "t").collect()) == [r[0] for r in odd]


def test_words_lost_to_question_marks(spark):
    texts = ["Узел готов???", "Что?! Кто?? Да", "Датчик ???????? ?????. Далее", "?????? ????\nдалее", "(????) и", "", None, "???\nДатчик", "с ?? ????. Далее"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert sorted(r["id"] for r in affected(rows, ["id"], "t").collect()) == [2, 3, 4, 8]
    assert {r["id"]: r["restored"] for r in restore(rows, ["id"], "t").collect()}[2] == texts[2]


def test_forms_are_never_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(mojibake, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    mojibake.garbled_words(spark.createDataFrame([(1, WORDS)], "id long, t string"), "t")
    joins = [re.findall(r"\w+Join", p)[0] for p in plans if "MapInPandas" in p]  # the outermost of each plan with forms
    assert joins == ["SortMergeJoin"]  # few words by the size of their file, but many times as many forms
