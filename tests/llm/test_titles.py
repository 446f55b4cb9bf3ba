import re

from pyspark.sql import functions as F

from specmill.llm.titles import assign_titles, match_titles, neighbourhood, osa, title_tokens
from specmill.session import broadcast_if_small, cut

REFERENCE = [("terms", "Термины и сокращения", ["Словарь терминов"]), ("packaging", "Маркировка и упаковка", ["Тара и этикетки"]), ("schedule", "Календарный план работ", None)]


def test_osa_distance():
    assert [osa("термины", w, 2) for w in ("термины", "темрины", "терминыы", "трмин", "смета")] == [0, 1, 1, 2, 3]
    assert "трмины" in neighbourhood("термины", 1)


def test_tokens_of_odd_titles():
    assert title_tokens("Раздел 14. ТАРА / этикетки ........ 27") == ["тара", "этикетки"]
    assert title_tokens("Т а р а   и   э т и к е т к и") == ["тара", "и", "этикетки"]
    assert title_tokens("11.3 Календ. плaн рабoт, часть 2") == ["календ.", "план", "работ"]
    assert title_tokens("архи- вирование") == ["архивирование"]


def test_match(spark):
    titles = ["1. Терминны и сокрщаения", "словартерминов", "Slovar terminov", "Маркир. и упак.", "ЭТИКЕТКИ И ТАРА", "Календарный- план работ", "Рецензия эксперта", "", "  ", None, "???", "Тара и этикетки", "Annex 7"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)] + [(0, titles[0], "x")], "id long, title string, entry string")
    reference = spark.createDataFrame(REFERENCE, "k string, title string, aliases array<string>")
    matches = match_titles(rows, "title", reference, "k", "title", "aliases")
    got = {r["id"]: r["entry"] for r in assign_titles(rows.drop("entry"), ["id"], "title", matches).collect()}
    assert got == {0: "terms", 1: "terms", 2: "terms", 3: "packaging", 4: "packaging", 5: "schedule", 6: "unmatched", 10: "unmatched", 11: "packaging", 12: "unmatched"}


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "Тара")], "id long, title string")
    reference = spark.createDataFrame([], "k string, title string, aliases array<string>")
    assert [r["entry"] for r in match_titles(rows, "title", reference, "k", "title", "aliases").collect()] == ["unmatched"]
    full = spark.createDataFrame(REFERENCE, "k string, title string, aliases array<string>")
    assert match_titles(rows.where("false"), "title", full, "k", "title", "aliases").count() == 0


def test_a_hot_title_and_a_long_one(spark):
    rows = spark.createDataFrame([(i, "Словарь терминов" if i % 3 else "слово " * 2000) for i in range(300)], "id long, title string")
    reference = spark.createDataFrame(REFERENCE, "k string, title string, aliases array<string>")
    got = assign_titles(rows, ["id"], "title", match_titles(rows, "title", reference, "k", "title", "aliases")).groupBy("entry").count().collect()
    assert {r["entry"]: r["count"] for r in got} == {"terms": 200, "unmatched": 100}


def test_hot_titles_are_spread(spark):
    rows = spark.createDataFrame([(i, "Введение" if i % 3 else f"раздел {i}") for i in range(60)] + [(60, None), (61, " ")], "id int, t string")
    matches = spark.createDataFrame([("Введение", "introduction")] + [(f"раздел {i}", "unmatched") for i in range(0, 60, 3)], "value string, entry string")
    small, salted = (assign_titles(rows, ["id"], "t", matches, max_broadcast_rows=n).collect() for n in (1000, 0))
    assert sorted(small) == sorted(salted) and len(small) == 60 and sum(r["entry"] == "introduction" for r in small) == 40


def test_broadcast_is_bounded_for_the_driver(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("заголовок"), F.col("id").cast("string")).alias("a"), F.col("id").cast("string").alias("b"))
    assert broadcast_if_small(rows, 1_000_000) is rows  # 8 MB and more, so the join shuffles
    assert broadcast_if_small(few := rows.limit(100), 1_000_000) is not few


def test_matches_and_repaired_tokens_are_broadcast_only_within_the_bounds(spark):
    rows = cut(spark.createDataFrame([(i, f"Тара и этикетки {i}") for i in range(30)], "id long, t string"))
    reference = spark.createDataFrame(REFERENCE, "k string, title string, aliases array<string>")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    matches = match_titles(rows, "t", reference, "k", "title", "aliases", max_broadcast_rows=0)
    joins = re.findall(r"(\w+Join) \[(\w+)#", plan(matches))
    assert {j for j, key in joins if key == "word"} == {"SortMergeJoin"}  # the files of repaired tokens and of words are small, not their rows
    assert re.findall(r"(\w+Join) \[value", plan(assign_titles(rows, ["id"], "t", matches, max_broadcast_rows=0))) == ["SortMergeJoin"]
    assert "SortMergeJoin [value" not in plan(assign_titles(rows, ["id"], "t", matches))
