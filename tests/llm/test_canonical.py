import unicodedata

from specmill.llm.canonical import canonical_texts, inconsistent, repaired


def test_repaired_words():
    assert repaired("телемeтpии") == "телеметрии"
    assert repaired("й") == "й" and repaired("LР-１２") == "LP-12"
    assert repaired("па​р­а") == "пара"
    assert repaired("Wäge") == unicodedata.normalize("NFC", "Wäge")


def test_inconsistent_and_canonical(spark):
    texts = [
        "Контроль давления", "Кoнтроль давления", "Контроль давления", "Контрол​ь давления", "", None, "适配器NX-7、２", "№ 5 ° × −", "  Контроль   давления ", "Tür offen", "Tür offen",
        "COM-порт", "й", "й", "हिन्दी", "слово " * 20000 + "пoследнее",
    ]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(1, texts[1], "x", "y")], "id long, t string, word string, canonical string")
    found = sorted(r["id"] for r in inconsistent(rows, ["id"], "t").collect())
    assert found == [1, 2, 3, 6, 9, 13, 15]
    canon = {r["id"]: r["canonical"] for r in canonical_texts(rows.drop("word", "canonical"), ["id"], "t").collect()}
    assert canon[0] == canon[1] == canon[2] == canon[3] == canon[8] == "Контроль давления"
    assert canon[5] is None and canon[4] == "" and canon[9] == canon[10] and canon[12] == canon[13]
    assert inconsistent(rows.where("false"), ["id"], "t").count() == 0


def test_mixed_words_that_cannot_be_repaired_are_reported(spark):
    rows = spark.createDataFrame([(1, "koмплект"), (2, "moнтaжные работы"), (3, "kалeндарный план"), (4, "комплект kit"), (5, "x̂")], "id int, t string")
    assert sorted(r["id"] for r in inconsistent(rows, ["id"], "t").collect()) == [1, 2, 3]


def test_consistent_words_stay_as_they_are(spark):
    english = "a valve is a part of c and i see B. before A or O"
    texts = [(1, english), (2, "а и в с о А В О " * 30), (3, "a\u200b valve"), (4, "а\u00ad и"), (5, "вaл и х"), (6, "Οδός Α")]
    canon = {r["id"]: r["canonical"] for r in canonical_texts(spark.createDataFrame(texts, "id int, t string"), ["id"], "t").collect()}
    assert canon[1] == english and canon[2] == texts[1][1].strip() and canon[6] == "Οδός Α"
    # what isn't consistent stays in its alphabet
    assert canon[3] == "a valve" and canon[4] == "а и" and canon[5] == "вал и х"
