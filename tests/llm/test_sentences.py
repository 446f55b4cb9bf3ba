import pytest

from specmill.llm.sentences import candidates, sentence_ends, split_sentences, train

CORPUS = [
    "Датчик проверяет журнал станции. Узел принимает перечень проб.\nПульт обновляет отчёт. Что делать? Внимание!\n\nВес не более 5 г.",
    "В 2016 г. завод заменил насос. Схему согласует инж. В. М. Щукарёв. Монтаж окончен в 2014 г. Планировщик готов.\n\nКонец.",
] * 20


@pytest.fixture(scope="module")
def weights():
    return train(CORPUS)


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("Узел готов. Пульт\nмолчит.", ["Узел готов.", " Пульт\nмолчит."]),
        ("В 2016 г. ООО «Сто» заменило узел. Монтаж окончен в 2014 г. Готово.", ["В 2016 г. ООО «Сто» заменило узел.", " Монтаж окончен в 2014 г.", " Готово."]),
        ("Табло гласит: «Ждите. Идёт пуск!». Далее.", ["Табло гласит: «Ждите. Идёт пуск!».", " Далее."]),
        ("Вопрос «Кто отвечает?» решает руководитель.", ["Вопрос «Кто отвечает?» решает руководитель."]),
        ("Состав:\n- один\n- два;\n1) три.", ["Состав:", "\n- один", "\n- два;", "\n1) три."]),
        ("Схему согласует инж. В. М. Щукарёв на ул. Труб, д. 5. Да.", ["Схему согласует инж. В. М. Щукарёв на ул. Труб, д. 5.", " Да."]),
        ("Лампы и т. п. Порог — до 27 В. Узел.", ["Лампы и т. п.", " Порог — до 27 В.", " Узел."]),
        ("谁负责？面板不超过0.4米。屏幕显示“满！是否？”，直到应答。", ["谁负责？", "面板不超过0.4米。", "屏幕显示“满！是否？”，直到应答。"]),
        ("ดูรูปที่38 ก่อนย้าย\nตู้ระบายน้ำ", ["ดูรูปที่38", " ก่อนย้าย", "\nตู้ระบายน้ำ"]),
        ("Dr. Oak prüft Nr. 42 am 18. März. Ende.", ["Dr. Oak prüft Nr. 42 am 18. März.", " Ende."]),
        ("без точки", ["без точки"]),
        ("  \n ", []),
        ("", []),
    ],
)
def test_sentences(text, sentences, weights):
    ends = sentence_ends(text, weights)
    starts = [0, *ends[:-1]]
    assert [text[a:b] for a, b in zip(starts, ends)] == sentences


def test_held_out_agreement_with_reliable_boundaries():
    model = train(CORPUS[:30])
    held = [c for t in CORPUS[30:] for c in candidates(t) if c.label is not None and c.features]
    right = sum((sum(model.get(f, 0.0) for f in c.features) > 0) == bool(c.label) for c in held)
    assert right / len(held) >= 0.97


def test_operator(spark, weights):
    rows = spark.createDataFrame([(1, "Раз. Два."), (1, "Раз. Два."), (2, None), (3, ""), (4, "слово " * 30000 + ". Конец.")], "id long, sent_end string")
    got = [(r["id"], r["sent_end"]) for r in split_sentences(rows, ["id"], "sent_end", weights).collect()]
    assert sorted(got)[:4] == [(1, 4), (1, 4), (1, 9), (1, 9)] and len(got) == 6
    assert split_sentences(rows.where("false"), ["id"], "sent_end").count() == 0
