import datetime
import random

import pytest

from specmill.llm.personal import feistel, find_personal, lemma, mentions, permuted, permuted_date, person_key, placeholder, pseudonymize


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Вчера Игорь Хвоинский сообщил о задержке.", [("person", "Игорь Хвоинский")]),
        ("Пропуск выписан Вере Юрчаловой, паспорт серии 0081 № 730900.", [("person", "Вере Юрчаловой"), ("id_number", "0081 № 730900")]),
        ("согласует инж. В. М. Щукарёв-Дольный, а не дежурный", [("person", "В. М. Щукарёв-Дольный")]),
        ("Марк Ильич Фонаревич (ИНН: 0041 6011 1835)", [("person", "Марк Ильич Фонаревич"), ("id_number", "0041 6011 1835")]),
        ("звоните 8 (092)252 68 98 или пишите x.y+z@post.example.", [("phone", "8 (092)252 68 98"), ("email", "x.y+z@post.example")]),
        ("p_s [собака] post (точка) example; тел. (073) 709-06-70.", [("email", "p_s [собака] post (точка) example"), ("phone", "(073) 709-06-70")]),
        ("по адресу: 000498, г. Верхнелипск, ул. Старых Мастеров, дом 32, кв. 5.", [("address", "000498, г. Верхнелипск, ул. Старых Мастеров, дом 32, кв. 5")]),
        ("Contact: Wexlowe, Leon, phone +1 037 555 0102.", [("person", "Wexlowe, Leon"), ("phone", "+1 037 555 0102")]),
        ("kept at Flat 18, 51 Copperkettle Street, Upper Tarnby ZZ7 4QX, ask E. Fennimoor.", [("address", "Flat 18, 51 Copperkettle Street, Upper Tarnby ZZ7 4QX"), ("person", "E. Fennimoor")]),
        ("Lieferung an Hopfenallee 7 in 00403 Oberfließ. Dr. Oakhurstle prüft Nr. 20.", [("address", "Hopfenallee 7 in 00403 Oberfließ"), ("person", "Oakhurstle")]),
        ("Изделие 351-96-0181, Сумма 459 688-00, маска 255.255.88.0, @main, 99 на 3 @ 23 per box, г. Тихомельск, филиал им. Сорока Опор", []),
        ("не выше 238,15 К. Сетевая маска. Каталожный номер 200.679.57-189, исх. № 829/47-0877", []),
        ("", []),
    ],
)
def test_mentions(text, expected):
    assert [(k, text[a:b]) for k, a, b in mentions(text)] == expected


def test_feistel_is_a_permutation_within_the_format():
    for size in (10, 97, 1000):
        images = [feistel(x, size, b"k") for x in range(size)]
        assert sorted(images) == list(range(size)) and images != list(range(size))
        assert [feistel(y, size, b"k", backward=True) for y in images] == list(range(size))
    hidden = permuted("0041 6011 1835", b"k")
    assert [len(x) for x in hidden.split(" ")] == [4, 4, 4] and permuted(hidden, b"k", backward=True) == "0041 6011 1835"
    day = datetime.date(1980, 2, 29)
    assert permuted_date(permuted_date(day, b"k"), b"k", backward=True) == day != permuted_date(day, b"k")


@pytest.mark.parametrize("size", [10**4, 10**5, 10**7, 10**10])
def test_feistel_differences_spread_over_the_range(size):
    rng = random.Random(1)
    values = [rng.randrange(size) for _ in range(2000)]
    distinct = len(set(values))
    images = {v: feistel(v, size, b"k") for v in values}
    assert len(set(images.values())) == distinct and all(0 <= y < size for y in images.values())
    assert len({(y - v) % size for v, y in images.items()}) > 0.85 * distinct * (0.9 if size <= 10**4 else 1)
    assert all(feistel(y, size, b"k", backward=True) == v for v, y in list(images.items())[:100])


def _number(placeholder: str) -> str:
    return "".join(c for c in placeholder if c.isdigit())


def test_equal_values_stay_linked_across_formats():
    forms = [placeholder("phone", p, b"k") for p in ("8 (073) 290-99-64", "+70732909964", "(073) 290-99-64", "+7 073 290 99 64")]
    assert len({_number(f)[-9:] for f in forms}) == 1 and "732909964" not in _number(forms[0])
    assert _number(placeholder("phone", "+7 (495) 123-45-67", b"k"))[-7:] != _number(placeholder("phone", "8 812 123-45-67", b"k"))[-7:]
    assert _number(placeholder("phone", "+49 30 1234567", b"k"))[-9:] == _number(placeholder("phone", "030/1234567", b"k"))[-9:]
    assert placeholder("email", "A.B@Post.Example", b"k") == placeholder("email", "a.b [at] post (dot) example", b"k")
    a, b = placeholder("id_number", "AB 0041-18", b"k"), placeholder("id_number", "AB004118", b"k")
    assert [c for c in a[11:] if c.isalnum()] == [c for c in b[11:] if c.isalnum()] and "AB" not in a
    assert placeholder("date", "01.02.1980", b"k")[6:-1].count(".") == 2 and placeholder("date", "01.02.1980", b"k") != placeholder("date", "01.02.1980", b"l")


def test_names_are_linked_by_lemma():
    assert lemma("Хвоинскому") == lemma("Хвоинский") and lemma("Клёновым") == lemma("Кленов") and lemma("Иваном") == lemma("Иван")
    assert person_key("Игорю Хвоинскому") == person_key("Хвоинский Игорь")
    planted = ["Александр Иванов", "Алексей Иванов", "Александр Иваненко", "Александр Ивановский", "А. Иванов", "А. П. Иванов", "Пётр Иванов", "John Smith", "Joan Smith", "J. Smith", "John Smithson"]
    assert len({placeholder("person", p, b"k") for p in planted}) == len(planted)
    assert len(placeholder("person", "А. Иванов", b"k")) >= len("[person:]") + 32


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Смирнов сообщил об аварии.", ["Смирнов"]),
        ("Мухаммед Алиев принял смену.", ["Мухаммед Алиев"]),
        ("Ксенофонт Петров", ["Ксенофонт Петров"]),
        ("Отчёт передан Кузнецову вчера.", ["Кузнецову"]),
        ("Vendor J. Smith delivered it.", ["J. Smith"]),
        ("It was signed by Deepak Sharma and the clerk.", ["Deepak Sharma"]),
        ("Станок перевезён из Саратова на ул. Петрова, завод им. Королёва. Магазин закрыл двери.", []),
        ("stays below 80 K. The panel, cf. App. B. Who signs? The parts from Upper Tarnby and the rest.", []),
    ],
)
def test_names_of_no_list(text, names):
    assert [text[a:b] for k, a, b in mentions(text) if k == "person"] == names


def test_names_off_the_lists_are_recalled():
    rng = random.Random(2)
    stems = ["".join(rng.choice(["ба", "ро", "ме", "ку", "лы", "тор", "зан", "вер", "щи", "пел"]) for _ in range(rng.randint(2, 3))) for _ in range(200)]
    texts = [f"Акт подписал {s.capitalize()}{e}, копия у мастера." for s, e in zip(stems, ["ов", "ев", "ин", "ский", "енко"] * 40)]
    found = sum([t[a:b] for k, a, b in mentions(t) if k == "person"] == [t.split(" ")[2].rstrip(",")] for t in texts)
    assert found / len(texts) >= 0.99


def test_dates_of_persons_are_permuted():
    text = "Мастер, дата рождения: 12.03.1980, принят 01.02.2020."
    assert [(k, text[a:b]) for k, a, b in mentions(text)] == [("date", "12.03.1980")]


def test_operator(spark):
    text = "Вчера Игорь Хвоинский сообщил."
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "слово " * 30000 + "почта a@b.example", "x")], "id long, t string, kind string")
    got = sorted((r["id"], r["kind"], r["start_pos"], r["end_pos"]) for r in find_personal(rows, "t", ["id"], "k").collect())
    assert got == [(1, "person", 6, 21), (1, "person", 6, 21), (4, "email", 180006, 180017)]
    out = {r["id"]: r["text"] for r in pseudonymize(rows, "t", ["id"], "k").collect()}
    assert out[1].startswith("Вчера [person:") and out[1].endswith("] сообщил.") and out[2] is None and out[3] == ""
    assert find_personal(rows.where("false"), "t", ["id"], "k").count() == 0
