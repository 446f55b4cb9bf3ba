from fractions import Fraction

import pytest

from specmill.operators.units import extract_measurements, measurements, parse_unit


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Длительность прогрева ЛЖ-7774 не превышает 1.9 ч.", {("duration", 6_840_000)}),
        ("Тепловыделение шкафа лежит в диапазоне от 96 до 195 МВт.", {("power", 96_000_000_000), ("power", 195_000_000_000)}),
        ("Задержка пакета, мс, ЮЦ-6285: 17.", {("duration", 17)}),
        ("Вес комплекта составляет 9 кг 310 г.", {("mass", 9_310_000)}),
        ("Масса изделия лежит в диапазоне 846...1 695 г.", {("mass", 846_000), ("mass", 1_695_000)}),
        ("Габариты шкафа: 390x640x450 мм.", {("length", 390_000), ("length", 640_000), ("length", 450_000)}),
        ("Потребляемая мощность указана в ваттах: по проекту 33, по факту 44.", {("power", 33_000), ("power", 44_000)}),
        ("Время ответа узла не превышает полутора часов.", {("duration", 5_400_000)}),
        ("Тактовая частота не ниже 4·10^6 Гц.", {("frequency", 4_000_000)}),
        ("Температура корпуса лежит в пределах от −15 до 30 °C.", {("temperature", -15_000), ("temperature", 30_000)}),
        ("The room temperature of X stays within 14 °F.", {("temperature", -10_000)}),
        ("The panel thickness is at most 12,850 inches.", {("length", 326_390_000)}),
        ("Размер вложения должен быть 24 МиБ в двух экземплярах", {("data_size", 24 * 1024**2)}),
        ("Скорость обмена — до 5,53 МБ/с", {("data_rate", 44_240_000)}),
        ("面板厚度（LN-1486）不超过705厘米。", {("length", 7_050_000)}),
        ("Пропускная способность не менее 3\u00ad2 кбит/с", {("data_rate", 32_000)}),
        ("В 2024 г. ООО «Сто Опор» заменило 15 шкафов, цена 243 тыс. руб., лист 345, п. 5.3.7.", set()),
        ("", set()),
    ],
)
def test_measurements(text, expected):
    assert measurements(text) == expected


def test_field_decides_ambiguous_units():
    assert parse_unit("мин", "duration") == ("duration", Fraction(60_000))
    assert parse_unit("В") is None
    assert parse_unit("В", "voltage") == ("voltage", Fraction(1000))
    assert parse_unit("мВт", "power") == ("power", Fraction(1))
    assert parse_unit("МВт", "power") == ("power", Fraction(10**9))


def test_very_long_text_is_read_to_its_end():
    text = "слово " * 50_000 + ". Длина кабеля не менее 7 м."
    assert measurements(text) == {("length", 7_000_000)}


def test_operator_on_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, t string, quantity string, base_value string"
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "Длина 5 м", None, None), (3, "Длина 5 м", None, None), (None, "Масса 2 кг", "x", "y")]
    out = extract_measurements(spark.createDataFrame(rows, schema), "t", ["doc_id"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, "length", 5_000_000), (3, "length", 5_000_000), (None, "mass", 2_000_000)], key=str)
    assert extract_measurements(spark.createDataFrame([], schema), "t", ["doc_id"]).count() == 0


def test_number_words_alone_reach_python(spark):
    texts = ["The valve closes within five minutes.", "Клапан закрывается за пять минут.", "Выдержка два часа", "ПОЛЧАСА", "Выдержка cемь часов", "Без чисел"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r["id"], r["quantity"], r["base_value"]) for r in extract_measurements(rows, "t", ["id"]).collect()}
    assert got == {(i, q, v) for i, t in enumerate(texts) for q, v in measurements(t)}
    assert {i for i, _, _ in got} == {0, 1, 2, 3, 4}


def test_values_beyond_64_bits_stay_and_several_values_of_a_field(spark):
    rows = spark.createDataFrame([(1, "Масса груза 99999999999999999 т")], "id int, t string")
    assert [tuple(r) for r in extract_measurements(rows, "t", ["id"]).collect()] == [(1, "mass", None)]
    assert measurements("Длина кабеля в миллиметрах: по проекту 467, по факту 470, по норме 480") == {("length", 467_000), ("length", 470_000), ("length", 480_000)}
