"""The documents that the checks run on, and their blocks and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.sources.tables import delivered_once, table

# Lines put before the blocks of a document, so that every rule has hits and misses: (condition on
# doc_id, text), both plain SQL expressions.
LINES: list[tuple[str, str]] = [
    ("doc_id % 9 = 0", "'Система должна обеспечивать хранение копий в течение указанного срока.'"),
    ("doc_id % 3 < 2", "'1. Введение'"),
    ("doc_id % 2 = 0", "'Документ предназначен для описания работ. Модуль должен работать быстро и качественно при любой нагрузке.'"),
    ("doc_id % 11 = 0", "'ТРЕБОВАНИЯ К БЕЗОПАСНОСТИ'"),
    ("doc_id % 5 < 3", "'2. Область применения'"),
    ("doc_id % 4 < 3", "'3. Функциональные требования'"),
    ("doc_id % 4 = 0", "'3.1 Требования к отчётам'"),
    ("doc_id % 8 = 0", "'3.1.1 Состав отчёта'"),
    ("doc_id % 4 < 2", "concat('Сервис обязан обрабатывать не менее ', CAST(doc_id % 97 + 1 AS VARCHAR(10)), ' запросов в секунду без задержек.')"),
    ("doc_id % 5 = 0", "'Интерфейс должен быть удобным и понятным для каждого оператора смены.'"),
    ("doc_id % 7 = 1", "'Период обновления должен составлять 15 единиц при полной загрузке узла.'"),
    ("doc_id % 7 = 2", "'Скорость следует указывать в Мбит/с для каждого канала связи.'"),
    ("doc_id % 7 = 3", "'Время отклика не должно превышать 2с при обычной нагрузке на канал.'"),
    ("doc_id % 13 = 0", "'2.5 мм составляет толщина защитной пластины шкафа.'"),
    ("doc_id % 5 < 3", "'Шлюз должен обеспечивать возможность записи. Есть возможность повтора при необходимости.'"),
    ("doc_id % 2 = 1", "'Техническое задание описывает работы, а ТЗ согласует заказчик.'"),
    ("doc_id % 3 = 0", "'Надёжность и надежность оценивает комиссия; рис. и рисунок даны отдельно.'"),
    ("doc_id % 3 > 0", "concat('На рисунке ', CAST(doc_id % 7 + 1 AS VARCHAR(10)), ' показан узел, см. также рис. ', CAST(doc_id % 4 + 1 AS VARCHAR(10)), ' и таблицу ', CAST(doc_id % 6 + 1 AS VARCHAR(10)), '.')"),
    ("doc_id % 7 < 6", "concat('Рисунок ', CAST(doc_id % 5 + 1 AS VARCHAR(10)), ' Общий вид узла')"),
    ("doc_id % 6 = 0", "concat('Рисунок ', CAST(doc_id % 5 + 1 AS VARCHAR(10)), ' Вид сбоку')"),
    ("doc_id % 2 = 0", "concat('Рис. ', CAST(doc_id % 5 + 4 AS VARCHAR(10)), ' Схема')"),
    ("doc_id % 7 < 5", "concat('Таблица ', CAST(doc_id % 4 + 1 AS VARCHAR(10)), ' Состав работ')"),
    ("doc_id % 4 = 1", "concat('Таблица ', CAST(doc_id % 4 + 5 AS VARCHAR(10)), ' Перечень')"),
    ("doc_id % 3 = 0", "'Порядок дан в приложении Б и приложении 2, см. приложение Г.'"),
    ("doc_id % 2 = 0", "'Приложение А Формы'"),
    ("doc_id % 4 < 2", "'Приложение Г Схемы'"),
    ("doc_id % 5 = 0", "'Приложение 1 Акты'"),
    ("doc_id % 5 < 2", "'Приложение 4 Бланки'"),
    ("doc_id % 12 = 0", "'Приложение к договору хранится отдельно.'"),
    ("doc_id % 10 = 0", "'Приложения к письмам и приложения В перечислены ниже.'"),
    ("doc_id % 8 = 0", "'Оператор обязан проверить журнал событий перед началом каждой смены. Оператор обязан проверить журнал событий перед началом каждой смены!'"),
    ("doc_id % 8 = 1", "'Ниже даны правила смены. Дежурный инженер обязан сверять показания всех датчиков перед началом смены. Перед началом смены дежурный инженер обязан сверять показания всех датчиков.'"),
    ("doc_id % 6 = 2", "'4. Порядок приёмки'"),
    ("doc_id % 3 = 1", "'Список литературы'"),
]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, blocks: every unified document once, with the lines of LINES put before its blocks."""
    docs = delivered_once(table(spark, sf_dir, "unified_document").where("blocks IS NOT NULL"), ["doc_id"])
    lines = "filter(array(" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in LINES) + "), x -> x IS NOT NULL)"
    return docs.select("doc_id", "kind", F.concat(F.expr(lines), F.col("blocks")).alias("blocks"))


CORPUS_SQL = (
    "docs AS (SELECT doc_id, any_value(kind) AS kind, any_value(blocks) AS b FROM unified_document WHERE blocks IS NOT NULL GROUP BY doc_id), "
    "corpus AS (SELECT doc_id, kind, list_concat(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in LINES) + "], lambda x: x IS NOT NULL), b) AS blocks FROM docs)"
)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, block_index, line_index, line: every line of every block."""
    blocks = docs.select("doc_id", F.posexplode("blocks").alias("block_index", "block"))
    return blocks.select("doc_id", "block_index", F.posexplode(F.split("block", "\n", -1)).alias("line_index", "line"))
