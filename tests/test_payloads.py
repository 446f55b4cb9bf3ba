"""Payloads and what they are made of: each search once, groups of recurring fragments, payloads read back once."""

from pyspark.sql import functions as F

from specmill.functions.text import WS, collapse
from specmill.operators import checks, duplicates, issues, spans
from specmill.operators.fragments import fragment_arrays, fragments
from specmill.operators.issues import Frames
from specmill.operators.structure import section_arrays
from specmill.rules.tables import OBLIGATION_ROOTS, OBLIGATIONS
from specmill.session import cut
from specmill.sinks import exports


def docs(spark, *blocks):
    return spark.createDataFrame([(i + 1, "docx", list(b)) for i, b in enumerate(blocks)], "doc_id long, kind string, blocks array<string>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_payloads_are_made_from_references_and_sections_found_once(spark, monkeypatch):
    read = []

    def recorded(df):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(issues, "cut", recorded)
    d = docs(spark, ["1. Введение", "Система должна работать быстро.", "Рисунок 1 Вид", "см. рис. 3 и таблицу 2", "Приложение А Формы"], [])
    frames = Frames.of(d, materialize=True)
    assert frames.secs.columns[-1] == "title_key" and "content_text" not in frames.secs.columns
    issues.build_issues(frames)
    assert sum(r"рисунком" in p for p in read) == sum("таблицей" in p for p in read) == sum("приложению" in p for p in read) == 1  # each searched for in one plan
    assert max(p.count("рисунком") for p in read) == 1  # and once within it


def test_only_recurring_fragments_are_grouped(spark):
    d = docs(spark, ["1. Введение", "Ниже даны правила.", "Оператор обязан проверить журнал событий перед началом каждой смены. Оператор обязан проверить журнал событий перед началом каждой смены! Дежурный обязан проверить журнал событий перед началом каждой смены."], ["Оператор обязан проверить журнал событий перед началом каждой смены."], [])
    arrays = fragment_arrays(d)
    kept = duplicates.recurring(arrays)
    assert sorted(r["frag"] for r in fragments(kept).collect()) == ["Оператор обязан проверить журнал событий перед началом каждой смены!", "Оператор обязан проверить журнал событий перед началом каждой смены."]
    whole, own = (duplicates.exact_duplicates(fragments(x)).collect() for x in (arrays, kept))
    assert whole == own and len(own) == 1


def test_payload_fragments_reads_a_payload_once(spark):
    texts = [
        '{"issues": [{"check_key": "a", "severity": "warning", "message": "m", "fragment_text": " ", "te\\u0078t_excerpt": "цитата"}, 5, {"check_key": "b", "metadata": "{\\"text_excerpt\\": \\"x\\"}"}]}',
        '{"issues": []}', '{"issues": null, "report": {"issues": [{"message": {"a": 1}, "metadata": {"source": {"text_excerpt": "s"}}}]}}', None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, payload string")
    out = exports.payload_fragments(df)
    assert sorted(map(tuple, out.collect()), key=str) == [(0, 1, "a", "warning", "m", "цитата"), (0, 2, "b", None, None, None), (2, 1, None, None, '{"a":1}', "s")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1  # else a filter below makes and reads it again


def test_whitespace_runs_and_obligation_roots(spark):
    for text in ("a b  c\t d \u00a0e\u3000\u2003f\n\n g\u1681h", "\u00a0 a \x1c b\u0085", "  ", "a\u2010 \u2028b"):
        assert one(spark, collapse(F.lit(text))) == one(spark, F.trim(F.regexp_replace(F.lit(text), f"{WS}+", " "))), repr(text)
    assert all(any(r in w for r in OBLIGATION_ROOTS) for w in OBLIGATIONS)


def test_group_names_of_payloads_are_made_once(spark):
    d = docs(spark, ["a"])
    none = F.lit(None).cast("string")
    built = d.select("doc_id", F.lit(1).alias("issue_ord"), F.lit(" c ").alias("check_key"), none.alias("severity"), F.lit("m").alias("message"), none.alias("recommendation"))
    made = exports.payloads(issues.report(d, built), built.where("doc_id > 0"))
    plan = made._jdf.queryExecution().analyzed().toString()
    plan = plan[: plan.index("Join")]
    assert plan.count("trim(") == 2  # else the issues are trimmed for each of their groups
    assert '"by_check" : {\n      "c" : [ 1 ]' in made.first()["payload"]


def test_findings_of_sections_and_terms_stay_in_the_row(spark, monkeypatch):
    read = []

    def recorded(df):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(issues, "cut", recorded)
    issues.build_issues(Frames.of(docs(spark, ["1. Введение", "Система должна работать быстро."]), materialize=True))
    for code in ("section_order.violation", "required_sections.missing", "terminology.mixed_variants", "vague_wording."):
        (plan,) = [p for p in read if code in p]
        assert not any(x in plan for x in ("Join", "Aggregate", "Window")), code  # else the driver draws up the largest plan again after each stage


def test_section_findings_are_those_of_the_frames(spark):
    d = docs(
        spark, ["2. Область применения", "1. Введение", "НАЗНАЧЕНИЕ", "Цель документа дана ниже.", "3. Введение "], ["1. Введение", "2. Назначение", "Требования к  надёжности"], ["Список литературы", "текст", "введение"],
        ["Критерием приёмки является акт."], [], ["1. Функциональные   требования", "4. Приложение"],
    )
    f = Frames.of(d)
    found = checks.sections_found(f.secs, f.required)
    rows = checks.section_findings(section_arrays(f.docs)).collect()
    assert len(rows) == 6
    flat = lambda df: sorted(map(tuple, df.collect()))
    assert sorted((r["doc_id"], *m) for r in rows for m in r["missing"]) == flat(checks.sections_missing(f.docs, found, f.required))
    wrong = flat(checks.order_violations(found))
    assert sorted((r["doc_id"], *r["wrong"]) for r in rows if r["wrong"]) == wrong and len(wrong) == 2
    absent = flat(checks.presence(f.texts, f.secs).where("NOT is_present").select("doc_id", "check_key"))
    assert sorted((r["doc_id"], k) for r in rows for k in r["absent"]) == absent and 0 < len(absent) < 30


def test_phrases_and_mixed_terms_in_the_row(spark):
    texts = spark.createDataFrame(
        [(1, "надёжность и надежность, приложение"), (2, "надёжность"), (3, "тз, техническое задание (тз) и птз"), (4, "рис. 1 и рисунок; рис_2"), (5, "")], "doc_id long, collapsed string"
    )
    mixed = sorted(map(tuple, spans.mixed_terms_of(texts).collect()))
    assert mixed == sorted(map(tuple, spans.mixed_terms(spans.term_counts(texts)).collect())) and [r[0] for r in mixed] == [1, 3, 4]
    found = spans.vague_findings(spark.createDataFrame([(1, "«аб в» аб в, в аб в аб вг % -а")], "doc_id long, collapsed string"), {"x": ["аб в", "в", "%", "-а", "аб вг"]}, {})
    assert [(r["start_pos"], r["phrase"]) for r in found.orderBy("start_pos").collect()] == [(1, "аб в"), (7, "аб в"), (13, "в"), (15, "аб в"), (20, "аб вг"), (26, "%"), (28, "-а")]


def test_reports_count_checks_in_one_grouping(spark):
    built = spark.createDataFrame([(1, " b ", "warning", "r"), (1, "a", None, " "), (1, "b", "x", None), (2, " ", "critical", "r")], "doc_id long, check_key string, severity string, recommendation string")
    out = issues.report(spark.range(1, 4).withColumnRenamed("id", "doc_id"), built)
    assert {r["doc_id"]: (r["total_issues"], r["by_check"]) for r in out.collect()} == {1: (3, {"a": 1, "b": 2}), 2: (1, {"unknown": 1}), 3: (0, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_lists_of_issues_are_never_broadcast(spark):
    built = cut(spark.range(1, 9).selectExpr("id AS doc_id", "1 AS issue_ord", "'c' AS check_key", "'warning' AS severity", "repeat('m', 9999) AS message", "'f' AS fragment_text", "'s' AS section_title", "'r' AS recommendation"))
    d = cut(docs(spark, ["a"], ["b"]))
    reports = issues.report(d, built)
    for made in (reports, exports.payloads(reports, built), exports.report_files(reports, built)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the file is small, as it is compressed, not its rows
