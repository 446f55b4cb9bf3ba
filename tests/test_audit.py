import io
import re
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specmill.functions.batches import in_pieces
from specmill.functions.text import collapse_casefold, normalize_text, page_cleanup
from specmill.operators import checks, duplicates, issues, references, spans
from specmill.operators.corpus import lines_of
from specmill.operators.fragments import fragment_arrays, fragments, matched_units, obligations, signals
from specmill.operators.issues import Frames
from specmill.operators.structure import sections
from specmill.plans import audit_queries
from specmill.rules.tables import GLOSSARY, VAGUE_PHRASES
from specmill.session import cut
from specmill.sinks import exports
from specmill.sources import files, pdf


def docs(spark, *blocks, kind="docx"):
    return spark.createDataFrame([(i + 1, kind, list(b)) for i, b in enumerate(blocks)], "doc_id long, kind string, blocks array<string>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, normalize_text(F.lit(" a\r\n\tb  c \n\n\n\n d\u00a0e "))) == "a\nb c\n\nd e"
    assert one(spark, page_cleanup(F.lit("a  \nb\t\n"))) == "a\nb"
    assert one(spark, collapse_casefold(F.lit(" Straße \n ДОМ "))) == "strasse дом"


def test_headings_levels_and_tree(spark):
    d = docs(
        spark,
        ["1. Введение", "текст", "1.1 Цели", "2.5 мм толщина", "2.5 секунд ждать", "1.1.1 Частности", "ЗАГЛАВНЫЕ", "заключение", "3.1. Не раздел", "5", "", "А" * 120],
        [],
    )
    rows = {r["section_ord"]: r for r in sections(d).collect()}
    assert [rows[i]["title"] for i in range(6)] == ["1. Введение", "1.1 Цели", "2.5 секунд ждать", "1.1.1 Частности", "ЗАГЛАВНЫЕ", "заключение"]
    assert [rows[i]["level"] for i in range(6)] == [1, 2, 2, 3, 1, 1]
    assert [rows[i]["parent_ord"] for i in range(6)] == [None, 0, 0, 2, None, None]
    assert [(rows[i]["start_block"], rows[i]["end_block"], rows[i]["subtree_end"]) for i in (0, 2, 5)] == [(0, 1, 5), (4, 4, 5), (7, 11, 11)]
    assert rows[0]["title_key"] == "введение" and rows[0]["content_text"] == "1. Введение\nтекст"


def test_sections_tile_the_blocks(spark):
    d = docs(spark, ["пролог", "1. А", "x", "2. Б", "y", "z"])
    rows = sorted(sections(d).collect(), key=lambda r: r["section_ord"])
    assert [(r["start_block"], r["end_block"]) for r in rows] == [(1, 2), (3, 5)]


def test_required_sections_order_and_completeness(spark):
    d = docs(spark, ["2. Область применения", "1. Введение", "1. Введение"], ["1. Введение", "Область применения"], [])
    secs, required = sections(d), checks.required_table(spark)
    found = checks.sections_found(secs, required)
    assert {(r["doc_id"], r["section_key"]) for r in found.collect()} == {(1, "scope"), (1, "introduction"), (2, "introduction")}
    missing = checks.sections_missing(d, found, required).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in missing} == {1: 9, 2: 10, 3: 11}
    wrong = checks.order_violations(found).collect()
    assert [(r["doc_id"], r["position"], r["expected_key"], r["found_key"]) for r in wrong] == [(1, 0, "introduction", "scope")]
    ratio = {r["doc_id"]: (r["completeness_ratio"], r["no_sections"]) for r in checks.completeness(d, secs, found).collect()}
    assert ratio == {1: (0.1818, False), 2: (0.0909, False), 3: (0.0, True)}


def test_presence_prefers_headings(spark):
    d = docs(spark, ["1. Назначение", "Целью документа является проверка."], ["Целью документа является проверка " + "х" * 200], ["ничего"])
    rows = {r["doc_id"]: r for r in checks.presence(Frames.of(d).texts, sections(d)).where("check_key = 'purpose_check'").collect()}
    assert (rows[1]["match_type"], rows[1]["matched_signal"]) == ("section_title", "Назначение")
    assert rows[2]["match_type"] == "text_phrase" and rows[2]["excerpt"].endswith(" ...") and not rows[2]["excerpt"].startswith("...")
    assert not rows[3]["is_present"]


def test_obligations_and_signals(spark):
    d = docs(
        spark,
        ["1. Требования", "Вот они. Система должна быть удобной для каждого оператора. СИСТЕМА ДОЛЖНА быть удобной для каждого оператора. Сервис обязан обрабатывать не менее 100 запросов в секунду. Должно быть. Период должен составлять 15 единиц при полной загрузке."],
        ["Время отклика должно быть 2с при обычной нагрузке на канал."],
    )
    rows = signals(obligations(fragments(fragment_arrays(d)))).collect()
    by = {r["collapsed"][:20]: r for r in rows}
    assert len(rows) == 4
    assert not by["система должна быть "]["verifiable"] and by["система должна быть "]["marker"] == "должна"
    upper = signals(obligations(fragments(fragment_arrays(docs(spark, ["Ввод. Система ДОЛЖНА быть удобной для каждого.", "Straße ДОЛЖНА быть удобной для каждого."]))))).collect()
    assert [(r["marker"], r["marker_start"], r["marker_end"]) for r in sorted(upper, key=lambda r: r["frag"], reverse=True)] == [("ДОЛЖНА", 8, 14), ("должна", 8, 14)]
    assert by["сервис обязан обраба"]["linked"] and by["сервис обязан обраба"]["tags"] == ["number", "rate", "threshold"]
    assert not by["период должен состав"]["linked"] and by["период должен состав"]["number"]
    assert by["время отклика должно"]["letter"] and by["время отклика должно"]["section_ord"] is None
    units = one(spark, matched_units(F.lit("Не менее 5 кг и 5 КГ"), F.lit("не менее 5 кг и 5 кг")))
    assert units == ["5 кг", "кг"]


def test_fragments_fall_back_only_without_sections(spark):
    d = docs(spark, ["пролог должен быть пропущен.", "1. Раздел"], ["Без разделов, но с текстом."])
    rows = fragments(fragment_arrays(d)).collect()
    assert {(r["doc_id"], r["frag"]) for r in rows} == {(1, "1."), (1, "Раздел"), (2, "Без разделов, но с текстом.")}


def test_spans_are_greedy_and_whole(spark):
    texts = spark.createDataFrame([(1, "шлюз должен обеспечивать возможность записи. возможность, возможностью, быстро быстро"), (2, ""), (3, None)], "doc_id long, collapsed string")
    found = [r["phrase"] for r in spans.vague_findings(texts).orderBy("doc_id", "start_pos").collect()]
    assert found == ["должен обеспечивать возможность", "возможность", "быстро", "быстро"]
    terms = spans.mixed_terms(spans.term_counts(spark.createDataFrame([(1, "надёжность и надежность, приложение"), (2, "надёжность")], "doc_id long, collapsed string"))).collect()
    assert [(r["doc_id"], r["term_key"], r["used_variants"]) for r in terms] == [(1, "reliability", "надежность, надёжность")]


def test_dictionary_overlaps_are_containments():
    """What the SQL counterparts of the greedy choice rely on."""
    for words in ([p for ps in VAGUE_PHRASES.values() for p in ps], *[[c, *o] for _, c, o in GLOSSARY]):
        for a in words:
            for b in words:
                if a != b and a not in b and b not in a:
                    assert not any(a.endswith(" " + b[:n].rstrip()) or a[-n:] == b[:n] and a[-n - 1 : -n] == " " for n in range(1, min(len(a), len(b))))


def test_numbered_references(spark):
    d = docs(spark, ["См. рис. 1 и рисунок 3.", "Рисунок 1 Вид", "Рисунок 5 Вид, см. рисунок 9", "Рисунок 5 Вид"], ["рисунки 7"])
    s = {r["label"]: (r["state"], r["is_duplicate"]) for r in references.label_summary(references.figure_references(lines_of(d))).collect()}
    assert s == {"1": ("ok", False), "3": ("missing", False), "5": ("unreferenced", True)}
    assert [r["missing"] for r in references.number_gaps(references.figure_references(lines_of(d))).orderBy("missing").collect()] == ["2", "3", "4"]


def test_number_gaps_beyond_one_piece(spark):
    refs = spark.createDataFrame([(1, "declaration", "1"), (1, "declaration", "12"), (2, "declaration", "99999999999999999999"), (2, "declaration", "100000000000000000002"), (2, "declaration", "9" * 50)], "doc_id long, role string, label string")
    assert sorted(int(r["missing"]) for r in references.number_gaps(refs.where("doc_id = 1"), longest=3).collect()) == list(range(2, 12))
    ranges = {r["doc_id"]: (int(r["first_missing"]), int(r["last_missing"])) for r in references.number_gap_ranges(refs).collect()}
    assert ranges == {1: (2, 11), 2: (10**20, 10**20 + 1)}
    assert one(spark, references.number_label(F.lit("٠٠١٢"))) == "12" and one(spark, references.number_label(F.lit("000"))) == "0"


def test_appendix_references(spark):
    d = docs(spark, ["В приложении А и приложении Б, см. приложение Г и приложении 2.", "Приложение А", "Приложение Б", "Приложение В", "Приложение 007 Акты", "Приложение к договору", "приложения к письмам, приложения К."])
    refs = references.appendix_references(lines_of(d))
    s = {r["label"]: r["state"] for r in references.label_summary(refs).collect()}
    assert s == {"А": "ok", "Б": "ok", "Г": "missing", "В": "unreferenced", "7": "unreferenced", "2": "missing", "К": "missing"}
    gaps = references.letter_gaps(spark.createDataFrame([(1, "declaration", "А"), (1, "declaration", "Г")], "doc_id long, role string, label string"))
    assert sorted(r["missing"] for r in gaps.collect()) == ["Б", "В"]


def test_duplicates(spark):
    d = docs(spark, ["1. Раздел", "Вот что важно. Оператор обязан проверить журнал событий перед сменой. Оператор  обязан проверить журнал, событий перед сменой! Перед сменой оператор обязан проверить журнал событий сам. Совсем другая мысль о погоде и о природе."])
    arrays = fragment_arrays(d)
    frags = fragments(arrays)
    exact = duplicates.exact_duplicates(frags).collect()
    assert [(r["occurrences"], r["key"]) for r in exact] == [(2, "оператор обязан проверить журнал событий перед сменой")]
    near = duplicates.near_duplicates(arrays).collect()
    assert len(near) == 0  # 7 of 8 words shared is 0.875, the sequence differs
    pairs = duplicates.near_pairs(arrays).collect()
    assert [round(r["jaccard"], 3) for r in pairs] == [0.875]


def test_report_counts_every_document(spark):
    d = docs(spark, ["1. Введение", "Модуль должен работать быстро и качественно всегда."], [])
    frames = Frames.of(d)
    built = issues.build_issues(frames).cache()
    report = {r["doc_id"]: r for r in issues.report(d, built).collect()}
    counts = {r["doc_id"]: r["count"] for r in built.groupBy("doc_id").count().collect()}
    assert {k: r["total_issues"] for k, r in report.items()} == counts and set(counts) == {1, 2}
    assert report[1]["status"] == "needs_review" and report[1]["by_check"]["vague_wording_check"] == 2
    assert report[1]["with_recommendation"] == report[1]["total_issues"]
    assert issues.filter_issues(built, "vague_wording_check", "recommendation").count() == 2
    vague = built.where("doc_id = 1 AND check_key = 'vague_wording_check'").orderBy("issue_ord").first()
    assert '"phrase":"быстро"' in vague["metadata"] and '"match_type":"dictionary_phrase"' in vague["metadata"] and vague["locations"] is None
    assert vague["message"] in ("Не содержит измеримого критерия времени", "Нужны критерии приёмки и метрики качества")
    grouped = {(r["grouping"], r["value"]): r["issue_ords"] for r in issues.groups(built.where("doc_id = 1")).collect()}
    assert sorted(grouped["by_severity", "warning"] + grouped["by_severity", "recommendation"]) == list(range(1, counts[1] + 1)) and len(grouped["by_check", "vague_wording_check"]) == 2
    labels = {(r["facet"], r["value"]): r["label"] for r in issues.facets(built.withColumn("severity", F.when(F.col("check_key") == "scope_check", "").otherwise(F.col("severity")))).collect()}
    assert labels["severity", ""] == "Серьёзность не указана" and labels["severity", "warning"] == "Предупреждение" and labels["check_key", "vague_wording_check"] == "Неконкретные формулировки"
    assert sorted(x for x in labels.values() if x.startswith("Иной"))[0] == "Иной тип проверки №1"
    assert built.where("issue_code = 'unverifiable.obligation_without_metrics'").first()["locations"][0]["fragment_index"] == 1
    empty = issues.report(d, built.where("false")).collect()
    assert {(r["status"], r["total_issues"]) for r in empty} == {("no_issues", 0)}
    lines = [r["line"] for r in exports.csv_rows(built).where("doc_id = 1").orderBy("line_no").collect()]
    assert lines[0].startswith("index,severity") and len(lines) == counts[1] + 1
    payload = exports.payloads(issues.report(d, built), built).where("doc_id = 1").first()["payload"]
    assert '"status" : "needs_review"' in payload
    assert '"by_severity"' in payload and '"vague_wording_check" : [' in payload
    names = spark.createDataFrame([(1, "a/тз.docx")], "doc_id long, filename string")
    made = {r["doc_id"]: r for r in exports.report_files(issues.report(d, built), built, names).collect()}
    lines, error = files.docx_blocks(bytes(made[1]["content"]))
    assert error is None and made[1]["filename"] == "тз-report.docx" and made[2]["filename"] == "document-report.docx"
    assert lines[:5] == ["Отчёт о проверке технического задания", "Исходный файл: a/тз.docx", report[1]["conclusion"], f"Число замечаний: {counts[1]}", "Список замечаний"]
    assert lines[5] == "Замечание 1" and any(x.startswith("Серьёзность: Предупреждение") for x in lines)
    assert files.docx_blocks(exports.office_document(exports.report_paragraphs(None, None, [])))[0][1:4] == ["Исходный файл: —", "Краткий вывод в данных отсутствует.", "Число замечаний: 0"]
    built.unpersist()


def test_payload_readers(spark):
    payload = '{"report": {"summary": {"conclusion": "Итог"}, "issues": [{"fragment_text": " ", "metadata": {"text_excerpt": "цитата"}}, 5]}}'
    assert one(spark, exports.conclusion_of(F.lit(payload))) == "Итог"
    rows = one(spark, exports.issues_of(F.lit(payload)))
    assert len(rows) == 1 and one(spark, exports.fragment_text_of(F.lit(rows[0]))) == "цитата"
    assert one(spark, exports.content_disposition(F.lit("отчёт 1.docx"))).endswith("%20" + "1.docx")
    assert one(spark, issues.normalize_severity(F.lit(" warning "))) == "warning" and one(spark, issues.normalize_severity(F.lit(" "))) is None
    for wrong in ("fatal", "Warning"):
        with pytest.raises(Exception, match="unknown severity"):
            one(spark, issues.normalize_severity(F.lit(wrong)))
    rows = spark.createDataFrame([(1, " ", "x")], "doc_id long, code string, message string")
    for code, message in ((F.col("code"), F.col("message")), (F.col("message"), F.col("code"))):
        with pytest.raises(Exception, match="must be non-empty"):
            issues.issue(rows, "c", code, "warning", message).collect()


@pytest.mark.parametrize(("name", "stem"), [("C:/x/report.v2.docx", "report.v2"), ("", "document"), (None, "document"), ("con.txt", "_con"), ('a<b>:"c".pdf', "a_b_c_"), (".hidden", ".hidden")])
def test_file_stems(spark, name, stem):
    assert one(spark, exports.file_stem(F.lit(name).cast("string"))) == stem


@pytest.mark.parametrize(
    ("name", "kind", "suffix"),
    [("A.DOCX", None, ".docx"), ("a", "application/pdf; x=1", ".pdf"), ("a.txt", "application/pdf", None), (None, None, None), ("dir/b.pdf", "", ".pdf")],
)
def test_upload_suffix(spark, name, kind, suffix):
    assert one(spark, files.upload_suffix(F.lit(name).cast("string"), F.lit(kind).cast("string"))) == suffix


def test_office_files_round_trip(spark, tmp_path):
    (tmp_path / "ok.docx").write_bytes(exports.office_document([("Normal", " 1. Введение "), ("Normal", ""), ("Normal", "a & b")]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert rows["ok.docx"]["blocks"] == ["1. Введение", "", "a & b"] and rows["ok.docx"]["error"] is None
    assert rows["bad.docx"]["error"] == "Файл не является корректным документом DOCX."
    assert files.docx_blocks(b"") == (None, "Файл пуст.") and files.pdf_blocks(None) == (None, "Empty file.")
    limited = {r["path"].rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path), max_bytes=10).collect()}
    assert limited["ok.docx"]["error"] == files.TOO_LARGE and limited["ok.docx"]["kind"] == "docx" and limited["bad.docx"]["error"] != files.TOO_LARGE


def test_runs_of_a_paragraph():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    box = "<w:r><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r>"
    body = f'<w:p><w:r><w:t>a</w:t><w:tab/><w:br w:type="page"/><w:br/><w:noBreakHyphen/></w:r>{box}<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert files.docx_blocks(out.getvalue()) == (["a\t\n-link"], None)


def _pdf(pages, flate=True, mapped=False):
    """A small PDF of pages of lines, in WinAnsi or with a map to Unicode."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    objects = {3: b"<< /Type /Font /ToUnicode 4 0 R >>" if mapped else b"<< /Type /Font /BaseFont /Helvetica >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)}
    kids = []
    for lines in pages:
        shown = [b"<" + x.encode("utf-16-be").hex().encode() + b">" if mapped else b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252")) + b")" for x in lines]
        text = b"BT /F1 12 Tf 14 TL 72 720 Td " + b"".join(x + b" Tj T* " for x in shown) + b"ET"
        data, n = zlib.compress(text) if flate else text, len(objects) + 3
        objects[n] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if flate else b"", data)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % n
        kids.append(b"%d 0 R" % (n + 1))
    objects |= {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] >>"}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf_pages_with_the_standard_library(flate):
    assert [p.split() for p in pdf.page_texts(_pdf([["Hello (world) \\", "two"], [], ["é 3"]], flate))] == [["Hello", "(world)", "\\", "two"], [], ["é", "3"]]
    assert pdf.page_texts(_pdf([["Привет, мир", "строка 2"]], flate, mapped=True))[0].strip() == "Привет, мир\nстрока 2"
    for wrong, error in ((b"no pdf", pdf.InvalidPdf), (b"%PDF-1.4 nothing", pdf.InvalidPdf), (b"%PDF-1.4 trailer << /Encrypt 5 0 R >>", pdf.EncryptedPdf)):
        with pytest.raises(error):
            pdf.page_texts(wrong)


def test_stream_audits_arriving_files(spark, tmp_path):
    from specmill.streaming.audit import audit_stream

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(exports.office_document([("Normal", "1. Введение"), ("Normal", "Модуль должен работать быстро и качественно всегда.")]))
    query = audit_stream(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(300)
    assert query.exception() is None
    assert spark.read.parquet(str(tmp_path / "out/reports")).count() == 1


def test_registry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_issues_are_drawn_up_from_written_findings(spark):
    d = docs(spark, ["1. Введение", "Система должна работать быстро.", "Рисунок 1 Вид", "см. рис. 3 и таблицу 2", "Приложение А Формы"])
    plan = issues.build_issues(Frames.of(d))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Relation ") <= 7  # else one plan of all checks takes the driver's memory


def test_files_are_made_in_pieces(spark):
    seen = []
    out = in_pieces(lambda a: seen.append(len(a)) or a, pa.int64(), pa.array(range(150)))
    assert seen == [64, 64, 22] and out.to_pylist() == list(range(150)) and len(in_pieces(list, pa.int64(), pa.array([], pa.int64()))) == 0
    d = spark.range(150).coalesce(1).select("id", F.when(F.col("id") != 70, F.array(F.col("id").cast("string"), F.lit(None))).alias("p"))
    rows = d.select("id", files.extract(F.lit(".docx"), exports.office_file("p")).alias("x")).collect()
    assert {r["id"]: r["x"]["blocks"] for r in rows} == {i: [str(i), ""] if i != 70 else None for i in range(150)} and [r["id"] for r in rows if r["x"]["error"]] == [70]


@pytest.mark.parametrize("name", ["payloads", "payload_fragments"])
def test_no_plan_of_payloads_holds_all_checks(spark, monkeypatch, name):
    read = []

    def recorded(df):
        read.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation "))
        return cut(df)

    monkeypatch.setattr(issues, "cut", recorded)
    monkeypatch.setattr(audit_queries, "cut", recorded)
    of = {"payloads": audit_queries._payload, "payload_fragments": audit_queries._payload_fragments}[name]
    d = docs(spark, ["1. Введение", "Система должна работать быстро.", "Рисунок 1 Вид", "см. рис. 3 и таблицу 2", "Приложение А Формы"], [])
    assert {r["doc_id"] for r in of(Frames.of(d, materialize=True)).collect()} >= {1}
    assert max(read) <= 12  # frames that a plan reads: one plan of all checks takes the driver's memory
