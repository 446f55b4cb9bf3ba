"""Exports of issues and reports: CSV text, JSON payloads, office documents, and their file names."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.batches import in_pieces
from specmill.functions.text import strip
from specmill.rules.tables import REPORT_TEXTS, SEVERITIES, SEVERITY_LABELS

# Fixed value: the columns of the CSV export.
CSV_COLUMNS = ["index", "severity", "check_key", "issue_code", "message", "section_title", "fragment_text", "recommendation", "category"]
# Fixed value: names that a system reserves.
RESERVED = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"
# Labels of the checks.
CHECK_LABELS = {
    "vague_wording_check": "Неконкретные формулировки",
    "unverifiable_requirements_check": "Проверяемость требований",
    "figure_references_check": "Ссылки на рисунки",
    "table_references_check": "Ссылки на таблицы",
    "appendix_references_check": "Ссылки на приложения",
    "terminology_consistency_check": "Согласованность терминов",
    "duplicate_formulations_check": "Повторы формулировок",
}


def file_stem(name: Column) -> Column:
    """A safe stem for an exported file: no folder, no extension, no characters or names that a system reserves,
    at most 120 characters, "document" where nothing is left."""
    base = F.substring_index(F.coalesce(F.nullif(strip(name), F.lit("")), F.lit("document")), "/", -1)
    stem = F.when(base.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    clean = F.regexp_replace(stem, r'[\x00-\x1f<>:"/\\|?*]+', "_")
    clean = strip(F.regexp_replace(clean, rf"^(?i)({RESERVED})(?=\.|$)", "_$1"))
    return F.coalesce(F.nullif(F.left(clean, F.lit(120)), F.lit("")), F.lit("document"))


def content_disposition(filename: Column) -> Column:
    """The header value that offers a file for download, with an ASCII name and the name in UTF-8."""
    ascii_name = F.regexp_replace(F.regexp_replace(filename, r"[^\x00-\x7f]", "_"), r'["\\?]', "_")
    ascii_name = F.when(F.trim(ascii_name) == "", "report.docx").otherwise(ascii_name)
    encoded = F.url_encode(filename)  # of a form: three characters differ from those of a path
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        encoded = F.regexp_replace(encoded, a, b)
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), encoded)


def csv_rows(issues: DataFrame) -> DataFrame:
    """doc_id, line_no, line: the CSV text of each document's issues, a header first; quoted where it must be."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    category = F.coalesce(F.create_map(*[F.lit(x) for kv in CHECK_LABELS.items() for x in kv])[F.col("check_key")], F.lit(""))
    cells = [F.col("issue_ord").cast("string"), *[F.coalesce(F.col(c), F.lit("")) for c in CSV_COLUMNS[1:-1]], category]
    body = issues.select("doc_id", F.col("issue_ord").alias("line_no"), F.concat_ws(",", *[quoted(c) for c in cells]).alias("line"))
    header = issues.select("doc_id").distinct().select("doc_id", F.lit(0).alias("line_no"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    return header.unionByName(body)


def csv_documents(issues: DataFrame) -> DataFrame:
    """doc_id, content: a CSV file per document, with a byte order mark and CRLF line ends."""
    lines = csv_rows(issues).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return lines.select("doc_id", F.concat(F.lit(chr(0xFEFF)), F.array_join("x.line", "\r\n"), F.lit("\r\n")).alias("content"))


def payloads(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, payload: the report, its groups and the issues of each document as JSON; absent values are left out.

    A group lists the numbers of its issues."""
    fields = [c for c in issues.columns if c != "doc_id"]
    listed = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("issue_ord", *[c for c in fields if c != "issue_ord"]))).alias("issues"))
    by = lambda c, empty: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(empty))
    ords = lambda k, v: F.transform(F.filter("__named", lambda x: x[k] == v), lambda x: x["issue_ord"])
    of_severity = F.map_from_arrays(F.array(*map(F.lit, [*SEVERITIES, "unspecified"])), F.array(*[ords("severity", v) for v in [*SEVERITIES, "unspecified"]]))
    of_check = F.map_from_arrays(F.col("__checks"), F.transform("__checks", lambda v: ords("check_key", v)))
    none = F.array().cast(listed.schema["issues"].dataType)
    # never broadcast: the planner takes the lists of issues to be as small as the compressed file that they are read from
    both = reports.join(listed.hint("merge"), "doc_id", "left").withColumn("issues", F.coalesce("issues", none))
    # the names of the groups of each issue, once; groups of an issue are looked up many times
    named = F.transform("issues", lambda x: F.struct(x["issue_ord"].alias("issue_ord"), by(x["severity"], "unspecified").alias("severity"), by(x["check_key"], "unknown").alias("check_key")))
    both = both.withColumn("__named", named).withColumn("__checks", F.array_sort(F.array_distinct(F.col("__named.check_key"))))
    summary = F.struct(*[c for c in reports.columns if c != "doc_id"])
    return both.select("doc_id", F.to_json(F.struct(summary.alias("summary"), F.struct(of_severity.alias("by_severity"), of_check.alias("by_check")).alias("groups"), F.col("issues")), {"pretty": "true"}).alias("payload"))


def conclusion_of(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.report.summary.conclusion"), F.get_json_object(payload, "$.summary.conclusion"))


def issues_of(payload: Column) -> Column:
    """The issues of a payload as an array of JSON objects: its own, else its report's; what is no object is left out."""
    listed = F.coalesce(F.get_json_object(payload, "$.issues"), F.get_json_object(payload, "$.report.issues"))
    return F.filter(F.from_json(listed, T.ArrayType(T.StringType())), lambda x: x.startswith("{"))


def fragment_text_of(payload: Column, own: Column | None = None) -> Column:
    """The first text of an issue's JSON that isn't blank: its fragment (own, where that is read already), its excerpt, or those of its metadata."""
    paths = ["$.text_excerpt", "$.metadata.source.text_excerpt", "$.metadata.text_excerpt"]
    read = [F.get_json_object(payload, "$.fragment_text") if own is None else own, *[F.get_json_object(payload, p) for p in paths]]
    first, *others = [F.nullif(F.trim(x), F.lit("")) for x in read]
    named = payload.contains("text_excerpt") | payload.contains("\\u")  # else there is nothing to look for; a name may be escaped
    return F.coalesce(first, F.when(named, F.coalesce(*others)))


def payload_fragments(payloads: DataFrame) -> DataFrame:
    """doc_id, issue_ord, check_key, severity, message, fragment_text: the issues of doc_id, payload, read back.

    The outer explode keeps the payload from being made and read once more for a filter below it."""
    listed = payloads.select("doc_id", F.posexplode_outer(issues_of(F.col("payload"))).alias("i", "issue")).where("issue IS NOT NULL")
    fields = ["check_key", "severity", "message"]
    rows = listed.select("doc_id", (F.col("i") + 1).cast("long").alias("issue_ord"), "issue", F.json_tuple("issue", *fields, "fragment_text").alias(*fields, "own"))
    return rows.select("doc_id", "issue_ord", *fields, fragment_text_of(F.col("issue"), F.col("own")).alias("fragment_text"))


_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _run(text: str, bold: bool = False) -> str:
    """A run of text: tabs and line breaks as elements, without characters that XML can't hold."""
    parts = re.split("(\t|\n)", _NOT_XML.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    inner = "".join("<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in parts if x)
    return f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{inner}</w:r>"


def office_document(paragraphs: list[tuple[str, str] | tuple[str, str, str]]) -> bytes:
    """A word-processing file of (style, text) and (style, bold label, text) paragraphs, made with the standard library only."""
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(p[0])}"/></w:pPr>{_run(p[1] + " ", True) if len(p) > 2 else ""}{_run(p[-1])}</w:p>' for p in paragraphs)
    files = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def office_file(paragraphs: pa.Array) -> pa.Array:
    """A word-processing file of an array of paragraphs; null ones are empty."""
    return in_pieces(lambda rows: [None if ps is None else office_document([("Normal", x or "") for x in ps]) for ps in rows], pa.binary(), paragraphs)


def report_paragraphs(filename: str | None, conclusion: str | None, issues: list) -> list[tuple]:
    """The paragraphs of a document's report: what has no value is left out."""
    t, filled = REPORT_TEXTS, lambda x: x.strip() if x and x.strip() else None
    out: list[tuple] = [("Heading1", t["title"]), ("Normal", t["file"], filled(filename) or "—"), ("Normal", filled(conclusion) or t["no_conclusion"]), ("Normal", t["count"].format(len(issues))), ("Heading2", t["list"])]
    if not issues:
        out.append(("Normal", t["none"]))
    for i, r in enumerate(issues, 1):
        out.append(("Heading3", t["issue"].format(i)))
        labels = {"severity": SEVERITY_LABELS, "check_key": CHECK_LABELS}
        for k in ("severity", "check_key", "message", "section_title", "fragment_text", "recommendation"):
            if x := filled(r[k]):
                out.append(("Normal", t[k], labels.get(k, {}).get(x, x)))
    return out


@F.arrow_udf(T.BinaryType())
def _report_file(filename: pa.Array, conclusion: pa.Array, issues: pa.Array) -> pa.Array:
    return in_pieces(lambda *rows: [office_document(report_paragraphs(f, c, r)) for f, c, r in zip(*rows)], pa.binary(), filename, conclusion, issues)


def report_files(reports: DataFrame, issues: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """doc_id, filename, content: a word-processing file with the conclusion and the issues of each document.

    names: doc_id and filename of the documents' files, one row each; the report is named after it."""
    row = F.struct("issue_ord", "message", "severity", "check_key", "fragment_text", "section_title", "recommendation")
    listed = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("issues"))
    both = reports.join(listed.hint("merge"), "doc_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType)))
    both = both.withColumn("__name", F.lit(None).cast("string")) if names is None else both.join(names.select("doc_id", F.col("filename").alias("__name")), "doc_id", "left")
    return both.select("doc_id", F.concat(file_stem(F.col("__name")), F.lit("-report.docx")).alias("filename"), _report_file("__name", "conclusion", "issues").alias("content"))
