"""Uploaded files: which kind they are, and their text as blocks."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.batches import in_pieces
from specmill.functions.text import join_blocks, normalize_text, page_cleanup, strip
from specmill.sources import pdf

# Content types of the kinds.
CONTENT_TYPES = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/pdf": ".pdf",
    "application/x-pdf": ".pdf",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EXTRACTED = T.StructType([T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def client_name(filename: Column) -> Column:
    """The name without folders, "upload" where there is none."""
    return F.coalesce(F.nullif(F.substring_index(F.coalesce(filename, F.lit("")), "/", -1), F.lit("")), F.lit("upload"))


def upload_suffix(filename: Column, content_type: Column) -> Column:
    """.docx or .pdf by the name's extension; by the content type where the name has none; else null."""
    extension = F.lower(F.regexp_extract(client_name(filename), r"(?s)^.+(\.[^.]+)$", 1))
    kind = F.lower(strip(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    by_type = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])[kind]
    return F.when(extension.isin(".docx", ".pdf"), extension).when(extension == "", by_type)


# The messages of files that can't be read.
ERRORS = {
    ".docx": {"empty": "Файл пуст.", "invalid": "Файл не является корректным документом DOCX.", "unreadable": "Не удалось прочитать файл DOCX."},
    ".pdf": {"empty": "Empty file.", "invalid": "Not a valid PDF document.", "unreadable": "Could not extract text from PDF.", "encrypted": "Encrypted PDF cannot be read without a password."},
}
TOO_LARGE = "File too large."


def _run_text(run: ElementTree.Element) -> str:
    """The text of a run's own elements; what floats beside the text, as a text box does, is none of it."""
    out = []
    for node in run:
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag in (f"{_W}tab", f"{_W}ptab"):
            out.append("\t")
        elif node.tag == f"{_W}cr" or node.tag == f"{_W}br" and node.get(f"{_W}type", "textWrapping") == "textWrapping":
            out.append("\n")
        elif node.tag == f"{_W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def docx_blocks(content: bytes | None) -> tuple[list[str] | None, str | None]:
    """The stripped body paragraphs of a word-processing file, empty ones kept; or an error."""
    errors = ERRORS[".docx"]
    if not content:
        return None, errors["empty"]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, errors["invalid"]
    except (OSError, zlib.error, NotImplementedError, RuntimeError):
        return None, errors["unreadable"]
    body = root.find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        runs = [r for child in p for r in ([child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else [])]
        out.append("".join(map(_run_text, runs)).strip())
    return out, None


def pdf_blocks(content: bytes | None) -> tuple[list[str] | None, str | None]:
    """The text of each page; or an error. A PDF library is used where one is installed, else the reader of
    specmill.sources.pdf."""
    errors = ERRORS[".pdf"]
    if not content:
        return None, errors["empty"]
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            return pdf.page_texts(content), None
        except pdf.EncryptedPdf:
            return None, errors["encrypted"]
        except pdf.InvalidPdf:
            return None, errors["invalid"]
        except Exception:  # noqa: BLE001 - one bad file never fails the others
            return None, errors["unreadable"]
    try:
        reader = PdfReader(io.BytesIO(content), strict=False)
        if reader.is_encrypted and not reader.decrypt(""):
            return None, errors["encrypted"]
        pages = list(reader.pages)
    except Exception:  # noqa: BLE001
        return None, errors["invalid"]
    try:
        return [page.extract_text() or "" for page in pages], None
    except Exception:  # noqa: BLE001 - any failure of a page fails the document
        return None, errors["unreadable"]


@F.arrow_udf(EXTRACTED)
def extract(suffix: pa.Array, content: pa.Array) -> pa.Array:
    """blocks and error of files by their suffix; one bad file never fails the others."""
    read = lambda s, c: docx_blocks(c) if s == ".docx" else pdf_blocks(c) if s == ".pdf" else (None, "unsupported type")
    kind = pa.struct([("blocks", pa.list_(pa.string())), ("error", pa.string())])
    return in_pieces(lambda *rows: [dict(zip(("blocks", "error"), read(s, c))) for s, c in zip(*rows)], kind, suffix, content)


def documents_of(files: DataFrame) -> DataFrame:
    """path, kind, blocks, error of binary files (path, content): read, cleaned and normalized."""
    suffix = upload_suffix(F.col("path"), F.lit(None).cast("string"))
    read = files.withColumn("suffix", suffix).withColumn("x", extract("suffix", "content"))
    cleaned = F.transform("x.blocks", lambda b: normalize_text(F.when(F.col("suffix") == ".pdf", page_cleanup(b)).otherwise(b)))
    return read.select("path", F.substring("suffix", 2, 4).alias("kind"), cleaned.alias("blocks"), F.col("x.error").alias("error"))


def read_folder(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """The documents of the files below a folder; the contents of larger ones than max_bytes aren't read, they come out with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is None:
        return documents_of(files)
    large = files.where(F.col("length") > max_bytes).select("path", F.substring(upload_suffix(F.col("path"), F.lit(None).cast("string")), 2, 4).alias("kind"), F.lit(None).cast("array<string>").alias("blocks"), F.lit(TOO_LARGE).alias("error"))
    return documents_of(files.where(F.col("length") <= max_bytes)).unionByName(large)


def unify(docx: DataFrame, pdf: DataFrame) -> DataFrame:
    """doc_id, kind, blocks, full_text of extracted paragraphs (doc_id, paragraphs) and pages (doc_id, pages)."""
    both = docx.select("doc_id", F.lit("docx").alias("kind"), F.col("paragraphs").alias("raw")).unionByName(pdf.select("doc_id", F.lit("pdf").alias("kind"), F.col("pages").alias("raw")))
    blocks = F.transform("raw", lambda b: normalize_text(F.when(F.col("kind") == "pdf", page_cleanup(b)).otherwise(b)))
    return both.select("doc_id", "kind", blocks.alias("blocks")).withColumn("full_text", join_blocks(F.col("blocks"), F.col("kind")))
