"""Uploaded files as tables: text, table rows, sheets, pages; which kinds are taken and how large."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import trimmed
from ..operators.chunking import csv_rows

MB = 1 << 20
# fixed values: MIME type -> extension, kind, most bytes
KINDS = {
    "application/pdf": ("pdf", "PDF", 200 * MB),
    "text/csv": ("csv", "CSV", 50 * MB),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("docx", "DOCX", 200 * MB),
    "application/msword": ("doc", "DOCX", 200 * MB),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("xlsx", "XLSX", 50 * MB),
    "application/vnd.ms-excel": ("xls", "XLSX", 50 * MB),
    "text/plain": ("txt", "TXT", 50 * MB),
    "application/json": ("json", "JSON", 50 * MB),
    "image/png": ("png", "IMAGE", 20 * MB),
    "image/jpeg": ("jpg", "IMAGE", 20 * MB),
    "image/webp": ("webp", "IMAGE", 20 * MB),
    "image/gif": ("gif", "IMAGE", 20 * MB),
}
DEFAULT_MOST = 50 * MB


def kinds(spark: SparkSession) -> DataFrame:
    """(mime, ext, kind, most_bytes): twelve rows to join uploads with."""
    return spark.createDataFrame([(m, *k) for m, k in KINDS.items()], "mime string, ext string, kind string, most_bytes long")


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """uploads (mime, file_size) with their kind and whether they are taken, or why not."""
    out = uploads.join(F.broadcast(kinds(uploads.sparkSession)), "mime", "left")
    reason = F.when(F.col("kind").isNull(), "type").when(F.col("file_size") > F.coalesce("most_bytes", F.lit(DEFAULT_MOST)), "size")
    return out.withColumn("refused", reason)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each text, JSON or CSV file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def csv_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files without their text, with (columns, row, line) for each line that isn't blank."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, csv_rows(F.col(text)).alias("csv")).select(*rest, "csv.columns", F.explode("csv.rows").alias("r")).select(*rest, "columns", "r.row", F.col("r.text").alias("line"))


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def _per_file(files: DataFrame, one, schema: str, types: pa.Schema) -> DataFrame:
    """Rows of each file, or one row with the error that it gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = [{"path": path, **r, "error": None} for r in one(content)]
                except (zipfile.BadZipFile, KeyError, ValueError, SyntaxError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return files.select("path", "content").mapInArrow(run, schema)


def _types(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema([("path", pa.string()), *kinds.items(), ("error", pa.string())])


_BREAK = re.compile(r"<[^>]*(?:lastRenderedPageBreak|w:br\b[^>]*type=\"page\")[^>]*>")
_TEXT = re.compile(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|(</w:p>)", re.S)


def docx_pages(content: bytes) -> list[dict]:
    """(page, text) of a document's pages; blank pages count but give no row, entities stay as written."""
    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "replace")
    out = []
    for number, part in enumerate(_BREAK.split(xml), 1):
        text = "".join("\n" if m[2] else m[1] for m in _TEXT.finditer(part)).strip()
        if text:
            out.append({"page": number, "text": text + "\n"})
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(binaries(spark, path, "*.docx"), docx_pages, "path string, page int, text string, error string", _types(page=pa.int32(), text=pa.string()))


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_sheets(content: bytes) -> list[dict]:
    """(sheet, sheet_no, row, text): rows of each sheet as comma-separated text, blank ones left out."""
    import xml.etree.ElementTree as ET

    z = zipfile.ZipFile(io.BytesIO(content))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for no, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns), 1):
        rows: dict[int, dict[int, str]] = {}
        for cell in ET.fromstring(z.read("xl/" + targets[sheet.get(rel)].removeprefix("/xl/"))).iter(f"{{{ns['m']}}}c"):
            v = cell.find("m:v", ns)
            kind = cell.get("t")
            value = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else "" if v is None else shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text or ""
            ref = cell.get("r")
            rows.setdefault(int(re.search(r"\d+", ref)[0]), {})[_column_number(ref)] = f'"{value.replace(chr(34), chr(34) * 2)}"' if re.search('[,"\n]', value) else value
        width = max((max(r) for r in rows.values()), default=0)
        for number in sorted(rows):
            text = ",".join(rows[number].get(i, "") for i in range(1, width + 1))
            if text.strip(","):
                out.append({"sheet": sheet.get("name"), "sheet_no": no, "row": number, "text": text})
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(binaries(spark, path, "*.xlsx"), xlsx_sheets, "path string, sheet string, sheet_no int, row int, text string, error string", _types(sheet=pa.string(), sheet_no=pa.int32(), row=pa.int32(), text=pa.string()))


# fixed values: the labels that a model is asked to put before the parts of its answer
LABELS = ("DESCRIPTION", "TAGS", "TEXT")


def image_text(answer: Column) -> Column:
    """(description, tags, visible_text, content) from a vision model's labelled answer."""
    part = lambda pattern: trimmed(F.regexp_extract(answer, f"(?s){pattern}", 1))
    first, second, third = LABELS
    labelled = rf"{first}:\s*(.+?)(?=\n{second}:)"
    description = F.when(answer.rlike(f"(?s){labelled}"), part(labelled)).otherwise(trimmed(answer))
    listed, visible = part(rf"{second}:\s*(.+?)(?=\n{third}:)"), part(rf"{third}:\s*(.+)")
    tags = F.filter(F.transform(F.split(listed, ","), trimmed), lambda x: x != "")
    seen = F.when((visible != "") & (visible != "None"), visible)
    content = F.concat_ws("\n\n", description, F.concat(F.lit("Visible text: "), seen), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))
    return F.struct(description.alias("description"), tags.alias("tags"), seen.alias("visible_text"), content.alias("content"))


def extracted(files: DataFrame) -> DataFrame:
    """(data_source_id, kind, part, text, columns) of files (data_source_id, mime, text, pages, answer), each by its kind.

    What comes from outside the engine comes as columns: pages (page, text) of PDF, DOCX and XLSX files, answer of a
    vision model. A CSV file gives its lines by number with the head's columns, a text or JSON file itself as part 0, an
    image its description. Other kinds give nothing. One pass: every row takes the branch of its kind.
    """
    f = files.join(F.broadcast(kinds(files.sparkSession).select("mime", "kind")), "mime")
    none = F.array().cast("array<string>")
    part = lambda number, text, columns=none: F.struct(number.cast("int").alias("part"), text.alias("text"), columns.alias("columns"))
    csv = csv_rows(F.col("text"))
    parts = (
        F.when(F.col("kind") == "CSV", F.transform(csv["rows"], lambda r: part(r["row"], r["text"], csv["columns"])))
        .when(F.col("kind").isin("TXT", "JSON"), F.array(part(F.lit(0), F.col("text"))))
        .when(F.col("kind") == "IMAGE", F.array(part(F.lit(0), image_text(F.col("answer"))["content"])))
        .otherwise(F.transform("pages", lambda p: part(p["page"], p["text"])))
    )
    return f.select("data_source_id", "kind", F.explode(parts).alias("p")).select("data_source_id", "kind", "p.*").where(F.col("text").isNotNull())
