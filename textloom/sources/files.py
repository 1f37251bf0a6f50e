"""Uploaded and stored files as blocks: text, DOCX, PDF; and JSON record sets."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import text_blocks
from textloom.operators.records import settled
from textloom.plans import lexicon as lx

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_upload(content: Column) -> Column:
    """Bytes of strict base64, null where it is none or holds over 12 MiB."""
    strict = (F.length(content) % 4 == 0) & F.rlike(content, F.lit(r"^[A-Za-z0-9+/]*={0,2}\z"))
    raw = F.when(strict, F.try_to_binary(content, F.lit("base64")))
    return F.when(F.octet_length(raw) <= lx.UPLOAD_LIMIT, raw)


def decode_text(content: bytes) -> str:
    """UTF-8, else UTF-16, else Latin-1, which takes any bytes."""
    for name in ("utf-8", "utf-16"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def docx_text(content: bytes) -> str:
    """Paragraphs, then the rows of tables with their cells between bars; parts at blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    parts = [said(p) for p in body.findall(f"{_W}p")]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ["\n".join(said(p) for p in c.findall(f"{_W}p")) for c in row.findall(f"{_W}tc")]
        parts.append(" | ".join(c.strip() for c in cells if c))
    return "\n\n".join(p for p in parts if p)


def pdf_text(content: bytes) -> str:
    """By pdfminer or PyMuPDF, whichever is installed."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError:
        try:
            import fitz
        except ImportError as e:
            raise ValueError("PDF needs pdfminer.six or PyMuPDF") from e
        return "\n\n".join(page.get_text() for page in fitz.open(stream=content, filetype="pdf"))
    return extract_text(io.BytesIO(content))


READERS = {".txt": decode_text, ".docx": docx_text, ".pdf": pdf_text}


def file_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, title (the stem), text, error: each file by its ending. A file that cannot be read gives an error and no failure of the job."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = (name or "").rsplit("/", 1)[-1]
                m = re.fullmatch(r"(.+)(\.[^.]+)", base)
                stem, ending = (m[1], m[2].lower()) if m else (base, "")
                if not base:
                    rows.append((name, stem, None, "missing filename"))
                elif ending not in READERS:
                    rows.append((name, stem, None, f"unsupported file type {ending}"))
                else:
                    try:
                        rows.append((name, stem, READERS[ending](data or b""), None))
                    except Exception as e:  # whatever a broken file does to its reader
                        rows.append((name, stem, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["path", "title", "text", "error"])

    return files.select(path, content).mapInArrow(run, "path string, title string, text string, error string")


def file_blocks(files: DataFrame, **names) -> DataFrame:
    """file_texts with blocks; an error where a file has none."""
    out = file_texts(files, **names).withColumn("blocks", text_blocks(F.col("text")))
    return out.withColumn("error", F.coalesce("error", F.when(F.size("blocks") == 0, "no readable text"))).drop("text")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return file_blocks(spark.read.format("binaryFile").load(path))


_BAND = T.StructType([T.StructField("conditions", T.ArrayType(T.StringType())), T.StructField("advice", T.ArrayType(T.StringType()))])
_KINDS = {f: T.ArrayType(T.StringType()) for f in lx.LIST_FIELDS} | {
    "severity_levels": T.StructType([T.StructField(x, _BAND) for x in ("mild", "moderate", "severe")]),
    "confidence_rules": T.StructType([T.StructField("min_symptoms_match", T.IntegerType()), T.StructField("high_confidence_threshold", T.DoubleType())]),
    "verified": T.BooleanType(),
}
RECORD = T.StructType([T.StructField(f, _KINDS.get(f, T.StringType())) for f in lx.EXPORT_FIELDS])


def with_defaults(data: Column) -> Column:
    """The record with a default for each field that is missing."""
    none = F.array().cast("array<string>")
    band = lambda name: F.struct(*(F.coalesce(data["severity_levels"][name][k], none).alias(k) for k in ("conditions", "advice"))).alias(name)
    given = {f: none for f in lx.LIST_FIELDS} | {"verified": F.lit(False), "category": F.lit(lx.CATEGORY)}
    special = {
        "severity_levels": F.struct(*(band(x) for x in ("mild", "moderate", "severe"))),
        "confidence_rules": F.struct(
            F.coalesce(data["confidence_rules"]["min_symptoms_match"], F.lit(2)).alias("min_symptoms_match"),
            F.coalesce(data["confidence_rules"]["high_confidence_threshold"], F.lit(0.7)).alias("high_confidence_threshold")
        ),
    }
    return F.struct(*(special.get(f, F.coalesce(data[f], given.get(f, F.lit("")))).alias(f) for f in lx.EXPORT_FIELDS))


def strict_json(text: Column) -> Column:
    """The text as a variant, null if it is not one JSON value. The parser passes over what follows a value; inside an array and inside an object, nothing can follow in both."""
    one = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return F.when(one("[", "]") & one('{"v":', "}"), F.try_parse_json(text))


def json_records(files: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    """Records of JSON files: an array, or an object with an array `records`; items that are no objects are left out.

    filename, pos, data, error. Files of another ending, broken JSON and other layouts give a row with an error; so do items
    whose arrays or texts have another type, since from_json would take 5 for '5'."""
    text = F.try_validate_utf8(F.col(content).cast("string")) if files.schema[content].dataType == T.BinaryType() else F.col(content)
    rows = files.select(F.col(name).alias("filename"), text.alias("text")).withColumn("v", strict_json(F.col("text")))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.records", "array<variant>"))
    error = F.when(
        ~F.endswith(F.lower("filename"), F.lit(".json")), "not a .json file"
    ).when(F.col("v").isNull(), "not valid JSON").when(items.isNull(), "neither an array nor an object with records")
    rows = settled(rows.withColumn("error", error), "items", F.when(F.col("error").isNull(), items))
    bad = rows.filter("error is not null").select("filename", F.lit(None).cast("int").alias("pos"), F.lit(None).cast(RECORD).alias("data"), "error")
    one = rows.filter("error is null").select("filename", F.posexplode("items").alias("pos", "item"))
    one = one.filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    lists = [F.schema_of_variant(F.variant_get("item", f"$.{f}", "variant")) for f in lx.LIST_FIELDS]
    wrong = F.lit(False)
    for kind in lists:
        wrong = wrong | ~F.coalesce(F.rlike(kind, F.lit("^ARRAY<(STRING|VOID)>$")), F.lit(True))
    for f in ("title", "description", "source_url", "source", "verified_from", "when_to_seek_doctor", "category"):
        wrong = wrong | (F.coalesce(F.schema_of_variant(F.variant_get("item", f"$.{f}", "variant")), F.lit("STRING")) != "STRING")
    data = with_defaults(F.from_json(F.to_json("item"), RECORD))
    good = one.select("filename", "pos", F.when(~wrong, data).alias("data"), F.when(wrong, "a field has another type").alias("error"))
    return good.unionByName(bad, allowMissingColumns=False)
