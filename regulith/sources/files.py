"""Documents from text, PDF and Word files.

Plain text is read by Spark itself, with any line ends as \\n; the others go through Python.
A file that can't be read gives a row with its error and a null text, so one bad file
doesn't end a scan; ``readable`` and ``errors`` part them. Ids are a hash of the path.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .pdf import pdf_bytes, pdf_text

SUFFIXES = (".txt", ".pdf", ".docx")
#: Bytes or characters of results that are Python objects at once.
PART = 4 << 20
#: Characters that XML can't hold as they are, but for line ends.
NOT_XML = re.compile("[\x00-\t\x0b-\x1f&<>\ud800-\udfff\ufffe\uffff]")
WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Text of the body's paragraphs, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{WORD_SPACE}body")
    marks = {f"{WORD_SPACE}tab": "\t", f"{WORD_SPACE}br": "\n", f"{WORD_SPACE}cr": "\n"}
    lines = []
    for paragraph in body.findall(f"{WORD_SPACE}p"):
        lines.append("".join((x.text or "") if x.tag == f"{WORD_SPACE}t" else marks.get(x.tag, "") for x in paragraph.iter()))
    return "\n".join(lines)


def docx_bytes(body: str) -> bytes:
    """A Word file with a paragraph for each line. Characters that XML can't hold become U+FFFD."""
    marks = {"\t": "</w:t><w:tab/><w:t xml:space=\"preserve\">", "&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"}
    held = NOT_XML.sub(lambda m: marks.get(m[0], "\ufffd"), body)
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{line}</w:t></w:r></w:p>' for line in held.split("\n"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD_SPACE.strip("{}")}"><w:body>{lines}</w:body></w:document>')
    return packed.getvalue()


def _array(rows: Iterable, kind: pa.DataType, size: Callable[[object], int]) -> pa.Array:
    """Rows as an Arrow array, taken over in parts of some MB: no more of them than that are Python objects at once."""
    parts, some, n = [], [], 0
    for row in rows:
        some.append(row)
        n += size(row)
        if n >= PART:
            parts.append(pa.array(some, kind))
            some, n = [], 0
    return pa.concat_arrays([*parts, pa.array(some, kind)])


def _read(path: str, data: bytes) -> tuple[str | None, str | None]:
    kind = path[path.rfind(".") :].lower()
    try:
        return {".docx": docx_text, ".pdf": pdf_text}[kind](data), None
    except Exception as e:  # noqa: BLE001  one bad file mustn't end the scan
        return None, f"{type(e).__name__}: {e}"


def suffix(path: Column) -> Column:
    """The lower-cased end of a path's name from its last dot on; "" without one."""
    return F.lower(F.regexp_extract(path, r"\.[^./]*\z", 0))


def decoded(files: DataFrame) -> DataFrame:
    """The files (path, content, and any other columns) with their text, or with the error of those that can't be read.

    Plain text stays in expressions; only Word and PDF contents go to Python, one file after the other. A file of
    another kind, or one whose bytes don't make sense, is a row with an error.
    """
    kind, raw = suffix(F.col("path")), F.col("content").cast("string")
    plain = kind == ".txt"

    def run(paths: pa.Array, contents: pa.Array) -> pa.Array:
        done = (_read(p.as_py(), d.as_py()) if d.is_valid else (None, None) for p, d in zip(paths, contents))
        kind = pa.struct([("text", pa.string()), ("error", pa.string())])
        return _array(({"text": t, "error": e} for t, e in done), kind, lambda r: 100 + len(r["text"] or ""))

    packed = F.arrow_udf(run, "struct<text: string, error: string>")(F.col("path"), F.when(kind.isin(".docx", ".pdf"), F.col("content")))
    bad = F.when(plain & ~F.is_valid_utf8(raw), "UnicodeDecodeError: not UTF-8").when(~kind.isin(*SUFFIXES), F.concat(F.lit("ValueError: Unsupported file type: "), kind))
    body = F.when(plain, F.regexp_replace(F.try_validate_utf8(raw), "\r\n?", "\n"))
    told = files.withColumn("__packed", packed).withColumns({"text": F.coalesce(body, F.col("__packed.text")), "error": F.coalesce(bad, F.col("__packed.error"))})
    return told.drop("content", "__packed")


def rendered(docs: DataFrame, kind: Column, name_col: str = "title", text_col: str = "text") -> DataFrame:
    """``docs`` as files: path (the name with the kind, ".txt", ".docx" or ".pdf", behind it) and content take the place of the text; a null text is empty.

    Of another kind, the content is the text's bytes.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))

    def run(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        write = {".docx": docx_bytes, ".pdf": pdf_bytes}
        return _array((write[k.as_py()](t.as_py()) if t.is_valid else None for k, t in zip(kinds, texts)), pa.binary(), lambda b: 100 + len(b or b""))

    packed = F.arrow_udf(run, "binary")(F.col("__kind"), F.when(F.col("__kind").isin(".docx", ".pdf"), body))
    files = docs.withColumn("__kind", kind).withColumn("content", F.coalesce(packed, body.cast("binary"))).withColumn("path", F.concat(F.col(name_col), "__kind"))
    return files.drop("__kind", text_col)


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt", jurisdiction: str = "Unknown") -> DataFrame:
    """doc_id, title, doc_type, source, jurisdiction, text, error of a file, or of a folder's files that match (not of its subfolders')."""
    single = _is_file(spark, path)
    name = path if single else pattern
    if not name.lower().endswith(SUFFIXES):
        raise ValueError(f"Unsupported file type: {name}")
    reader = spark.read.format("binaryFile")
    files = reader.load(path) if single else reader.option("pathGlobFilter", pattern).load(path)
    read = decoded(files.select("path", "content")).withColumnRenamed("path", "source")
    name = F.element_at(F.split("source", "/"), -1)
    return read.select(
        F.xxhash64("source").alias("doc_id"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"), text.document_type(F.col("text")).alias("doc_type"),
        "source", F.lit(jurisdiction).alias("jurisdiction"), "text", "error",
    )


def from_texts(spark: SparkSession, texts: list[str], doc_type: str = "unknown", title: str = "Untitled", source: str = "unknown", jurisdiction: str | None = None) -> DataFrame:
    return spark.createDataFrame([(i, title, doc_type, source, jurisdiction, t, None) for i, t in enumerate(texts)], "doc_id long, title string, doc_type string, source string, jurisdiction string, text string, error string")


def readable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("error").isNull()).drop("error")


def errors(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("error").isNotNull()).select("source", "error")


def non_blank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.where(F.rlike(text_col, F.lit(r"(?U)\S")))
