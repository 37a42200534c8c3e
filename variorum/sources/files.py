"""Readers of the formats that editions come in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charsets import detect

#: Limits of a file unless others are given.
MOST_BYTES, MOST_CHARS = 10 << 20, 100_000
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _decode(data: bytes) -> str | None:
    found = detect(data)
    return found and found[1].strip()


def _docx(data: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = ("".join(t.text or "" for t in p.iter(_WORD + "t")).strip() for p in root.iter(_WORD + "p"))
    return "\n".join(x for x in lines if x)


def _tei(data: bytes) -> str | None:
    """The body's running text without notes."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return None
    skipped = {"note", "teiHeader", "back"}

    def walk(x) -> Iterator[str]:
        if x.tag.rpartition("}")[2] not in skipped:
            yield x.text or ""
            for child in x:
                yield from walk(child)
                yield child.tail or ""

    body = next((x for x in root.iter() if x.tag.rpartition("}")[2] == "body"), None)
    return "".join(walk(body)).strip() if body is not None else None


_READERS = {"txt": _decode, "md": _decode, "docx": _docx, "xml": _tei}


def witnesses(spark: SparkSession, path: str, most_bytes: int | None = MOST_BYTES, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """name (file stem), kind, text and error of txt, md, docx and TEI files below path. Files beyond the limits (None: no limit), of unknown kinds or that cannot be read have a null text and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select(name.alias("name"), kind.alias("kind"), (F.col("content") if most_bytes is None else F.when(F.col("length") <= most_bytes, F.col("content"))).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, error = None, None
                if data is None:
                    error = "too large"
                elif kind not in _READERS:
                    error = "unknown kind"
                else:
                    text = _READERS[kind](data)
                    if text is None:
                        error = "unreadable"
                    elif most_chars is not None and len(text) > most_chars:
                        text, error = None, "too long"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["name", "kind", "text", "error"])

    return rows.mapInArrow(run, "name string, kind string, text string, error string")


PROJECT = "id string, title string, type string, status string, updated_at timestamp, data string"


def projects(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """One JSON file a project, newest first."""
    p = spark.read.schema(PROJECT).option("multiLine", "true").json(path)
    if status is not None:
        p = p.where(F.col("status") == status)
    return p.orderBy(F.desc("updated_at"), "id")
