"""Documents from tables and files: title split, JSON defaults, txt, docx and pdf extraction, downloads."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import files
from quillspark.sources.extraction import MAX_TITLE, WHITE, Parser, clean_pdf_text, docx_text, extract, extract_limited, split_name  # noqa: F401

#: Characters of the texts that a task gives back at once.
OUT_CHARS = 4 << 20
DOC_SCHEMA = "id string, title string, body string, format string, size long, created long, updated long, file boolean"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))  # the same white space as in extracted files


def split_title(text: Column, fallback: Column) -> tuple[Column, Column]:
    """(title, body): the first line, unless it is too long; then the fallback and the whole text."""
    t = _trim(F.coalesce(text, F.lit("")))
    first = _trim(F.substring_index(t, "\n", 1))
    long = F.char_length(first) > MAX_TITLE
    rest = _trim(F.when(F.instr(t, "\n") > 0, F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise(F.lit("")))
    return F.when(long, fallback).otherwise(first), F.when(long, t).otherwise(rest)


def from_table(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """A table's texts as documents."""
    key = F.col(id_column).cast("string")
    title, body = split_title(F.col(text), key)
    return rows.select(
        key.alias("id"),
        title.alias("title"),
        body.alias("body"),
        F.lit("txt").alias("format"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
        F.lit(0).cast("long").alias("created"),
        F.lit(0).cast("long").alias("updated"),
        F.lit(False).alias("file"),
    )


def with_defaults(docs: DataFrame, now: int) -> DataFrame:
    """Ingest defaults: created, format and size where they are zero or empty."""
    size = F.octet_length("title") + 1 + F.octet_length("body")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return docs.select(
        "id",
        "title",
        "body",
        F.when(F.coalesce("format", F.lit("")) == "", "txt").otherwise(F.col("format")).alias("format"),
        F.when(zero("size"), size).otherwise(F.col("size")).cast("long").alias("size"),
        F.when(zero("created"), F.lit(now)).otherwise(F.col("created")).cast("long").alias("created"),
        F.coalesce("updated", F.lit(0)).cast("long").alias("updated"),
        F.coalesce("file", F.lit(False)).alias("file"),
    )


def read_json(spark: SparkSession, path: str, now: int) -> DataFrame:
    return with_defaults(spark.read.schema(DOC_SCHEMA).json(path), now)


def read_txt_folder(spark: SparkSession, path: str) -> DataFrame:
    """Bulk load of the txt files of a folder, see :func:`parse_txt`."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    if empty := files.empty_files(spark, path, ".txt"):
        found = found.union(spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary"))
    return parse_txt(found)


def parse_txt(rows: DataFrame) -> DataFrame:
    """(path, content): id is the file's stem, the first line the title, the rest the body; nothing else is checked."""
    text = F.decode("content", "UTF-8")
    line = F.instr(text, "\n")
    stem = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    return rows.select(
        stem.alias("id"),
        _trim(F.substring_index(text, "\n", 1)).alias("title"),
        F.when(line > 0, _trim(F.substring(text, line + 1, F.length(text)))).otherwise("").alias("body"),
        F.lit("txt").alias("format"),
        F.octet_length("content").cast("long").alias("size"),
        F.lit(0).cast("long").alias("created"),
        F.lit(0).cast("long").alias("updated"),
        F.lit(False).alias("file"),
    )


def extract_files(files: DataFrame) -> DataFrame:
    """(path, content) to documents with an ``error`` column; docx and pdf are parsed in limited child processes."""

    columns = ["path", "id", "title", "body", "format", "size", "error"]

    def run(batches):
        with Parser() as parser:
            for pdf in batches:
                rows, held = [], 0
                for p, c in zip(pdf["path"], pdf["content"], strict=True):
                    rows.append(dict.fromkeys(columns) | {"path": p} | parser.extract(p, bytes(c)))
                    held += len(rows[-1]["body"] or "")
                    if held > OUT_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(
        run,
        "path string, id string, title string, body string, format string, size long, error string",
    )


def upload(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, id, status, error): indexed, exists (already known, or earlier in the batch) or error."""
    from pyspark.sql import Window as W

    got = extract_files(files).join(existing.select(F.col("id").alias("known")).distinct(), F.col("id") == F.col("known"), "left")
    first = F.row_number().over(W.partitionBy("id").orderBy("path"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("known").isNotNull() | (F.col("nth") > 1), "exists").otherwise("indexed")
    return got.withColumn("nth", first).select("path", "id", status.alias("status"), "error")


def download_text() -> Column:
    """What a download gives for a document without an original file."""
    return F.concat(F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n"))


# Media types by format.
MEDIA_TYPES = {
    "txt": "text/plain; charset=utf-8",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def content_disposition(name: str) -> str:
    plain = re.sub(r"[^0-9A-Za-z.\-_ ]", "_", name)
    return f"attachment; filename=\"{plain}\"; filename*=UTF-8''{quote(name, safe='')}"
