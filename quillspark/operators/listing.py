"""Document listing: filter, sort, keyset cursor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.analysis import word_count

DEFAULT_PAGE, MAX_PAGE = 50, 200
SEPARATOR = "\x1f"


def sort_key(sort: str) -> Column:
    if sort == "title":
        return F.lower("title")
    if sort in ("created", "size"):
        return F.lpad(F.col(sort).cast("string"), 20, "0")
    return F.col("id")


def doc_info(docs: DataFrame) -> DataFrame:
    return docs.select("id", "title", word_count(F.col("body")).cast("long").alias("words"), "format", "size", "created", "updated", "file")


def listing(docs: DataFrame, sort: str = "id", desc: bool = False, after: str | None = None, fmt: str = "", size: int = DEFAULT_PAGE) -> DataFrame:
    """One more row than the page, in order, with its sort ``key``; words are counted for these rows alone."""
    d = (docs.where(F.col("format") == fmt) if fmt else docs).withColumn("key", sort_key(sort))
    if after:
        key, _, last = after.partition(SEPARATOR) if SEPARATOR in after and sort != "id" else (after, "", after)
        at, bound = F.struct("key", "id"), F.struct(F.lit(key).alias("key"), F.lit(last).alias("id"))
        d = d.where(at < bound if desc else at > bound)
    size = min(max(size, 1), MAX_PAGE)
    order = [F.desc("key"), F.desc("id")] if desc else [F.asc("key"), F.asc("id")]
    top = d.orderBy(*order).limit(size + 1)
    return top.select(
        "id",
        "title",
        word_count(F.col("body")).cast("long").alias("words"),
        "format",
        "size",
        "created",
        "updated",
        "file",
        "key",
    ).orderBy(*order)


@dataclass
class Page:
    total: int
    docs: list
    next: str | None


def list_docs(docs: DataFrame, sort: str = "id", desc: bool = False, after: str | None = None, fmt: str = "", size: int = DEFAULT_PAGE) -> Page:
    size = min(max(size, 1), MAX_PAGE)
    rows = listing(docs, sort, desc, after, fmt, size).collect()
    total = (docs.where(F.col("format") == fmt) if fmt else docs).count()
    more, rows = len(rows) > size, rows[:size]
    last = rows[-1] if rows and more else None
    return Page(total, rows, (last["id"] if sort == "id" else f"{last['key']}{SEPARATOR}{last['id']}") if last else None)
