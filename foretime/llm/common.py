"""Word rules, row keys, shared files and Arrow batches that the operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foretime.session import shared_folder

#: A word of lower-cased text: bytes outside the ASCII controls, marks and capitals.
LOW_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same rule, and that of white-space words, for SQL functions.
SPACED_WORD_SQL = r"[^\x20\x09-\x0D]+"


def low_words(text: str | None) -> list[bytes]:
    """Words of ``text`` with A-Z lower-cased; none for a null."""
    return LOW_WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, unchanged; none for a null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Rows per Arrow batch of texts.
TEXT_ROWS = 1000


class Interned(dict):
    """Word -> dense number in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def text_key(text: str) -> Column:
    """With the id it names a row; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def with_text(df: DataFrame, text: str) -> DataFrame:
    """``text`` as a string column whatever type an empty table gave it. Texts are long, so
    Arrow batches hold few rows: they bound what a task keeps on both sides of the pipe."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return df if isinstance(df.schema[text].dataType, StringType) else df.withColumn(text, F.col(text).cast("string"))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is written inside; the session's own after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` into the shared folder once and scan it from there: later
    stages see the same rows even if executors are lost meanwhile."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that every executor can reach."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, data: bytes) -> str:
    """Write one file and return its name. The name is new for each attempt of a
    task, so a retried or doubled task never touches a file that is in use."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}"
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python values of the named columns, row by row."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def sized_groups(rows: Iterable[tuple], text_at: int, most_bytes: int) -> Iterator[list[tuple]]:
    """Consecutive rows whose texts have about ``most_bytes``; a longer text is a group alone."""
    group, size = [], 0
    for row in rows:
        n = len(row[text_at] or "")
        if group and size + n > most_bytes:
            yield group
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield group


def same_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
