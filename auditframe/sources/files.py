"""File trees: source code and documents, one row per file."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.paths import extension, file_name, in_directory
from auditframe.functions.text import document_title


def _suffix_glob(extensions: Sequence[str]) -> str:
    """A file-name glob matching the suffixes in any letter case."""
    def either_case(suffix: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)

    return "*{" + ",".join(either_case(e) for e in extensions) + "}"


def _below(path: Column, root: str) -> Column:
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).strip("/")
    return F.regexp_replace(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*\Q" + bare + r"\E/", "")


def _utf8_text(content: Column) -> Column:
    """Bytes as text: undecodable bytes dropped, line ends unified to ``\\n``."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def _scan(spark: SparkSession, root: str, extensions: Sequence[str] | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", _suffix_glob(extensions))
    return reader.load(root)


def scan_source_files(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] | None = None,
    skip_dirs: Sequence[str] = vocab.SKIP_DIRECTORIES,
) -> DataFrame:
    """Read a source tree: path (below ``root``), extension, size, content.

    Files of any size are read. Suffixes are matched while listing, and a
    condition on the file's path leaves out skipped directories before any of
    their files is opened.
    """
    files = _scan(spark, root, extensions)
    path = _below(F.col("path"), root)
    if skip_dirs:
        listed = _below(F.col("_metadata.file_path"), root)
        files = files.where(~in_directory(listed, skip_dirs)).where(~in_directory(path, skip_dirs))
    return files.select(
        path.alias("path"),
        extension(path).alias("extension"),
        F.col("length").alias("size"),
        _utf8_text(F.col("content")).alias("content"),
    )


def scan_documents(spark: SparkSession, root: str, extensions: Sequence[str] = vocab.DOCUMENT_EXTENSIONS) -> DataFrame:
    """Read text documents of any size: path, type, title, content, metadata."""
    files = _scan(spark, root, extensions)
    texts = files.select("path", "length", _utf8_text(F.col("content")).alias("content"))
    return texts.select(
        "path",
        F.substring(extension(F.col("path")), 2, 16).alias("type"),
        document_title(F.col("content")).alias("title"),
        "content",
        F.create_map(
            F.lit("file_size"), F.col("length").cast("string"), F.lit("file_name"), file_name(F.col("path"))
        ).alias("metadata"),
    )


def redact_documents(docs: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """Redact document content."""
    from auditframe.functions.text import redact

    return docs.withColumn("content", redact(F.col("content"), patterns))
