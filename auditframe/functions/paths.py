"""Functions over file paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import lookup


def file_name(path: Column) -> Column:
    """Last component of the path."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for names such as ``.profile``."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def detect_language(path: Column, table: Mapping[str, str] = vocab.EXTRACTOR_LANGUAGES,
                    default: str | None = "unknown") -> Column:
    """Language by file extension, through one of the tables in ``vocab``."""
    return lookup(extension(path), table, F.lit(default).cast("string"))


def is_code_file(path: Column, extensions: Sequence[str] = vocab.RISK_CODE_EXTENSIONS) -> Column:
    """Whether the extension is one that risk scans treat as code."""
    return extension(path).isin(*extensions)


def in_directory(path: Column, names: Sequence[str]) -> Column:
    """Whether any directory on the path carries one of ``names``."""
    choices = "|".join(n.replace(".", r"\.") for n in names)
    return F.rlike(path, F.lit(rf"(^|/)({choices})/"))
