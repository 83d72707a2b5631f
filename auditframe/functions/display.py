"""Human-readable sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions.columns import fixed


def format_bytes(size: Column) -> Column:
    """Size with one decimal place in the largest unit below 1024."""
    value = size.cast("double")
    chain = None
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scaled = value / float(1024**power)
        text = F.concat(fixed(scaled, 1), F.lit(f" {unit}"))
        chain = F.when(scaled < 1024.0, text) if chain is None else chain.when(scaled < 1024.0, text)
    return chain.otherwise(F.concat(fixed(value / float(1024**5), 1), F.lit(" PB")))


def format_duration(ms: Column) -> Column:
    """Milliseconds as ``ms``, ``s``, ``m`` or ``h``."""
    value = ms.cast("double")
    return (
        F.when(value < 1000, F.concat(fixed(value, 0), F.lit("ms")))
        .when(value < 60000, F.concat(fixed(value / 1000, 1), F.lit("s")))
        .when(value < 3600000, F.concat(fixed(value / 60000, 1), F.lit("m")))
        .otherwise(F.concat(fixed(value / 3600000, 1), F.lit("h")))
    )
