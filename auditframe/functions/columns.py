"""Small building blocks shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() sees it: Unicode white space plus four separators.
_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda body is evaluated per element, so an expensive expression that is
    merely referenced there would run again for every element.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind, line ends included."""
    return F.regexp_replace(col, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def first_group(col: Column, pattern: str, group: int = 1) -> Column:
    """The captured group of the first match, NULL where nothing matches.

    Dropping the empty text from a one-element array runs the pattern once,
    where ``nullif`` would run it twice.
    """
    return F.get(F.array_remove(F.array(F.regexp_extract(col, pattern, group)), ""), F.lit(0))


def all_groups(col: Column, pattern: str, group: int = 1) -> Column:
    """The captured group of every match, in order."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def lookup(col: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Translate a column through a small constant table."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)


def fixed(col: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounded from the exact binary value.

    ``format_number`` rounds half to even on the exact value of the double,
    which ``round`` and ``format_string`` do not.
    """
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def round_exact(col: Column, digits: int) -> Column:
    """Round a double from its exact binary value (2.675 becomes 2.67)."""
    return F.coalesce(fixed(col, digits).try_cast("double"), col)


def title_case(col: Column) -> Column:
    """Capitalise every run of letters (``o_neil`` becomes ``O_Neil``)."""
    runs = all_groups(F.lower(col), r"(\p{L}+|\P{L}+)")
    return F.array_join(F.transform(runs, F.initcap), "")


def sort_key(*cols: Column) -> Column:
    """Order-preserving text of non-negative integers, for mixed-source sorting."""
    return F.concat_ws("/", *[F.lpad(c.cast("string"), 19, "0") for c in cols])
