"""Names, codes and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _found(c: Column, what: str) -> Column:
    return F.nullif(F.instr(c, what), F.lit(0))


def short_name(c: Column) -> Column:
    """Text before the first hyphen, else before the first comma; NULL with neither."""
    return F.substring(c, F.lit(1), F.coalesce(_found(c, "-"), _found(c, ",")) - 1)


def city_part(c: Column) -> Column:
    """Text before the first comma."""
    return F.substring(c, F.lit(1), _found(c, ",") - 1)


def state_part(c: Column) -> Column:
    """Text from two characters after the first comma."""
    return F.substring(c, _found(c, ",") + 2, F.length(c))


def display_name(c: Column) -> Column:
    """City with its hyphens spaced out (double ones if it has any, else single ones), then the state."""
    city = city_part(c)
    dash = F.lit(" – ")
    spaced = F.when(F.contains(city, F.lit("--")), F.replace(city, F.lit("--"), dash)) \
        .otherwise(F.replace(city, F.lit("-"), dash))
    return F.concat(spaced, F.lit(", "), state_part(c))


def wrapped_name(c: Column) -> Column:
    """Display name broken into lines at the hyphens."""
    return F.replace(display_name(c), F.lit(" – "), F.lit("/\n"))


def fips5(c: Column) -> Column:
    """Last five characters after putting two zeros in front."""
    return F.right(F.concat(F.lit("00"), c), F.lit(5))


def strip_first(c: Column, pattern: str) -> Column:
    """Remove the first match of a pattern."""
    return F.regexp_replace(c, f"^(.*?)(?:{pattern})(.*)$", "$1$2")


def split_at_end(c: Column, n: int) -> tuple[Column, Column]:
    """Text without its last ``n`` characters (trimmed), and those last ``n`` (trimmed)."""
    return (
        F.trim(F.substring(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))),
        F.trim(F.right(c, F.lit(n))),
    )


def ranked_label(rank: Column, *parts: Column) -> Column:
    """``"3. Name, Country"``; a missing part leaves the whole label NULL."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit(", "), part]
    return F.concat(rank.cast("string"), F.lit(". "), *pieces)


def spaced_hyphens(c: Column) -> Column:
    """A blank after every hyphen, double hyphens kept together."""
    return F.replace(F.replace(c, F.lit("-"), F.lit("- ")), F.lit("- - "), F.lit("-- "))
