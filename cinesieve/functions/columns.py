"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, inside lambdas too, where Spark would evaluate it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows it, none for names without one or with a leading dot alone."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def is_progress_line(line: Column) -> Column:
    """Lines of a progress bar: not blank, with a percentage before a bar."""
    return (F.trim(line) != "") & line.rlike(r"\d+%\|")


def data_uri(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def exactly_rounded(x: Column, digits: int) -> Column:
    """x to `digits` (0 to 6) decimals by the exact value of the double, ties to even; for absolute values under 1024.

    The double is taken apart into three integers of 31 bits and more, so that x * 2**93 and its distance from the middle
    of two decimals are integers that a decimal column holds. NaN and null give null.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits are 0 to 6")
    whole = lambda v: F.floor(v).cast("decimal(38,0)")
    unit = F.lit(2.0**31)

    def of(a: Column) -> Column:
        first = a * unit
        second = (first - F.floor(first)) * unit
        third = (second - F.floor(second)) * unit
        wide = F.lit(1 << 31).cast("decimal(10,0)")
        scaled = ((whole(first) * wide).cast("decimal(38,0)") + whole(second)).cast("decimal(38,0)")
        scaled = ((scaled * wide).cast("decimal(38,0)") + whole(third)).cast("decimal(38,0)")
        low = F.floor(a * 10.0**digits)
        times = lambda v, n: (v * F.lit(str(n)).cast("decimal(38,0)")).cast("decimal(38,0)")
        # x * 10**digits against low + 1/2, both in units of 2**-93
        middle = times((2 * low + 1).cast("decimal(38,0)"), 1 << 92)
        value = times(scaled, 10**digits)
        up = (value > middle) | ((value == middle) & (low % 2 == 1))
        return (low + up.cast("int")).cast("double") / 10.0**digits

    return F.when(F.abs(x) < 1024, F.signum(x) * let(F.abs(x), of))


def fixed(x: Column, digits: int) -> Column:
    """x with `digits` decimals, rounded as exactly_rounded does."""
    return F.format_string(f"%.{digits}f", exactly_rounded(x, digits))


def percent(x: Column) -> Column:
    return F.concat(fixed(x, 1), F.lit("%"))


def reduction_of_video(raw: Column, final: Column) -> Column:
    """Per cent of frames removed from one video; a video without frames counts as fully reduced."""
    return (1 - final / F.greatest(raw, F.lit(1))) * 100


def reduction_of_batch(raw: Column, unique: Column) -> Column:
    """Per cent of frames removed from a batch, to one decimal; 0 without frames."""
    return F.when(raw == 0, F.lit(0.0)).otherwise(exactly_rounded(100.0 * (raw - unique) / raw, 1))
