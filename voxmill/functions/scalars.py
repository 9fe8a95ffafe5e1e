"""Scalar helpers on names, lists and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_lists() -> list[Column]:
    """A csv of two part columns read as integers and summed after adding one; the same list written as csv."""
    text = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    numbers = F.transform(F.split(text, ","), lambda v: v.cast("int") + 1)
    return [F.aggregate(numbers, F.lit(0), lambda a, v: a + v).alias("total"), F.array_join(numbers.cast("array<string>"), ",").alias("csv")]


def remove_extension(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")


def simple_pattern(pattern: Column) -> Column:
    """A data-set pattern without wildcards, parentheses, backslashes, ``.tif`` and dashes at its ends."""
    return F.regexp_replace(F.regexp_replace(pattern, r"\.\*|[()\\]|\.tif", ""), "^(--)+|(--)+$", "")


def slice_label(name: Column, class_id: Column) -> Column:
    return F.concat(F.substring_index(name, ".", 1), F.lit("-"), class_id.cast("string"))


def channels(mask: Column) -> Column:
    """Numbers of the set bits among the low eight, as csv."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("shiftright", mask, b).bitwiseAND(F.lit(1)) == 1)
    return F.array_join(bits.cast("array<string>"), ",")


def range_bounds(text: Column, margin: int, low: int, high: int) -> tuple[Column, Column]:
    """First and last plane of a text like "3,7", widened by ``margin`` on both sides and kept inside low..high."""
    ends = F.split(text, ",")
    first, last = (F.trim(F.get(ends, i)).cast("int") for i in (0, 1))
    return F.greatest(F.lit(low), first - margin).alias("low"), F.least(F.lit(high), last + margin).alias("high")


def label_key(class_id: str, t: str, z: str, label: str) -> Column:
    """Key of a label in reviews; frames and planes count from 1."""
    return F.concat(F.lit("c"), F.col(class_id), F.lit("-t"), F.col(t) + 1, F.lit("-z"), F.col(z) + 1, F.lit("-i"), F.col(label))
