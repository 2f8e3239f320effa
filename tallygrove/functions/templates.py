"""Texts with places to fill: every match of a pattern is replaced once, from left to right, and what was put in is not looked at again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.text import col

# Fixed value: the place of an element in a body.
ELEMENT = r"\[\[\[CONTENT-ELEMENT-(\d+)\]\]\]"


def replaced(x, pattern: str, by: Callable[[Column], Column]) -> Column:
    """The text with by(match) for every match of the pattern, which matches no empty text; null gives nothing."""
    between, found = F.split(col(x), pattern, -1), F.regexp_extract_all(col(x), F.lit(pattern), F.lit(0))
    pieces = F.transform(F.arrays_zip(between.alias("b"), found.alias("m")), lambda p: F.concat(p["b"], F.coalesce(by(p["m"]), F.lit(""))))
    return F.array_join(pieces, "")


def filled(x, contents: Column, pattern: str = ELEMENT) -> Column:
    """The text with contents (a map by the pattern's first group, as text) in its places; places without content go."""
    return replaced(x, pattern, lambda m: F.try_element_at(contents, F.regexp_extract(m, pattern, 1)))


def local_media(x, pattern: str, folder: str) -> Column:
    """HTML in which the address (first group) of every match is folder and its SHA-1."""

    def local(m):
        address = F.regexp_extract(m, pattern, 1)
        return F.replace(m, address, F.concat(F.lit(folder), F.sha1(address)))

    return replaced(x, pattern, local)
