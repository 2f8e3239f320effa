"""JSON that stands inside other text: the object or list that begins behind a marker, cut where its brackets balance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.text import col

# strings as a whole (what they hold opens and closes nothing), brackets, and runs of anything else; possessive, so long texts need no stack
PIECES = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]|[^\[\]{}"]++|"'


def behind(x, marker: str, opening: str = "{") -> Column:
    """The text from the first opening bracket behind the marker on; null if either is missing."""
    rest = F.substr(col(x), F.nullif(F.instr(col(x), F.lit(marker)), F.lit(0)) + len(marker))
    return F.substr(rest, F.nullif(F.instr(rest, F.lit(opening)), F.lit(0)))


def balanced(x) -> Column:
    """The shortest beginning of a text whose brackets balance, from its first bracket on; null if they never do.

    The depth behind each piece is a running sum of the brackets up to it, strings left out; the first zero ends the object. Kinds of brackets are not told apart.
    """
    pieces = F.regexp_extract_all(col(x), F.lit("(?s)" + PIECES), F.lit(0))
    step = lambda p: F.when(p.isin("{", "["), 1).when(p.isin("}", "]"), -1).otherwise(0)
    state = lambda depth, length, done: F.struct(depth.cast("int").alias("depth"), length.cast("int").alias("length"), done.alias("done"))

    def read(a, p):
        depth = a["depth"] + step(p)
        return F.when(a["done"], a).otherwise(state(depth, a["length"] + F.length(p), (step(p) == -1) & (depth <= 0)))

    end = F.aggregate(pieces, state(F.lit(0), F.lit(0), F.lit(False)), read, lambda a: F.when(a["done"] & (a["depth"] == 0), a["length"]))
    return F.when(end.isNotNull(), F.substr(col(x), F.lit(1), end))


def embedded_json(x, marker: str, opening: str = "{") -> Column:
    """The balanced text behind a marker, if it is JSON; null otherwise."""
    found = balanced(behind(x, marker, opening))
    return F.when(F.try_parse_json(found).isNotNull(), found)
