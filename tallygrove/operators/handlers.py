"""Script calls in links, resolved to the URLs they lead to: from the page's script, or learned from calls whose landing is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import urls
from tallygrove.functions.text import col

TOKEN = r"[A-Za-z0-9_\-]+|[^A-Za-z0-9_\-]+"
CALL = r"^(?:javascript:\s*)*([A-Za-z_][\w$]*)\s*\((.*)\)"
ARGUMENT = r"'([^']*)'|\"([^\"]*)\"|([\w.\-]+)"


def called(href) -> Column:
    """struct fn, args of a script call; null for other links."""
    inner = F.regexp_extract(col(href), CALL, 2)
    one = lambda k: F.regexp_extract_all(inner, F.lit(ARGUMENT), F.lit(k))
    args = F.transform(F.arrays_zip(one(1).alias("a"), one(2).alias("b"), one(3).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"]))
    return F.when(F.regexp_like(col(href), F.lit(CALL)), F.struct(F.regexp_extract(col(href), CALL, 1).alias("fn"), args.alias("args")))


def abstracted(url, args) -> Column:
    """The URL with {i} for each of its words that is argument i (the first of equal arguments)."""
    place = lambda t: F.array_position(args, t)
    return F.array_join(F.transform(F.regexp_extract_all(col(url), F.lit(TOKEN), F.lit(0)), lambda t: F.when(place(t) > 0, F.concat(F.lit("{"), place(t) - 1, F.lit("}"))).otherwise(t)), "")


def filled(template, args) -> Column:
    """The URL of a template; null if an argument that it names is missing."""
    pieces = F.regexp_extract_all(col(template), F.lit(r"\{[0-9]+\}|[^{]+|\{"), F.lit(0))
    value = lambda p: F.get(args, F.regexp_extract(p, "[0-9]+", 0).cast("int"))
    parts = F.transform(pieces, lambda p: F.when(F.regexp_like(p, F.lit(r"^\{[0-9]+\}$")), value(p)).otherwise(p))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def learned_templates(calls: DataFrame, *, least: float = 0.9) -> DataFrame:
    """site, fn, template, support, tried, right: where a script function leads, by the position of its arguments.

    calls: site, fn, args, landed (URL), held_out. Each call to learn from says which words of its URL are which argument; the template that
    most of them agree on is tried (the least of equals), if it names an argument. It is kept if it gives the landed URL of at least a share least of the calls
    held out, of which there must be one. Counts of templates and of hits are partial aggregates; only templates are joined.
    """
    learn = calls.filter(~F.col("held_out") & F.col("landed").isNotNull())
    counts = learn.groupBy("site", "fn", abstracted("landed", F.col("args")).alias("template")).agg(F.count("*").alias("support")).filter(F.col("template").rlike(r"\{[0-9]+\}"))
    best = counts.groupBy("site", "fn").agg(F.min_by(F.struct("template", "support"), F.struct((-F.col("support")).alias("n"), "template")).alias("b")).select("site", "fn", "b.*")
    held = calls.filter(F.col("held_out") & F.col("landed").isNotNull()).join(best, ["site", "fn"])
    tried = held.groupBy("site", "fn", "template", "support").agg(F.count("*").alias("tried"), F.count_if(filled("template", F.col("args")) == F.col("landed")).alias("right"))
    return tried.filter(F.col("right") >= least * F.col("tried"))


def script_actions(html) -> Column:
    """array of struct fn, action, parameter: the functions of a page's script that set a form's action, and the form field they fill (idx if none)."""
    body = r"(?i)function\s+([A-Za-z_][\w$]*)\s*\([^)]*\)\s*\{([^}]+)\}"
    pairs = F.arrays_zip(F.regexp_extract_all(col(html), F.lit(body), F.lit(1)).alias("fn"), F.regexp_extract_all(col(html), F.lit(body), F.lit(2)).alias("body"))
    field = lambda b: F.regexp_extract(b, r"\w+\.(\w+)\.value\s*=", 1)
    read = F.transform(pairs, lambda x: F.struct(F.lower(x["fn"]).alias("fn"), F.regexp_extract(x["body"], r"\.action\s*=\s*['\"]([^'\"]+)['\"]", 1).alias("action"), F.coalesce(F.nullif(field(x["body"]), F.lit("")), F.lit("idx")).alias("parameter")))
    return F.filter(read, lambda x: x["action"] != "")


def resolved(page_url, html, fn, argument) -> Column:
    """Where a call leads by its page's script: the first function of that name (in any case); null if none sets an action, and for pop-ups."""
    hit = F.try_element_at(F.filter(script_actions(html), lambda x: x["fn"] == F.lower(col(fn))), F.lit(1))
    action = urls.absolute(col(page_url), hit["action"])
    joint = F.when(F.contains(action, F.lit("?")), "&").otherwise("?")
    return F.when(~F.endswith(F.lower(col(fn)), F.lit("popup")), F.concat(action, joint, hit["parameter"], F.lit("="), col(argument)))
