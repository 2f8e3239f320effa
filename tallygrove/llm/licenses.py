"""License scan by MinHash over overlapping text windows, in DataFrame functions throughout.

Words are runs of letters and digits, lower-cased; a shingle is five words. A template of n shingles is sought in windows of n plus a step of
a quarter of n less one shingles, one window a step, so every place where the template can stand lies whole in some window. A window that
holds a share c of the template has a Jaccard similarity of c * n / (n + step + (1 - c) * n) or more with it, 0.55 at c = 0.8. With 32 bands of 2
MinHash values such a window meets its template in some band with probability 1 - (1 - 0.55 ** 2) ** 32 > 0.99999. Windows met are verified:
the share of the template's distinct shingles, compared as words, must be min_containment or more.

A window without any shingle of a template has no MinHash value of it, so only windows with one are built; that drops no match.

Templates that share half of the smaller one or more (BSD-2-Clause and BSD-3-Clause, a grant and its full text, two versions of a notice) are told
apart by what is the larger one's own: without half of that part a match of the larger one does not count, and with it the smaller one, where the
larger one reaches around it, does not. A grant that stands apart, but within that reach of its full text, counts as part of it.
The template table is fixed and small (its size is checked), and it alone is broadcast.

Defined cases: null, empty and short texts (under five words) match nothing; repeated rows, and rows that share a doc_id (null too),
give one row for each license; ties in containment are one row anyway; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS = 5, 32, 2

# A template that holds most of another one is told from it by the part that is its own: so much of that must be there
OWN_SHARE = 0.5

# Texts, opening paragraphs and notices of public licenses, by SPDX identifier.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_COPIES = "provided that the above copyright notice and this permission notice appear in all copies."
ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
GNU = "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
CREATIVE_COMMONS = "This work is licensed under a Creative Commons {terms} 4.0 International License."
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-grant": MIT_GRANT,
    "MIT": f"{MIT_GRANT} {MIT_REST}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0-or-later": GNU.format(work="program", name="General Public License", version="2"),
    "GPL-3.0-or-later": GNU.format(work="program", name="General Public License", version="3"),
    "AGPL-3.0-or-later": GNU.format(work="program", name="Affero General Public License", version="3"),
    "LGPL-2.1-or-later": GNU.format(work="library", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0-or-later": GNU.format(work="program", name="Lesser General Public License", version="3"),
    "BSD-opening": BSD_OPENING,
    "BSD-2-Clause": f"{BSD_OPENING} {BSD_CLAUSES} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_OPENING} {BSD_CLAUSES} {BSD_NAMES} {BSD_DISCLAIMER}",
    "ISC-grant": f"{ISC_GRANT}, {ISC_COPIES}",
    "ISC": f"{ISC_GRANT}, {ISC_COPIES} {ISC_DISCLAIMER}",
    "0BSD": f"{ISC_GRANT}. {ISC_DISCLAIMER}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "CC-BY-4.0": CREATIVE_COMMONS.format(terms="Attribution"),
    "CC-BY-SA-4.0": CREATIVE_COMMONS.format(terms="Attribution-ShareAlike"),
    "CC-BY-NC-4.0": CREATIVE_COMMONS.format(terms="Attribution-NonCommercial"),
    "CC-BY-ND-4.0": CREATIVE_COMMONS.format(terms="Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": CREATIVE_COMMONS.format(terms="Attribution-NonCommercial-ShareAlike"),
}


def words_of(text: str) -> list[str]:
    """The words of a template, as the scan takes them."""
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(text: str) -> list[list[str]]:
    """Distinct shingles in order."""
    words = words_of(text)
    return [list(x) for x in dict.fromkeys(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))]


def step_of(n: int) -> int:
    """How far apart the windows for templates of n shingles begin."""
    return max(1, n // 4)


def rivals(templates: dict[str, str]) -> list[tuple[str, str, list[str]]]:
    """(larger, smaller, the larger one's own shingles) of templates of which the smaller, or equally large, has half its shingles or more in the larger."""
    sets = {name: dict.fromkeys(" ".join(x) for x in shingles_of(t)) for name, t in templates.items()}
    pairs = ((a, b) for a in sets for b in sets if a != b and len(sets[a]) >= len(sets[b]) and 2 * sum(x in sets[a] for x in sets[b]) >= len(sets[b]))
    return [(a, b, own) for a, b in pairs if (own := [x for x in sets[a] if x not in sets[b]])]


def margins(templates: dict[str, str]) -> dict[int, int]:
    """By the number of shingles of a template: how far a larger rival may reach beyond a window for it."""
    n = {name: len(shingles_of(t)) for name, t in templates.items()}
    reach = {size: 0 for size in n.values()}
    for large, small, _ in rivals(templates):
        if n[large] > n[small]:
            reach[n[small]] = max(reach[n[small]], n[large] - n[small] + step_of(n[small]))
    return reach


def _hash(shingle: list[str]) -> int:
    """Spark's xxhash64 of the words as columns."""
    seed = 42
    for w in shingle:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


# SQL: the least value of each hash function over an array of shingle hashes, and from these the hashes of the bands
MINIMA = f"transform(sequence(0, {BANDS * ROWS - 1}), j -> array_min(transform(hashes, h -> xxhash64(h, j))))"
BANDED = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, {', '.join(f'get(mins, b * {ROWS} + {r})' for r in range(ROWS))}))"

# as an expression: from an exploded column Spark infers a filter, and pushed down that computes the MinHash values again for every band
ALL_BANDS = f"slice(bands, 1, {BANDS})"


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_containment: float = 0.8) -> DataFrame:
    """doc_id, license, containment (of the best window) of every license found in a document."""
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    chosen = {name: shingles_of(t) for name, t in templates.items()}
    if short := [name for name, s in chosen.items() if not s]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    if sum(map(len, chosen.values())) > 100_000:
        raise ValueError("the template table is broadcast: 100,000 shingles at most")
    joined, reach, pairs = {name: [" ".join(x) for x in s] for name, s in chosen.items()}, margins(templates), rivals(templates)
    rows = []
    for name, s in chosen.items():
        larger = [(joined[a], own) for a, b, own in pairs if b == name and len(chosen[a]) > len(s)]
        rows.append((name, joined[name], [_hash(x) for x in s], len(s), [own for a, _, own in pairs if a == name], larger))
    schema = "license string, shingles array<string>, hashes array<long>, n int, own_parts array<array<string>>, larger array<struct<shingles: array<string>, own: array<string>>>"
    table = spark.createDataFrame(rows, schema).withColumn("mins", F.expr(MINIMA)).withColumn("bands", F.expr(BANDED))
    index = table.select("license", "n", F.col("bands").alias("template_bands"), F.explode(F.expr(ALL_BANDS)).alias("band"))
    bodies = table.select("license", "shingles", "own_parts", "larger")
    firsts = sorted({x[0] for s in chosen.values() for x in s})
    by_size = {n: sorted({_hash(x) for s in chosen.values() if len(s) == n for x in s}) for n in sorted(reach)}
    hashes = sorted({h for x in by_size.values() for h in x})

    # no filter on a computed column before the generator: pushed down, it would split the text again for every word looked at
    words = docs.select(F.col(id_col).alias("doc_id"), F.filter(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    at = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE)])
    every = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE)).otherwise(F.expr("array()"))
    hits = words.withColumn("hits", F.filter(every, lambda i: F.get("words", i).isin(firsts) & at(i).isin(hashes)))

    def placed(n: int) -> Column:
        """The windows for n shingles that hold a shingle of a template of that size: number k covers shingles k * step to k * step + span - 1."""
        step, span = step_of(n), n + step_of(n) - 1
        held = F.filter("hits", lambda p: at(p).isin(by_size[n]))
        numbers = F.flatten(F.transform(held, lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - span + 1) / step).cast("int")), F.floor(p / step).cast("int"))))
        sizes = [F.lit(x).alias(name) for name, x in (("n", n), ("start", step), ("span", span), ("margin", reach[n]))]
        return F.transform(F.array_distinct(numbers), lambda k: F.struct(sizes[0], (k * step).alias("start"), *sizes[2:]))

    windows = hits.select("doc_id", "words", F.explode(F.when(F.size("hits") > 0, F.concat(*map(placed, by_size)))).alias("w")).select("doc_id", "words", "w.*").withColumn("lead", F.least("start", "margin"))
    cut = windows.select("doc_id", "n", "lead", "span", F.expr(f"slice(words, start - lead + 1, lead + span + margin + {SHINGLE - 1})").alias("wide"))
    cut = cut.withColumn("own", F.expr(f"slice(wide, lead + 1, span + {SHINGLE - 1})"))
    own = lambda i: F.xxhash64(*[F.get("own", i + k) for k in range(SHINGLE)])
    signed = cut.withColumn("hashes", F.transform(F.sequence(F.lit(0), F.size("own") - SHINGLE), own)).withColumn("mins", F.expr(MINIMA)).withColumn("bands", F.expr(BANDED))
    met = signed.select("doc_id", "n", "own", "wide", "bands", F.posexplode(F.expr(ALL_BANDS)).alias("b", "band")).join(F.broadcast(index), ["n", "band"])
    once = met.filter(F.expr("array_position(zip_with(bands, template_bands, (x, y) -> x = y), true) = b + 1"))  # a window meets a template in its first equal band
    text = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - SHINGLE), lambda i: F.concat_ws(" ", F.slice(c, i + 1, SHINGLE)))
    held = once.join(F.broadcast(bodies), "license").withColumn("text", text("own")).withColumn("wide", text("wide"))
    held = held.withColumn("containment", F.size(F.array_intersect("shingles", "text")) / F.size("shingles")).filter(F.col("containment") >= min_containment)
    lacks = lambda part, where: F.size(F.array_intersect(part, F.col(where))) < OWN_SHARE * F.size(part)
    whole = lambda x: F.size(F.array_intersect(x["shingles"], F.col("wide"))) / F.size(x["shingles"]) >= min_containment
    verified = held.filter(~F.exists("own_parts", lambda part: lacks(part, "text"))).filter(~F.exists("larger", lambda x: whole(x) & ~lacks(x["own"], "wide")))
    return verified.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
