"""License notices by MinHash bands over overlapping text windows, in DataFrame operations alone.

Templates are public notices and whole licence paragraphs, at least three words
long (fewer are an error). Their 3-word shingles are compared to those of
overlapping word windows in as many sizes as the templates need: windows of 6
words every 3 for templates of 3 words, of 16 every 8 for those up to 8, of 32
every 16 for those up to 16, and so on by doubling, so that any occurrence lies
inside one window. A band is one MinHash value; their number is chosen so that
a window that holds ``CONTAINMENT`` of any template of its size shares a band
with it with probability 0.9999. Retrieved pairs are verified by the exact
share of the template's shingles in the window.

Only texts with a word that no match can do without are cut into windows: of
each template the fewest words are kept so that the shingles without them are
less than ``CONTAINMENT`` of all (a lossless test). Their words and shingle
hashes are stored once for all window sizes; a window is a row of its own slices.

Defined results: NULL, empty and texts of fewer than three words match nothing;
rows that repeat doc_id and text are one document with one row in the result,
rows that share the doc_id alone have a row each; a NULL doc_id is an id like
others; an empty table gives no rows; other columns are ignored; a notice that
occurs twice in a document counts once, one that begins a longer notice counts
beside it; of equal shares the first window is told.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import cut, documents, text_hash

SHINGLE, CONTAINMENT, MISS = 3, 0.8, 1e-4
#: fixed values: name and wording of public notices
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                      "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                      "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                     "of the Software.",
    "MIT-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited "
                    "to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall "
                    "the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of "
                    "contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
                    "dealings in the software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                      "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
                      "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
                      "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                      "other materials provided with the distribution.",
    "BSD-warranty": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied "
                    "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a "
                    "particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any "
                    "direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
                    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however "
                    "caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or "
                    "otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                      "option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but without any warranty; without even the "
                    "implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License "
                    "for more details.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ARR": "Copyright. All rights reserved.",
    "ARR-plain": "All rights reserved.",
}
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def words_of(notice: str) -> list[str]:
    return re.findall(WORD, notice.lower())


def shingles_of(words: list[str]) -> list[str]:
    k = min(SHINGLE, len(words))
    return sorted({" ".join(words[i:i + k]) for i in range(len(words) - k + 1)})


def needed(notices: dict[str, str]) -> list[str]:
    """Words without which no notice reaches ``CONTAINMENT``: the longest first, until the rest is too little."""
    out: set[str] = set()
    for notice in notices.values():
        words = words_of(notice)
        all_ = shingles_of(words)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            left = sum(not set(s.split()) & out for s in all_)
            if left < CONTAINMENT * len(all_):
                break
            out.add(w)
    return sorted(out)


def longest_of(n: int) -> int:
    """The longest template that shares windows with one of ``n`` words; a window is twice as long, a step once."""
    return n if n <= SHINGLE else max(8, 1 << (n - 1).bit_length())


def sizes_of(notices: dict[str, str]) -> dict[int, tuple[int, int]]:
    """Longest template: (window, step) in words, as many as the templates need."""
    for name, notice in notices.items():
        if len(words_of(notice)) < SHINGLE:
            raise ValueError(f"The notice {name} has fewer than {SHINGLE} words")
    return {n: (2 * n, n) for n in sorted({longest_of(len(words_of(t))) for t in notices.values()})}


SIZES = sizes_of(NOTICES)


def bands_of(window: int, shingles: int) -> int:
    """Bands of one value that miss a window with ``CONTAINMENT`` of a template's shingles with probability ``MISS``."""
    least = math.ceil(CONTAINMENT * shingles)
    similarity = least / (window - SHINGLE + 1 + shingles - least)
    return math.ceil(math.log(MISS) / math.log(1 - similarity)) if similarity < 1 else 1


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id of every document (doc_id and text), its notices in order, the share of each and the word where its window begins."""
    spark, sizes = docs.sparkSession, sizes_of(notices)
    if not sizes:
        raise ValueError("No notices")
    base = docs.select("doc_id", text_hash().alias("th"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    some = base.where(F.col("t").rlike(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, needed(notices))) + r")(?![a-z0-9])"))
    texts = some.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") >= SHINGLE)
    # every text is read and searched once; a shingle is hashed once, its bands are mixed from that hash
    texts = cut(texts.withColumn("h", F.expr(f"transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(SHINGLE))}))")))
    found = []
    for longest, (window, step) in sizes.items():
        own = {n: words_of(t) for n, t in notices.items() if longest_of(len(words_of(t))) == longest}
        bands = max(bands_of(window, len(shingles_of(w))) for w in own.values())
        values = F.expr(f"transform(sequence(0, {bands - 1}), b -> array_min(transform(g, s -> xxhash64(s, b))))")
        templates = spark.createDataFrame([(n, shingles_of(w)) for n, w in own.items()], "notice string, its array<string>")
        hashed = F.transform("its", lambda s: F.xxhash64(*(F.get(F.split(s, " "), F.lit(j)) for j in range(SHINGLE))))
        keys = templates.withColumn("g", hashed).select("notice", "its", F.posexplode(values).alias("band", "value"))
        # windows with their own words only, so that a long text isn't copied into each of them
        windows = texts.select("doc_id", "th", F.inline(F.expr(
            f"transform(sequence(0, greatest(size(w) - {window - step} - 1, 0), {step}), a -> named_struct('at', a, "
            f"'v', slice(w, a + 1, {window}), 'g', array_distinct(slice(h, a + 1, {window - SHINGLE + 1}))))"))).where(F.size("g") > 0)
        hits = windows.select("doc_id", "th", "at", "v", F.posexplode(values).alias("band", "value")).join(F.broadcast(keys), ["band", "value"])
        # notices x bands rows of fixed texts: broadcast by a size that no input changes
        hits = hits.select("doc_id", "th", "at", "v", "notice", "its").dropDuplicates(["doc_id", "th", "at", "notice"])
        words = F.expr(f"array_distinct(transform(sequence(1, greatest(size(v) - {SHINGLE - 1}, 1)), i -> array_join(slice(v, i, {SHINGLE}), ' ')))")
        share = (F.size(F.array_intersect(words, "its")) / F.size("its")).alias("share")
        hits = hits.select("doc_id", "th", "at", "notice", share).where(F.col("share") >= CONTAINMENT)
        found.append(hits)
    hits = found[0]
    for h in found[1:]:
        hits = hits.union(h)
    best = hits.groupBy("doc_id", "th", "notice").agg(F.max("share").alias("share"), F.min("at").alias("at"))
    per = best.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("k")).agg(F.sort_array(F.collect_list(F.struct("notice", "share", "at"))).alias("found"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k"))
    return base.select("doc_id", "th").distinct().join(per, same, "left").select(
        "doc_id", F.coalesce(F.array_join(F.transform("found", lambda x: x.notice), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"), "found")


def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = scan(documents(spark, sf))
    return out.select("doc_id", "licenses", F.greatest("n_licenses", F.lit(0).cast("long")).alias("n_licenses"))


QUERIES = {"op8_license_scan": op8_license_scan}
SQL: dict[str, str] = {}
