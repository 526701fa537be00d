"""License scans, with DataFrame operations only and without moving a document.

A text's 5-word shingles are cut into windows that overlap by half; a window's
bands are its k smallest shingle hashes (a bottom-k MinHash sketch), one value
each. Templates have the same sketches in a small fixed table. A broadcast
join of bands to templates retrieves candidates, and each candidate is
verified by the exact share of the template's shingles in its window.

There are two classes of windows. A short template (up to 17 shingles) lies
whole in some window of 32; with k = 32 that window's bands are all its
shingles, so a template that shares any is retrieved with certainty. A long one
(up to 64 shingles) lies whole in some window of 128; a window that holds 0.8
of a template of n shingles has Jaccard similarity s >= 0.8n / (128 + 0.2n),
and the k smallest of the union miss the common part with probability about
(1 - s)^k: at k = 48 under 0.004 for n = 18, 0.00005 for n = 32. Longer
texts, such as whole licenses, are cut into pieces of at most 64 shingles by
`cut_text`, which are templates, and put together again from what is found of them.

Windows are made of documents only that have an anchor: for each template some of
its words, chosen so that less than the asked share of its shingles is without
one. A text that holds that share of them holds an anchor; no other is looked at.

Notices of under five words are one shingle of their own length each, and found
by equality at every place of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, cut, text_key

SHINGLE, MIN_CONTAINMENT = 5, 0.8
SHORT, LONG = 17, 64
#: (window, bands) of the two classes; windows begin at every half of their length.
WINDOWS = ((32, 32), (128, 48))
#: Templates at most: the bound of what is broadcast.
MAX_TEMPLATES = 10_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words, in a lower-cased text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Short notices and headers by which licenses are named in texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)

#: Notices of under five words.
NOTICES = (("all-rights-reserved", "All rights reserved."),)


#: Whole license texts, without the lines that name the holder and the year.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
)


def _split_words(text: str) -> list[str]:
    """A text's words, as `_words` has them."""
    return re.findall(_WORD, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def cut_text(text: str) -> list[str]:
    """A long license text as runs of words of about one size that make at most 64 shingles each; a text under five words is an error."""
    words = _split_words(text)
    if len(words) < SHINGLE:
        raise ValueError(f"a license text must have {SHINGLE} words at least")
    pieces = -(-len(words) // (LONG + SHINGLE - 1))
    ends = [len(words) * i // pieces for i in range(pieces + 1)]
    return [" ".join(words[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def anchors(texts, min_containment: float) -> list[str]:
    """Words of which each text of `texts` holds one that holds the share min_containment of a template's shingles: the longest ones that suffice."""
    out: set[str] = set()
    for text in texts:
        words = _split_words(text)
        size = min(SHINGLE, len(words))
        left = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        n = len(left)
        for w in sorted(set(words), key=lambda w: (w not in out, -len(w), w)):
            if len(left) < min_containment * n:
                break
            if any(w in x for x in left):
                out.add(w)
                left = {x for x in left if w not in x}
    return sorted(out)


def _words(text: Column) -> Column:
    """Words by splitting between them, which costs a fifth of extracting each."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; `words` must be the name of a column."""
    n = F.size(words) - SHINGLE + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column, window: int, k: int, label: int) -> Column:
    """(class, first shingle, band) of all windows."""
    step = window // 2
    last = F.greatest(F.lit(0), F.ceil((F.size(shingles) - step) / step).cast("int") - 1)
    starts = F.when(F.size(shingles) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))

    def of(start: Column) -> Column:
        least = F.slice(F.sort_array(F.array_distinct(F.slice(shingles, start + 1, F.lit(window)))), 1, k)
        return F.transform(least, lambda band: F.struct(F.lit(label).alias("cls"), start.alias("start"), band.alias("band")))

    return F.flatten(F.transform(starts, of))


def templates(spark: SparkSession, texts=TEMPLATES) -> DataFrame:
    """(template, license, shingles, cls, band): each template's sketch. At most MAX_TEMPLATES, of 5 to 68 words."""
    if len(texts) > MAX_TEMPLATES:
        raise ValueError(f"{len(texts)} templates; {MAX_TEMPLATES} at most")
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(texts)])
    own = spark.range(1).select(F.inline(rows)).withColumn("words", _words(F.col("text")))
    own = own.withColumn("shingles", F.array_distinct(_shingles(F.col("words")))).withColumn("n", F.size("shingles"))
    own = own.withColumn("n", F.when((F.col("n") < 1) | (F.col("n") > LONG), F.raise_error(F.lit("a template must have 5 to 68 words"))).otherwise(F.col("n")))
    own = own.withColumn("cls", F.when(F.col("n") <= SHORT, 0).otherwise(1))
    k = F.when(F.col("cls") == 0, WINDOWS[0][1]).otherwise(WINDOWS[1][1])
    return own.select("template", "license", "shingles", "cls", F.explode(F.slice(F.sort_array("shingles"), F.lit(1), k)).alias("band"))


def _phrase(text: str) -> tuple[str, ...]:
    """A notice's words."""
    words = tuple(_split_words(text))
    if not 0 < len(words) < SHINGLE:
        raise ValueError("a notice must have 1 to 4 words")
    return words


def _notice_bands(words: str, notices) -> Column:
    """(class, place, band) of all places of notices; class 2."""
    phrases = sorted({_phrase(text) for _, text in notices})

    def of(size: int) -> Column:
        own = [p for p in phrases if len(p) == size]
        firsts, every = sorted({p[0] for p in own}), [" ".join(p) for p in own]

        def phrase(i: Column) -> Column:
            return F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])

        places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
        held = F.filter(places, lambda i: F.get(words, i).isin(firsts) & phrase(i).isin(every))
        return F.transform(held, lambda i: F.struct(F.lit(2).alias("cls"), i.alias("start"), F.xxhash64(phrase(i)).alias("band")))

    sizes = sorted({len(p) for p in phrases})
    return F.concat(*map(of, sizes)) if sizes else F.array().cast("array<struct<cls:int,start:int,band:bigint>>")


def _notice_table(spark: SparkSession, notices, first: int) -> DataFrame:
    """Notices as rows of `templates`, numbered from `first`."""
    if first + len(notices) > MAX_TEMPLATES:
        raise ValueError(f"{first + len(notices)} templates and notices; {MAX_TEMPLATES} at most")
    rows = F.array(*[F.struct(F.lit(first + i).alias("template"), F.lit(name).alias("license"), F.xxhash64(F.lit(" ".join(_phrase(text)))).alias("band")) for i, (name, text) in enumerate(notices)])
    return spark.range(1).select(F.inline(rows)).select("template", "license", F.array("band").alias("shingles"), F.lit(2).alias("cls"), "band")


def scan(docs: DataFrame, texts=TEMPLATES, min_containment: float = MIN_CONTAINMENT, doc_id: str = "doc_id", text: str = "text", notices=(), whole=()) -> DataFrame:
    """(doc, license, template, containment, n_windows, first_word): each template found in each document.

    containment: the largest share of the template's shingles in one window;
    first_word: where the first window of that share begins, from 0. Rows with
    the same id and text give one row. Null, empty and short texts (under five
    words) have no shingles and give none; nor does an empty table.

    notices: (license, text) of under five words, such as NOTICES; they are
    numbered after the templates, and each place is a window. Texts of any
    length can hold them.

    whole: (license, text) of any length from five words on, such as TEXTS,
    numbered after the notices. A row says that pieces were found which hold the
    share min_containment of all its pieces' shingles; containment is their
    share, n_windows the number of pieces found.
    """
    spark = docs.sparkSession
    pieces = [(i, name, p) for i, (name, long) in enumerate(whole) for p in cut_text(long)]
    every = [*texts, *[(name, p) for _, name, p in pieces]]
    words = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("tk"), _words(F.col(text)).alias("words"))
    held = F.array(*map(F.lit, anchors([t for _, t in (*every, *notices)], min_containment))).cast("array<string>")
    own = words.where(F.arrays_overlap("words", held))
    own = own.select("doc", "tk", _shingles(F.col("words")).alias("own"), _notice_bands("words", notices).alias("notes"))
    bands = F.concat("notes", *[_bands(F.col("own"), w, k, i) for i, (w, k) in enumerate(WINDOWS)])
    own = own.select("doc", "tk", "own", bands.alias("bands"))
    # The outer form: else a filter on the arrays' size is pushed down, and computes the windows once more in every lambda.
    sent = own.select("doc", "tk", "own", F.explode_outer("bands").alias("b")).select("doc", "tk", "own", "b.cls", "b.start", "b.band")
    sought = templates(spark, every)
    if notices:
        sought = sought.unionByName(_notice_table(spark, notices, len(every)))
    found = sent.join(F.broadcast(sought), ["cls", "band"])
    width = F.when(F.col("cls") == 0, WINDOWS[0][0]).otherwise(WINDOWS[1][0])
    share = F.size(F.array_intersect("shingles", F.slice("own", F.col("start") + 1, width))) / F.size("shingles")
    share = F.when(F.col("cls") == 2, 1.0).otherwise(share)
    found = found.select("doc", "tk", "license", "template", F.size("shingles").alias("n"), "start", share.alias("containment")).where(F.col("containment") >= min_containment)
    best = F.min(F.struct((-F.col("containment")).alias("c"), F.col("start").alias("start"))).alias("best")
    grouped = found.groupBy("doc", "tk", "license", "template", "n").agg(F.countDistinct("start").alias("n_windows"), best)
    rows = grouped.select("doc", "tk", "license", "template", "n", (-F.col("best.c")).alias("containment"), "n_windows", F.col("best.start").alias("first_word"))
    out = ["doc", "license", "template", "containment", "n_windows", "first_word"]
    if not pieces:
        return rows.select(out)
    rows = cut(rows)  # a row for each template found; read twice
    first, last = len(texts), len(every)
    single = rows.where((F.col("template") < first) | (F.col("template") >= last)).withColumn("template", F.when(F.col("template") < first, F.col("template")).otherwise(F.col("template") - len(pieces)))
    # Which text each piece is of, and the shingles of all its pieces.
    of = F.array(*[F.lit(i) for i, _, _ in pieces])
    sizes = [0] * len(whole)
    for i, _, p in pieces:
        sizes[i] += len(set(zip(*[p.split()[k:] for k in range(SHINGLE)], strict=False)))
    part = rows.where(F.col("template").between(first, last - 1)).withColumn("of", F.get(of, F.col("template") - first))
    share = F.sum(F.col("n") * F.col("containment")) / F.get(F.array(*map(F.lit, sizes)), F.col("of"))
    joined = part.groupBy("doc", "tk", "license", "of").agg(share.alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("first_word").alias("first_word")).where(F.col("containment") >= min_containment - 1e-9)
    joined = joined.withColumn("template", (F.col("of") + first + len(notices)).cast("int"))
    return single.select(out).unionByName(joined.select(out))
