"""License scans: Dice coefficient over word bigrams between parts of a text and licence templates. DataFrame functions throughout.

Text is lower-cased and everything but letters and digits becomes one space. Compared are each line, each paragraph (between
blank lines) and the whole text, and, for notices that share these with other words, each window of the text with as many words as a
template. A part with u distinct bigrams can reach Dice d with a template of t only if
t d / (2 - d) <= u <= t (2 - d) / d; other templates are pruned for it. Such a part also holds at least t d / (2 - d) of the
template's bigrams, so it holds one of any t - ceil(t d / (2 - d)) + 1 of them: those with the longest words serve as signatures, and
texts and parts without any are skipped before bigrams are made, and windows are taken only around them. By the same count some beginnings
of words (stems) cover so many bigrams of each template that a text without all of them is skipped at once. No bound loses a match.
Templates are short notices and whole licence texts.

One row per document row and licence found: the best Dice and the number of matching parts, 0 where only windows match. Null and empty texts and one-word
parts match nothing; a text of any length is read whole. Repeated rows with one id, and rows without one, count together. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 0.8
#: Notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, "
        "Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', "
        "without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs "
        "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present "
        "and future rights to this software under copyright law.",
}
TEMPLATES["BSD-3-Clause-text"] = TEMPLATES["BSD-2-Clause-text"].replace("THIS SOFTWARE IS PROVIDED BY", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY", 1)


def template_bigrams(text: str) -> list[str]:
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def signatures(bigrams: list[str], least: float) -> list[str]:
    t = len(bigrams)
    shared = math.ceil(t * least / (2 - least) - 1e-9)
    return sorted(bigrams, key=lambda b: (-min(map(len, b.split())), -len(b), b))[: t - shared + 1]


def stems(by_name: dict[str, list[str]], least: float) -> list[str]:
    """A few beginnings of words of which any text that reaches a template holds one: they are in so many of its bigrams that no
    such text can be without all of these. Chosen greedily over all templates, each for what it adds."""
    needs = {k: len(b) - math.ceil(len(b) * least / (2 - least) - 1e-9) + 1 for k, b in by_name.items()}
    left = {k: set(b) for k, b in by_name.items()}
    known, out = sorted({w[:6] for b in by_name.values() for x in b for w in x.split() if len(w) >= 5}), []
    adds = lambda stem: sum(min(needs[k], sum(stem in x for x in left[k])) for k in needs if needs[k] > 0)
    while any(n > 0 for n in needs.values()):
        best = max(known, key=lambda stem: (adds(stem), stem))
        if not adds(best):  # templates of short words alone
            return out + sorted({x for k in needs if needs[k] > 0 for x in left[k]})
        out.append(best)
        for k in left:
            met = {x for x in left[k] if best in x}
            left[k] -= met
            needs[k] -= len(met)
    return out


def template_words(text: str) -> int:
    return len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())


def _pairs(w: Column) -> Column:
    """Bigrams of a column of words, in order (a column of its own, or every pair would split the part again)."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def _best_window(pairs: Column, t: Column) -> Column:
    """The best Dice of windows of t's number of words that hold a signature of t; null without any."""
    long = t["words"] - 1  # bigrams of a window
    spots = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.array_contains(t["signatures"], F.get(pairs, i)))
    starts = F.array_distinct(F.flatten(F.transform(spots, lambda p: F.sequence(F.greatest(F.lit(0), p - long + 1), F.least(p, F.size(pairs) - long)))))

    def dice(i):
        own = F.array_distinct(F.slice(pairs, i + 1, long))
        return 2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + F.size(t["bigrams"]))

    return F.array_max(F.transform(starts, dice))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, n_parts."""
    by_name = {k: b for k, v in sorted(templates.items()) if (b := template_bigrams(v))}
    marks = sorted({s for b in by_name.values() for s in signatures(b, least)})
    # substring search in text made of single-spaced words; a pattern of all signatures costs far more
    signed = lambda c: F.exists(F.array(c), lambda t: reduce(or_, [t.contains(m) for m in marks]))
    first = stems(by_name, least)  # far fewer than signatures, so most texts are done with after them
    either = lambda t, words: reduce(or_, [t.contains(m) for m in words])
    spaced = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    hinted = docs.filter(F.exists(F.array(spaced), lambda t: either(t, first) & either(t, marks)))
    plain = hinted.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ").alias("plain"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    parts = F.concat(F.split("plain", "\n"), F.split("plain", r"\n\s*\n"), F.array("plain"))
    units = F.concat(F.transform(F.array_distinct(F.transform(parts, flat)), lambda x: F.struct(x.alias("part"), F.lit(1).alias("n"))), F.array(F.struct(flat(F.col("plain")).alias("part"), F.lit(0).alias("n"))))
    units = plain.select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.*").filter(signed(F.col("part")))
    units = units.select("doc_id", "n", F.split("part", " ").alias("w")).select("doc_id", "n", _pairs(F.col("w")).alias("pairs"))
    units = units.select("doc_id", "n", "pairs", F.array_distinct("pairs").alias("own"))
    known = F.array(*[
        F.struct(F.lit(k).alias("license"), F.lit(template_words(templates[k])).alias("words"), F.array(*map(F.lit, b)).alias("bigrams"), F.array(*map(F.lit, signatures(b, least))).alias("signatures"))
        for k, b in by_name.items()
    ])
    u = F.size("own")
    fits = lambda t: (u >= F.size(t["bigrams"]) * (least / (2 - least)) - 1e-9) & (u <= F.size(t["bigrams"]) * ((2 - least) / least) + 1e-9)
    holds = lambda t: (F.size("pairs") >= t["words"] - 1) & F.arrays_overlap("own", t["signatures"])
    tried = units.select("doc_id", "n", "pairs", "own", F.explode(F.filter(known, lambda t: F.when(F.col("n") == 1, fits(t)).otherwise(holds(t)))).alias("t"))
    t = F.col("t")
    dice = 2.0 * F.size(F.array_intersect("own", t["bigrams"])) / (u + F.size(t["bigrams"]))
    scored = tried.select("doc_id", "n", t["license"].alias("license"), F.when(F.col("n") == 1, dice).otherwise(_best_window(F.col("pairs"), t)).alias("dice"))
    return scored.filter(F.col("dice") >= least).groupBy("doc_id", "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.sum("n").alias("n_parts"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same without pruning, as DuckDB SQL."""
    rows = ", ".join(f"('{k}', ['" + "', '".join(template_bigrams(v)) + "'])" for k, v in sorted(templates.items()))
    return f"""
    with t(license, bigrams) as (values {rows}),
    p as (select doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') as plain from documents),
    parts as (select doc_id, unnest(list_distinct(list_transform(list_concat(string_split(plain, chr(10)), regexp_split_to_array(plain, '\\n\\s*\\n'), [plain]), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))))) as part from p),
    w as (select doc_id, list_filter(string_split(part, ' '), lambda x: x <> '') as w from parts),
    own as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as own from w where len(w) >= 2),
    scored as (select doc_id, license, 2.0 * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) as dice from own, t
               where list_has_any(own, bigrams))
    select doc_id, license, round(max(dice), 6)::double as dice, count(*) as n_parts from scored where dice >= {least} group by all
    """


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
