"""Licence scan by canonical digests, in built-in functions only.

A text is lower-cased, copyright lines go, punctuation becomes a space and equivalent spellings, of one word or two, become
one; the digest of the whole canonical text is looked up among the digests of known texts by a hash join. The same lookup runs
over the lines and sentences that speak of a licence, for notices inside other text: distinct sets of their digests
meet the known notices in a join of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower, maybe_broadcast, stash, table

# Spellings that licence matching guidelines treat as equal, after punctuation has gone.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
# The same of two words, as they are once punctuation has gone.
EQUIVALENT_PAIRS = (
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
)
_COPYRIGHT = r"(?m)^[ \t*#/;>-]*(?:copyright(?:[ \t]*(?:\(c\)|©|:|,)|[ \t]+\d)|\(c\)[ \t]*\d|©|all rights reserved)[^\n]*$"
#: What every line that _COPYRIGHT takes has one of.
_MARKS = ("copyright", "(c)", "©", "all rights reserved")
_LINE = r"[^\n]*licen[cs][^\n]*"
#: Where a sentence ends; a line end is none.
_SENTENCE = r"(?<=[.!?;:])\s+|\n\s*\n"

# Published licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = _0BSD.replace("is hereby granted.", "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXTS = (
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD3),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
)

# Digests of the canonical forms of published texts that are too long to stand here.
DIGESTS = (
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


def _lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; a text of ASCII by the faster way, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _speaks(low: Column) -> Column:
    return F.contains(low, F.lit("licenc")) | F.contains(low, F.lit("licens"))


def canonical(text: Column) -> Column:
    """The text whose digest is looked up; null gives the empty text."""

    def bare(low: Column) -> Column:
        return F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in _MARKS)), F.regexp_replace(low, _COPYRIGHT, "")).otherwise(low)

    def same(w: Column) -> Column:
        spelt = reduce(lambda c, e: F.regexp_replace(c, rf"\b{e[0]}\b", e[1]), (*EQUIVALENT_PAIRS, *EQUIVALENT), w)
        # a word of a set is found faster than an alternative of a pattern; two words are looked for as they are
        some = F.arrays_overlap(F.split(w, " "), F.array(*(F.lit(a) for a, _ in EQUIVALENT)))
        return F.when(some | reduce(lambda a, b: a | b, (F.contains(w, F.lit(a)) for a, _ in EQUIVALENT_PAIRS)), spelt).otherwise(w)

    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    words = F.trim(F.regexp_replace(once(_lower(F.coalesce(text, F.lit(""))), bare), r"[^\p{L}\p{N}]+", " "))
    return once(words, same)


def known_digests(spark: SparkSession, texts: tuple, digests: tuple = ()) -> DataFrame:
    """(digest, license) of known texts, and of known canonical digests; of several names for one digest, the first in order."""
    rows = F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("t"), F.lit(None).cast("string").alias("d")) for n, t in texts), *(F.struct(F.lit(n).alias("license"), F.lit(None).cast("string").alias("t"), F.lit(d).alias("d")) for n, d in digests))
    t = spark.range(1).select(F.inline(rows))
    return t.groupBy(F.coalesce("d", F.sha2(canonical(F.col("t")), 256)).alias("digest")).agg(F.min("license").alias("license"))


def candidates(text: Column) -> Column:
    """The distinct digests, sorted, of the lines and sentences that speak of a licence; null where there is none."""
    # other texts are empty from here on: what stands in a branch may be evaluated for all rows
    low = F.when(_speaks(F.lower(text)), _lower(text)).otherwise("")
    # lines by a split and a search: a pattern that starts with any characters tries each of them, which is quadratic in long lines
    lines = F.filter(F.split(low, "\n"), _speaks)
    sentences = F.filter(F.split(low, _SENTENCE), _speaks)
    found = F.array_sort(F.array_distinct(F.transform(F.array_distinct(F.concat(lines, sentences)), lambda x: F.sha2(canonical(x), 256))))
    return F.get(F.filter(F.array(found), lambda x: F.size(x) > 0), F.lit(0))


def scan_licenses(docs: DataFrame, known: DataFrame, notices: tuple = NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with ``digest`` (of the whole canonical text), ``license`` (of ``known(digest, license)``, or null) and
    ``notices`` (sorted names of the known notices among its lines and sentences that speak of a licence).

    A null or empty text has the digest of the empty text; rows that repeat are judged each; an empty table of either
    kind is fine; columns of the three names are replaced, all others stay. Whole texts are read, of any length. A known side, or one of
    distinct sets of notices, is broadcast if its counted rows are few, and else the digests are shuffled.
    """
    own = [c for c in docs.columns if c not in ("digest", "license", "notices")]
    spark = docs.sparkSession
    found = candidates(F.col(f"`{text}`"))
    group = F.sha2(F.array_join(F.col("lines"), ""), 256)
    # the few texts that count are told by a search, so that their lines are made once and not in a filter too; a null set has no row
    sets = docs.where(_speaks(F.lower(F.col(f"`{text}`")))).select(found.alias("lines")).select(group.alias("group"), "lines").dropDuplicates(["group"])
    named = sets.select("group", F.explode("lines").alias("digest")).join(F.broadcast(known_digests(spark, notices)), "digest") if notices else None
    k = known.groupBy("digest").agg(F.min("license").alias("license"))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"), F.sha2(canonical(F.col(f"`{text}`")), 256).alias("digest"), found.alias("lines"))
    out = out.join(maybe_broadcast(k, k.count()), "digest", "left")
    none = F.array().cast("array<string>")
    if named is None:
        out = out.withColumn("notices", none)
    else:
        per = stash(named.groupBy("group").agg(F.array_sort(F.collect_set("license")).alias("notices")), "license-notices")
        # a text without such lines has a group of its own, so that none gathers them
        own_group = F.when(F.col("lines").isNotNull(), group).otherwise(F.concat(F.lit("-"), F.col("digest")))
        out = out.withColumn("group", own_group).join(maybe_broadcast(per, per.count(), 100_000), "group", "left").withColumn("notices", F.coalesce("notices", none))
    return out.select(*(F.col("doc")[c].alias(c) for c in own), "digest", "license", "notices")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, known_digests(spark, TEXTS, DIGESTS))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql() -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    lit = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        c = f"trim(regexp_replace(regexp_replace(translate({x}, {az}), {lit(_COPYRIGHT)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for a, b in (*EQUIVALENT_PAIRS, *EQUIVALENT):
            c = f"regexp_replace({c}, '\\b{a}\\b', '{b}', 'g')"
        return c

    values = lambda rows: ", ".join(f"({lit(n)}, {lit(t)})" for n, t in rows)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT digest, min(n) AS license FROM (SELECT sha256({canon("t")}) AS digest, n FROM (VALUES {values(TEXTS)}) v(n, t) UNION ALL SELECT d, n FROM (VALUES {values(DIGESTS)}) w(n, d)) GROUP BY 1),
q AS (SELECT sha256({canon("t")}) AS digest, min(n) AS n FROM (VALUES {values(NOTICES)}) v(n, t) GROUP BY 1),
l AS (SELECT doc_id, sha256({canon("x")}) AS digest FROM (SELECT doc_id, unnest(regexp_extract_all(translate(t, {az}), '{_LINE}')) AS x FROM d
 UNION ALL SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(translate(t, {az}), '\\n\\s*\\n', chr(1), 'g'), '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x FROM d) WHERE regexp_matches(x, 'licen[cs]'))),
f AS (SELECT doc_id, string_agg(n, ',' ORDER BY n) AS notices FROM (SELECT DISTINCT doc_id, n FROM l JOIN q USING (digest)) GROUP BY 1),
w AS (SELECT doc_id, sha256({canon("t")}) AS digest FROM d)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM w LEFT JOIN k USING (digest) LEFT JOIN f USING (doc_id)
"""


SQL = _sql()
