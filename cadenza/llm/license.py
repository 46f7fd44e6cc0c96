"""License scans by diagonal voting. Native: DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, words_of

# The base phrases with their labels, and notices of well-known licenses.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    # whole licenses
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation
     the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
     and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
     merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
     from out of or in connection with the software or the use or other dealings in the software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
     conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
     distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by
     the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the
     copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or
     business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
     possibility of such damage"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
     provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
     consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
     software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software
     for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the
     original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented
     as being the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any
     purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this
     dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
     copyright law"""),
    ("boost", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and
     transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire
     statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative
     works are solely in the form of machine executable object code generated by a source language processor"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required
     by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language
     governing permissions and limitations under the license"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any
     later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for
     more details you should have received a copy of the gnu general public license along with this program"""),
]


def template_rows(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """Places of the templates' word k-grams: pairs of words for phrases, triples (w3) for notices. A template has no
    most words; one too short for a k-gram is an error."""
    rows, k = [], 0
    for exact, templates in ((True, phrases), (False, notices)):
        for label, text in templates:
            w = re.findall(WORD, text)
            n = len(w) - (1 if exact else 2)
            if n < 1:
                raise ValueError(f"a template of too few words: {text}")
            rows += [(k, label, exact, n, i, w[i], w[i + 1], None if exact else w[i + 2]) for i in range(n)]
            k += 1
    return rows


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(template_rows(phrases, notices), "template int, label string, exact boolean, n_grams int, at int, t1 string, t2 string, t3 string")


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, drift: int = 2, min_coverage: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(per document, spans) of license phrases and notices in the whole texts of docs (doc_id, text).

    Every rolling word k-gram of every text is joined by its hash to the places of the templates (a fixed
    list, so broadcast) and its words are compared. A hit votes for the diagonal word place - template place. A
    phrase stands where one diagonal has all its votes. For the longer notices, diagonals at most `drift`
    apart are merged, so that words put in or left out shift but do not end a match, and a span is verified if
    the merged votes cover min_coverage of the template within one and a half times its length.

    spans: doc_id, text_key, label, exact, first_word, end_word, coverage. Per document: doc_id, n_words, n_base
    (places of phrases), first_word and last_word (smallest and largest start of them, null without), base_labels,
    labels, score (largest coverage of any template, verified or not). A row comes for every row of docs: rows of one
    doc_id (null too) with different texts are judged apart, by doc_id and text_key, two 64-bit hashes of the text;
    repeated rows alike. A null or empty text has no words; an empty table gives no rows.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, phrases, notices).withColumn("h", F.xxhash64("t1", "t2"))
    w = words_of(F.col("text"))
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("license"), "text").alias("b"))
    words = docs.select("doc_id", key.alias("text_key"), w.alias("w")).where(F.size("w") > 1)
    n = F.size("w")
    triples = F.arrays_zip(F.slice("w", 1, n - 1).alias("w1"), F.slice("w", 2, n - 1).alias("w2"), F.slice("w", 3, n).alias("w3"))
    places = words.select("doc_id", "text_key", F.posexplode(triples).alias("place", "g")).select("doc_id", "text_key", "place", "g.w1", "g.w2", "g.w3")
    same = (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("t3").isNull() | (F.col("t3") == F.col("w3")))
    hits = places.withColumn("h", F.xxhash64("w1", "w2")).join(F.broadcast(grams), "h").where(same)
    template = ["doc_id", "text_key", "template", "label", "exact", "n_grams"]
    # equal rows vote alike, so that one vote of each place and template place is enough
    votes = (
        hits.withColumn("diagonal", F.col("place") - F.col("at"))
        .groupBy(*template, "diagonal")
        .agg(F.collect_set("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    )
    # neighbouring diagonals of a notice fall into one group, each diagonal of a phrase into its own
    line = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("exact"), 0).otherwise(drift), F.lit(True))
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*template, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("diagonal")
    )
    coverage = F.col("votes") / F.col("n_grams")
    long_enough = (F.col("last") - F.col("first") + 1) <= 1.5 * F.col("n_grams") + 1
    good = F.when(F.col("exact"), coverage == 1).otherwise((coverage >= min_coverage) & long_enough)
    found = merged.withColumns({"coverage": coverage, "good": good})
    spans = found.where("good").select(
        "doc_id", "text_key", "label", "exact",
        F.col("first").cast("long").alias("first_word"),
        (F.col("last") + F.when(F.col("exact"), 2).otherwise(3)).cast("long").alias("end_word"),
        "coverage",
    )
    base = F.col("good") & F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_text = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(F.col("good"), F.col("label"))).alias("labels"), F.max("coverage").alias("score"),
    )
    rows = docs.select("doc_id", key.alias("text_key"), F.size(w).cast("long").alias("n_words"))
    out = rows.join(per_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    zero, blank = F.lit(0).cast("long"), F.lit("")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", blank).alias("base_labels"), F.coalesce("labels", blank).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    ), spans
