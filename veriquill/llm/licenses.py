"""License scans by diagonal voting, in DataFrame operations.

All rolling GRAM-word windows of a text join those of the license templates by hash; words that match are compared too. A match at word p of
the text and word t of the template votes for the diagonal p - t. Diagonals of one document and template that are at most BAND apart merge,
so that inserted and missing words do not split a copy. A merged group is verified by the share of the template's words that its matches
cover: from COVER on it is a span of that license.

The phrases are searched word by word beside it; their labels always stay.

Defined results: null and blank texts have no words and no labels. Each row comes out once, also repeated ones; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .words_sql import NOT_ALNUM, lower_ascii, with_key, words

GRAM, BAND, COVER = 4, 4, 0.6
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License texts as words in lower case, fixed values: the notices that files carry, and the whole texts of short licenses. What stands before a
#: colon is the label.
TEMPLATES = {
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "mit:whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc:whole": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd:whole": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "zlib:whole": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    "unlicense:whole": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
}
#: Windows of templates that are broadcast, about 100 bytes each; more of them are joined by a shuffle.
BROADCAST_GRAMS = 200_000


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """template, label, text of named texts; the label is what stands before a colon in the name."""
    return spark.createDataFrame([(name, name.split(":")[0], text) for name, text in templates.items()], "template string, label string, text string")


def template_grams(templates: DataFrame) -> DataFrame:
    """template, label, n_template, t, t_gram, h: all windows of the words of templates (template, label, text)."""
    split = templates.select("template", "label", words(lower_ascii(F.col("text")), NOT_ALNUM).alias("w")).where(F.size("w") >= GRAM)
    places = split.select("template", "label", "w", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)).alias("t"))
    grams = places.select("template", "label", F.size("w").alias("n_template"), "t", F.slice("w", F.col("t") + 1, GRAM).alias("t_gram"))
    return grams.withColumn("h", F.xxhash64("t_gram"))


def phrase_starts(w: str, text: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after another; only texts that hold its first word are walked."""
    parts = phrase.split()

    def at(i: Column) -> Column:
        found = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return found

    return F.when(F.contains(text, F.lit(parts[0])) & (F.size(w) > 0), F.filter(F.sequence(F.lit(0), F.size(w) - 1), at)).otherwise(F.array().cast("array<int>"))


def _base(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "th", lower_ascii(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.select("doc_id", "th", "low", words(F.col("low"), NOT_ALNUM).alias("w"))
    starts = [phrase_starts("w", F.col("low"), p).alias(f"s{k}") for k, p in enumerate(PHRASES)]
    rows = rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), *starts)
    names = [f"s{k}" for k in range(len(PHRASES))]
    found = F.array_compact(F.array(*[F.when(F.size(s) > 0, label) for s, label in zip(names, PHRASES.values(), strict=True)]))
    every = F.concat(*names)
    return rows.select("doc_id", "th", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), found.alias("base"))


def license_spans(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, th, template, label, first, last, score: verified spans, for docs as with_key() gives them and templates (template, label, text).

    Templates of any number and length may be given; those of fewer than GRAM words match nothing.
    """
    kinds = template_grams(template_table(docs.sparkSession) if templates is None else templates)
    kinds = F.broadcast(kinds) if kinds.count() <= BROADCAST_GRAMS else kinds
    split = docs.select("doc_id", "th", words(lower_ascii(F.col("text")), NOT_ALNUM).alias("w"))
    grams = split.select("doc_id", "th", "w", F.posexplode("w").alias("p", "word")).select("doc_id", "th", "p", F.slice("w", F.col("p") + 1, GRAM).alias("gram"))
    votes = grams.select("doc_id", "th", "p", "gram", F.xxhash64("gram").alias("h")).join(kinds, "h").where("gram = t_gram")
    by = ["doc_id", "th", "template", "label", "n_template"]
    diagonals = votes.groupBy(*by, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.min("p").alias("first"), (F.max("p") + GRAM - 1).alias("last"))
    order = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= BAND, 0).otherwise(1)
    merged = diagonals.withColumn("new", new).withColumn("group", F.sum("new").over(order))
    merged = merged.groupBy(*by, "group").agg(F.flatten(F.collect_list("ts")).alias("ts"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + GRAM - 1)))))
    return merged.select("doc_id", "th", "template", "label", "first", "last", (covered / F.col("n_template")).alias("score")).where(F.col("score") >= COVER)


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text)."""
    docs = with_key(docs)
    found = license_spans(docs, templates).groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = found.withColumnsRenamed({"doc_id": "span_id", "th": "span_th"})
    base = _base(docs)
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("th") == F.col("span_th")), "left")
    written = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", written("base").alias("base_labels"), written(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"))
