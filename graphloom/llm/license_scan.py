"""License scan by diagonal voting.

All rolling word k-gram hashes of a document are joined to the template positions that have the same
gram. Hits vote for the diagonal (place in the document minus place in the template); neighbouring
diagonals merge, so that a dropped or added word doesn't split a match. Words of every hit are compared,
and the text between the first and the last hit of a merged span with the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _dist
from .decontaminate import covered, word_hashes, words

#: Phrases that the base labels stand for.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Wordings from the public licenses themselves, for labels beside the base ones.
WORDINGS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
)
#: Whole texts of short public licenses.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", "zlib"),
)
#: Longest gram; templates of fewer words have one gram.
GRAM = 4
#: Share of a wording's words that merged diagonals must cover, and of its characters that the text between them must equal; how far apart diagonals may be.
LEAST_COVER, NEAR_DIAGONALS, NEAR_WORDS = 0.7, 3, 6


def grams(spark: SparkSession, base: tuple, wordings: tuple) -> DataFrame:
    """(hash, gram, k, template, is_base, at, length): the rolling grams of all templates, a table whose size the templates fix."""
    rows = []
    for t, (phrase, _) in enumerate((*base, *wordings)):
        w = phrase.split(" ")
        k = min(GRAM, len(w))
        rows += [(w[i : i + k], k, t, t < len(base), i, len(w)) for i in range(len(w) - k + 1)]
    table = spark.createDataFrame(rows, "gram array<string>, k int, template int, is_base boolean, at int, length int")
    return table.select(F.xxhash64(word_hashes(F.col("gram"))).alias("hash"), "*")


def diagonals(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, row_key, template, is_base, length, k, diagonal, votes, spans) of docs(doc_id, text); spans: template words hit, sorted."""
    sizes = sorted(r["k"] for r in templates.select("k").distinct().collect())  # 1 to GRAM
    split = docs.select("doc_id", _dist.row_key("doc_id", "text").alias("row_key"), words(F.col("text")).alias("w")).withColumn("h", word_hashes(F.col("w")))
    at = split.select("doc_id", "row_key", "w", "h", F.posexplode("h").alias("pos", "word"))
    at = at.withColumn("n", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("pos") + F.col("n") <= F.size("h"))
    at = at.withColumn("hash", F.xxhash64(F.slice("h", F.col("pos") + 1, F.col("n"))))
    probe = F.broadcast(templates.withColumnRenamed("hash", "__hash"))
    # equality as a range, so that words are compared after the hashes have met, not probed with them
    met = at.join(probe, (F.col("hash") == F.col("__hash")) & F.slice("w", F.col("pos") + 1, F.col("n")).between(F.col("gram"), F.col("gram")))
    met = met.withColumn("diagonal", F.col("pos") - F.col("at"))
    keys = ["doc_id", "row_key", "template", "is_base", "length", "k", "diagonal"]
    span = F.struct(F.col("at").alias("pos"), (F.col("at") + F.col("k")).alias("end"))
    return met.groupBy(*keys).agg(F.array_sort(F.collect_set(span)).alias("spans")).withColumn("votes", F.size("spans"))


def _merge(found: Column) -> Column:
    """The run of neighbouring diagonals that covers the most distinct template words: (cover, start, end, first, last), words of the document and of the template. found: sorted (start, end, diagonal, spans)."""
    none = F.array().cast("array<struct<pos:int,end:int>>")
    best = F.struct(F.lit(0).cast("long").alias("cover"), *[F.lit(0).alias(c) for c in ("start", "end", "first", "last")])
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("diagonal"), none.alias("spans"), best.alias("best"))

    def add(acc: Column, x: Column) -> Column:
        near = (F.size(acc["spans"]) > 0) & (F.abs(x["diagonal"] - acc["diagonal"]) <= NEAR_DIAGONALS) & (x["start"] - acc["end"] <= NEAR_WORDS)
        start, end = F.when(near, acc["start"]).otherwise(x["start"]), F.when(near, F.greatest(acc["end"], x["end"])).otherwise(x["end"])
        return F.transform(F.array(F.when(near, F.array_sort(F.array_union(acc["spans"], x["spans"]))).otherwise(x["spans"])), lambda spans: F.transform(F.array(covered(spans)), lambda cover: F.struct(
            start.alias("start"), end.alias("end"), x["diagonal"].alias("diagonal"), spans.alias("spans"),
            F.when(cover > acc["best"]["cover"], F.struct(cover.alias("cover"), start.alias("start"), end.alias("end"), spans[0]["pos"].alias("first"), F.array_max(F.transform(spans, lambda y: y["end"])).alias("last"))).otherwise(acc["best"]).alias("best"),
        ))[0])[0]

    return F.aggregate(found, zero, add, lambda acc: acc["best"])


def _likeness(words_: Column, run: Column, templates: list[list[str]]) -> Column:
    """Share of the template's characters between a run's first and last hit that the document's words there equal, 0 below LEAST_COVER: one less the edit distance over the longer length."""
    template = F.array(*[F.array(*[F.lit(w) for w in t]) for t in templates])[run["template"]]
    said = F.array_join(F.slice(words_, run["start"] + 1, run["end"] - run["start"]), " ")
    asked = F.array_join(F.slice(template, run["first"] + 1, run["last"] - run["first"]), " ")
    longer = F.greatest(F.length(said), F.length(asked))
    most = F.floor(longer * (1 - LEAST_COVER)).cast("int")
    distance = F.call_function("levenshtein", said, asked, most)
    return F.when((F.abs(F.length(said) - F.length(asked)) <= most) & (distance >= 0), 1 - distance / longer).otherwise(0.0)


def license_scan(docs: DataFrame, base: tuple = BASE, wordings: tuple = (*WORDINGS, *TEXTS)) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null texts have none.
    n_base: places where all words of a base phrase stand one after the other; first_word and last_word:
    their smallest and largest start, from 0, else null. labels adds those of wordings of which merged
    diagonals cover LEAST_COVER or more of the distinct places, and whose text there is as alike. score:
    1 with a base phrase, else the best share of a wording, covered and then alike, 0 to 1. Label lists are
    distinct, sorted and comma-joined, empty without labels. Rows that repeat one another get equal
    results. A long text is split in one task, whose memory holds its words once. Empty tables give no
    rows; other columns don't matter.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labels = F.array(*[F.lit(label) for _, label in (*base, *wordings)])
    votes = diagonals(docs, grams(docs.sparkSession, base, wordings))
    whole = F.when(F.col("is_base") & (F.col("votes") == F.col("length") - F.col("k") + 1), F.col("diagonal"))
    run = F.struct((F.col("diagonal") + F.col("spans")[0]["pos"]).alias("start"), (F.col("diagonal") + F.element_at("spans", -1)["end"]).alias("end"), "diagonal", "spans")
    by_template = votes.groupBy("doc_id", "row_key", "template", "is_base", "length").agg(F.array_sort(F.collect_list(F.when(~F.col("is_base"), run))).alias("runs"), F.count(whole).alias("places"), F.min(whole).alias("first"), F.max(whole).alias("last"))
    by_template = by_template.withColumn("best", F.when(~F.col("is_base"), _merge(F.col("runs")))).where(~F.col("is_base") | (F.col("places") > 0))
    found = by_template.groupBy("doc_id", "row_key").agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("is_base"), labels[F.col("template")]))).alias("base_labels"),
        F.collect_list(F.when(~F.col("is_base"), F.struct("template", (F.col("best.cover") / F.col("length")).alias("share"), "best.start", "best.end", "best.first", "best.last"))).alias("runs"),  # one for each template
    )
    found = _dist.materialize(found, "licenses")
    named = found.withColumnsRenamed({"doc_id": "__id", "row_key": "__row"})
    each = docs.select("doc_id", _dist.row_key("doc_id", "text").alias("row_key"), words(F.col("text")).alias("w"))
    out = each.join(_dist.small_or_shuffled(named, found.count()), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__row")), "left")
    texts = [phrase.split(" ") for phrase, _ in (*base, *wordings)]
    sure = F.transform("runs", lambda r: F.struct(labels[r["template"]].alias("label"), (r["share"] >= LEAST_COVER).alias("covered"), F.when(r["share"] >= LEAST_COVER, F.least(r["share"], _likeness(F.col("w"), r, texts))).otherwise(r["share"]).alias("score")))
    out = out.select("doc_id", F.size("w").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", sure.alias("runs"))
    fits = F.transform(F.filter("runs", lambda r: r["covered"] & (r["score"] >= LEAST_COVER)), lambda r: r["label"])
    none = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("runs", lambda r: r["score"])), F.lit(0.0)))
    base_labels = F.coalesce("base_labels", none)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce(fits, none)))), ",").alias("labels"), score.alias("score"))
