"""License scan by diagonal voting on rolling word k-grams.

Every k-gram of a text is probed against the k-grams of the templates. A match at
position p with template offset o votes for diagonal p - o. Votes are summed per
(document, template, diagonal); neighbours in the order of diagonals that are close to
each other are merged, so that a few added or missing words don't split a notice, nor do
the far diagonals of grams it repeats; a merged span counts if it holds enough of its
template. Short notices are cut into shorter grams, of which an added word breaks fewer.
The base phrases are templates whose 2-grams must all stand on one diagonal.

The templates are constants, so their k-grams (some thousand rows) are broadcast. Only
votes and one row per document are shuffled.

Defined results: a null or empty text has no words and no labels; a null id is an id like
any other; rows that repeat an id and a text each get the same result; a place that
several notices share counts for each of them; an empty table gives no rows; other columns
are ignored. A very long text is one row of hashes; its votes are counted by diagonal before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpuswarden.llm.common import (
    WORD_BREAKS, ascii_lower, doc_key, gram_hash, split_words)

# The base phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# The words of common public license notices, with SPDX-like labels.
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under "
                   "the terms of the gnu general public license as published by the free "
                   "software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not "
                          "use this file except in compliance with the license you may obtain a "
                          "copy of the license at"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 "
                  "international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 "
                     "international license"),
    ("mit-release", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of "
                 "this software and associated documentation files the software to deal in the "
                 "software without restriction"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification "
                 "are permitted provided that the following conditions are met"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose "
                 "with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl-2.0", "either version 2 of the license or at your option any later version"),
    ("lgpl-notice", "redistribute it and or modify it under the terms of the gnu lesser general public "
                    "license as published by the free software foundation"),
    ("agpl-notice", "redistribute it and or modify it under the terms of the gnu affero general public "
                    "license as published by the free software foundation"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any "
                     "warranty without even the implied warranty of merchantability or fitness for a "
                     "particular purpose see the gnu general public license for more details"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the "
                "eclipse public license 2 0"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("apache-2.0-warranty", "unless required by applicable law or agreed to in writing software distributed "
                            "under the license is distributed on an as is basis without warranties or "
                            "conditions of any kind either express or implied see the license for the "
                            "specific language governing permissions and limitations under the license"),
    ("mit-full", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                 "and associated documentation files the software to deal in the software without restriction "
                 "including without limitation the rights to use copy modify merge publish distribute "
                 "sublicense and or sell copies of the software and to permit persons to whom the software is "
                 "furnished to do so subject to the following conditions the above copyright notice and this "
                 "permission notice shall be included in all copies or substantial portions of the software "
                 "the software is provided as is without warranty of any kind express or implied including but "
                 "not limited to the warranties of merchantability fitness for a particular purpose and "
                 "noninfringement in no event shall the authors or copyright holders be liable for any claim "
                 "damages or other liability whether in an action of contract tort or otherwise arising from "
                 "out of or in connection with the software or the use or other dealings in the software"),
    ("isc-full", "permission to use copy modify and or distribute this software for any purpose with or without "
                 "fee is hereby granted provided that the above copyright notice and this permission notice "
                 "appear in all copies the software is provided as is and the author disclaims all warranties "
                 "with regard to this software including all implied warranties of merchantability and fitness "
                 "in no event shall the author be liable for any special direct indirect or consequential "
                 "damages or any damages whatsoever resulting from loss of use data or profits whether in an "
                 "action of contract negligence or other tortious action arising out of or in connection with "
                 "the use or performance of this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are "
                     "permitted provided that the following conditions are met 1 redistributions of source "
                     "code must retain the above copyright notice this list of conditions and the following "
                     "disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
                     "this list of conditions and the following disclaimer in the documentation and or other "
                     "materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written "
                     "permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the "
             "authors be held liable for any damages arising from the use of this software permission is "
             "granted to anyone to use this software for any purpose including commercial applications and to "
             "alter it and redistribute it freely subject to the following restrictions 1 the origin of this "
             "software must not be misrepresented you must not claim that you wrote the original software if "
             "you use this software in a product an acknowledgment in the product documentation would be "
             "appreciated but is not required 2 altered source versions must be plainly marked as such and "
             "must not be misrepresented as being the original software 3 this notice may not be removed or "
             "altered from any source distribution"),
)

PHRASE_K = 2
NOTICE_K, SHORT_K = 3, 2
SHORT = 12          # words below which a notice is cut into grams of SHORT_K
MAX_SHIFT = 3       # diagonals this close are neighbours
MAX_GAP = 6         # unmatched words between two merged parts
MIN_COVERAGE = 0.7  # part of a notice's k-grams that must be found


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[str, str, int, list[str]]]:
    """(template, label, k, words)."""
    rows = [(f"phrase {label}", label, PHRASE_K, text.split()) for label, text in phrases]
    words = [(label, text.split()) for label, text in notices]
    return rows + [(f"notice {label}", label, SHORT_K if len(w) < SHORT else NOTICE_K, w) for label, w in words]


def _grams(spark, rows) -> DataFrame:
    """One row per distinct k-gram: (k, gram, places), places being (template, offset)."""
    values = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(k).alias("k"), F.lit(" ".join(w)).alias("text"))
                       for t, _, k, w in rows])
    words = spark.range(1).select(F.inline(values)).withColumn("words", F.split("text", " "))
    offsets = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("offset")
    each = words.select("template", "k", "words", offsets).select(
        "k", F.slice("words", F.col("offset") + 1, F.col("k")).alias("gram"), F.struct("template", "offset").alias("at"))
    return each.groupBy("k", "gram").agg(F.array_sort(F.collect_list("at")).alias("places"))


def _votes(docs: DataFrame, rows, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, total, pos, template, offset) per vote; pos is -1 in one row per document."""
    grams = _grams(docs.sparkSession, rows)
    words = docs.select(*doc_key(docs, id_col, text_col), split_words(
        ascii_lower(F.col(f"`{text_col}`")), WORD_BREAKS).alias("words"))
    hashed = words.select("id", "digest", "words", F.size("words").alias("total"),
                          F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    marked = F.concat(F.array(F.lit(None).cast("long")), "h")
    at = hashed.select("id", "digest", "words", "total", "h", F.posexplode(marked).alias("p", "_"))
    met, start = at.withColumn("pos", F.col("p") - 1), F.col("pos")
    sizes = sorted({k for _, _, k, _ in rows})
    for k in sizes:
        side = grams.where(F.col("k") == k).select(
            "gram", F.col("places").alias(f"places{k}"),
            gram_hash(F.transform("gram", lambda w: F.xxhash64(w)), F.lit(0), k).alias("key"))
        key = F.when((start >= 0) & (start + k <= F.col("total")), gram_hash(F.col("h"), start, k))
        same = (key == side["key"]) & (
            F.slice("words", F.greatest(start + 1, F.lit(1)), k) == side["gram"])
        met = met.join(F.broadcast(side), same, "left").drop("gram", "key")
    none = F.expr("cast(array() as array<struct<template:string,offset:int>>)")
    found = F.concat(*[F.coalesce(f"places{k}", none) for k in sizes])
    alone = F.expr("array(struct(cast(null as string) as template, cast(null as int) as offset))")
    places = F.when(start < 0, alone).otherwise(found)
    return met.select("id", "digest", "total", "pos", F.explode(places).alias("at")).select(
        "id", "digest", "total", "pos", "at.template", "at.offset")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES,
         notices=NOTICES) -> DataFrame:
    """Per row of `docs`: (id, n_words, places, spans, best).

    `places` are (start, label) of the base phrases, `spans` (start, end, label, coverage)
    of the verified notices, in words; `best` is the greatest part of a notice found.
    """
    rows = templates(phrases, notices)
    size = F.create_map(*[F.lit(x) for t, _, k, w in rows for x in (t, len(w) - k + 1)])
    gram = F.create_map(*[F.lit(x) for t, _, k, _ in rows for x in (t, k)])
    label = F.create_map(*[F.lit(x) for t, name, _, _ in rows for x in (t, name)])
    votes = _votes(docs, rows, id_col, text_col)
    diagonals = votes.groupBy(
        "id", "digest", "template", (F.col("pos") - F.col("offset")).alias("diagonal")).agg(
        F.count("*").alias("rows"), F.max("total").alias("total"),
        F.min("pos").alias("low"), F.max("pos").alias("high"),
        F.collect_set("offset").alias("offsets"))
    is_base = F.col("template").startswith("phrase ")
    in_order = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    far = is_base | (F.col("diagonal") - F.lag("diagonal").over(in_order) > MAX_SHIFT)
    bands = diagonals.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn(
        "band", F.sum("far").over(in_order))
    key = Window.partitionBy("id", "digest", "template", "band").orderBy("low", "diagonal")
    apart = F.col("low") > F.max("high").over(key.rowsBetween(Window.unboundedPreceding, -1)) + MAX_GAP
    clusters = bands.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "cluster", F.sum("apart").over(key)).groupBy("id", "digest", "template", "band", "cluster").agg(
        F.max("rows").alias("rows"), F.max("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.size(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("matched"))
    sized = clusters.withColumn("coverage", F.col("matched") / size[F.col("template")]).withColumn(
        "end", F.col("high") + gram[F.col("template")]).withColumn("label", label[F.col("template")])
    found = F.col("template").isNotNull() & ~is_base
    keyed = sized.groupBy("id", "digest").agg(
        F.max("total").cast("long").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).cast("int").alias("copies"),
        F.array_sort(F.collect_list(F.when(is_base & (F.col("coverage") == 1), F.struct(
            F.col("low").alias("start"), "label")))).alias("places"),
        F.array_sort(F.collect_list(F.when(found & (F.col("coverage") >= MIN_COVERAGE), F.struct(
            F.col("low").alias("start"), "end", "label", "coverage")))).alias("spans"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("best"))
    return keyed.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop(
        "_", "copies", "digest")


def report(docs: DataFrame) -> DataFrame:
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label"))))
    return scan(docs).select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"))


def _oracle() -> str:
    from corpuswarden.llm.decontaminate import WORDS_SQL

    values = ", ".join(
        f"('{t}', '{label}', {k}, '{' '.join(words)}', {str(t.startswith('phrase ')).lower()})"
        for t, label, k, words in templates())
    return f"""
with t(template, label, k, words, base) as (values {values}),
tw as (select template, label, k, base, string_split(words, ' ') as w from t),
g as (select template, k, unnest(range(len(w) - k + 1)) as o,
             unnest(list_transform(range(len(w) - k + 1),
                    lambda s: array_to_string(list_slice(w, s + 1, s + k), ' '))) as words from tw),
d as (select doc_id, {WORDS_SQL} as w from documents),
p as (select doc_id, k, unnest(range(len(w) - k + 1)) as pos,
             unnest(list_transform(range(len(w) - k + 1),
                    lambda s: array_to_string(list_slice(w, s + 1, s + k), ' '))) as words
      from d cross join (select distinct k from t) s where len(w) >= k),
dg as (select doc_id, template, pos - o as diagonal, min(pos) as low, max(pos) as high,
              list(distinct o) as offsets
       from p join g using (k, words) group by 1, 2, 3),
b as (select *, sum(case when template like 'phrase %' or before is null or diagonal - before > {MAX_SHIFT}
                         then 1 else 0 end) over (partition by doc_id, template order by diagonal) as band
      from (select *, lag(diagonal) over (partition by doc_id, template order by diagonal) as before from dg)),
n as (select *, max(high) over (partition by doc_id, template, band order by low, diagonal
                                rows between unbounded preceding and 1 preceding) as reach from b),
c as (select *, sum(case when reach is null or low > reach + {MAX_GAP} then 1 else 0 end)
                over (partition by doc_id, template, band order by low, diagonal) as cluster from n),
m as (select doc_id, template, band, cluster, min(low) as low, max(high) as high,
             len(list_distinct(flatten(list(offsets)))) as matched
      from c group by 1, 2, 3, 4),
s as (select m.doc_id, m.low, tw.label, tw.base,
             cast(m.matched as double) / (len(tw.w) - tw.k + 1) as coverage
      from m join tw using (template)),
r as (select doc_id, cast(count(*) filter (base and coverage = 1) as bigint) as n_base,
             min(low) filter (base and coverage = 1) as first_word,
             max(low) filter (base and coverage = 1) as last_word,
             max(coverage) filter (not base) as best,
             string_agg(distinct label, ',' order by label) filter (base and coverage = 1) as base_labels,
             string_agg(distinct label, ',' order by label) filter (
               case when base then coverage = 1 else coverage >= {MIN_COVERAGE} end) as labels
      from s group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(r.n_base, 0) as n_base,
       cast(r.first_word as bigint) as first_word, cast(r.last_word as bigint) as last_word,
       coalesce(r.base_labels, '') as base_labels, coalesce(r.labels, '') as labels,
       case when r.n_base > 0 then 1.0::double else coalesce(r.best, 0.0::double) end as score
from d left join r using (doc_id)
"""


ORACLE = _oracle()
