"""Benchmark decontamination: documents that hold word windows of benchmark items.

The hash set of normalised benchmark windows, their words and a number each, is broadcast
if its rows and bytes allow it. The words of a document are hashed once, exploded in place
and probed window by window inside generated code; equal hashes are verified on the words.
Only hits and one row per document are shuffled. The items of a window, of which a phrase
that all of them share has any number, meet the numbers found in a document afterwards.

Defined results: a null or empty text has no words and is clean; an item with fewer
words than a window is one window, an item without words none; items with equal texts
share windows and all count; an item whose id is null marks words but is not counted;
rows that repeat an id and a text each get the same result; an empty benchmark hits
nothing; other columns of the inputs are ignored by `scan` and kept by `remove_*`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuswarden.llm.common import (
    WORD_BREAKS, ascii_lower, doc_key, durable, gram_hash, same_key, split_words, whole_row)

WINDOW = 10
# Distinct windows that are broadcast at most, and the bytes of their words.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 32 << 20

# The same breaks in text that still has its capitals.
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"



def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), WORD_BREAKS)


def windows_of(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id",
               text_col: str = "text") -> DataFrame:
    """Distinct windows (number, words, n, key, items): `items` are the sorted ids as strings."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"),
                             words_of(F.col(f"`{text_col}`")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    grams = items.where(F.size("w") > 0).select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    keyed = F.transform("words", lambda w: F.xxhash64(w))
    distinct = grams.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = distinct.select("words", F.size("words").alias("n"), "items", keyed.alias("h"))
    keys = [gram_hash(F.col("h"), F.lit(0), n) for n in range(1, size + 1)]
    chosen = F.coalesce(*[F.when(F.col("n") == n, key) for n, key in enumerate(keys, 1)])
    return rows.select(F.monotonically_increasing_id().alias("number"), "words", "n", "items",
                       chosen.alias("key"))


def _positions(docs: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, digest, words, total, pos, n, key) for every window, and a row with pos 0 per document."""
    words = docs.select(*doc_key(docs, id_col, text_col),
                        words_of(F.col(f"`{text_col}`")).alias("words"))
    hashed = words.select("id", "digest", "words", F.size("words").alias("total"),
                          F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    marked = F.concat(F.array(F.lit(None).cast("long")), "h")
    at = hashed.select("id", "digest", "words", "total", "h", F.posexplode(marked).alias("pos", "_"))
    first = F.col("pos") - 1
    keys = [F.struct(F.lit(n).alias("n"), F.when(
        (F.col("pos") > 0) & (first + n <= F.col("total")),
        gram_hash(F.col("h"), first, n)).alias("key")) for n in lengths]
    if len(keys) == 1:
        rows = at.select("id", "digest", "words", "total", "pos", keys[0].alias("g"))
    else:
        rows = at.select("id", "digest", "words", "total", "pos", F.explode(F.array(*keys)).alias("g"))
        rows = rows.where((F.col("pos") > 0) | (F.col("g.n") == lengths[0]))
    return rows.select("id", "digest", "words", "total", "pos", "g.n", "g.key")


def _found(docs: DataFrame, windows: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Verified hits (id, digest, total, pos, n, number) and a row with pos 0 per document.

    `windows` is durable, so its numbers stay.
    """
    sizes = windows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.aggregate(
        "words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))).alias("bytes")
    ).collect()  # one row per window length, `size` at most
    lengths = sorted(row["n"] for row in sizes) or [size]
    rows = _positions(docs, lengths, id_col, text_col)
    side = windows.select("key", F.col("words").alias("window"), "number")
    if (sum(row["rows"] for row in sizes) <= BROADCAST_WINDOWS
            and sum(row["bytes"] for row in sizes) <= BROADCAST_BYTES):
        side = F.broadcast(side)
        same = (rows["key"] == side["key"]) & (
            F.slice(rows["words"], F.greatest(rows["pos"], F.lit(1)), rows["n"]) == side["window"])
        met = rows.join(side, same, "left").where("pos = 0 or number is not null")
        return met.select("id", "digest", "total", "pos", "n", "number")
    # A benchmark too large to broadcast: narrow candidates meet its windows by hash,
    # and go back to their documents for the words.
    alone = rows.where("pos = 0").select("id", "digest", "total", "pos", "n",
                                         F.lit(None).cast("long").alias("number"))
    near = rows.where("key is not null").select("id", "digest", "pos", "n", "key").join(side, "key")
    texts = docs.select(*doc_key(docs, id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    texts = texts.groupBy("id", "digest").agg(F.first("text").alias("text"))
    back = near.join(texts, same_key(near, texts)).select(
        near["id"], near["digest"], "pos", "n", "number", "window", words_of(F.col("text")).alias("words"))
    sure = back.where(F.slice("words", F.col("pos"), F.col("n")) == F.col("window")).select(
        "id", "digest", F.size("words").alias("total"), "pos", "n", "number")
    return alone.unionByName(sure)


def _with_spans(df: DataFrame) -> DataFrame:
    """`df` with `spans`, disjoint (start, end), for its `hits`; a hit has `size` words at most.

    The hit words are put in order once, and a span ends where the next one doesn't follow.
    """
    words = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1)))
    marked = df.withColumn("at", F.array_sort(F.array_distinct(words)))
    n = F.size("at")
    firsts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (
        F.get("at", i) > F.get("at", i - 1) + 1))
    cut = marked.withColumn("firsts", F.when(n > 0, firsts))
    spans = F.transform(F.sequence(F.lit(0), F.size("firsts") - 2), lambda k: F.struct(
        F.get("at", F.get("firsts", k)).alias("start"),
        (F.get("at", F.get("firsts", k + 1) - 1) + 1).alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return cut.withColumn("spans", F.when(n > 0, spans).otherwise(none)).drop("at", "firsts", "hits")


def _per_key(docs, benchmark, size, id_col, text_col, item_col, item_text_col) -> DataFrame:
    windows = durable(windows_of(benchmark, size, item_col, item_text_col))
    found = _found(docs, windows, size, id_col, text_col)
    hit = F.when(F.col("pos") > 0, F.struct((F.col("pos") - 1).alias("start"),
                                            (F.col("pos") - 1 + F.col("n")).alias("end")))
    grouped = durable(_with_spans(found.groupBy("id", "digest").agg(
        F.max("total").cast("long").alias("n_words"), F.sum(F.expr("int(pos = 0)")).alias("copies"),
        F.collect_set(hit).alias("hits"), F.collect_set("number").alias("numbers"))))
    named = grouped.where(F.size("numbers") > 0).select(
        F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.explode("numbers").alias("number"))
    items = named.join(windows.select("number", "items"), "number").groupBy("hit_id", "hit_digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    none = F.expr("cast(array() as array<string>)")
    return grouped.drop("numbers").join(items, same, "left").select(
        "id", "digest", "n_words", "copies", "spans", F.coalesce("items", none).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of `docs`: (id, digest, n_words, n_hit, spans, items).

    `spans` are disjoint ranges of hit words, `items` the sorted ids of the items with
    windows in the document.
    """
    keyed = _per_key(docs, benchmark, size, id_col, text_col, item_col, item_text_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    rows = keyed.withColumn("n_hit", hit).withColumn(
        "_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select("id", "digest", "n_words", "n_hit", "spans", "items")


def _hit_keys(docs, benchmark, size, id_col, text_col, item_col, item_text_col) -> DataFrame:
    return _per_key(docs, benchmark, size, id_col, text_col, item_col, item_text_col).where(
        F.size("spans") > 0)


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                     id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text") -> DataFrame:
    """Rows of `docs` without any hit, with all their columns."""
    hit = _hit_keys(docs, benchmark, size, id_col, text_col, item_col, item_text_col)
    rows = docs.select(whole_row(docs).alias("row"), *doc_key(docs, id_col, text_col))
    return rows.join(hit, same_key(rows, hit), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """`docs` with the hit words, and what stands between them, cut out of the text."""
    hit = _hit_keys(docs, benchmark, size, id_col, text_col, item_col, item_text_col)
    rows = docs.select(whole_row(docs).alias("row"), *doc_key(docs, id_col, text_col))
    met = rows.join(hit.select("id", "digest", "spans"), same_key(rows, hit), "left")
    raw = F.col(f"row.`{text_col}`")
    # A word and the break after it are one unit; the text is a leading break and its units.
    words = split_words(raw, RAW_BREAKS)
    breaks = F.regexp_extract_all(raw, F.lit(RAW_BREAKS), F.lit(0))
    lead = raw.rlike("^" + RAW_BREAKS)
    units = F.transform("words", lambda w, i: F.concat(w, F.coalesce(
        F.get("breaks", i + F.col("lead").cast("int")), F.lit(""))))
    kept = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.array_join(F.slice(
        "units", F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("spans", i)["start"], F.size("units"))
        - F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))), ""))
    cut = met.select(rows["row"], "spans", words.alias("words"), breaks.alias("breaks"),
                     lead.alias("lead")).withColumn("units", units)
    start = F.when(F.col("lead"), F.get("breaks", F.lit(0))).otherwise(F.lit(""))
    text = F.when(F.col("spans").isNull(), raw).otherwise(F.concat(start, F.array_join(kept, "")))
    return cut.withColumn("text_", text).select(*[
        (F.col("text_") if name == text_col else F.col(f"row.`{name}`")).alias(name)
        for name in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The scan with the counts and the digest of the items."""
    ids = F.array_join("items", ",")
    return scan(docs, benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLE = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
b as (select cast(item_id as varchar) as item, {WORDS_SQL} as w from benchmark),
win as (
  select distinct item, list_slice(w, s + 1, s + least(10, len(w))) as words
  from (select item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct len(words) as n from win),
p as (
  select doc_id, n, unnest(range(len(w) - n + 1)) as s,
         unnest(list_transform(range(len(w) - n + 1),
                               lambda s: array_to_string(list_slice(w, s + 1, s + n), ' '))) as words
  from d cross join sizes where len(w) >= n),
hit as (select p.doc_id, p.s, p.n, win.item
        from p join (select item, array_to_string(words, ' ') as words, len(words) as n from win) win
          using (words, n)),
marks as (select distinct doc_id, unnest(range(s, s + n)) as at from hit),
n_hit as (select doc_id, count(*) as n from marks group by 1),
its as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids
        from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit.n, 0) as bigint) as n_hit,
       cast(coalesce(its.n, 0) as bigint) as n_items, sha256(coalesce(its.ids, '')) as items_sha256,
       coalesce(n_hit.n, 0) > 0 as contaminated
from d left join n_hit using (doc_id) left join its using (doc_id)
"""
