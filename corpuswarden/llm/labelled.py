"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text is 0 modulo 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, text, y) of at most `per_class` documents of each class, and the class sizes.

    Only ids outside the held-out fold take part; those with the smallest hashes are
    taken, so the sample does not depend on partitions. Labels that are null or not 0
    or 1 are ignored; of several labels of one id the greatest counts. The sampled ids,
    at most twice `per_class`, are broadcast.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(
        F.max("y").alias("y"))
    sizes = {row["y"]: row["count"] for row in known.groupBy("y").count().collect()}
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(
        known.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(
        F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "y"), sizes
