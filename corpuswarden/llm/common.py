"""Helpers the training-data operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from corpuswarden.session import shared_dir

# Fixed value: what separates words in the contracts of decontamination and licenses.
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the folder all executors share.

    It cuts the lineage of iterative jobs and survives lost executors. Where the session
    was started with `spark.cleaner.referenceTracking.cleanCheckpoints`, the context's
    cleaner deletes the files once nothing refers to them; else they stay.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sized(df: DataFrame, max_rows: int) -> tuple[DataFrame, int]:
    """A durable side of a join, marked for broadcast if it has at most `max_rows` rows."""
    df = durable(df)
    rows = df.count()
    return (F.broadcast(df) if rows <= max_rows else df), rows


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and everything else as it is; null is empty.

    `lower` is fast and right for plain ASCII; `translate` leaves other letters alone.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column, breaks: str) -> Column:
    """The non-empty pieces between matches of `breaks`."""
    return F.array_remove(F.split(text, breaks), "")


def gram_hash(hashes: Column, start: Column, n: int) -> Column:
    """Hash of the `n` consecutive word hashes at `start`; it depends on `n` too."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, start + i) for i in range(n)])


def whole_row(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that added columns can't clash with them."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def doc_key(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """(id, digest): equal for rows that repeat both the id and the text."""
    return [F.col(f"`{id_col}`").alias("id"),
            F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["digest"] == right["digest"])
