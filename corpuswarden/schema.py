"""Schemas of the tables that flow between operators."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("rel", T.StringType()),
    T.StructField("text", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("evidence", T.StringType()),
])

# One row per piece of evidence found in one file. `kind` says what `a` and `b` hold.
FACTS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("rel", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("a", T.StringType()),
    T.StructField("b", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
])

REPO_RUNS = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("checks", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StructType([
        T.StructField(level, T.LongType()) for level in ("P0", "P1", "P2", "P3")
    ])),
    T.StructField("total", T.LongType()),
    T.StructField("files", T.LongType()),
    T.StructField("stack", T.ArrayType(T.StringType())),
    T.StructField("seconds", T.DoubleType()),
])

SCHEMA_VERSION = 1
CONFIDENCES = ("CONFIRMED", "SUSPECTED")
SEVERITIES = ("P0", "P1", "P2", "P3")
FIX_CLASSES = ("auto", "assisted", "manual")
SNIPPET_CHARS = 240
