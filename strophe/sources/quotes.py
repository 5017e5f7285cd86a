"""Quote files: one quote per line, or per paragraph if a blank line parts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.text import clean_quote


def read_official(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("text"))


def parsed_quotes(texts: DataFrame, text: str = "text") -> DataFrame:
    """(columns of ``texts``, quote_no from 1, quote) in order, empty quotes left out."""
    parts = F.when(F.col(text).rlike(r"\S[ \t]*\n[ \t]*\n\s*\S"), F.split(text, r"\n\s*\n")).otherwise(F.split(text, r"\r?\n"))
    quotes = F.filter(F.transform(parts, clean_quote), lambda q: q != "")
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(quotes).alias("i", "quote")).select(*others, (F.col("i") + 1).alias("quote_no"), "quote")
