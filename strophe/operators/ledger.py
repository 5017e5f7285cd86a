"""Cost ledgers: totals, estimates and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.text import one_decimal


def totals(entries: DataFrame, key: str, usd: str) -> DataFrame:
    """Sum per ``key`` and the grand total under the name total."""
    rolled = entries.rollup(key).agg(F.sum(usd).alias("usd"), F.grouping(key).alias("__all"))
    return rolled.select(F.when(F.col("__all") == 1, "total").otherwise(F.col(key)).alias(key), F.coalesce("usd", F.lit(0.0)).alias("usd"))


def estimate_total(usd: Column) -> Column:
    """The sum, or null if any row has no price."""
    return F.when(F.bool_or(usd.isNull()), None).otherwise(F.sum(usd))


def call_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, cache_read: Column, cache_write: Column, price_read: Column, price_write: Column) -> Column:
    """Cost of a call; cached tokens cost a tenth or five quarters of input tokens unless priced; null without a price."""
    read, write = F.coalesce(price_read, 0.1 * price_in), F.coalesce(price_write, 1.25 * price_in)
    return (tokens_in * price_in + tokens_out * price_out + cache_read * read + cache_write * write) / 1_000_000


def units_text(value: Column) -> Column:
    """Thousands separators; two decimals for small values that aren't whole."""
    return F.when((value == F.floor(value)) | (F.abs(value) >= 100), F.format_number(F.bround(value), 0)).otherwise(F.format_number(value, 2))


def bytes_text(size: Column) -> Column:
    """B, KB, MB or GB by thousands."""
    scaled = lambda k, unit: F.concat(one_decimal(size / float(10**k)), F.lit(f" {unit}"))
    return F.when(size < 1000, F.format_string("%d B", size)).when(size < 10**6, scaled(3, "KB")).when(size < 10**9, scaled(6, "MB")).otherwise(scaled(9, "GB"))


def clock(seconds: Column) -> Column:
    """m:ss of the rounded seconds (half to even)."""
    s = F.bround(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)
