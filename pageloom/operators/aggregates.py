"""Aggregations: filtered and distinct counts, yields, histograms in one pass, counter maps, duplicates, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.numbers import posterior_rate, yield_delta


def conditional_counts(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """One count per named condition in a single pass; NULL conditions don't count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()))


def yields(jobs: DataFrame, origin: str, url: str, productive: Column) -> DataFrame:
    """Distinct addresses fetched and productive per origin, posterior rate and score delta.

    Two-phase: one row per (origin, url) with an OR of productive, then counts; both combine before their shuffles, so
    an origin with a third of the jobs costs no more than its distinct addresses.
    """
    pages = jobs.where(F.col(origin).isNotNull() & F.col(url).isNotNull()).groupBy(origin, url).agg(F.max(F.coalesce(productive, F.lit(False))).alias("p"))
    out = pages.groupBy(origin).agg(F.count(F.lit(1)).alias("fetched"), F.count(F.when(F.col("p"), 1)).alias("productive"))
    return out.withColumns({"rate": posterior_rate(F.col("productive"), F.col("fetched")), "delta": yield_delta(F.col("productive"), F.col("fetched"))})


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n: the histograms of several columns from one scan (grouping sets); NULL is a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def counter_sums(df: DataFrame, keys: list[str], counters: str) -> DataFrame:
    """Sum of open counter maps: keys, counter, total."""
    return df.select(*keys, F.explode(counters).alias("counter", "__v")).groupBy(*keys, "counter").agg(F.sum("__v").alias("total"))


def surplus_duplicates(df: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """Rows beyond the first of each duplicate key, per group of keys."""
    n = df.withColumn("__k", key).where("__k IS NOT NULL").groupBy(*keys, "__k").agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.sum(F.col("__n") - 1).alias("duplicates"))


def most_common(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n most frequent values with their counts; ties by value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(n)


def overlap(actual: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """correct, false_positive, missed and expected counts of two sets of rows."""
    a, e = actual.select(*on).distinct().withColumn("__a", F.lit(1)), expected.select(*on).distinct().withColumn("__e", F.lit(1))
    both = a.join(e, on, "full")
    return both.agg(
        F.count(F.when(F.col("__a").isNotNull() & F.col("__e").isNotNull(), 1)).alias("correct"), F.count(F.when(F.col("__e").isNull(), 1)).alias("false_positive"),
        F.count(F.when(F.col("__a").isNull(), 1)).alias("missed"), F.count("__e").alias("expected"),
    )
