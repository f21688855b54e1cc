"""Window-style operators: top n, interleaving, caps, running admission, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps only n rows per key before the shuffle (window group limit)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def numbered_top(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """The first n rows of each key with their place; Spark keeps only n rows per key before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def interleaved(df: DataFrame, scope: list[str], tier: str, origin: str, priority: str, pos: str) -> DataFrame:
    """Add ``place``: tiers in order; in a tier origins by their best item, one item of each origin per round."""
    by = [*scope, tier]
    w = Window.partitionBy(*by, origin).orderBy(F.desc(priority), F.asc(pos))
    d = df.withColumn("__round", F.row_number().over(w))
    best = d.where("__round = 1").select(*by, origin, F.struct((-F.col(priority)).alias("p"), F.col(pos).alias("q"), F.col(origin).alias("o")).alias("__best"))
    d = d.join(best, [*by, origin])
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(tier, "__round", "__best"))
    return d.withColumn("place", place).drop("__round", "__best")


def excess(df: DataFrame, keys: list[str], order: list[Column], cap: Column) -> DataFrame:
    """The rows to give up so that no key has more than ``cap``: the first by ``order``; cap is constant per key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(cap).alias("__cap")).where("__n > __cap")
    d = df.join(counts, keys)
    return d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r <= __n - __cap").drop("__r", "__n", "__cap")


def admitted(df: DataFrame, keys: list[str], order: list[Column], capacity: Column) -> DataFrame:
    """Rows in order while the running count of their key is within the capacity."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= capacity).drop("__r")


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: str, out: str = "running") -> DataFrame:
    """Running sum of an amount up to and including each row."""
    return df.withColumn(out, F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def last_at_first_place(df: DataFrame, keys: list[str], pos: str, columns: list[str]) -> DataFrame:
    """One row per key: the values of its last row at the position of its first."""
    last = F.max(F.struct(F.col(pos).alias("__p"), *columns)).alias("__l")
    return df.groupBy(*keys).agg(F.min(pos).alias(pos), last).select(*keys, pos, *(F.col(f"__l.{c}").alias(c) for c in columns))


def ranked(df: DataFrame, keys: list[str], order: list[Column], relevant: Column) -> DataFrame:
    """Add rank and hits (relevant rows so far) within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("rank", F.row_number().over(w)).withColumn("relevant", F.coalesce(relevant.cast("int"), F.lit(0)))
    return d.withColumn("hits", F.sum("relevant").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def average_precision(df: DataFrame, keys: list[str], order: list[Column], relevant: Column, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Average precision and precision at k per key; 0 without relevant rows."""
    d = ranked(df, keys, order, relevant)
    ap = F.coalesce(F.sum(F.when(F.col("relevant") == 1, F.col("hits") / F.col("rank"))) / F.nullif(F.sum("relevant"), F.lit(0)), F.lit(0.0))
    at = [F.avg(F.when(F.col("rank") <= k, F.col("relevant"))).alias(f"p_at_{k}") for k in ks]
    return d.groupBy(*keys).agg(ap.alias("average_precision"), *at)
