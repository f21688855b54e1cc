"""Merges as full-outer-join rewrites: upserts, presence sweeps, change detection, import ladders, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], fields: list[str], seen: str) -> DataFrame:
    """Stored rows refreshed by new ones: a non-empty new value wins, an empty or NULL one never overwrites.

    Both sides hold one row per key. first_seen stays the stored one, last_seen takes the later; rows of either side
    alone are kept.
    """
    s = stored.select(*keys, *(F.col(f).alias(f"__s_{f}") for f in fields), "first_seen", "last_seen")
    n = new.select(*keys, *(F.col(f).alias(f"__n_{f}") for f in fields), F.col(seen).alias("__seen"))
    d = s.join(n, keys, "full")
    pick = lambda f: F.coalesce(F.when(F.col(f"__n_{f}") != "", F.col(f"__n_{f}")), F.col(f"__s_{f}"), F.col(f"__n_{f}")).alias(f)
    return d.select(*keys, *map(pick, fields), F.coalesce("first_seen", "__seen").alias("first_seen"), F.greatest("last_seen", "__seen").alias("last_seen"))


def presence_sweep(observations: DataFrame, seen: DataFrame, page: list[str], keys: list[str]) -> DataFrame:
    """Observations with ``present`` made true for the keys seen again, false for others of re-read pages, else kept."""
    pages = seen.select(*page).distinct().withColumn("__read", F.lit(True))
    again = seen.select(*page, *keys).distinct().withColumn("__again", F.lit(True))
    d = observations.join(pages, page, "left").join(again, [*page, *keys], "left")
    return d.withColumn("present", F.when(F.col("__read"), F.coalesce("__again", F.lit(False))).otherwise(F.col("present"))).drop("__read", "__again")


def changed(pages: DataFrame, snapshots: DataFrame, keys: list[str], content: str, signature: str) -> DataFrame:
    """Pages whose content hash or extraction signature isn't in the snapshots yet."""
    return pages.join(snapshots.select(*keys, content, signature), [*keys, content, signature], "left_anti")


def import_outcomes(rows: DataFrame, existing: DataFrame, key: Column, pos: str, stored_key: str) -> DataFrame:
    """Add ``outcome``: invalid, existing, duplicate_in_file or would_create, decided in the order of ``pos``."""
    d = rows.withColumn("__k", key)
    known = existing.select(F.col(stored_key).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__old", F.lit(True))
    d = d.join(known, "__k", "left")
    nth = F.row_number().over(Window.partitionBy("__k").orderBy(pos))
    outcome = F.when(F.col("__k").isNull(), "invalid").when(F.col("__old"), "existing").when(nth > 1, "duplicate_in_file").otherwise("would_create")
    return d.withColumn("outcome", outcome).drop("__k", "__old")


def expired(df: DataFrame, at: str, now: Column, text: str) -> DataFrame:
    """Texts blanked from their expiry on; the other columns stay."""
    return df.withColumn(text, F.when(F.col(at) <= now, "").otherwise(F.col(text)))
