"""Joins: semi and anti joins, top-1 per key, first match in order, shared values, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import small


def having(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a partner (EXISTS); NULL keys have none."""
    return df.join(other.select(*on), on, "left_semi")


def lacking(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner (NOT EXISTS): rows with NULL keys stay."""
    return df.join(other.select(*on), on, "left_anti")


def looked_up(df: DataFrame, dimension: DataFrame, on: list[str], defaults: dict | None = None) -> DataFrame:
    """Left lookup with defaults for what is missing; the dimension is broadcast only if its size is proven small."""
    out = df.join(small(dimension), on, "left")
    return out.fillna(defaults) if defaults else out


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key with the columns of its greatest row by ``order`` (ascending structs, NULL least).

    A mergeable maximum: one row per key and map task is shuffled, whatever the size of a key.
    """
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__b.v.{c}").alias(c) for c in columns if c not in keys))


def first_match(rows: DataFrame, row_id: str, rules: DataFrame, on: list[str], condition: Column, order: list[str], columns: list[str]) -> DataFrame:
    """For every row the first rule (by ``order``) that shares the keys and meets the condition; no rule, no row."""
    met = rows.join(small(rules), on).where(condition)
    pick = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))).alias("__r")
    return met.groupBy(row_id).agg(pick).select(row_id, *(F.col(f"__r.v.{c}").alias(c) for c in columns))


def shared_values(df: DataFrame, scope: list[str], value: str, row_id: str) -> DataFrame:
    """row_id of the rows whose value occurs in more than one row of its scope; NULL and empty values are not shared."""
    own = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    many = own.groupBy(*scope, value).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return own.join(many, [*scope, value], "left_semi").select(row_id).distinct()


def namesakes(df: DataFrame, page: list[str], name: str, entity: str) -> DataFrame:
    """Pairs (a, b), a < b, of entities that share a page and the lower-case name, with their first common page."""
    d = df.where(F.trim(name) != "").select(*page, F.lower(F.trim(name)).alias("__n"), entity).distinct()
    a, b = d.withColumnRenamed(entity, "a"), d.withColumnRenamed(entity, "b")
    return a.join(b, [*page, "__n"]).where("a < b").groupBy("a", "b").agg(*(F.min(c).alias(c) for c in page))


def zipped(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Positional join of two arrays: key, pos, left, right; the shorter array is filled with NULL."""
    return df.select(key, F.posexplode(F.arrays_zip(left, right)).alias("pos", "z")).select(key, "pos", F.col(f"z.{left}").alias(left), F.col(f"z.{right}").alias(right))
