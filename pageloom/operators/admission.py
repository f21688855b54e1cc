"""Ordered admission under interacting caps: an exact fold per scope, and its window form for separable caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def admit_exact(df: DataFrame, scope: str, order: list[str], group: str, exploratory: str, slots: str, share_cap: str) -> DataFrame:
    """Rows taken in order while slots last, exploratory rows only up to their cap, one exploratory row per group.

    The two caps interact, so rows are folded in order: partitions are cut by scope and sorted, and the fold is a
    stream over each partition with one counter pair and one set of groups per scope, never a gathered scope. Rows with a
    NULL scope are one scope; a NULL cap admits none of what it caps; ties of ``order`` are admitted in any order.
    """
    keep = df.schema.fieldNames()
    # A text that no other scope has stands for NULL, which would equal nothing in the fold.
    key = F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken, explored, groups = object(), 0, 0, set()
        for pdf in batches:
            mask = []
            for s, g, e, n, cap in zip(pdf["__scope"], pdf[group], pdf[exploratory], pdf[slots], pdf[share_cap]):
                if s != at:
                    at, taken, explored, groups = s, 0, 0, set()
                ok = taken < n and (not e or (explored < cap and g not in groups))
                if ok:
                    taken += 1
                    if e:
                        explored += 1
                        groups.add(g)
                mask.append(ok)
            yield pdf.loc[mask, keep]

    d = df.withColumn("__scope", key).repartition("__scope").sortWithinPartitions("__scope", *order)
    return d.mapInPandas(fold, StructType([df.schema[c] for c in keep]))


def admit_separable(df: DataFrame, scope: list[str], order: list[Column], per_group: tuple[str, Column] | None, total: Column) -> DataFrame:
    """The window form: at most a cap per group first, then the total per scope, both in the same order."""
    if per_group:
        name, cap = per_group
        df = df.withColumn("__g", F.row_number().over(Window.partitionBy(*scope, name).orderBy(*order))).where(F.col("__g") <= cap).drop("__g")
    return df.withColumn("__t", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("__t") <= total).drop("__t")
