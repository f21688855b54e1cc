"""Capping records per dominant contributor with mergeable quality histograms.

Per contributor a histogram of the quality is built with map-side combining (one row per bin, never one per
record). The running count over the bins, best first, gives one cutoff row for each contributor over its cap: the
borderline bin and how many records of it may stay. One join with the cutoffs drops the records of better bins, marks
those of worse bins as over the cap and leaves the borderline ones, narrow rows of fixed width that are written once
and go on to the next, finer binning. The last bins hold at most TIES records each, by a split of the row ids, so that
not even a contributor of equal qualities is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.registry import query
from pageloom.session import small, table, written


#: Row ids to a last bin: the most records that are ranked together.
TIES = 4096


def over_cap(df: DataFrame, contributor: list[str], cap: str, levels: list[str], row_id: str) -> DataFrame:
    """Ids of the records beyond the first ``cap`` of their contributor; cap is a column, constant per contributor.

    levels: quality columns, coarse to fine, of which greater values come first and NULL comes last; a level may be a
    rounding of the next. Ties of all levels are settled by the smaller row_id, a unique integer. A NULL cap never
    cuts; a cap of 0 or less cuts every record; NULL contributors form one contributor; an empty table gives no row.
    """
    who = [x for c in contributor for x in (F.col(c).isNull(), F.col(c))]
    # (false, NULL) is below every (true, value); smaller ids come first.
    bins = [F.struct(F.col(c).isNotNull(), F.col(c)) for c in levels] + [F.struct(F.lit(True), -F.floor(F.col(row_id) / TIES))]
    at = df.where(F.col(cap).isNotNull()).select(
        F.xxhash64(F.lit(1), *who).alias("h1"), F.xxhash64(F.lit(2), *who).alias("h2"), F.greatest(F.col(cap).cast("long"), F.lit(0).cast("long")).alias("left"),
        F.col(row_id), *(b.alias(f"bin{n}") for n, b in enumerate(bins)),
    )
    over = None
    for n in range(len(bins)):
        counts = at.groupBy("h1", "h2", f"bin{n}").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("h1", "h2").orderBy(F.desc(f"bin{n}")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = counts.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left")))
        cut = cut.select("h1", "h2", F.col(f"bin{n}").alias("at"), (F.col("left") - F.col("before")).alias("rest"))
        rest = [f"bin{m}" for m in range(n + 1, len(bins))]
        met = at.join(cut, ["h1", "h2"]).where(F.col(f"bin{n}") <= F.col("at"))
        beyond = (F.col(f"bin{n}") < F.col("at")) | (F.col("rest") == 0)
        met = written(met.select("h1", "h2", F.col("rest").alias("left"), row_id, *rest, beyond.alias("beyond")))
        lost, at = met.where("beyond").select(row_id), met.where("NOT beyond").drop("beyond")
        over = lost if over is None else over.unionByName(lost)
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(row_id))
    return over.unionByName(at.withColumn("rank", rank).where(F.col("rank") > F.col("left")).select(row_id))


def with_share_cap(df: DataFrame, scope: list[str], share: float, out: str = "cap") -> DataFrame:
    """Add the number of records that a contributor may have: the whole part of a share of all records of its scope."""
    total = df.groupBy(*scope).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).cast("long").alias(out))
    keys = [F.col(f"__t.{c}") for c in scope]
    d = df.alias("__d").join(small(total).alias("__t"), [F.col(f"__d.{c}").eqNullSafe(k) for c, k in zip(scope, keys)])
    return d.select("__d.*", f"__t.{out}")


#: Origin without case, blanks and punctuation at its ends.
ORIGIN_EDGES = "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$"


def origin_key(origin: Column) -> Column:
    """Origins are the same apart from case, blanks and end punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(origin), "[\\s\\u00a0\\u200b\\u3000]+", ""), ORIGIN_EDGES, "")


ACTIVE = """
SELECT url_id, u.campaign_id, score, last_seen, floor(c.max_candidates / 10) AS cap,
       regexp_replace(regexp_replace(lower(origin), '[\\s\\x{00a0}\\x{200b}\\x{3000}]+', '', 'g'), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS o
FROM discovered_urls u JOIN campaigns c ON u.campaign_id = c.campaign_id WHERE archived_at IS NULL
"""
RANKED = f"SELECT *, row_number() OVER (PARTITION BY campaign_id, o ORDER BY score DESC NULLS LAST, last_seen DESC NULLS LAST, url_id) AS r FROM ({ACTIVE})"


def capped_urls(spark, sf_dir) -> DataFrame:
    """Active rows with origin key and the campaign's cap; campaigns are few rows and joined as AQE sees fit."""
    urls = table(spark, sf_dir, "discovered_urls").where("archived_at IS NULL").select("url_id", "campaign_id", origin_key(F.col("origin")).alias("o"), "score", "last_seen")
    caps = table(spark, sf_dir, "campaigns").select("campaign_id", F.floor(F.col("max_candidates") / 10).alias("cap"))
    return urls.join(caps, "campaign_id")


@query("p6_found", f"SELECT url_id FROM ({RANKED}) WHERE r > cap")
def p6_found(spark, sf_dir):
    """Rows beyond their origin's share: bins by score, then by hour of last_seen, then by last_seen, ties by url_id."""
    urls = capped_urls(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "last_seen"))
    return over_cap(urls, ["campaign_id", "o"], "cap", ["score", "hour", "last_seen"], "url_id")


_SHARE = """SELECT *, row_number() OVER (PARTITION BY campaign_id, method ORDER BY score DESC NULLS LAST, url_id) AS r, count(*) OVER (PARTITION BY campaign_id) AS n FROM discovered_urls"""


@query("p6_share_of_method", f"SELECT url_id FROM ({_SHARE}) WHERE r > floor(n * 0.25)")
def p6_share_of_method(spark, sf_dir):
    """Rows beyond a quarter of their campaign's rows for each method of discovery, lowest scores first."""
    urls = with_share_cap(table(spark, sf_dir, "discovered_urls").select("url_id", "campaign_id", "method", "score"), ["campaign_id"], 0.25)
    return over_cap(urls, ["campaign_id", "method"], "cap", ["score"], "url_id")


@query("p6_shares", f"SELECT campaign_id, o AS origin_key, count(*) AS active, count(*) FILTER (WHERE r > cap) AS over FROM ({RANKED}) GROUP BY 1, 2 HAVING count(*) > max(cap)")
def p6_shares(spark, sf_dir):
    """Contributors that exceed their cap: active rows and rows over it, from the counts alone."""
    return (
        capped_urls(spark, sf_dir).groupBy("campaign_id", F.col("o").alias("origin_key")).agg(F.count(F.lit(1)).alias("active"), F.max("cap").alias("cap"))
        .where("active > cap").select("campaign_id", "origin_key", "active", (F.col("active") - F.greatest("cap", F.lit(0))).alias("over"))
    )
