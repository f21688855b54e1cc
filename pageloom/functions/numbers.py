"""Numeric rules as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def posterior_rate(productive: Column, fetched: Column) -> Column:
    """Mean of the Beta(1, 1) posterior of a share."""
    return (1 + productive) / (2 + fetched)


def yield_delta(productive: Column, fetched: Column) -> Column:
    """-15 after three fetches without result, +10 for two results at a rate of a half or more, else 0."""
    return F.when((fetched >= 3) & (productive == 0), -15).when((productive >= 2) & (posterior_rate(productive, fetched) >= 0.5), 10).otherwise(0)


def span_delta(productive: Column, fetched: Column, span: int = 40) -> Column:
    """Half-even rounded span x (rate - 1/2)."""
    return F.bround(F.lit(float(span)) * (posterior_rate(productive, fetched) - 0.5)).cast("int")


def retry_delay(attempts: Column, asked: Column | None = None) -> Column:
    """Seconds: 30 x 2^(attempts - 1) up to an hour, at least what was asked for, up to a day."""
    base = F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1))
    return F.least(F.lit(86400.0), F.greatest(base, F.coalesce(asked.cast("double"), F.lit(0.0)) if asked is not None else F.lit(0.0))).cast("int")


def cache_bucket(at: Column, days: int = 7) -> Column:
    """Number of the period of so many days that a time lies in."""
    return F.floor(F.unix_timestamp(at) / (days * 86400)).cast("long")


def percent_cap(limit: Column, share: Column) -> Column:
    """Share per cent of a limit, rounded up, in integers."""
    return F.floor((limit * share + 99) / 100).cast("int")


def normalized(weights: Column) -> Column:
    """Array of weights scaled to sum 1; NULL where the sum isn't positive."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(total > 0, F.transform(weights, lambda x: x.cast("double") / total))


def next_midnight(at: Column) -> Column:
    """Start of the day after a time."""
    return F.date_add(F.to_date(at), 1).cast("timestamp")


def nano(amount: Column) -> Column:
    """Amount in whole billionths, exact up to nine decimals."""
    return (amount.cast("decimal(20,9)") * 1000000000).cast("long")


def status_gate(status: Column) -> Column:
    """What a response's status asks for: retry (429 and from 500 on), blocked (401, 403), ok (2xx), else error; error for NULL."""
    return F.when((status == 429) | (status >= 500), "retry").when(status.isin(401, 403), "blocked").when(status.between(200, 299), "ok").otherwise("error")


def failure_category(kind: Column, message: Column, status: Column, retryable: Column) -> Column:
    """Category of a failure: kind is fetch, timeout, value, type or another; NULL messages, statuses and flags say nothing."""
    text, fetch = F.lower(F.coalesce(message, F.lit(""))), kind == "fetch"
    return (
        F.when((kind == "timeout") | (fetch & text.rlike("timed out|timeout")), "timeout").when(fetch & text.contains("robots"), F.when(text.contains("html"), "robots_invalid").otherwise("robots_denied"))
        .when(fetch & status.isin(401, 403), "access_blocked").when(fetch & (F.coalesce(retryable, F.lit(False)) | (status >= 500)), "http_unavailable").when(fetch, "fetch_error")
        .when(kind.isin("value", "type"), "parser_or_extraction_error").otherwise("worker_error")
    )


def readiness(cards: Column, roles: Column, accepted: Column, hard: Column, truncated: Column) -> Column:
    """Points of a recipe: cards (20 from two on, 15 for one), roles on 80 % of them 20, accepted records 25, no hard error among
    them 25; hard errors or a truncated page cost 25; never below 0."""
    some = lambda c, n: F.when(c, n).otherwise(0)
    points = F.when(cards >= 2, 20).when(cards > 0, 15).otherwise(0) + some((cards > 0) & (roles / cards >= 0.8), 20) + some(accepted > 0, 25) + some((accepted > 0) & (hard == 0), 25)
    return F.greatest(F.lit(0), points - some((hard > 0) | truncated, 25))


def merged_counters(a: Column, b: Column) -> Column:
    """Two counter maps as one, key by key; a NULL map counts as empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def sampled_priority(productive: Column, fetched: Column, seed: Column) -> Column:
    """80 and up to 10 more by a draw from Beta(1 + productive, 1 + the rest); the seed column makes it repeatable."""

    @F.pandas_udf("int")
    def draw(p: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
        got = [np.random.default_rng(abs(int(k))).beta(1 + a, 1 + max(b - a, 0)) for a, b, k in zip(p, n, s)]
        return pd.Series([80 + round(10 * x) for x in got], dtype="int32")

    return draw(F.coalesce(productive, F.lit(0)), F.coalesce(fetched, F.lit(0)), seed)
