"""Merges, sources and streams as queries over the domain tables."""

from pyspark.sql import functions as F

from pageloom.operators import merge as M
from pageloom.plans.registry import query
from pageloom.session import table

_UP = """WITH s AS (SELECT lead_id, max_by(title, record_id) AS title, max_by(company, record_id) AS company, min(record_id) AS f, max(record_id) AS l FROM (SELECT lead_id, record_id, coalesce(title,'') AS title, coalesce(company,'') AS company FROM records WHERE record_id % 2 = 0) GROUP BY 1),
 n AS (SELECT lead_id, max_by(title, record_id) AS title, max_by(company, record_id) AS company, max(record_id) AS seen FROM (SELECT lead_id, record_id, coalesce(title,'') AS title, coalesce(company,'') AS company FROM records WHERE record_id % 2 = 1) GROUP BY 1)
 SELECT coalesce(s.lead_id, n.lead_id) AS lead_id, coalesce(nullif(n.title, ''), s.title, n.title) AS title, coalesce(nullif(n.company, ''), s.company, n.company) AS company,
 coalesce(s.f, n.seen) AS first_seen, greatest(s.l, n.seen) AS last_seen FROM s FULL JOIN n ON s.lead_id = n.lead_id"""


@query("m01_upsert", _UP)
def m01_upsert(spark, d):
    """Leads known from one half of the records refreshed by the other half: non-empty values win."""
    r = table(spark, d, "records").select("lead_id", "record_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("company", F.lit("")).alias("company"))
    last = F.max(F.struct("record_id", "title", "company")).alias("b")
    old = r.where("record_id % 2 = 0").groupBy("lead_id").agg(last, F.min("record_id").alias("first_seen"), F.max("record_id").alias("last_seen")).select("lead_id", "b.title", "b.company", "first_seen", "last_seen")
    new = r.where("record_id % 2 = 1").groupBy("lead_id").agg(last, F.max("record_id").alias("seen")).select("lead_id", "b.title", "b.company", "seen")
    return M.upsert(old, new, ["lead_id"], ["title", "company"], "seen")


@query("m02_presence", """WITH seen AS (SELECT DISTINCT campaign_id, origin, url FROM discovered_urls WHERE score >= 50), pages AS (SELECT DISTINCT campaign_id, origin FROM seen)
 SELECT u.url_id, CASE WHEN p.origin IS NOT NULL THEN s.url IS NOT NULL ELSE true END AS present FROM discovered_urls u LEFT JOIN pages p ON u.campaign_id = p.campaign_id AND u.origin = p.origin
 LEFT JOIN seen s ON u.campaign_id = s.campaign_id AND u.origin = s.origin AND u.url = s.url""")
def m02_presence(spark, d):
    """Presence after a sweep: page = origin, seen again = addresses that scored 50."""
    u = table(spark, d, "discovered_urls").select("url_id", "campaign_id", "origin", "url", "score").withColumn("present", F.lit(True))
    return M.presence_sweep(u, u.where("score >= 50"), ["campaign_id", "origin"], ["url"]).select("url_id", "present")


@query("m22_expired", "SELECT doc_id, CASE WHEN fetched_at::TIMESTAMP <= TIMESTAMP '2025-09-01' THEN 0 ELSE length(text) END AS kept FROM documents")
def m22_expired(spark, d):
    """Length of each text after those fetched before September 2025 have expired."""
    docs = M.expired(table(spark, d, "documents").select("doc_id", "text", "fetched_at"), "fetched_at", F.lit("2025-09-01").cast("timestamp"), "text")
    return docs.select("doc_id", F.length("text").alias("kept"))


@query("s17_export", """SELECT lead_id, CASE WHEN regexp_matches(ltrim(n), '^[=+@-]') THEN '''' || n ELSE n END AS name, records FROM (SELECT lead_id, array_to_string(list_sort(list(DISTINCT name)), '; ') AS n, count(*) AS records FROM records WHERE name <> '' GROUP BY 1)""")
def s17_export(spark, d):
    """Export rows: sorted distinct names of a lead in one safe cell."""
    from pageloom.functions.text import safe_cell

    names = table(spark, d, "records").where("name <> ''")
    cells = names.select("lead_id", "name").distinct().groupBy("lead_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("n"))
    return cells.join(names.groupBy("lead_id").agg(F.count(F.lit(1)).alias("records")), "lead_id").select("lead_id", safe_cell(F.col("n")).alias("name"), "records")


@query("g06_stream_quotas", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def g06_stream_quotas(spark, d):
    """Daily quotas as a stream: tumbling day windows over the event files, read until no data is left."""
    from pageloom.streaming.quotas import daily_counts

    return daily_counts(spark, f"{d}/events.parquet")


@query("g10_stream_dedup", "SELECT count(DISTINCT event_id) AS events FROM events")
def g10_stream_dedup(spark, d):
    """Events delivered twice count once in the stream."""
    from pageloom.streaming.quotas import distinct_events

    return distinct_events(spark, f"{d}/events.parquet").agg(F.count(F.lit(1)).alias("events"))


@query("g04_stream_throttle", "SELECT user_id, count(*) AS requests, floor(max(epoch(ts)))::BIGINT + 60 AS next_allowed FROM events GROUP BY 1")
def g04_stream_throttle(spark, d):
    """Next allowed time per origin (user) from keyed state with a delay of a minute."""
    from pageloom.streaming.quotas import throttled

    return throttled(spark, f"{d}/events.parquet", 60)
