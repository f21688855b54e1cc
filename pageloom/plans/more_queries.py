"""Further reports, joins, windows and merges over the domain tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.operators import aggregates as A
from pageloom.operators import joins as J
from pageloom.operators import windows as W
from pageloom.plans.registry import query
from pageloom.session import small, table


@query("a01_totals", """SELECT count(*) AS total, count(*) FILTER (WHERE contact_scope = 'person') AS personal, count(*) FILTER (WHERE contact_scope = 'shared') AS shared,
 count(*) FILTER (WHERE coalesce(email, '') <> '' OR coalesce(phone, '') <> '') AS reachable FROM records""")
def a01_totals(spark, d):
    """Totals of the records in one pass."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return A.conditional_counts(table(spark, d, "records"), [], personal=F.col("contact_scope") == "person", shared=F.col("contact_scope") == "shared", reachable=there("email") | there("phone"))


@query("a10_funnel", """SELECT t.threshold, u.campaign_id, count(*) AS pending, count(*) FILTER (WHERE score >= t.threshold) AS passing FROM discovered_urls u, (SELECT unnest([70, 50, 35]) AS threshold) t WHERE decision = 'pending' GROUP BY 1, 2""")
def a10_funnel(spark, d):
    """Pending rows that would pass each of three thresholds, from one scan."""
    u = table(spark, d, "discovered_urls").where("decision = 'pending'").withColumn("threshold", F.explode(F.array(F.lit(70), F.lit(50), F.lit(35))))
    return u.groupBy("threshold", "campaign_id").agg(F.count(F.lit(1)).alias("pending"), F.count(F.when(F.col("score") >= F.col("threshold"), 1)).alias("passing"))


@query("a11_method_funnel", """SELECT method, count(*) AS urls, count(*) FILTER (WHERE decision = 'approved') AS approved, count(DISTINCT search_query) FILTER (WHERE search_query <> '') AS queries FROM discovered_urls GROUP BY 1""")
def a11_method_funnel(spark, d):
    """Rows, approvals and distinct queries by method."""
    u = table(spark, d, "discovered_urls")
    q = u.where("search_query <> ''").select("method", "search_query").distinct().groupBy("method").agg(F.count(F.lit(1)).alias("queries"))
    n = u.groupBy("method").agg(F.count(F.lit(1)).alias("urls"), F.count(F.when(F.col("decision") == "approved", 1)).alias("approved"))
    return n.join(q, "method", "left").fillna(0, ["queries"])


@query("a13_query_stats", """SELECT search_query, count(DISTINCT origin) AS sites, count(DISTINCT origin) FILTER (WHERE decision = 'approved') AS good FROM discovered_urls WHERE search_query <> '' GROUP BY 1""")
def a13_query_stats(spark, d):
    """Sites and approved sites of every search query."""
    u = table(spark, d, "discovered_urls").where("search_query <> ''").groupBy("search_query", "origin").agg(F.max((F.col("decision") == "approved").cast("int")).alias("g"))
    return u.groupBy("search_query").agg(F.count(F.lit(1)).alias("sites"), F.sum("g").alias("good"))


@query("a16_assessments", """SELECT source_id, sum(name_cards)::BIGINT AS cards, count(*) AS records, count(*) FILTER (WHERE coalesce(title,'') <> '') AS titled,
 CASE WHEN count(*) FILTER (WHERE contact_scope = 'person') > 0 THEN 'contacts_found' WHEN sum(name_cards) > 0 THEN 'people_without_contacts' ELSE 'no_people' END AS outcome FROM records GROUP BY 1""")
def a16_assessments(spark, d):
    """Sums and outcome of every source's pages."""
    r = table(spark, d, "records").groupBy("source_id").agg(
        F.sum("name_cards").alias("cards"), F.count(F.lit(1)).alias("records"), F.count(F.when(F.coalesce("title", F.lit("")) != "", 1)).alias("titled"), F.count(F.when(F.col("contact_scope") == "person", 1)).alias("__p"),
    )
    return r.withColumn("outcome", F.when(F.col("__p") > 0, "contacts_found").when(F.col("cards") > 0, "people_without_contacts").otherwise("no_people")).drop("__p")


@query("a17_richest_pages", """SELECT source_id, page_url FROM (SELECT source_id, page_url, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, cards DESC, page_url DESC) AS r FROM
 (SELECT source_id, page_url, count(*) AS n, max(name_cards) AS cards FROM records WHERE page_url IS NOT NULL GROUP BY 1, 2)) WHERE r = 1""")
def a17_richest_pages(spark, d):
    """Page of every source with the most records, then cards."""
    p = table(spark, d, "records").where("page_url IS NOT NULL").groupBy("source_id", "page_url").agg(F.count(F.lit(1)).alias("n"), F.max("name_cards").alias("cards"))
    return J.best_per_key(p, ["source_id"], [F.col("n"), F.col("cards"), F.col("page_url")], ["page_url"])


@query("a23_name_multiplicity", "SELECT record_id, count(*) OVER (PARTITION BY page_url, lower(name)) AS same_name FROM records WHERE page_url IS NOT NULL AND name <> ''")
def a23_name_multiplicity(spark, d):
    """How many records of the page have the name."""
    r = table(spark, d, "records").where("page_url IS NOT NULL AND name <> ''").select("record_id", "page_url", F.lower("name").alias("n"))
    c = r.groupBy("page_url", "n").agg(F.count(F.lit(1)).alias("same_name"))
    return r.join(c, ["page_url", "n"]).select("record_id", "same_name")


@query("a29_lane_counters", "SELECT event_type, user_id % 4 AS lane, count(*) AS queued, count(*) FILTER (WHERE value > 50) AS ready, min(ts) AS next_at FROM events GROUP BY 1, 2")
def a29_lane_counters(spark, d):
    """Queued and ready items of every lane and their earliest time."""
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 4).alias("lane"))
    return e.agg(F.count(F.lit(1)).alias("queued"), F.count(F.when(F.col("value") > 50, 1)).alias("ready"), F.min("ts").alias("next_at"))


@query("j02_lookup", "SELECT u.url_id, coalesce(s.collector, 'none') AS collector FROM discovered_urls u LEFT JOIN sources s ON u.source_id = s.source_id")
def j02_lookup(spark, d):
    """Collector of every URL's source, 'none' where there is no source."""
    u = table(spark, d, "discovered_urls").select("url_id", "source_id")
    return J.looked_up(u, table(spark, d, "sources").select("source_id", "collector"), ["source_id"], {"collector": "none"}).select("url_id", "collector")


@query("j08_composite", "SELECT spec_id, EXISTS (SELECT 1 FROM discovered_urls u WHERE u.source_id = b.source_hint AND u.url = b.url) AS known FROM url_batches b")
def j08_composite(spark, d):
    """Whether the inventory holds the spec's (source, address)."""
    u = table(spark, d, "discovered_urls").where("source_id IS NOT NULL").select(F.col("source_id").alias("source_hint"), "url").distinct().withColumn("k", F.lit(True))
    return table(spark, d, "url_batches").select("spec_id", "source_hint", "url").join(u, ["source_hint", "url"], "left").select("spec_id", F.coalesce("k", F.lit(False)).alias("known"))


@query("j13_union_evidence", """WITH e AS (SELECT source_id, page_url AS u, contact_scope = 'person' AS p FROM records WHERE page_url IS NOT NULL UNION ALL SELECT source_id, url, score >= 60 FROM discovered_urls WHERE source_id IS NOT NULL)
 SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE p) AS productive FROM (SELECT source_id, u, bool_or(coalesce(p, false)) AS p FROM e GROUP BY 1, 2) GROUP BY 1""")
def j13_union_evidence(spark, d):
    """Yield of every source over two kinds of evidence, each address once."""
    a = table(spark, d, "records").where("page_url IS NOT NULL").select("source_id", F.col("page_url").alias("u"), (F.col("contact_scope") == "person").alias("p"))
    b = table(spark, d, "discovered_urls").where("source_id IS NOT NULL").select("source_id", F.col("url").alias("u"), (F.col("score") >= 60).alias("p"))
    return A.yields(a.unionByName(b), "source_id", "u", F.col("p")).select("source_id", "fetched", "productive")


@query("w05_best_start", "SELECT campaign_id, origin, url_id FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, origin ORDER BY score DESC, url_id) AS r FROM discovered_urls WHERE archived_at IS NULL) WHERE r = 1")
def w05_best_start(spark, d):
    """Best start page of every site of a campaign."""
    u = table(spark, d, "discovered_urls").where("archived_at IS NULL").select("campaign_id", "origin", "url_id", "score")
    return J.best_per_key(u, ["campaign_id", "origin"], [F.col("score"), -F.col("url_id")], ["url_id"])


@query("w08_first_page", "SELECT lead_id, min(record_id) AS record_id FROM records WHERE page_url IS NOT NULL GROUP BY 1")
def w08_first_page(spark, d):
    """First record with a page of every lead."""
    return table(spark, d, "records").where("page_url IS NOT NULL").groupBy("lead_id").agg(F.min("record_id").alias("record_id"))


@query("w10_cursor", "SELECT url_id FROM discovered_urls WHERE url_id > 500 AND decision = 'pending' ORDER BY url_id LIMIT 100")
def w10_cursor(spark, d):
    """Next hundred pending rows after a cursor (the scan's batch is the feature)."""
    return table(spark, d, "discovered_urls").where("url_id > 500 AND decision = 'pending'").orderBy("url_id").limit(100).select("url_id")


_PACKS = """WITH RECURSIVE r AS (SELECT coalesce(lead_id, -1) AS lead_id, record_id, coalesce(length(evidence), 0) AS n, row_number() OVER (PARTITION BY lead_id ORDER BY record_id) AS k FROM records),
 p AS (SELECT lead_id, record_id, k, n AS used, 0 AS pack FROM r WHERE k = 1 UNION ALL SELECT r.lead_id, r.record_id, r.k, CASE WHEN p.used + r.n > 300 THEN r.n ELSE p.used + r.n END, CASE WHEN p.used + r.n > 300 THEN p.pack + 1 ELSE p.pack END
 FROM p JOIN r ON r.lead_id = p.lead_id AND r.k = p.k + 1) SELECT record_id, pack FROM p"""


@query("w13_packing", _PACKS)
def w13_packing(spark, d):
    """Pack of every record's evidence under 300 characters per lead: greedy in order, one streamed fold; NULL leads are one."""

    def fold(batches):
        at, pack, used = None, 0, 0
        for pdf in batches:
            out = []
            for lead, n in zip(pdf["lead"], pdf["n"]):
                if lead != at:
                    at, pack, used = lead, 0, 0
                elif used + n > 300:
                    pack, used = pack + 1, 0
                used += n
                out.append(pack)
            yield pdf.assign(pack=out)[["record_id", "pack"]].astype({"pack": "int32"})

    lead = F.coalesce(F.concat(F.lit("="), F.col("lead_id").cast("string")), F.lit(""))
    r = table(spark, d, "records").select(lead.alias("lead"), "record_id", F.coalesce(F.length("evidence"), F.lit(0)).alias("n"))
    return r.repartition("lead").sortWithinPartitions("lead", "record_id").mapInPandas(fold, "record_id long, pack int")


@query("f02_candidates", "SELECT url_id FROM discovered_urls WHERE decision = 'pending' AND archived_at IS NULL AND (contains(lower(url), 'team') OR contains(lower(label), 'team'))")
def f02_candidates(spark, d):
    """Open candidates that mention a team."""
    has = lambda c: F.lower(c).contains("team")
    return table(spark, d, "discovered_urls").where((F.col("decision") == "pending") & F.col("archived_at").isNull() & (has("url") | F.coalesce(has("label"), F.lit(False)))).select("url_id")


@query("f20_spans", "SELECT doc_id, sha256(substr(text, 1, least(120, length(text)))) AS span_hash, length(text) >= 40 AS valid FROM documents")
def f20_spans(spark, d):
    """Hash and bounds check of every document's first span."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(F.substring(t, 1, 120), 256).alias("span_hash"), (F.length(t) >= 40).alias("valid"))


@query("c27_queries", """SELECT DISTINCT campaign_id, k || ' ' || t AS search_query FROM (SELECT campaign_id, unnest(keywords) AS k, sales_terms FROM campaigns), unnest(sales_terms) AS x(t)""")
def c27_queries(spark, d):
    """Search queries of a campaign: every keyword with every sales term, within the row."""
    c = table(spark, d, "campaigns").select("campaign_id", F.explode("keywords").alias("k"), "sales_terms").select("campaign_id", "k", F.explode("sales_terms").alias("t"))
    return c.select("campaign_id", F.concat_ws(" ", "k", "t").alias("search_query")).distinct()


@query("c40_json_path", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def c40_json_path(spark, d):
    """Sum of a JSON field by event type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("m24_cascade", "SELECT url_id, coalesce(s.blocked_at IS NOT NULL, false) AS paused FROM discovered_urls u LEFT JOIN sources s ON u.source_id = s.source_id")
def m24_cascade(spark, d):
    """Rows paused by the block of their source."""
    s = table(spark, d, "sources").select("source_id", F.col("blocked_at").isNotNull().alias("b"))
    return table(spark, d, "discovered_urls").select("url_id", "source_id").join(small(s), "source_id", "left").select("url_id", F.coalesce("b", F.lit(False)).alias("paused"))


@query("s10_index_specs", """WITH s AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, min(source_id) AS source_id FROM sources WHERE approved GROUP BY 1)
 SELECT s.source_id, count(DISTINCT b.url) AS pages FROM url_batches b JOIN s ON regexp_extract(b.url, '^https?://([^/?#]+)', 1) = s.h GROUP BY 1""")
def s10_index_specs(spark, d):
    """Index lines by the approved source on their host."""
    h = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    s = table(spark, d, "sources").where("approved").groupBy(h.alias("h")).agg(F.min("source_id").alias("source_id"))
    b = table(spark, d, "url_batches").where("url IS NOT NULL").select(h.alias("h"), "url").where("h <> ''").distinct()
    return b.join(small(s), "h").groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"))


@query("u05_taken_sites", """SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS site FROM (SELECT url FROM sources UNION ALL SELECT origin AS url FROM discovered_urls WHERE decision = 'dismissed') WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) <> ''""")
def u05_taken_sites(spark, d):
    """Sites that sources or dismissals take."""
    both = table(spark, d, "sources").select("url").unionByName(table(spark, d, "discovered_urls").where("decision = 'dismissed'").select(F.col("origin").alias("url")))
    h = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return both.where(h != "").select(F.regexp_replace(h, "^www\\.", "").alias("site")).distinct()


