"""Joins, aggregations, windows, sorts, limits and set operations as reports over the domain tables and the star schema."""

from pyspark.sql import functions as F

from pageloom.operators import aggregates as A
from pageloom.operators import joins as J
from pageloom.operators import windows as W
from pageloom.plans.registry import query
from pageloom.session import small, table



def active():
    """Rows that count as inventory: not archived, and not dismissed without a scope."""
    return F.col("archived_at").isNull() & ~((F.col("decision") == "dismissed") & (F.coalesce("dismissal_scope", F.lit("")) == ""))


ACTIVE_SQL = "(archived_at IS NULL AND NOT (decision = 'dismissed' AND coalesce(dismissal_scope, '') = ''))"


@query("inventory_report", f"""SELECT campaign_id, count(*) AS total, count(*) FILTER (WHERE {ACTIVE_SQL}) AS counted, count(*) FILTER (WHERE archived_at IS NOT NULL) AS archived,
 count(*) FILTER (WHERE source_id IS NOT NULL) AS with_source, count(*) FILTER (WHERE manual_review_required) AS to_review FROM discovered_urls GROUP BY 1""")
def inventory_report(spark, d):
    """Counts of every campaign's inventory in one pass."""
    return A.conditional_counts(
        table(spark, d, "discovered_urls"), ["campaign_id"], counted=active(), archived=F.col("archived_at").isNotNull(),
        with_source=F.col("source_id").isNotNull(), to_review=F.col("manual_review_required"),
    )


_DIMS = ["decision", "kind", "method", "archive_reason", "dismissal_scope"]


@query("a06_histograms", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c}::VARCHAR AS value, count(*) AS n FROM discovered_urls GROUP BY 2" for c in _DIMS))
def a06_histograms(spark, d):
    """Histograms of the inventory's categories from one scan."""
    return A.histograms(table(spark, d, "discovered_urls"), _DIMS)


_Y = "SELECT user_id, count(DISTINCT event_id) AS fetched, count(DISTINCT event_id) FILTER (WHERE value > 80) AS productive FROM events GROUP BY 1"


@query("a02_yields", f"""SELECT user_id, fetched, productive, (1 + productive) / (2 + fetched) AS rate, CASE WHEN fetched >= 3 AND productive = 0 THEN -15
 WHEN productive >= 2 AND (1 + productive) / (2 + fetched) >= 0.5 THEN 10 ELSE 0 END AS delta FROM ({_Y})""")
def a02_yields(spark, d):
    """Yield of every origin; origin = user_id, address = event_id, productive = value above 80."""
    return A.yields(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 80)


@query("a02_label_yields", """SELECT origin, count(*) AS fetched, count(*) FILTER (WHERE p) AS productive FROM (SELECT origin, url, bool_or(coalesce(label, '') <> '') AS p FROM discovered_urls
 WHERE origin IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def a02_label_yields(spark, d):
    """Distinct addresses and labelled addresses per origin; one origin holds a tenth of the rows."""
    return A.yields(table(spark, d, "discovered_urls"), "origin", "url", F.coalesce("label", F.lit("")) != "").select("origin", "fetched", "productive")


@query("a04_harvest", "SELECT event_type, user_id % 10 AS lane, count(*) AS n, sum(value) AS total, grouping(event_type, user_id % 10)::INT AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())")
def a04_harvest(spark, d):
    """Harvest by method, by lane and overall in one grouping-sets pass."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("lane"), "value")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.grouping_id().cast("int").alias("level")]
    return e.groupingSets([["event_type"], ["lane"], []], "event_type", "lane").agg(*sums)


@query("a05_having", "SELECT source_id, count(*) AS pages FROM discovered_urls WHERE source_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND max(score) < 80")
def a05_having(spark, d):
    """Sources with ten pages or more and none that scores 80."""
    u = table(spark, d, "discovered_urls").where("source_id IS NOT NULL")
    return u.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), F.max("score").alias("m")).where("pages >= 10 AND m < 80").drop("m")


@query("a08_counters", "SELECT campaign_id, e.key AS counter, sum(e.value)::BIGINT AS total FROM (SELECT campaign_id, unnest(map_entries(diagnostics)) AS e FROM discovery_runs) GROUP BY 1, 2")
def a08_counters(spark, d):
    """Sum of the runs' open counters per campaign."""
    return A.counter_sums(table(spark, d, "discovery_runs"), ["campaign_id"], "diagnostics")


@query("a09_terminal", """SELECT run_id, CASE WHEN status = 'failed' THEN 'job_failures' WHEN contacts_seen = 0 AND coalesce(list_sum(map_values(diagnostics)), 0) > 0 THEN 'extraction_rejected'
 WHEN pages_done > 0 AND contacts_seen = 0 THEN 'no_accepted_contacts' WHEN contacts_seen > 0 AND new_contacts = 0 THEN 'refresh_only' ELSE 'completed' END AS ending FROM discovery_runs""")
def a09_terminal(spark, d):
    """How a run ended: failures, then refused cards, then pages without contacts, then known contacts only; its diagnostics count the refusals."""
    refused = F.coalesce(F.aggregate(F.map_values("diagnostics"), F.lit(0).cast("long"), lambda x, v: x + v), F.lit(0))
    e = (
        F.when(F.col("status") == "failed", "job_failures").when((F.col("contacts_seen") == 0) & (refused > 0), "extraction_rejected")
        .when((F.col("pages_done") > 0) & (F.col("contacts_seen") == 0), "no_accepted_contacts").when((F.col("contacts_seen") > 0) & (F.col("new_contacts") == 0), "refresh_only").otherwise("completed")
    )
    return table(spark, d, "discovery_runs").select("run_id", e.alias("ending"))


@query("a12_latest_runs", "SELECT campaign_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY run_id DESC) AS r FROM discovery_runs) WHERE r = 1")
def a12_latest_runs(spark, d):
    """Latest run of every campaign (mergeable maximum, no sort)."""
    return J.best_per_key(table(spark, d, "discovery_runs"), ["campaign_id"], [F.col("run_id")], ["run_id", "status"])


@query("a15_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM discovered_urls) GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def a15_reasons(spark, d):
    """The twenty most frequent score reasons."""
    return A.most_common(table(spark, d, "discovered_urls").select(F.explode("reasons").alias("reason")), ["reason"], 20)


@query("a19_daily_quotas", """SELECT campaign_id, strftime(day, '%Y-%m-%d') AS day, used, sum(used) OVER (PARTITION BY campaign_id ORDER BY day)::BIGINT AS running FROM
 (SELECT campaign_id, CAST(first_seen::TIMESTAMP AS DATE) AS day, count(*) AS used FROM discovered_urls WHERE first_seen IS NOT NULL GROUP BY 1, 2)""")
def a19_daily_quotas(spark, d):
    """Requests per campaign and UTC day with their running total."""
    u = table(spark, d, "discovered_urls").where("first_seen IS NOT NULL").groupBy("campaign_id", F.to_date("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return W.running_total(u, ["campaign_id"], [F.col("day")], "used").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a20_ledger", "SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS spent, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS reserved FROM orders GROUP BY 1")
def a20_ledger(spark, d):
    """Exact integer totals and open reservations per owner."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(cents).alias("spent"), F.sum(F.when(F.col("o_orderstatus") == "O", cents).otherwise(0)).alias("reserved"))


@query("a24_overlap", """WITH a AS (SELECT DISTINCT url FROM url_batches WHERE url IS NOT NULL), e AS (SELECT DISTINCT url FROM discovered_urls)
 SELECT count(*) FILTER (WHERE a.url IS NOT NULL AND e.url IS NOT NULL) AS correct, count(*) FILTER (WHERE e.url IS NULL) AS false_positive,
 count(*) FILTER (WHERE a.url IS NULL) AS missed, count(e.url) AS expected FROM a FULL JOIN e ON a.url = e.url""")
def a24_overlap(spark, d):
    """Overlap of handed-in addresses with the inventory."""
    return A.overlap(table(spark, d, "url_batches").where("url IS NOT NULL"), table(spark, d, "discovered_urls"), ["url"])


_AP = """WITH r AS (SELECT campaign_id, (decision = 'approved')::INT AS rel, row_number() OVER w AS rk, sum((decision = 'approved')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM discovered_urls WINDOW w AS (PARTITION BY campaign_id ORDER BY score DESC, url_id))
 SELECT campaign_id, coalesce(sum(CASE WHEN rel = 1 THEN h / rk END) / nullif(sum(rel), 0), 0) AS average_precision, avg(CASE WHEN rk <= 10 THEN rel END) AS p_at_10, avg(CASE WHEN rk <= 50 THEN rel END) AS p_at_50 FROM r GROUP BY 1"""


@query("a25_ranking_quality", _AP)
def a25_ranking_quality(spark, d):
    """Average precision and precision at 10 and 50 of the score against the decisions."""
    return W.average_precision(table(spark, d, "discovered_urls").select("campaign_id", "url_id", "score", "decision"), ["campaign_id"], [F.desc("score"), F.asc("url_id")], F.col("decision") == "approved")


@query("a27_distinct_lists", "SELECT lead_id, array_to_string(list_sort(list(DISTINCT t)), '; ') AS tags FROM (SELECT lead_id, unnest(person_tags) AS t FROM records) GROUP BY 1")
def a27_distinct_lists(spark, d):
    """Sorted distinct tags of every lead as one cell."""
    r = table(spark, d, "records").select("lead_id", F.explode("person_tags").alias("t")).distinct()
    return r.groupBy("lead_id").agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias("tags"))


@query("a30_structure_hash", "SELECT campaign_id, sha256(array_to_string(list_sort(list(DISTINCT kind || '/' || method)), ',')) AS structure FROM discovered_urls GROUP BY 1")
def a30_structure_hash(spark, d):
    """Hash of the sorted distinct row shapes of a campaign."""
    s = table(spark, d, "discovered_urls").select("campaign_id", F.concat_ws("/", "kind", "method").alias("s")).distinct()
    return s.groupBy("campaign_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("s")), ","), 256).alias("structure"))


@query("j03_semi", "SELECT source_id FROM sources s WHERE EXISTS (SELECT 1 FROM records r WHERE r.source_id = s.source_id AND r.contact_scope = 'person')")
def j03_semi(spark, d):
    """Sources with a personal contact."""
    return J.having(table(spark, d, "sources"), table(spark, d, "records").where("contact_scope = 'person'"), ["source_id"]).select("source_id")


@query("j04_anti", "SELECT url_id FROM discovered_urls u WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = u.source_id AND s.approved)")
def j04_anti(spark, d):
    """URLs without an approved source; NULL sources stay."""
    return J.lacking(table(spark, d, "discovered_urls"), table(spark, d, "sources").where("approved"), ["source_id"]).select("url_id")


@query("j05_namesakes", """WITH n AS (SELECT DISTINCT source_id, page_url, lower(trim(name)) AS k, lead_id FROM records WHERE trim(name) <> '' AND page_url IS NOT NULL)
 SELECT a.lead_id AS a, b.lead_id AS b, min(a.source_id) AS source_id, min(a.page_url) AS page_url FROM n a JOIN n b ON a.source_id = b.source_id AND a.page_url = b.page_url AND a.k = b.k AND a.lead_id < b.lead_id GROUP BY 1, 2""")
def j05_namesakes(spark, d):
    """Leads of one name on one page."""
    return J.namesakes(table(spark, d, "records").where("page_url IS NOT NULL"), ["source_id", "page_url"], "name", "lead_id")


@query("j06_first_match", """SELECT url_id, min(s.source_id) AS source_id FROM discovered_urls u JOIN sources s ON regexp_extract(u.url, '^([a-z]+://[^/?#]+)', 1) = regexp_extract(s.url, '^([a-z]+://[^/?#]+)', 1) AND s.approved WHERE regexp_extract(u.url, '^([a-z]+://[^/?#]+)', 1) <> '' GROUP BY 1""")
def j06_first_match(spark, d):
    """Lowest approved source on the origin of each URL."""
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    u = table(spark, d, "discovered_urls").select("url_id", site.alias("site")).where("site <> ''")
    s = table(spark, d, "sources").where("approved").select(site.alias("site"), "source_id")
    # The rules are reduced to their first per site before the join, so the join adds no rows.
    return u.join(small(s.groupBy("site").agg(F.min("source_id").alias("source_id"))), "site").select("url_id", "source_id")


@query("j09_latest_completed", """SELECT campaign_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY run_id DESC) AS r FROM discovery_runs WHERE status = 'completed') WHERE r = 1 AND pages_done > 0 AND contacts_seen = 0""")
def j09_latest_completed(spark, d):
    """Campaigns whose latest completed run read pages but saw no contact."""
    best = J.best_per_key(table(spark, d, "discovery_runs").where("status = 'completed'"), ["campaign_id"], [F.col("run_id")], ["run_id", "pages_done", "contacts_seen"])
    return best.where("pages_done > 0 AND contacts_seen = 0").select("campaign_id", "run_id")


@query("j10_zipped", "SELECT campaign_id, p::INT AS pos, keywords[p + 1] AS keyword, sales_terms[p + 1] AS term FROM (SELECT *, unnest(range(greatest(len(keywords), len(sales_terms)))) AS p FROM campaigns)")
def j10_zipped(spark, d):
    """Keywords and sales terms of a campaign side by side."""
    z = J.zipped(table(spark, d, "campaigns"), "campaign_id", "keywords", "sales_terms")
    return z.select("campaign_id", "pos", F.col("keywords").alias("keyword"), F.col("sales_terms").alias("term"))


@query("j11_best_observation", "SELECT lead_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY (page_url IS NOT NULL) DESC, extracted_at DESC NULLS LAST, record_id DESC) AS r FROM records) WHERE r = 1")
def j11_best_observation(spark, d):
    """Best observation of every lead: with a page, then the latest."""
    return J.best_per_key(table(spark, d, "records"), ["lead_id"], [F.col("page_url").isNotNull(), F.col("extracted_at"), F.col("record_id")], ["record_id"])


@query("j14_lineage", """SELECT n_name, count(DISTINCT l_orderkey) AS orders, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1""")
def j14_lineage(spark, d):
    """Multiway join along the keys from facts to regions."""
    r = table(spark, d, "region").where("r_name = 'EUROPE'")
    n = table(spark, d, "nation").join(small(r), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(small(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("q").alias("quantity"))


@query("w02_top_per_lane", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 40")
def w02_top_per_lane(spark, d):
    """The last forty events of every lane."""
    return W.top_n(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 40).select("event_id", "event_type")


@query("w04_excess", """SELECT url_id FROM (SELECT url_id, row_number() OVER (PARTITION BY u.campaign_id, origin ORDER BY score, url_id DESC) AS r, count(*) OVER (PARTITION BY u.campaign_id, origin) AS n, max_active_per_origin AS cap
 FROM discovered_urls u JOIN campaigns c ON u.campaign_id = c.campaign_id WHERE archived_at IS NULL) WHERE r <= n - cap""")
def w04_excess(spark, d):
    """Active rows to give up so that no origin exceeds its campaign's cap, worst first."""
    u = table(spark, d, "discovered_urls").where("archived_at IS NULL").select("url_id", "campaign_id", "origin", "score")
    u = u.join(small(table(spark, d, "campaigns").select("campaign_id", "max_active_per_origin")), "campaign_id")
    return W.excess(u, ["campaign_id", "origin"], [F.asc("score"), F.desc("url_id")], F.col("max_active_per_origin")).select("url_id")


@query("w06_admitted", """SELECT spec_id FROM (SELECT spec_id, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, pos) AS r, max_pages FROM url_batches b JOIN campaigns c ON b.campaign_id = c.campaign_id) WHERE r <= max_pages""")
def w06_admitted(spark, d):
    """Specs of a run within its campaign's page capacity, best first."""
    b = table(spark, d, "url_batches").join(small(table(spark, d, "campaigns").select("campaign_id", "max_pages")), "campaign_id")
    return W.admitted(b, ["run_id"], [F.desc("priority"), F.asc("pos")], F.col("max_pages")).select("spec_id")


_TIERED = """WITH RECURSIVE r AS (SELECT spec_id, run_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, source_hint IS NULL AS e, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, pos) AS k FROM url_batches WHERE url IS NOT NULL),
 p AS (SELECT DISTINCT run_id, 0::BIGINT AS k, 0 AS taken, 0 AS explored, []::VARCHAR[] AS hosts, 0::BIGINT AS spec_id, false AS ok FROM r
 UNION ALL SELECT run_id, k, taken + ok::INT, explored + (ok AND e)::INT, CASE WHEN ok AND e THEN list_append(hosts, host) ELSE hosts END, spec_id, ok FROM
 (SELECT r.run_id, r.k, p.taken, p.explored, p.hosts, r.host, r.e, r.spec_id, p.taken < 25 AND (NOT r.e OR (p.explored < 10 AND NOT list_contains(p.hosts, r.host))) AS ok FROM p JOIN r ON r.run_id = p.run_id AND r.k = p.k + 1))
 SELECT run_id, spec_id FROM p WHERE ok"""


@query("w07_tiered_admission", _TIERED)
def w07_tiered_admission(spark, d):
    """Slots of a run under two interacting caps: exploratory specs (no hint) up to 40 %, one per host."""
    from pageloom.operators.admission import admit_exact

    b = table(spark, d, "url_batches").where("url IS NOT NULL").select(
        "spec_id", "run_id", (-F.col("priority")).alias("rank"), "pos", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1).alias("host"),
        F.col("source_hint").isNull().alias("exploratory"), F.lit(25).alias("slots"), F.lit(10).alias("share_cap"),
    )
    return admit_exact(b, "run_id", ["rank", "pos"], "host", "exploratory", "slots", "share_cap").select("run_id", "spec_id")


@query("w09_repeated", "SELECT record_id FROM records r JOIN (SELECT page_url, email FROM records WHERE coalesce(email, '') <> '' GROUP BY 1, 2 HAVING count(DISTINCT lower(name)) > 1) x ON r.page_url = x.page_url AND r.email = x.email")
def w09_repeated(spark, d):
    """Records whose address several names of the page own."""
    r = table(spark, d, "records").where("email <> '' AND page_url IS NOT NULL")
    many = r.groupBy("page_url", "email").agg(F.count_distinct(F.lower("name")).alias("n")).where("n > 1").drop("n")
    return r.join(many, ["page_url", "email"], "left_semi").select("record_id")


@query("w11_last_wins", """SELECT lead_id, n AS name, min(record_id) AS pos, max_by(title, record_id) AS title FROM (SELECT lead_id, lower(name) AS n, record_id, coalesce(title, '') AS title FROM records) GROUP BY 1, 2""")
def w11_last_wins(spark, d):
    """One row per lead and name: the last title at the first position."""
    r = table(spark, d, "records").select("lead_id", F.lower("name").alias("name"), F.col("record_id").alias("pos"), F.coalesce("title", F.lit("")).alias("title"))
    return W.last_at_first_place(r, ["lead_id", "name"], "pos", ["title"])


@query("l01_ordered_page", "SELECT url_id FROM discovered_urls ORDER BY score DESC, last_seen DESC, url_id LIMIT 50 OFFSET 100")
def l01_ordered_page(spark, d):
    """Third page of fifty in the inventory's default order."""
    return table(spark, d, "discovered_urls").orderBy(F.desc("score"), F.desc("last_seen"), "url_id").offset(100).limit(50).select("url_id")


@query("l03_next_jobs", "SELECT run_id, spec_id FROM (SELECT run_id, spec_id, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, pos) AS r FROM url_batches) WHERE r = 1")
def l03_next_jobs(spark, d):
    """Head of every run's queue, without a sort."""
    return J.best_per_key(table(spark, d, "url_batches"), ["run_id"], [F.col("priority"), -F.col("pos")], ["spec_id"])


@query("u01_union", "SELECT source_id FROM records WHERE contact_scope = 'person' UNION SELECT source_id FROM discovered_urls WHERE source_id IS NOT NULL")
def u01_union(spark, d):
    """Distinct sources with a personal contact or a discovered page."""
    a = table(spark, d, "records").where("contact_scope = 'person'").select("source_id")
    return a.unionByName(table(spark, d, "discovered_urls").where("source_id IS NOT NULL").select("source_id")).distinct()


@query("u02_difference", "SELECT source_id FROM sources EXCEPT SELECT source_id FROM records")
def u02_difference(spark, d):
    """Sources without a record."""
    return table(spark, d, "sources").select("source_id").subtract(table(spark, d, "records").select("source_id"))


@query("u03_intersection", "SELECT url FROM url_batches WHERE url IS NOT NULL INTERSECT SELECT url FROM discovered_urls")
def u03_intersection(spark, d):
    """Addresses handed in that the inventory holds letter for letter."""
    return table(spark, d, "url_batches").where("url IS NOT NULL").select("url").intersect(table(spark, d, "discovered_urls").select("url"))


@query("f01_search", "SELECT DISTINCT lead_id FROM records WHERE contains(lower(concat_ws(' ', name, company, title, email)), 'telecom') AND list_contains(person_tags, (SELECT min(t) FROM (SELECT unnest(person_tags) AS t FROM records)))")
def f01_search(spark, d):
    """Leads that mention telecom and carry the first tag of all."""
    r = table(spark, d, "records")
    first = r.select(F.explode("person_tags").alias("t")).agg(F.min("t").alias("t"))
    hit = r.where(F.lower(F.concat_ws(" ", "name", "company", "title", "email")).contains("telecom"))
    return hit.join(F.broadcast(first), F.expr("array_contains(person_tags, t)")).select("lead_id").distinct()


@query("f15_turnover", """SELECT url_id FROM discovered_urls u WHERE archived_at IS NULL AND NOT EXISTS (SELECT 1 FROM records r WHERE r.source_id = u.source_id)
 AND NOT EXISTS (SELECT 1 FROM url_batches b WHERE b.campaign_id = u.campaign_id AND b.url = u.url) AND score < 20""")
def f15_turnover(spark, d):
    """Rows no protected set holds: chain of anti joins."""
    u = table(spark, d, "discovered_urls").where("archived_at IS NULL AND score < 20").select("url_id", "source_id", "campaign_id", "url")
    return J.lacking(J.lacking(u, table(spark, d, "records"), ["source_id"]), table(spark, d, "url_batches"), ["campaign_id", "url"]).select("url_id")


@query("a22_protection", """SELECT campaign_id, CASE WHEN source_id IN (SELECT source_id FROM records) THEN 'productive' WHEN manual_review_required THEN 'in_review' WHEN score >= 60 THEN 'high_score' ELSE 'none' END AS reason, count(*) AS n FROM discovered_urls WHERE archived_at IS NULL GROUP BY 1, 2""")
def a22_protection(spark, d):
    """First reason that protects each active row, counted."""
    p = table(spark, d, "records").select("source_id").distinct().withColumn("p", F.lit(True))
    u = table(spark, d, "discovered_urls").where("archived_at IS NULL").join(small(p), "source_id", "left")
    why = F.when(F.col("p"), "productive").when(F.col("manual_review_required"), "in_review").when(F.col("score") >= 60, "high_score").otherwise("none")
    return u.groupBy("campaign_id", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("g07_lookback", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def g07_lookback(spark, d):
    """Events of the last seven days up to the latest one."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("g14_idle", "SELECT min(due) AS next_at FROM (SELECT min(received_at::TIMESTAMP) AS due FROM url_batches UNION ALL SELECT min(first_seen::TIMESTAMP) FROM discovered_urls)")
def g14_idle(spark, d):
    """Earliest due time over two queues."""
    a = table(spark, d, "url_batches").agg(F.min("received_at").alias("at"))
    return a.unionByName(table(spark, d, "discovered_urls").agg(F.min("first_seen").alias("at"))).agg(F.min("at").cast("timestamp_ntz").alias("next_at"))
