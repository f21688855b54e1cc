"""Queries of sources, sinks, classifiers and joins by scope, as round trips over the tables."""

from pyspark.sql import functions as F

from pageloom.functions import numbers as N
from pageloom.functions import scores as S
from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.operators import joins as J
from pageloom.operators import merge as M
from pageloom.plans.link_queries import INTENT, RANK, TIER, links, ranked_links, seen_sql
from pageloom.plans.registry import ORACLES, query
from pageloom.plans.url_queries import canonical_sql, g, host_sql, origin_sql, path_sql
from pageloom.session import scratch_dir, small, spread, table
from pageloom.sources import files

_STATUS = "(200 + (event_id * 37) % 400)::INT"


@query("s04_status_gate", f"""SELECT CASE WHEN s = 429 OR s >= 500 THEN 'retry' WHEN s IN (401, 403) THEN 'blocked' WHEN s BETWEEN 200 AND 299 THEN 'ok' ELSE 'error' END AS gate, count(*) AS n FROM (SELECT {_STATUS} AS s FROM events) GROUP BY 1""")
def s04_status_gate(spark, d):
    """Responses by what their status asks for: retry, review, use or give up."""
    e = table(spark, d, "events").select((200 + (F.col("event_id") * 37) % 400).cast("int").alias("status"))
    return e.groupBy(N.status_gate(F.col("status")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query("s05_decoded", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def s05_decoded(spark, d):
    """Texts sent in three declared encodings (one unknown) and read back as text."""
    k = F.col("doc_id") % 3
    body = F.when(k == 1, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(k == 0, "text/html").when(k == 1, "text/html; charset=\"utf-16-be\"; q=1").otherwise("text/html; charset=no-such")
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", body.alias("body"), kind.alias("content_type")))
    return docs.select("doc_id", F.md5(files.decoded(F.col("body"), F.col("content_type"))).alias("digest"))


@query("s07_sitemaps", "SELECT url_id, CASE WHEN url_id % 5 = 0 THEN 'sitemap' ELSE 'page' END AS kind, trim(url, ' ' || chr(9) || chr(10) || chr(13)) AS url FROM discovered_urls WHERE NOT regexp_matches(url, '[\\x00-\\x1f\\x{0080}-\\x{009f}\\x{2000}-\\x{20ff}\\x{00a0}\\x{3000}\\x{fe00}-\\x{feff}]')")
def s07_sitemaps(spark, d):
    """Address and kind read from a sitemap, or sitemap index, written around every URL of printable characters."""
    u = table(spark, d, "discovered_urls").where(~F.col("url").rlike("[\\x00-\\x1f\\x{80}-\\x{9f}\\x{2000}-\\x{20ff}\\x{a0}\\x{3000}\\x{fe00}-\\x{feff}]"))
    loc = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    wrap = lambda a, b: F.concat(F.lit(f'<?xml version="1.0"?><{a} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><{b}><loc> '), loc, F.lit(f" </loc></{b}></{a}>"))
    body = F.encode(F.when(F.col("url_id") % 5 == 0, wrap("sitemapindex", "sitemap")).otherwise(wrap("urlset", "url")), "UTF-8")
    return files.sitemap_rows(spread(u.select("url_id", body.alias("body"))), "url_id", "body").select("url_id", "kind", "url")


@query("s09_index_lines", "SELECT url FROM url_batches WHERE url IS NOT NULL")
def s09_index_lines(spark, d):
    """Addresses read back from an index of JSON lines, broken lines between them."""
    at = scratch_dir(spark)
    good = table(spark, d, "url_batches").where("url IS NOT NULL").select(F.to_json(F.struct("url", F.lit("200").alias("status"))).alias("value"))
    good.unionByName(spark.createDataFrame([("{broken",), ('{"other": 1}',), ("",)], "value string")).write.text(at)
    return files.index_lines(spark, at)


@query("s11_strict_json", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' END AS document FROM events""")
def s11_strict_json(spark, d):
    """Documents in canonical form; repeated keys and NaN are refused."""
    k = F.col("event_id") % 4
    bad = F.when(k == 0, '{"k": 1, "k": 2}').when(k == 1, '{"k": NaN}').otherwise(F.col("props"))
    return files.strict_texts(spread(table(spark, d, "events").select("event_id", bad.alias("body"))), "event_id", "body").select("event_id", "document")


_META = f"""SELECT b.spec_id, b.url, b.run_id, b.pos, CASE WHEN b.url = trim(b.url) AND length(b.url) <= 1500 AND NOT regexp_matches(url_decode(b.url), '\\p{{C}}') AND regexp_matches(b.url, '^https?://') THEN c.clean END AS k FROM url_batches b JOIN ({ORACLES['c03_clean_url']}) c ON b.spec_id = c.spec_id"""


@query("s13_metadata_import", f"""WITH m AS ({_META}), o AS (SELECT DISTINCT {canonical_sql('url')} AS c FROM discovered_urls)
 SELECT spec_id, CASE WHEN k IS NULL THEN 'invalid' WHEN o.c IS NOT NULL THEN 'existing' WHEN row_number() OVER (PARTITION BY k ORDER BY spec_id) > 1 THEN 'duplicate_in_file' ELSE 'would_create' END AS outcome FROM m LEFT JOIN o ON m.k = o.c""")
def s13_metadata_import(spark, d):
    """Outcome of every row of a metadata import: addresses as typed must be usable, then known, repeated or new."""
    rows = table(spark, d, "url_batches").select("spec_id", "url")
    old = table(spark, d, "discovered_urls").select(U.canonical_url(F.col("url")).alias("c"))
    return M.import_outcomes(rows.withColumn("k", U.metadata_url(F.col("url"))), old, F.col("k"), "spec_id", "c").select("spec_id", "outcome")


@query("s18_json_report", """SELECT campaign_id, '{"urls":' || count(*) || ',"archived":' || count(archived_at) || ',"methods":' || to_json(list_sort(list(DISTINCT method))) || '}' AS report FROM discovered_urls GROUP BY 1""")
def s18_json_report(spark, d):
    """One JSON report a campaign."""
    u = table(spark, d, "discovered_urls").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("urls"), F.count("archived_at").alias("archived"), F.array_sort(F.collect_set("method")).alias("methods"))
    return u.select("campaign_id", F.to_json(F.struct("urls", "archived", "methods")).alias("report"))


@query("s20_activity_tail", "SELECT * FROM (SELECT floor(epoch(ts)) AS t, event_type AS lane, event_id::VARCHAR AS text FROM events WHERE floor(epoch(ts)) > 1704500000 ORDER BY t DESC, lane, text LIMIT 50)")
def s20_activity_tail(spark, d):
    """The last fifty events of a feed of JSON lines after a time; a torn line is dropped."""
    at = scratch_dir(spark)
    e = table(spark, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("event_type").alias("lane"), F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("text"))
    files.append_activity(e, at)
    spark.createDataFrame([('{"t": 9e9, "lane": "x", "te',)], "value string").write.mode("append").text(at)
    return files.activity_since(spark, at, 1704500000.0, 50).select("t", "lane", "text")


_BARE = lambda u: f"regexp_replace({host_sql(u)}, '^www\\.', '')"


@query("f32_redirects", f"""WITH x AS (SELECT u.url_id, {origin_sql('s.url')} AS so, {origin_sql('u.url')} AS uo, {_BARE('s.url')} AS sh, {_BARE('u.url')} AS uh, lower({g('s.url', 1)}) AS ss, lower({g('u.url', 1)}) AS us, {path_sql('u.url')} AS p, {g('u.url', 5)} AS qs, allowed_paths, allow_homepage
 FROM discovered_urls u JOIN sources s ON s.source_id = coalesce(u.source_id, 1 + u.url_id % (SELECT count(*) FROM sources)))
 SELECT url_id, CASE WHEN uo IS NULL OR so IS NULL THEN 'invalid' WHEN so = uo THEN 'same_origin' WHEN sh = uh AND ss = 'https' AND us = 'http' THEN 'downgrade'
 WHEN sh = uh AND contains(sh, '.') THEN CASE WHEN NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND NOT contains(p, '\\') AND ((p IN ('', '/') AND qs = '' AND allow_homepage) OR len(list_filter(allowed_paths, lambda a: trim(a) <> '' AND ((CASE WHEN p = '' THEN '/' ELSE p END) = rtrim(a, '/') OR starts_with(CASE WHEN p = '' THEN '/' ELSE p END, rtrim(a, '/') || '/')))) > 0) THEN 'canonical' ELSE 'canonical_path_out_of_scope' END
 WHEN uh LIKE '%.' || sh OR sh LIKE '%.' || uh THEN 'other_subdomain' ELSE 'cross_domain' END AS class FROM x""")
def f32_redirects(spark, d):
    """Class of a redirect from every URL's source (or, without one, some source) to the URL."""
    s = table(spark, d, "sources")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    u = spread(table(spark, d, "discovered_urls").select("url_id", "source_id", "url")).crossJoin(F.broadcast(n)).withColumn("source_id", F.coalesce("source_id", 1 + F.col("url_id") % F.col("n")))
    u = u.join(small(s.select("source_id", F.col("url").alias("from"), "allowed_paths", "allow_homepage")), "source_id")
    return u.select("url_id", U.redirect_class(*map(F.col, ("from", "url", "allowed_paths", "allow_homepage"))).alias("class"))


_FAIL = "['Request timed out.', 'Robots page is HTML', 'Robots disallow', 'HTTP 403', 'HTTP 503', 'HTTP 404', 'bad value', 'disk full']"


@query("f33_failures", f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN kind = 'timeout' OR (kind = 'fetch' AND regexp_matches(m, 'timed out|timeout')) THEN 'timeout' WHEN kind = 'fetch' AND contains(m, 'robots') THEN CASE WHEN contains(m, 'html') THEN 'robots_invalid' ELSE 'robots_denied' END
 WHEN kind = 'fetch' AND status IN (401, 403) THEN 'access_blocked' WHEN kind = 'fetch' THEN CASE WHEN retryable OR status >= 500 THEN 'http_unavailable' ELSE 'fetch_error' END WHEN kind IN ('value', 'type') THEN 'parser_or_extraction_error' ELSE 'worker_error' END AS category
 FROM (SELECT lower(({_FAIL})[event_id % 8 + 1]) AS m, CASE event_id % 8 WHEN 3 THEN 403 WHEN 4 THEN 503 WHEN 5 THEN 404 END AS status, event_id % 8 = 5 AND user_id % 2 = 0 AS retryable, (['fetch', 'timeout', 'value', 'type', 'other'])[CASE WHEN event_id % 8 < 6 THEN 1 ELSE event_id % 5 + 1 END] AS kind FROM events)) GROUP BY 1""")
def f33_failures(spark, d):
    """Failures by category, from their kind, message, status and whether they may be tried again."""
    k = F.col("event_id") % 8
    messages = ["Request timed out.", "Robots page is HTML", "Robots disallow", "HTTP 403", "HTTP 503", "HTTP 404", "bad value", "disk full"]
    e = table(spark, d, "events").select(
        F.get(F.array(*map(F.lit, messages)), k.cast("int")).alias("message"), F.when(k == 3, 403).when(k == 4, 503).when(k == 5, 404).alias("status"), ((k == 5) & (F.col("user_id") % 2 == 0)).alias("retryable"),
        F.when(k < 6, "fetch").otherwise(F.get(F.array(*map(F.lit, ("fetch", "timeout", "value", "type", "other"))), (F.col("event_id") % 5).cast("int"))).alias("kind"),
    )
    return e.groupBy(N.failure_category(*map(F.col, ("kind", "message", "status", "retryable"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("j06_scoped_source", f"""WITH s AS (SELECT source_id, approval_kind, allowed_paths, allow_homepage, {origin_sql('url')} AS so, {_BARE('url')} AS h, lower({g('url', 1)}) AS ss FROM sources WHERE approved),
 b AS (SELECT spec_id, source_hint, {origin_sql('url')} AS uo, {_BARE('url')} AS h, lower({g('url', 1)}) AS us, CASE WHEN {g('url', 4)} = '' THEN '/' ELSE {path_sql('url')} END AS p, {g('url', 5)} AS qs FROM url_batches)
 SELECT spec_id, source_id FROM (SELECT spec_id, source_id, row_number() OVER (PARTITION BY spec_id ORDER BY source_id IS DISTINCT FROM source_hint, source_id) AS r FROM b JOIN s ON b.h = s.h AND (so = uo OR (approval_kind = 'operator' AND (ss = us OR (ss = 'http' AND us = 'https')) AND contains(s.h, '.')))
 AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND NOT contains(p, '\\') AND ((p = '/' AND qs = '' AND allow_homepage) OR len(list_filter(allowed_paths, lambda a: trim(a) <> '' AND (p = rtrim(a, '/') OR starts_with(p, rtrim(a, '/') || '/')))) > 0)) WHERE r = 1""")
def j06_scoped_source(spark, d):
    """First approved source whose scope holds a spec, the hinted one first: an equi-join on the site, then the scope test."""
    s = table(spark, d, "sources").where("approved").select("source_id", F.col("url").alias("source_url"), "approval_kind", "allowed_paths", "allow_homepage", U.site_key(F.col("url")).alias("site"))
    b = table(spark, d, "url_batches").select("spec_id", "source_hint", "url", U.site_key(F.col("url")).alias("site"))
    inside = U.in_scope(*map(F.col, ("source_url", "approval_kind", "allowed_paths", "allow_homepage", "url")))
    met = b.join(small(s), "site").withColumn("__in", inside)
    return J.best_per_key(met.where("__in"), ["spec_id"], [F.coalesce(F.col("source_id") == F.col("source_hint"), F.lit(False)), -F.col("source_id")], ["source_id"])


@query("j07_site_prefix", f"""WITH s AS (SELECT source_id, {_BARE('url')} AS h FROM sources), u AS (SELECT url_id, {canonical_sql('url')} AS c FROM discovered_urls)
 SELECT source_id, count(*) AS urls FROM s JOIN u ON starts_with(c, 'http://' || h || '/') OR starts_with(c, 'https://' || h || '/') OR starts_with(c, 'http://www.' || h || '/') OR starts_with(c, 'https://www.' || h || '/') GROUP BY 1""")
def j07_site_prefix(spark, d):
    """URLs below any of a source's four origins (either scheme, with or without www.): an equi-join on the site, no prefix scan."""
    s = table(spark, d, "sources").select("source_id", U.site_key(F.col("url")).alias("site")).where("site IS NOT NULL")
    u = table(spark, d, "discovered_urls").select(U.site_key(F.col("url")).alias("site")).where("site IS NOT NULL").groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return s.join(u, "site").groupBy("source_id").agg(F.sum("n").alias("urls"))


@query("w12_explained", f"""{RANK}, t AS (SELECT url_id, CASE WHEN {INTENT} THEN 300 WHEN {TIER} IS NOT NULL THEN 200 ELSE 100 END AS base FROM ({seen_sql('url_id', 'discovered_urls')})),
 v AS (SELECT r.url_id, r.campaign_id, t.base + r.score AS worth, CASE t.base WHEN 300 THEN 'direct' WHEN 200 THEN 'company' ELSE 'generic' END || ' intake tier (+' || t.base || ')' AS reason FROM r JOIN t ON r.url_id = t.url_id)
 SELECT url_id, worth, reason, row_number() OVER (PARTITION BY campaign_id ORDER BY worth DESC, url_id) AS place FROM v""")
def w12_explained(spark, d):
    """Candidates ranked by tier (people, company, other pages) and score, with the tier as the first reason."""
    from pyspark.sql.window import Window

    r = ranked_links(spark, d)
    tier = S.page_tier(F.col("url"), F.col("label"))
    base = F.when(S.direct_intent(F.col("url"), F.col("label")), 300).when(tier.isNotNull(), 200).otherwise(100)
    r = r.select("url_id", "campaign_id", base.alias("base"), F.col("r.score").alias("score"))
    name = F.when(F.col("base") == 300, "direct").when(F.col("base") == 200, "company").otherwise("generic")
    r = r.select("url_id", "campaign_id", (F.col("base") + F.col("score")).alias("worth"), F.concat(name, F.lit(" intake tier (+"), F.col("base").cast("string"), F.lit(")")).alias("reason"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("worth"), "url_id"))).drop("campaign_id")


@query("a18_readiness", """WITH s AS (SELECT source_id, count(*) AS cards, count(*) FILTER (WHERE coalesce(email, '') <> '') AS accepted, count(*) FILTER (WHERE coalesce(title, '') <> '') AS roles, count(*) FILTER (WHERE coalesce(name, '') = '') AS hard FROM records GROUP BY 1)
 SELECT source_id, greatest(0, CASE WHEN cards >= 2 THEN 20 WHEN cards > 0 THEN 15 ELSE 0 END + CASE WHEN cards > 0 AND roles / cards >= 0.8 THEN 20 ELSE 0 END + CASE WHEN accepted > 0 THEN 25 ELSE 0 END + CASE WHEN accepted > 0 AND hard = 0 THEN 25 ELSE 0 END - CASE WHEN hard > 0 OR cards > 500 THEN 25 ELSE 0 END) AS readiness FROM s""")
def a18_readiness(spark, d):
    """Readiness of every source's recipe from its cards: accepted ones have an address, hard errors are missing names."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    r = table(spark, d, "records").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("cards"), F.count(F.when(there("email"), 1)).alias("accepted"), F.count(F.when(there("title"), 1)).alias("roles"), F.count(F.when(~there("name"), 1)).alias("hard"))
    return r.select("source_id", N.readiness(F.col("cards"), F.col("roles"), F.col("accepted"), F.col("hard"), F.col("cards") > 500).alias("readiness"))


@query("a26_gate_quality", f"""WITH x AS (SELECT campaign_id, decision = 'approved' AS good, {INTENT} AS passed FROM ({seen_sql('campaign_id, decision', 'discovered_urls')})), p AS (SELECT campaign_id, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE good) AS positives, count(*) FILTER (WHERE good AND passed) AS hits FROM x GROUP BY 1),
 s AS (SELECT campaign_id, count(DISTINCT origin) AS expected, count(DISTINCT origin) FILTER (WHERE decision = 'approved') AS found FROM discovered_urls WHERE origin IS NOT NULL GROUP BY 1)
 SELECT campaign_id, passed, round(CASE WHEN passed > 0 THEN hits / passed ELSE 0 END, 3) AS precision, round(CASE WHEN positives > 0 THEN hits / positives ELSE 0 END, 3) AS recall, round(found / expected, 3) AS site_recall FROM p JOIN s USING (campaign_id)""")
def a26_gate_quality(spark, d):
    """Precision and recall of the intent gate against the decisions, and the share of sites with an approved page."""
    u = links(spark, d, "campaign_id", "decision", "origin").withColumn("passed", S.direct_intent(F.col("url"), F.col("label"))).withColumn("good", F.col("decision") == "approved")
    p = u.groupBy("campaign_id").agg(F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(F.col("good"), 1)).alias("positives"), F.count(F.when(F.col("good") & F.col("passed"), 1)).alias("hits"))
    s = u.where("origin IS NOT NULL").groupBy("campaign_id", "origin").agg(F.max(F.col("good").cast("int")).alias("g")).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("expected"), F.sum("g").alias("found"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 3)
    return p.join(s, "campaign_id").select("campaign_id", "passed", share("hits", "passed").alias("precision"), share("hits", "positives").alias("recall"), share("found", "expected").alias("site_recall"))


@query("a28_next_versions", "SELECT source_id, max(coalesce(name_cards, 0)) + 1 AS next_version FROM records GROUP BY 1")
def a28_next_versions(spark, d):
    """Number after the greatest one of every source."""
    return table(spark, d, "records").groupBy("source_id").agg((F.max(F.coalesce("name_cards", F.lit(0))) + 1).alias("next_version"))


@query("c22_passages", """SELECT record_id, CASE WHEN m <= 60 THEN substr(e, 1, 120) ELSE substr(e, m - 20, 120) END AS passage FROM (SELECT record_id, evidence AS e, instr(lower(evidence), lower(company)) AS m FROM records WHERE evidence <> '' AND company <> '')""")
def c22_passages(spark, d):
    """Passage of the evidence that mentions the company: its beginning, or from 20 characters before a late mention."""
    r = table(spark, d, "records").where("evidence <> '' AND company <> ''")
    return r.select("record_id", T.passage(F.col("evidence"), F.col("company"), 120, 60, 20).alias("passage"))


@query("c26_service_labels", "SELECT code, CASE code WHEN 'pos' THEN 'Point of sale' WHEN 'funding' THEN 'Business funding' ELSE code END AS label FROM reference_values WHERE code IN ('pos', 'funding', 'payroll_hr') OR code LIKE '%z%'")
def c26_service_labels(spark, d):
    """Labels of service codes; a code without a label is its own."""
    names = F.create_map(*map(F.lit, ("pos", "Point of sale", "funding", "Business funding")))
    r = table(spark, d, "reference_values").where("code IN ('pos', 'funding', 'payroll_hr') OR code LIKE '%z%'")
    return r.select("code", F.coalesce(F.element_at(names, F.col("code")), F.col("code")).alias("label"))


@query("c29_controls", "SELECT record_id FROM records WHERE regexp_matches(name, '\\p{C}') OR regexp_matches(title, '\\p{C}') OR regexp_matches(company, '\\p{C}')")
def c29_controls(spark, d):
    """Records with control or invisible characters in a field."""
    c = T.has_controls(F.col("name")) | T.has_controls(F.col("title")) | T.has_controls(F.col("company"))
    return table(spark, d, "records").where(c).select("record_id")


@query("c37_explore_caps", "SELECT campaign_id, (max_pages * (campaign_id % 5) * 5 + 99) // 100 AS slots FROM campaigns")
def c37_explore_caps(spark, d):
    """Slots for exploration: a share of the pages per cent, rounded up."""
    return table(spark, d, "campaigns").select("campaign_id", N.percent_cap(F.col("max_pages"), (F.col("campaign_id") % 5) * 5).cast("long").alias("slots"))


@query("c39_merged_counters", """WITH e AS (SELECT campaign_id, run_id % 2 AS side, unnest(map_entries(diagnostics)) AS e FROM discovery_runs) SELECT campaign_id, e.key AS counter, sum(e.value)::BIGINT AS total FROM e GROUP BY 1, 2""")
def c39_merged_counters(spark, d):
    """Counter maps of odd and of even runs merged key by key."""
    r = table(spark, d, "discovery_runs").select("campaign_id", (F.col("run_id") % 2).alias("side"), F.explode("diagnostics").alias("k", "v")).groupBy("campaign_id", "side", "k").agg(F.sum("v").alias("v"))
    m = r.groupBy("campaign_id", "side").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    a, b = m.where("side = 0").select("campaign_id", F.col("m").alias("a")), m.where("side = 1").select("campaign_id", F.col("m").alias("b"))
    both = a.join(b, "campaign_id", "full").select("campaign_id", F.explode(N.merged_counters(F.col("a"), F.col("b"))).alias("counter", "total"))
    return both


@query("c43_nano_amounts", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1000000000 AS BIGINT) AS nano FROM orders")
def c43_nano_amounts(spark, d):
    """Amounts in whole billionths."""
    return table(spark, d, "orders").select("o_orderkey", N.nano(F.col("o_totalprice").cast("decimal(18,2)")).alias("nano"))


@query("l08_sampled_query")
def l08_sampled_query(spark, d):
    """The query of every campaign that a seeded draw from the posteriors of its success picks; the draw has no SQL."""
    u = table(spark, d, "discovered_urls").where("search_query <> ''").groupBy("campaign_id", "search_query", "origin").agg(F.max((F.col("decision") == "approved").cast("int")).alias("g"))
    s = u.groupBy("campaign_id", "search_query").agg(F.count(F.lit(1)).alias("sites"), F.sum("g").alias("good"))
    s = s.withColumn("priority", N.sampled_priority(F.col("good"), F.col("sites"), F.xxhash64("campaign_id", "search_query")))
    return J.best_per_key(s, ["campaign_id"], [F.col("priority"), F.col("search_query")], ["search_query", "priority"])
