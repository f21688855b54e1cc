"""Queries of the link score, its gates and adjustments, and of what follows from them."""

from pyspark.sql import functions as F

from pageloom.functions import scores as S
from pageloom.functions import urls as U
from pageloom.operators import aggregates as A
from pageloom.operators import joins as J
from pageloom.operators import windows as W
from pageloom.plans.registry import query
from pageloom.plans.url_queries import host_sql, path_sql
from pageloom.session import small, spread, table


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The oracle states the gates on its own: phrases by a plain list, edges as characters that are no letter, digit or underscore.
def any_of(text: str, phrases: str) -> str:
    """SQL: whether a text holds one of the comma-separated phrases as words, with a plural s where it may have one."""
    words = "|".join(p + ("s?" if len(p) > 2 and not p.endswith("s") else "") for p in (x.strip() for x in phrases.split(",")))
    return f"regexp_matches({text}, {q(f'(^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])({words})($|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])')})"


def plain(text: str) -> str:
    return f"translate(lower({text}), '-_', '  ')"


PEOPLE = "team, staff, people, profile, bio, biography, leadership, agents, reps, representatives, sales team, sales representative, sales rep, sales agent"
NOISE = "collateral, document, document sharing, social, deck, sheet, playbook, brochure, schedule, scheduling, calendar, booking, appointment, login, sign in, signin, business agent, business rep, business representative"
EDITORIAL, PRODUCT = "blog, article, news, careers, vacancies, privacy, terms", "product, device, software, emv credit card machines"
CLOSED = (
    "(^|\\.)(facebook\\.com|linkedin\\.com|x\\.com|twitter\\.com|instagram\\.com|tiktok\\.com|youtube\\.com|reddit\\.com|bsky\\.app|docs\\.google\\.com|drive\\.google\\.com|dropbox\\.com|box\\.com|docsend\\.com"
    "|slideshare\\.net|scribd\\.com|notion\\.site|notion\\.so|calendly\\.com|cal\\.com|acuityscheduling\\.com|calendar\\.google\\.com|meetings\\.hubspot\\.com)$"
)
GENERIC = "['login', 'portal', 'business', 'directory', 'search', 'find', 'contact', 'about', 'apply', 'application', 'support', 'resources']"
SEGMENTS = f"list_filter(list_transform(string_split(p, '/'), lambda s: {plain('s')}), lambda s: s <> '')"


def seen_sql(columns: str, source: str) -> str:
    """SQL: the columns, h(ost), p(ath), l(abel) and near (plain path and label) of a table with url and label."""
    return f"""SELECT *, {plain("p || ' ' || l")} AS near FROM (SELECT {columns}, coalesce({host_sql('url')}, '') AS h, coalesce({path_sql('url')}, '') AS p, coalesce(label, '') AS l FROM {source})"""


INTENT = f"""(NOT regexp_matches(h, {q(CLOSED)}) AND NOT regexp_matches(lower(p), '(^|/)(tag|tags|category|categories|topic|topics)(/|$)') AND NOT {any_of('near', NOISE)} AND ({any_of('near', PEOPLE)}
 OR len(list_filter(list_zip({SEGMENTS}, ({SEGMENTS})[2:]), lambda z: z[1] IN ('rep', 'representative') AND z[2] IS NOT NULL AND NOT list_contains({GENERIC}, z[2]))) > 0))"""
TIER = f"""(CASE WHEN regexp_matches(h, {q(CLOSED)}) OR {any_of('near', NOISE)} OR {any_of('near', EDITORIAL)} OR {any_of('near', PRODUCT)} THEN NULL
 WHEN {any_of('near', 'about, about us, who we are, our company, our story, meet us')} THEN 1 WHEN {any_of('near', 'contact, contact us')} THEN 2 END)"""


def links(spark, d, *more):
    return spread(table(spark, d, "discovered_urls").select("url_id", "url", "label", *more))


@query("f10_direct_intent", f"SELECT url_id FROM ({seen_sql('url_id', 'discovered_urls')}) WHERE {INTENT}")
def f10_direct_intent(spark, d):
    """URLs whose path or label describes a page of people."""
    return links(spark, d).where(S.direct_intent(F.col("url"), F.col("label"))).select("url_id")


@query("f11_page_tiers", f"SELECT url_id, tier FROM (SELECT url_id, {TIER} AS tier FROM ({seen_sql('url_id', 'discovered_urls')})) WHERE tier IS NOT NULL")
def f11_page_tiers(spark, d):
    """Pages about a firm (1) and contact pages (2)."""
    return links(spark, d).select("url_id", S.page_tier(F.col("url"), F.col("label")).alias("tier")).where("tier IS NOT NULL")


@query("f12_low_value", f"SELECT campaign_id, count(*) AS n FROM ({seen_sql('campaign_id, kind', 'discovered_urls')}) WHERE kind = 'page' AND NOT {INTENT} GROUP BY 1")
def f12_low_value(spark, d):
    """Pages of every campaign that can never pass the intent gate."""
    low = S.low_value(F.col("url"), F.col("label"), F.col("kind"), F.lit(False))
    return links(spark, d, "campaign_id", "kind").where(low).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"))


@query("f34_review_split", f"""WITH x AS (SELECT campaign_id AS queue, score, url, label FROM discovered_urls WHERE decision = 'pending' UNION ALL SELECT campaign_id, 0, url, label FROM url_batches)
 SELECT queue, count(*) AS total, count(*) FILTER (WHERE score > 0 OR {INTENT} OR {TIER} IS NOT NULL) AS promising FROM ({seen_sql('queue, score', 'x')}) GROUP BY 1""")
def f34_review_split(spark, d):
    """Promising rows over the union of two queues: a score, direct intent or a page tier."""
    a = table(spark, d, "discovered_urls").where("decision = 'pending'").select(F.col("campaign_id").alias("queue"), "score", "url", "label")
    b = table(spark, d, "url_batches").select(F.col("campaign_id").alias("queue"), F.lit(0).alias("score"), "url", "label")
    good = (F.col("score") > 0) | S.direct_intent(F.col("url"), F.col("label")) | S.page_tier(F.col("url"), F.col("label")).isNotNull()
    return A.conditional_counts(spread(a.unionByName(b)).withColumn("good", good), ["queue"], promising=F.col("good"))


_HELD = "regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(translate({term}, '-_', '  ')) || (CASE WHEN length({term}) > 2 AND {term} NOT LIKE '%s' THEN 's?' ELSE '' END) || '($|[^\\p{{L}}\\p{{N}}_])')"


def held(text: str, term: str) -> str:
    return _HELD.format(text=text, term=term)


def found_sql(column: str) -> str:
    """SQL: the campaign's terms that the text t holds, in their order."""
    return f"list_filter(list_transform({column}, lambda w: lower(trim(w))), lambda w: w <> '' AND {held('t', 'w')})"


RANK = f"""WITH u AS (SELECT url_id, campaign_id, url, label, context FROM discovered_urls), s AS ({seen_sql('url_id, campaign_id, context', 'u')}),
 x AS (SELECT s.*, {plain("p || ' ' || l || ' ' || coalesce(context, '')")} AS t, {plain("h || ' ' || p || ' ' || l || ' ' || coalesce(context, '')")} AS whole, c.region, c.exclusions, c.keywords, c.sales_terms FROM s JOIN campaigns c ON s.campaign_id = c.campaign_id),
 y AS (SELECT *, list_filter(list_transform(exclusions, lambda r: lower(trim(r))), lambda r: CASE WHEN r = '' THEN false WHEN starts_with(r, 'path:') THEN {held(plain('p'), 'trim(substr(r, 6))')}
   WHEN starts_with(r, 'domain:') OR regexp_matches(r, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') THEN h = regexp_replace(r, '^domain:', '') OR h LIKE '%.' || regexp_replace(r, '^domain:', '') ELSE {held('whole', 'r')} END) AS ex,
   {found_sql('keywords')} AS kw, {found_sql('sales_terms')} AS st, {INTENT} AS direct, {any_of('near', EDITORIAL)} AS ed, {any_of('near', PRODUCT)} AS pr,
   coalesce(region, '') <> '' AND {held('t', 'lower(region)')} AS reg FROM x),
 r AS (SELECT url_id, campaign_id, CASE WHEN len(ex) > 0 THEN -100 ELSE 35 * direct::INT + 25 * (len(kw) > 0)::INT + 20 * (len(st) > 0)::INT + 10 * reg::INT - 20 * ed::INT - 25 * pr::INT END AS score,
   CASE WHEN len(ex) > 0 THEN list_transform(ex[:3], lambda e: 'Excluded phrase: ' || e) ELSE list_filter([CASE WHEN direct THEN 'Direct contact or person page (+35)' END,
   CASE WHEN len(kw) > 0 THEN 'Industry: ' || array_to_string(kw[:3], ', ') || ' (+25)' END, CASE WHEN len(st) > 0 THEN 'Sales role: ' || array_to_string(st[:3], ', ') || ' (+20)' END,
   CASE WHEN reg THEN 'Region mentioned (+10; not verified)' END, CASE WHEN ed THEN 'Editorial, legal or recruitment page (-20)' END, CASE WHEN pr THEN 'Product, device or software page (-25)' END], lambda z: z IS NOT NULL) END AS reasons FROM y)"""
_OR_NONE = "CASE WHEN len(reasons) = 0 THEN ['No strong relevance signal yet'] ELSE reasons END"


def ranked_links(spark, d):
    """url_id, campaign_id, r (score and reasons) and the columns that adjustments need."""
    c = table(spark, d, "campaigns").select("campaign_id", "keywords", "sales_terms", "exclusions", "region")
    u = links(spark, d, "campaign_id", "context", "origin", "source_id", "score", "method").withColumnRenamed("score", "stored").join(small(c), "campaign_id")
    r = S.rank(*map(F.col, ("url", "label", "context", "keywords", "sales_terms", "exclusions", "region")))
    return u.select("url_id", "campaign_id", "url", "label", "origin", "source_id", "stored", "method", r.alias("r"))


@query("c19_rank", f"{RANK} SELECT url_id, score, {_OR_NONE} AS reasons FROM r")
def c19_rank(spark, d):
    """Explainable score of every URL with its campaign's terms: total and reasons."""
    return ranked_links(spark, d).select("url_id", "r.score", "r.reasons")


_YIELDS = "yl AS (SELECT origin, count(*) AS n, count(*) FILTER (WHERE p) AS g FROM (SELECT origin, url, bool_or(source_id IS NOT NULL) AS p FROM discovered_urls WHERE origin IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
_DELTA = "(CASE WHEN n >= 3 AND g = 0 THEN -15 WHEN g >= 2 AND (1 + g) / (2 + n) >= 0.5 THEN 10 ELSE 0 END)"


@query("c20_current_scores", f"""{RANK}, {_YIELDS}, v AS (SELECT DISTINCT source_id FROM records WHERE contact_scope = 'person'),
 z AS (SELECT r.url_id, r.score AS s, coalesce({_DELTA}, 0) AS delta, v.source_id IS NOT NULL AS known, u.method = 'seed' AS first FROM r JOIN discovered_urls u ON r.url_id = u.url_id LEFT JOIN yl ON yl.origin = u.origin LEFT JOIN v ON v.source_id = u.source_id)
 SELECT url_id, CASE WHEN s < 0 THEN s ELSE greatest(CASE WHEN first THEN 90 ELSE -1000 END, least(CASE WHEN known THEN 100 ELSE 1000 END, (CASE WHEN delta <> 0 THEN greatest(0, least(100, s + delta)) ELSE s END) + CASE WHEN known THEN 10 ELSE 0 END)) END AS score FROM z""")
def c20_current_scores(spark, d):
    """Score after the adjustments: yield of the origin (a page with a source counts as productive), sources with personal contacts, seeds."""
    u = table(spark, d, "discovered_urls").select("origin", "url", F.col("source_id").isNotNull().alias("p"))
    y = A.yields(u, "origin", "url", F.col("p")).select("origin", "fetched", "productive")
    v = table(spark, d, "records").where("contact_scope = 'person'").select("source_id").distinct().withColumn("reviewed", F.lit(True))
    r = ranked_links(spark, d).join(y, "origin", "left").join(small(v), "source_id", "left")
    now = S.adjusted(F.col("r"), F.col("productive"), F.col("fetched"), F.col("reviewed"), F.col("method") == "seed")
    return r.select("url_id", now["score"].alias("score"))


@query("m08_rescored", f"{RANK} SELECT r.url_id, u.score AS old_score, r.score AS new_score FROM r JOIN discovered_urls u ON r.url_id = u.url_id WHERE r.score <> u.score")
def m08_rescored(spark, d):
    """Rows whose score, computed anew, differs from the stored one, and only those."""
    return ranked_links(spark, d).select("url_id", F.col("stored").alias("old_score"), F.col("r.score").alias("new_score")).where("new_score <> old_score")


@query("c21_query_adjustments", """WITH s AS (SELECT search_query, count(DISTINCT origin) AS sites, count(DISTINCT origin) FILTER (WHERE decision = 'approved') AS good FROM discovered_urls WHERE search_query <> '' GROUP BY 1)
 SELECT search_query, CASE WHEN sites >= 2 THEN round_even(40 * ((1 + good) / (2 + sites) - 0.5), 0)::INT ELSE 0 END AS delta FROM s""")
def c21_query_adjustments(spark, d):
    """Points of every search query by the share of its sites that were approved."""
    u = table(spark, d, "discovered_urls").where("search_query <> ''").groupBy("search_query", "origin").agg(F.max((F.col("decision") == "approved").cast("int")).alias("g"))
    s = u.where("origin IS NOT NULL").groupBy("search_query").agg(F.count(F.lit(1)).alias("sites"), F.sum("g").alias("good"))
    return s.select("search_query", S.query_adjustment(F.col("sites"), F.col("good")).alias("delta"))


@query("a14_family_outcomes", f"""WITH x AS (SELECT {host_sql('url')} AS h, decision FROM discovered_urls), f AS (SELECT regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS family, decision FROM x WHERE h IS NOT NULL)
 SELECT family, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE decision = 'dismissed') AS dismissed, count(*) FILTER (WHERE decision = 'pending') AS pending,
 CASE WHEN count(*) FILTER (WHERE decision = 'approved') > 0 THEN 15 WHEN count(*) FILTER (WHERE decision = 'dismissed') > 0 THEN -60 WHEN count(*) FILTER (WHERE decision = 'pending') > 0 THEN -20 ELSE 0 END AS delta FROM f GROUP BY 1""")
def a14_family_outcomes(spark, d):
    """Outcomes of every site family and the points that follow."""
    u = table(spark, d, "discovered_urls").select(U.site_family(F.col("url")).alias("family"), "decision").where("family IS NOT NULL")
    got = u.groupBy("family").agg(*(F.count(F.when(F.col("decision") == x, 1)).alias(x) for x in ("approved", "dismissed", "pending")))
    return got.withColumn("delta", S.family_adjustment(F.col("approved"), F.col("dismissed"), F.col("pending")))


_PRIORITY = f"(35 * {any_of('near', 'team, staff, people, representative, rep, dealer, partner, agent, executive, sales, contact, about, directory, member, profile, bio, biography, leadership')}::INT - 20 * {any_of('near', EDITORIAL)}::INT - 25 * {any_of('near', PRODUCT)}::INT)"


@query("l04_link_priority", f"SELECT url_id, priority FROM (SELECT url_id, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY found_on ORDER BY {_PRIORITY} DESC, url_id) AS r FROM ({seen_sql('url_id, found_on', 'discovered_urls')}) WHERE found_on <> '') WHERE r <= 5")
def l04_link_priority(spark, d):
    """The five links of every page that are crawled first, by the priority of path and label."""
    u = links(spark, d, "found_on").where("found_on <> ''").select("url_id", "found_on", S.link_priority(F.col("url"), F.col("label")).alias("priority"))
    return W.top_n(u, ["found_on"], [F.desc("priority"), F.asc("url_id")], 5).select("url_id", "priority")


@query("l07_probe_links", f"""SELECT url_id, place FROM (SELECT url_id, row_number() OVER (PARTITION BY campaign_id, origin ORDER BY NOT direct, coalesce(tier, 3), score DESC, url_id) AS place FROM
 (SELECT url_id, campaign_id, origin, score, {INTENT} AS direct, CASE WHEN {INTENT} THEN 0 ELSE {TIER} END AS tier FROM ({seen_sql('url_id, campaign_id, origin, score', 'discovered_urls')})) WHERE direct OR tier IS NOT NULL) WHERE place <= 50""")
def l07_probe_links(spark, d):
    """Links of a site in the order they are probed: people pages by score, then company and contact pages; fifty a site."""
    direct = S.direct_intent(F.col("url"), F.col("label"))
    u = links(spark, d, "campaign_id", "origin", "score").withColumn("direct", direct)
    u = u.withColumn("tier", F.when(F.col("direct"), 0).otherwise(S.page_tier(F.col("url"), F.col("label")))).where("tier IS NOT NULL")
    order = [F.asc("tier"), F.desc("score"), F.asc("url_id")]
    return W.numbered_top(u, ["campaign_id", "origin"], order, 50, "place").select("url_id", "place")


@query("m10_parked", f"""SELECT campaign_id, count(*) AS parked, min(url_id) AS first_id FROM ({seen_sql('url_id, campaign_id, kind, source_id, archived_at, manual_review_required, park_low_value_urls', 'discovered_urls JOIN campaigns USING (campaign_id)')})
 WHERE archived_at IS NULL AND park_low_value_urls AND kind = 'page' AND NOT manual_review_required AND NOT {INTENT} AND (source_id IS NULL OR source_id NOT IN (SELECT source_id FROM records WHERE source_id IS NOT NULL)) GROUP BY 1""")
def m10_parked(spark, d):
    """Active low-value pages that a campaign parks: not under review, and their source has no record."""
    c = table(spark, d, "campaigns").where("park_low_value_urls").select("campaign_id")
    u = links(spark, d, "campaign_id", "kind", "source_id", "archived_at", "manual_review_required").where("archived_at IS NULL AND NOT manual_review_required").join(small(c), "campaign_id")
    u = J.lacking(u.where(S.low_value(F.col("url"), F.col("label"), F.col("kind"), F.lit(False))), table(spark, d, "records").where("source_id IS NOT NULL"), ["source_id"])
    return u.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("parked"), F.min("url_id").alias("first_id"))


@query("l05_candidate_pool", "SELECT url_id FROM discovered_urls WHERE decision = 'pending' AND archived_at IS NULL ORDER BY score DESC, url_id LIMIT 2000")
def l05_candidate_pool(spark, d):
    """The pool of at most two thousand open candidates, best first (the bound is the feature)."""
    return table(spark, d, "discovered_urls").where("decision = 'pending' AND archived_at IS NULL").orderBy(F.desc("score"), "url_id").limit(2000).select("url_id")
