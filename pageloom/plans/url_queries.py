"""Queries of the URL functions and predicates over discovered_urls, url_batches and sources."""

from pyspark.sql import functions as F

from pageloom.functions import urls as U
from pageloom.operators import joins as J
from pageloom.operators import merge as M
from pageloom.plans.registry import query
from pageloom.session import small, table

# The oracle takes an address apart on its own: scheme, host, port, path, query.
S = "'(?is)^\\s*(https?)://(\\[[0-9a-f:.]+\\]|[^/?#@\\s:\\[\\]]+)(?::([0-9]*))?((?:/[^?#]*?)?)(?:\\?([^#]*?))?(?:#.*?)?\\s*$'"


def g(url: str, n: int) -> str:
    return f"regexp_extract({url}, {S}, {n})"


def host_sql(u: str) -> str:
    ok = f"NOT regexp_matches({u}, '[\\x00-\\x1f\\\\]') AND ltrim({g(u, 3)}, '0') IN ('', CASE WHEN lower({g(u, 1)}) = 'https' THEN '443' ELSE '80' END)"
    return f"(CASE WHEN {ok} THEN nullif(regexp_replace(lower({g(u, 2)}), '\\.+$', ''), '') END)"


def canonical_sql(u: str) -> str:
    return f"""(lower({g(u, 1)}) || '://' || {host_sql(u)} || (CASE WHEN {g(u, 4)} = '' THEN '/' ELSE {g(u, 4)} END) || (CASE WHEN {g(u, 5)} = '' THEN '' ELSE '?' || {g(u, 5)} END))"""


def origin_sql(u: str) -> str:
    return f"(lower({g(u, 1)}) || '://' || {host_sql(u)})"


def path_sql(u: str) -> str:
    return f"(CASE WHEN {host_sql(u)} IS NOT NULL THEN url_decode({g(u, 4)}) END)"


@query("c01_canonical_url", f"SELECT url_id, {canonical_sql('url')} AS canonical, {origin_sql('url')} AS url_origin FROM discovered_urls")
def c01_canonical_url(spark, d):
    """Canonical address and origin of every discovered URL (NULL for invalid ones)."""
    return table(spark, d, "discovered_urls").select("url_id", U.canonical_url(F.col("url")).alias("canonical"), U.origin(F.col("url")).alias("url_origin"))


@query("c01_batch_canonical", f"SELECT spec_id, {canonical_sql('url')} AS canonical FROM url_batches")
def c01_batch_canonical(spark, d):
    """Canonical address of every handed-in spec, unusable ones included as NULL."""
    return table(spark, d, "url_batches").select("spec_id", U.canonical_url(F.col("url")).alias("canonical"))


_FIELDS = f"list_filter(list_transform(list_filter(string_split({g('url', 5)}, '&'), lambda f: f <> ''), lambda f: {{'k': url_decode(replace(split_part(f, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(f, '=') THEN substr(f, instr(f, '=') + 1) ELSE '' END, '+', ' '))}}), lambda p: NOT (lower(p.k) LIKE 'utm\\_%' ESCAPE '\\' OR lower(p.k) IN ('gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid')))"


@query("c03_clean_url", f"""WITH a AS (SELECT spec_id, url, {origin_sql('url')} AS o, {host_sql('url')} AS h, {g('url', 4)} AS rawpath, {path_sql('url')} AS path, {_FIELDS} AS f FROM url_batches),
 c AS (SELECT *, o || (CASE WHEN rawpath = '' THEN '/' ELSE rawpath END) || (CASE WHEN len(f) > 0 THEN '?' || array_to_string(list_transform(list_sort(f), lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') ELSE '' END) AS out FROM a)
 SELECT spec_id, CASE WHEN o IS NOT NULL AND contains(h, '.') AND NOT regexp_matches(h, '(^|\\.)localhost$|\\.(local|internal)$') AND NOT regexp_matches(h, '^[0-9.]+$')
 AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND NOT contains(path, '\\') AND NOT regexp_matches(lower(path), '/(login|logout|signin|signout|search|cart|checkout|calendar|wp-admin)(/|$)')
 AND NOT regexp_matches(lower(path), '\\.(pdf|jpe?g|png|gif|svg|webp|zip|exe|mp[34]|css|js|ico|woff2?|docx?|xlsx?)$') AND len(f) <= 8
 AND len(list_filter(f, lambda p: lower(p.k) IN ('sort', 'order', 'filter', 'session', 'sessionid', 'sid', 'calendar', 'replytocom'))) = 0 AND length(out) <= 1500 THEN out END AS clean FROM c""")
def c03_clean_url(spark, d):
    """Cleaned address of every handed-in spec, NULL for those that lead to no content."""
    return table(spark, d, "url_batches").select("spec_id", U.clean_url(F.col("url")).alias("clean"))


@query("c05_site_family", f"""SELECT h AS host, CASE WHEN length(l[-1]) = 2 AND len(l) > 2 AND list_contains(['co','com','org','net','gov','edu','ac','or','ne'], l[-2])
  THEN array_to_string(l[greatest(len(l)-2,1):len(l)], '.') ELSE array_to_string(l[greatest(len(l)-1,1):len(l)], '.') END AS family, count(*) AS n
  FROM (SELECT {host_sql('url')} AS h, list_filter(string_split({host_sql('url')}, '.'), lambda x: x <> '') AS l FROM discovered_urls) WHERE h IS NOT NULL GROUP BY 1, 2""")
def c05_site_family(spark, d):
    """Registrable-domain heuristic of every host."""
    u = F.col("url")
    return table(spark, d, "discovered_urls").select(U.host(u).alias("host"), U.site_family(u).alias("family")).where("host IS NOT NULL").groupBy("host", "family").agg(F.count(F.lit(1)).alias("n"))


@query("c07_duplicate_groups", f"""SELECT campaign_id, sum(n - 1)::BIGINT AS duplicates FROM (SELECT campaign_id, lower({g('url', 1)}) || chr(31) || regexp_replace({host_sql('url')}, '^www\\.', '')
  || chr(31) || regexp_replace({g('url', 4)}, '/+$', '') || chr(31) || {g('url', 5)} AS k, count(*) AS n FROM discovered_urls GROUP BY 1, 2) WHERE k IS NOT NULL GROUP BY 1""")
def c07_duplicate_groups(spark, d):
    """Rows beyond the first of each duplicate key, per campaign."""
    from pageloom.operators.aggregates import surplus_duplicates

    return surplus_duplicates(table(spark, d, "discovered_urls"), ["campaign_id"], U.duplicate_key(F.col("url")))


_SAME = f"""((lower({g('s.url', 1)}) = lower({g('u.url', 1)}) OR (lower({g('s.url', 1)}) = 'http' AND lower({g('u.url', 1)}) = 'https'))
  AND regexp_replace({host_sql('s.url')}, '^www\\.', '') = regexp_replace({host_sql('u.url')}, '^www\\.', '') AND contains(regexp_replace({host_sql('s.url')}, '^www\\.', ''), '.'))"""


@query("f04_in_scope", f"""WITH x AS (SELECT u.url_id, s.source_id, s.allowed_paths, s.allow_homepage, {g('u.url', 5)} AS qs, {origin_sql('s.url')} = {origin_sql('u.url')} OR (s.approval_kind = 'operator' AND {_SAME}) AS here,
  CASE WHEN {g('u.url', 4)} = '' THEN '/' ELSE {path_sql('u.url')} END AS p FROM discovered_urls u JOIN sources s ON u.source_id = s.source_id)
  SELECT url_id, source_id, coalesce(here AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND NOT contains(p, '\\') AND ((p = '/' AND qs = '' AND allow_homepage)
  OR len(list_filter(allowed_paths, lambda a: trim(a) <> '' AND (p = rtrim(a, '/') OR starts_with(p, rtrim(a, '/') || '/')))) > 0), false) AS in_scope FROM x""")
def f04_in_scope(spark, d):
    """Discovered URLs that lie in the scope of their source; the source is found by key, not by prefix scans."""
    s = table(spark, d, "sources").select("source_id", F.col("url").alias("source_url"), "approval_kind", "allowed_paths", "allow_homepage")
    u = table(spark, d, "discovered_urls").where("source_id IS NOT NULL").select("url_id", "source_id", "url").join(small(s), "source_id")
    return u.select("url_id", "source_id", U.in_scope(*map(F.col, ("source_url", "approval_kind", "allowed_paths", "allow_homepage", "url"))).alias("in_scope"))


@query("f05_same_site", f"SELECT url_id, coalesce({_SAME}, false) AS same_site FROM discovered_urls u JOIN sources s ON u.source_id = s.source_id")
def f05_same_site(spark, d):
    """Whether a URL lies on its source's website."""
    s = table(spark, d, "sources").select("source_id", F.col("url").alias("su"))
    u = table(spark, d, "discovered_urls").select("url_id", "source_id", "url").join(small(s), "source_id")
    return u.select("url_id", U.same_site(F.col("su"), F.col("url")).alias("same_site"))


@query("f06_exact_starts", f"""SELECT url_id, {canonical_sql('u.url')} = {canonical_sql('s.url')} AND {canonical_sql('u.url')} IS NOT NULL AS exact_start FROM discovered_urls u JOIN sources s ON u.source_id = s.source_id
  WHERE NOT contains(u.url, '?') AND NOT regexp_matches(lower(u.url), '/(login|logout|signin|signout|search|cart|checkout|calendar|wp-admin)(/|$)|\\.[a-z0-9]{{2,5}}$|%') AND {host_sql('u.url')} IS NOT NULL""")
def f06_exact_starts(spark, d):
    """Whether a URL is its source's own address but for spelling; URLs without query, escape or file ending."""
    s = table(spark, d, "sources").select("source_id", F.col("url").alias("su"))
    u = table(spark, d, "discovered_urls").select("url_id", "source_id", "url").where("NOT contains(url, '?')").join(small(s), "source_id")
    u = u.where(~F.lower("url").rlike("/(login|logout|signin|signout|search|cart|checkout|calendar|wp-admin)(/|$)|\\.[a-z0-9]{2,5}$|%") & U.host(F.col("url")).isNotNull())
    return u.select("url_id", U.same_start(F.col("url"), F.col("su")).alias("exact_start"))


@query("f07_denied", f"SELECT url_id FROM discovered_urls WHERE regexp_matches({host_sql('url')}, '(^|\\.)tesfesim-listings\\.example$')")
def f07_denied(spark, d):
    """URLs on, or below, a denied domain."""
    deny = F.array(F.lit("tesfesim-listings.example"))
    return table(spark, d, "discovered_urls").where(U.denied(F.col("url"), deny)).select("url_id")


_CHROME_HOSTS = {
    "social profile or share link": "facebook.com linkedin.com x.com twitter.com instagram.com tiktok.com youtube.com reddit.com bsky.app pinterest.com threads.net",
    "document or file share": "docs.google.com drive.google.com dropbox.com box.com docsend.com slideshare.net scribd.com notion.site notion.so",
    "scheduling page": "calendly.com cal.com acuityscheduling.com calendar.google.com meetings.hubspot.com", "link shortener": "goo.gl bit.ly t.co tinyurl.com ow.ly buff.ly lnkd.in rebrand.ly cutt.ly",
    "app store listing": "apps.apple.com itunes.apple.com play.google.com chromewebstore.google.com", "review or event platform": "trustpilot.com g2.com capterra.com luma.com eventbrite.com meetup.com", "policy page": "policies.google.com",
}
_CHROME_PATHS = {
    "share button": "/(sharer(\\.php)?|share|sharearticle|intent/(tweet|post))(/|$)", "signup or application form": "/(signup|sign-up|register|registration|apply|application)(/|$)",
    "legal page": "/(privacy(-policy)?|terms(-of-service|-of-use)?|legal|cookies?(-policy)?)(/|$)", "feed, sitemap or CDN helper": "(\\.(rss|atom)$|/(feed|rss|sitemap|cdn-cgi)(/|\\.xml|$))",
    "help or sponsorship page": "/(help|faq|sponsor|sponsors|sponsorship|pass-picker|tickets?)(/|$)",
}
_NOISE = f"""CASE WHEN h IS NULL THEN NULL WHEN regexp_matches(h, 'https?$') OR regexp_matches(raw, 'https?:?//') THEN 'malformed link (URL pasted into another URL)' {' '.join(f"WHEN regexp_matches(h, '(^|\\.)({x.replace('.', chr(92) + '.').replace(' ', '|')})$') THEN '{w}'" for w, x in _CHROME_HOSTS.items())}
 WHEN regexp_matches(h, '^((auth|login|accounts|sso|signin|dash|dashboard|app)[0-9]*|[^.]*-cdn)\\.[^.]*\\.') THEN 'login or app screen' WHEN regexp_matches(h, '^(docs|help|support|developers)[0-9]*\\.[^.]*\\.') THEN 'documentation or help site'
 WHEN regexp_matches(h, '^(cdn|static|assets)[0-9]*\\.[^.]*\\.') THEN 'CDN or asset host' {' '.join(f"WHEN regexp_matches(lower(p), '{x}') THEN '{w}'" for w, x in _CHROME_PATHS.items())} END"""
#: Chrome that every site has, beside the tables' own addresses, so that every rung of the ladder is reached.
_ADDED = [f"https://www.{h}/p/1" for x in _CHROME_HOSTS.values() for h in x.split()] + [f"https://{h}.site.example/" for h in ("login2", "docs", "img-cdn", "static", "app.a", "help9")] + [
    f"https://site.example/{p}" for p in ("share/x", "sharer.php", "intent/tweet", "sign-up", "apply", "privacy-policy", "terms", "cookie", "feed/", "a.rss", "cdn-cgi/x", "faq", "tickets", "https://b.example/", "pass-picker", "team")]


@query("f08_noise", f"""WITH x AS (SELECT url FROM url_batches UNION ALL SELECT unnest({_ADDED!r})), y AS (SELECT {host_sql('url')} AS h, {g('url', 4)} AS raw, {path_sql('url')} AS p FROM x)
 SELECT coalesce({_NOISE}, 'content') AS reason, count(*) AS n FROM y GROUP BY 1""")
def f08_noise(spark, d):
    """Why an address is page chrome, counted, over the handed-in specs and a list of chrome addresses."""
    added = spark.createDataFrame([(u,) for u in _ADDED], "url string")
    u = table(spark, d, "url_batches").select("url").unionByName(added).select(F.coalesce(U.noise_reason(F.col("url")), F.lit("content")).alias("reason"))
    return u.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("c11_page_kinds", f"""SELECT campaign_id, CASE WHEN p IS NULL THEN 'other' WHEN regexp_replace(p, '/+', '', 'g') = '' THEN 'start' WHEN regexp_matches(p, '(^|[^a-z])(team|staff|people|agents?|representatives?|advisors?|leadership)([^a-z]|$)') THEN 'team'
 WHEN regexp_matches(p, '(^|[^a-z])(about|who we are|our company)([^a-z]|$)') THEN 'about' WHEN regexp_matches(p, '(^|[^a-z])contacts?([^a-z]|$)') THEN 'contact' ELSE 'other' END AS page_kind, count(*) AS n
 FROM (SELECT campaign_id, lower(translate({path_sql('url')}, '-_', '  ')) AS p FROM discovered_urls) GROUP BY 1, 2""")
def c11_page_kinds(spark, d):
    """Pages by kind and campaign."""
    u = table(spark, d, "discovered_urls").select("campaign_id", U.page_kind(F.col("url")).alias("page_kind"))
    return u.groupBy("campaign_id", "page_kind").agg(F.count(F.lit(1)).alias("n"))


_IMPORT = f"""WITH k AS (SELECT spec_id, run_id, pos, campaign_id, {canonical_sql('url')} AS c FROM url_batches),
 old AS (SELECT DISTINCT {canonical_sql('url')} AS c FROM discovered_urls)
 SELECT spec_id, CASE WHEN k.c IS NULL THEN 'invalid' WHEN old.c IS NOT NULL THEN 'existing'
 WHEN row_number() OVER (PARTITION BY k.c ORDER BY spec_id) > 1 THEN 'duplicate_in_file' ELSE 'would_create' END AS outcome
 FROM k LEFT JOIN old ON k.c = old.c"""


@query("s12_import_outcomes", _IMPORT)
def s12_import_outcomes(spark, d):
    """Outcome ladder of a bulk import: invalid, existing, duplicate in the file, or new."""
    rows = table(spark, d, "url_batches").select("spec_id", "url")
    old = table(spark, d, "discovered_urls").select(U.canonical_url(F.col("url")).alias("c"))
    return M.import_outcomes(rows, old, U.canonical_url(F.col("url")), "spec_id", "c").select("spec_id", "outcome")


@query("m04_changed_pages", f"""SELECT spec_id FROM url_batches b WHERE NOT EXISTS (SELECT 1 FROM discovered_urls u WHERE u.campaign_id = b.campaign_id AND u.url = b.url AND u.label = b.label)""")
def m04_changed_pages(spark, d):
    """Specs that aren't known yet with this content (address and label) in their campaign."""
    b = table(spark, d, "url_batches").select("spec_id", "campaign_id", "url", "label")
    return J.lacking(b, table(spark, d, "discovered_urls"), ["campaign_id", "url", "label"]).select("spec_id")


_INTERLEAVE = """WITH t AS (SELECT spec_id, run_id, pos, priority, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS o, CASE WHEN seed THEN 0 ELSE 1 END AS tier FROM url_batches WHERE url IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY run_id, tier, o ORDER BY priority DESC, pos) AS rnd FROM t),
 b AS (SELECT run_id, tier, o, priority AS bp, pos AS bq FROM r WHERE rnd = 1)
 SELECT r.spec_id, row_number() OVER (PARTITION BY r.run_id ORDER BY r.tier, r.rnd, -b.bp, b.bq, r.o) AS place FROM r JOIN b ON r.run_id = b.run_id AND r.tier = b.tier AND r.o = b.o"""


@query("w03_interleaved", _INTERLEAVE)
def w03_interleaved(spark, d):
    """Fetch order of every run: seeds first, then one page of each host per round, best host first."""
    from pageloom.operators.windows import interleaved

    b = table(spark, d, "url_batches").where("url IS NOT NULL")
    b = b.select("spec_id", "run_id", "pos", "priority", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1).alias("o"), F.when(F.col("seed"), 0).otherwise(1).alias("tier"))
    return interleaved(b, ["run_id"], "tier", "o", "priority", "pos").select("spec_id", "place")
