"""Queries of the text and numeric functions over documents, records and discovered_urls."""

from pyspark.sql import functions as F

from pageloom.functions import numbers as N
from pageloom.functions import text as T
from pageloom.operators.joins import shared_values
from pageloom.plans.html_queries import mails, numbers
from pageloom.plans.registry import query
from pageloom.session import small, table

_WS = "'[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("c12_normalized", f"SELECT doc_id, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS normal FROM documents")
def c12_normalized(spark, d):
    """Text of every document with single blanks."""
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query("c13_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(translate(lower(text), '-_', '  '), '(^|[^\\p{L}\\p{N}])card readers?([^\\p{L}\\p{N}]|$)')")
def c13_phrase(spark, d):
    """Documents that name a card reader, in either number."""
    return table(spark, d, "documents").where(T.phrase(F.col("text"), "card-reader")).select("doc_id")


@query("c14_lines", """SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(lower(x))), lambda x: x <> ''))) AS lines FROM documents""")
def c14_lines(spark, d):
    """Number of distinct lines of every document."""
    return table(spark, d, "documents").select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("lines"))


_TAG_SQL = " UNION ALL ".join(f"SELECT record_id, '{t}' AS tag FROM records WHERE regexp_matches(concat_ws(' ', title, company, evidence), {q(p)})" for t, p in T.TAGS)


@query("c15_tags", f"SELECT tag, count(*) AS n FROM ({_TAG_SQL}) GROUP BY 1")
def c15_tags(spark, d):
    """Records by service tag of their title, company and evidence."""
    r = table(spark, d, "records").select(F.explode(T.tags(F.concat_ws(" ", "title", "company", "evidence"))).alias("tag"))
    return r.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("c16_sales_roles", f"SELECT record_id FROM records WHERE regexp_matches(title, {q(T.SALES_ROLE)})")
def c16_sales_roles(spark, d):
    """Records whose title names a sales role."""
    return table(spark, d, "records").where(F.col("title").rlike(T.SALES_ROLE)).select("record_id")


@query("c17_contacts", f"""SELECT doc_id, list_sort(list_distinct(list_transform({mails('text')}, lambda x: lower(x)))) AS emails,
 list_sort(list_distinct(list_transform({numbers('text')}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')))) AS phones FROM documents""")
def c17_contacts(spark, d):
    """Every address and number in every document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.emails(t).alias("emails"), T.phones(t).alias("phones"))


_DIG = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
_NAT = f"(CASE WHEN length({_DIG}) = 11 AND {_DIG} LIKE '1%' THEN substr({_DIG}, 2) ELSE {_DIG} END)"


@query("f25_placeholder_phones", f"""SELECT record_id, CASE WHEN len(list_distinct(string_split({_NAT}, ''))) <= 1 THEN 'repeated digits'
 WHEN {_NAT} IN ('1234567890','0123456789','9876543210','1234567','12345678','123456789') THEN 'sequential digits' ELSE '' END AS reason FROM records WHERE {_DIG} <> ''""")
def f25_placeholder_phones(spark, d):
    """Why a record's number is a template value."""
    r = table(spark, d, "records").where(T.digits(F.col("phone")) != "")
    return r.select("record_id", T.placeholder_phone(F.col("phone")).alias("reason"))


@query("f27_usable_contacts", f"""SELECT contact_scope, count(*) FILTER (WHERE regexp_matches(coalesce(email,''), {q('(?i)^' + T.EMAIL[4:] + '$')})) AS emails,
 count(*) FILTER (WHERE length({_DIG}) BETWEEN 7 AND 15) AS phones, count(*) AS total FROM records GROUP BY 1""")
def f27_usable_contacts(spark, d):
    """Usable addresses and numbers by contact scope."""
    from pageloom.operators.aggregates import conditional_counts

    r = table(spark, d, "records")
    return conditional_counts(r, ["contact_scope"], emails=T.usable_contact("email", F.col("email")), phones=T.usable_contact("phone", F.col("phone")))


@query("c25_safe_cells", "SELECT record_id, CASE WHEN regexp_matches(ltrim(name), '^[=+@-]') THEN '''' || name ELSE name END AS cell FROM records")
def c25_safe_cells(spark, d):
    """Names as safe spreadsheet cells."""
    return table(spark, d, "records").select("record_id", T.safe_cell(F.col("name")).alias("cell"))


@query("c30_identities", """SELECT record_id, sha256(lower(coalesce(name,'')) || chr(31) || lower(coalesce(email,''))) AS identity FROM records WHERE coalesce(email,'') <> ''""")
def c30_identities(spark, d):
    """Content-derived identity of every record with an address."""
    r = table(spark, d, "records").where(F.coalesce("email", F.lit("")) != "")
    return r.select("record_id", T.identity(F.col("name"), F.col("email")).alias("identity"))


@query("c28_token_estimates", "SELECT doc_id, (ceil(octet_length(encode(text)) * 1.25) + 512)::BIGINT AS tokens FROM documents")
def c28_token_estimates(spark, d):
    """Upper token estimate of every document."""
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("j12_shared_contacts", f"""WITH p AS (SELECT record_id, page_url, {_DIG} AS dg, lower(email) AS em FROM records)
 SELECT DISTINCT record_id FROM p WHERE (page_url, em) IN (SELECT page_url, em FROM p WHERE em <> '' GROUP BY 1, 2 HAVING count(*) > 1)
 OR (page_url, dg) IN (SELECT page_url, dg FROM p WHERE dg <> '' GROUP BY 1, 2 HAVING count(*) > 1)""")
def j12_shared_contacts(spark, d):
    """Records that share an address or a number with another record of their page."""
    r = table(spark, d, "records").where("page_url IS NOT NULL").select("record_id", "page_url", F.lower("email").alias("em"), T.digits(F.col("phone")).alias("dg"))
    return shared_values(r, ["page_url"], "em", "record_id").unionByName(shared_values(r, ["page_url"], "dg", "record_id")).distinct()


@query("c19_matched_terms", """WITH u AS (SELECT url_id, campaign_id, ' ' || trim(regexp_replace(lower(coalesce(label,'') || ' ' || coalesce(context,'')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS t FROM discovered_urls),
 k AS (SELECT campaign_id, unnest(keywords) AS w FROM campaigns), n AS (SELECT campaign_id, w, trim(regexp_replace(lower(w), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS x FROM k)
 SELECT u.url_id, count(*) AS terms FROM u JOIN n ON u.campaign_id = n.campaign_id WHERE x <> '' AND (contains(t, ' ' || x || ' ') OR (length(w) > 2 AND w NOT LIKE '%s' AND contains(t, ' ' || x || 's '))) GROUP BY 1""")
def c19_matched_terms(spark, d):
    """Number of its campaign's keywords that a URL's label and context mention."""
    c = table(spark, d, "campaigns").select("campaign_id", "keywords")
    u = table(spark, d, "discovered_urls").select("url_id", "campaign_id", F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("context", F.lit(""))).alias("t"))
    return u.join(small(c), "campaign_id").select("url_id", F.size(T.any_phrase(F.col("t"), F.col("keywords"))).cast("long").alias("terms")).where("terms > 0")


@query("c33_retry_delays", "SELECT event_id, least(86400, greatest(least(3600, 30 * pow(2, greatest(user_id % 12, 1) - 1)), coalesce(value, 0)))::INT AS delay FROM (SELECT event_id, user_id, floor(value) AS value FROM events)")
def c33_retry_delays(spark, d):
    """Retry delay with attempts = user_id mod 12 and the value as the delay asked for."""
    return table(spark, d, "events").select("event_id", N.retry_delay(F.col("user_id") % 12, F.floor("value")).alias("delay"))


@query("c34_cache_buckets", "SELECT floor(epoch(ts) / 604800)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1")
def c34_cache_buckets(spark, d):
    """Events by seven-day bucket."""
    return table(spark, d, "events").groupBy(N.cache_bucket(F.col("ts").cast("timestamp")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("c36_normalized_weights", """WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: (x * x)::DOUBLE) AS s FROM embeddings), n AS (SELECT vec_id, list_transform(s, lambda x: x / list_sum(s)) AS w FROM w)
 SELECT vec_id, list_position(w, list_max(w)) AS peak, round(list_sum(w), 6) AS total FROM n""")
def c36_normalized_weights(spark, d):
    """Squared vectors scaled to sum 1, and the position of the peak."""
    w = N.normalized(F.transform("embedding", lambda x: x * x))
    e = table(spark, d, "embeddings").select("vec_id", w.alias("w"))
    return e.select("vec_id", F.array_position("w", F.array_max("w")).alias("peak"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("f24_reserved_hosts", """WITH h AS (SELECT url, rtrim(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '.') AS h FROM (SELECT url FROM sources UNION ALL SELECT unnest(['https://example.com/', 'https://a.example.org', 'https://localhost', 'https://b.localhost', 'https://shop.test./x', 'https://notexample.com', 'https://real.site.com'])))
 SELECT h AS host, regexp_matches(h, '(^|\\.)example\\.(com|org|net)$|\\.(example|test|invalid|localhost|local)$') AS reserved, count(*) AS n FROM h GROUP BY 1, 2""")
def f24_reserved_hosts(spark, d):
    """Hosts of the sources, and of a few others, that are reserved for examples and tests."""
    more = ["https://example.com/", "https://a.example.org", "https://localhost", "https://b.localhost", "https://shop.test./x", "https://notexample.com", "https://real.site.com"]
    u = table(spark, d, "sources").select("url").unionByName(spark.createDataFrame([(x,) for x in more], "url string"))
    h = u.select(F.rtrim(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)), F.lit(".")).alias("host"))
    return h.groupBy("host", T.reserved_host(F.col("host")).alias("reserved")).agg(F.count(F.lit(1)).alias("n"))


@query("f25_placeholder_emails", """WITH v AS (SELECT lower(email) AS e FROM records WHERE email <> '' UNION ALL SELECT lower(unnest(['a@b.png', 'x@yourdomain.com', 'x@cdn.wixpress.com', 'John.Doe@firm.example', 'noreply@firm.example', 'ann@firm.example', 'no-at-sign'])))
 SELECT CASE WHEN regexp_matches(e, '\\.(png|jpg|jpeg|gif|svg|webp|avif|bmp|ico|tif|tiff|css|js|pdf)$') THEN 'file name, not an email'
 WHEN regexp_matches(e, '(^|[@.])(domain|yourdomain|yoursite|yourcompany|yourwebsite|mydomain|mysite|company|website|sample|email|test|wixpress)\\.com$|(^|[@.])sentry(-cdn\\.com|\\.io)$') THEN 'placeholder or framework domain'
 WHEN regexp_matches(e, '^(yourname|your\\.name|your_name|name|email|youremail|your\\.email|user|username|john\\.doe|johndoe|jane\\.doe|janedoe|firstname\\.lastname|first\\.last|firstlast|someone|example|test|noreply|no-reply|donotreply|do-not-reply)@[^@]*$') THEN 'placeholder mailbox name' ELSE '' END AS reason, count(*) AS n FROM v GROUP BY 1""")
def f25_placeholder_emails(spark, d):
    """Why addresses are template values, counted, over the records and a few templates."""
    more = ["a@b.png", "x@yourdomain.com", "x@cdn.wixpress.com", "John.Doe@firm.example", "noreply@firm.example", "ann@firm.example", "no-at-sign"]
    e = table(spark, d, "records").where("email <> ''").select("email").unionByName(spark.createDataFrame([(x,) for x in more], "email string"))
    return e.groupBy(T.placeholder_email(F.col("email")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("c31_next_midnight", "SELECT run_id, date_trunc('day', finished_at::TIMESTAMP) + INTERVAL 1 DAY AS next_day FROM discovery_runs WHERE finished_at IS NOT NULL")
def c31_next_midnight(spark, d):
    """Start of the day after each run's end (UTC)."""
    r = table(spark, d, "discovery_runs").where("finished_at IS NOT NULL")
    return r.select("run_id", N.next_midnight(F.col("finished_at")).cast("timestamp_ntz").alias("next_day"))
