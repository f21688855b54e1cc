"""HTML table functions as round trips: pages are written from table rows and must give the rows back."""

from pyspark.sql import functions as F

from pageloom.functions import extraction as X
from pageloom.functions import html as H
from pageloom.functions import text as T
from pageloom.plans.registry import query
from pageloom.session import small, spread, table


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _part(name):
    return _escaped(F.coalesce(F.col(name), F.lit("")))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BLANK = "'[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+'"
# The oracle's own statement of an address and of a number; its engine has no look-around, so edges are characters.
EMAIL = "(?i)[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9.-]+\\.[a-z]{2,}"
NUMBER = "\\+[0-9][0-9 ().-]{6,20}[0-9]|\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}"
EDGE = "[^\\p{L}\\p{N}_]"


def clean(c: str) -> str:
    """SQL: a text with single blanks, none at the ends, empty for NULL."""
    return f"trim(regexp_replace(coalesce({c}, ''), {BLANK}, ' ', 'g'))"


def mails(c: str) -> str:
    return f"regexp_extract_all({c}, {q(EMAIL)})"


def numbers(c: str) -> str:
    return f"regexp_extract_all({c}, {q(f'(?:^|{EDGE})({NUMBER})(?:$|{EDGE})')}, 1)"


@query("h02_page_text", f"SELECT record_id, {clean('evidence')} AS text FROM records WHERE evidence IS NOT NULL")
def h02_page_text(spark, d):
    """Visible text of a page around every record's evidence, scripts and hidden parts left out."""
    r = table(spark, d, "records").where("evidence IS NOT NULL")
    page = F.concat(F.lit("<body><script>var a = '<p>no</p>';</script><p>"), _escaped(F.col("evidence")), F.lit("</p><div style='display: none'>no<p>no</p></div><p hidden>no</p></body>"))
    return r.select("record_id", H.page_text(page).alias("text"))


_BASE = "'https://h' || (url_id % 7) || '.example/a/b/page.html'"


@query("h03_links", f"""WITH t AS (SELECT url_id, {clean('label')} AS label, {clean("coalesce(label, '') || ' ' || coalesce(context, '')")} AS context, regexp_extract({_BASE}, '^https://[^/]+') AS o FROM discovered_urls)
 SELECT url_id, 0 AS pos, o || '/home' AS url, 'home' AS label, '' AS context FROM t UNION ALL SELECT url_id, 1, o || '/a/b/c/' || url_id || '.html?k=1#x', label, CASE WHEN length(context) <= 600 THEN context ELSE '' END FROM t
 UNION ALL SELECT url_id, 2, o || '/a/u/' || url_id, 'up', 'up' FROM t UNION ALL SELECT url_id, 3, 'mailto:x@y.example', 'write', 'write' FROM t""")
def h03_links(spark, d):
    """Address, label and context of every link of a page written around each URL's label and context."""
    u = spread(table(spark, d, "discovered_urls").select("url_id", "label", "context"))
    page = F.concat(
        F.lit('<html><body><nav><a href="/home">home</a></nav><ul><li><a href="c/'), F.col("url_id").cast("string"), F.lit('.html?k=1#x"> '), _part("label"), F.lit("</a> "), _part("context"),
        F.lit('</li><li><a href=" ../u/'), F.col("url_id").cast("string"), F.lit('">up</a></li><li><a href="mailto:x@y.example">write</a></li></ul><a href="">none</a></body></html>'),
    )
    base = F.concat(F.lit("https://h"), (F.col("url_id") % 7).cast("string"), F.lit(".example/a/b/page.html"))
    return H.links(u.select("url_id", base.alias("base"), page.alias("html")), "url_id", "base", "html").drop("truncated")


def _unquoted(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\?.*$', ''))"


def _card(*inner):
    return F.concat(F.lit('<div class="x team-card"><h3>'), _part("name"), F.lit('</h3><p class="title">'), _part("title"), F.lit('</p><span class="company">'), _part("company"), F.lit("</span>"), *inner, F.lit("</div>"))


@query("h04_cards", f"""SELECT record_id, {clean('name')} AS name, {clean('title')} AS title, {clean('company')} AS company, {_unquoted('email')} AS email, {_unquoted('phone')} AS phone,
 {clean(f"coalesce(name, '') || ' ' || coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || {_unquoted('email')} || ' mail ' || {_unquoted('phone')} || ' call'")} AS evidence, 1 AS name_cards
 FROM records WHERE NOT contains(coalesce(email, ''), '%') AND NOT contains(coalesce(phone, ''), '%')""")
def h04_cards(spark, d):
    """All parts of every record, extracted by the default selectors from a card written around it; a card in the header is
    another's, a hidden one is none. Percent signs would be escapes in a link."""
    r = spread(table(spark, d, "records").where(~F.coalesce("email", F.lit("")).contains("%") & ~F.coalesce("phone", F.lit("")).contains("%")))
    page = F.concat(F.lit('<body><div class="team-card" hidden><h3>Nobody</h3></div>'), _card(F.lit('<a href="MAILTO:'), _part("email"), F.lit('">mail</a><a href="tel:'), _part("phone"), F.lit('">call</a>')), F.lit("</body>"))
    got = H.raw_cards(r.select("record_id", page.alias("html")), "record_id", "html")
    return got.select("record_id", "name", "title", "company", "email", "phone", "evidence", F.col("name_cards").cast("int").alias("name_cards"))


_SEEN = f"{clean(f'''coalesce(name, '') || ' ' || coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(email, '') || ' ' || coalesce(phone, '')''')}"


@query("h05_visible_contacts", f"""WITH t AS (SELECT record_id, {clean('name')} AS n, {_SEEN} AS s FROM records), m AS (SELECT *, {mails('s')} AS ms, {numbers('s')} AS ps FROM t),
 o AS (SELECT *, CASE WHEN n <> '' AND len(list_distinct(list_transform(ms, lambda x: lower(x)))) = 1 AND lower(split_part(ms[1], '@', 1)) NOT IN ('info', 'sales', 'contact', 'hello', 'support', 'office', 'admin', 'team', 'enquiries', 'inquiries') THEN ms[1] ELSE '' END AS email,
 CASE WHEN n <> '' AND len(list_distinct(list_transform(ps, lambda x: regexp_replace(x, '[^0-9]', '', 'g')))) = 1 THEN ps[1] ELSE '' END AS phone FROM m)
 SELECT record_id, email, phone, (email <> '')::INT + (phone <> '')::INT AS visible FROM o""")
def h05_visible_contacts(spark, d):
    """Address and number that a card shows in plain text, where they are the only ones; those of its navigation don't count."""
    r = spread(table(spark, d, "records"))
    page = F.concat(F.lit("<body><footer>info@site.example</footer>"), _card(F.lit("<p>"), _part("email"), F.lit(" "), _part("phone"), F.lit("</p><nav>other@site.example</nav>")), F.lit("</body>"))
    pages = r.select("record_id", page.alias("html"))
    got = X.with_visible_contacts(H.raw_cards(pages, "record_id", "html"), H.page_lines(pages, "record_id", "html"), "record_id")
    return got.select("record_id", "email", "phone", F.size(F.filter(F.map_values("provenance"), lambda v: v == "visible")).alias("visible"))


_ROLE = "(?i)\\bsales\\b|account (executive|manager)|business development|(payment|merchant|pos|payroll|funding|telecom|insurance).{0,25}(consultant|agent|advisor|broker|specialist)|independent (agent|rep)|\\breseller\\b|\\biso\\b"
_FAKE = "(?i)^(john|jane)\\s+doe$|^(your|full|first|last|member|staff|employee|agent|person|sample|team|contact|user|person''s)\\s+(name|member)$|^first\\s*name\\s+last\\s*name$|^name\\s+(surname|lastname|last name)$|^lorem\\s+ipsum|^(test|demo)\\s+(user|person|name)$|^first\\s+last$"
_D = "regexp_replace(phone, '[^0-9]', '', 'g')"
_NAT = f"(CASE WHEN length({_D}) = 11 AND {_D} LIKE '1%' THEN substr({_D}, 2) ELSE {_D} END)"
_FAKE_MAIL = """(regexp_matches(lower(email), '\\.(png|jpg|jpeg|gif|svg|webp|avif|bmp|ico|tif|tiff|css|js|pdf)$') OR regexp_matches(lower(email), '[@.](domain|yourdomain|yoursite|yourcompany|yourwebsite|mydomain|mysite|company|website|sample|email|test|wixpress)\\.com$|[@.]sentry(-cdn\\.com|\\.io)$')
 OR regexp_matches(lower(email), '^(yourname|your\\.name|your_name|name|email|youremail|your\\.email|user|username|john\\.doe|johndoe|jane\\.doe|janedoe|firstname\\.lastname|first\\.last|firstlast|someone|example|test|noreply|no-reply|donotreply|do-not-reply)@[^@]*$'))"""
_VALID = f"""WITH a AS (SELECT record_id, {clean('evidence')} AS e, substr({clean('r.name')}, 1, 200) AS name, substr({clean('r.title')}, 1, 200) AS title, substr({clean('r.company')}, 1, 200) AS company, substr({clean('r.email')}, 1, 254) AS email, substr({clean('r.phone')}, 1, 80) AS phone,
  coalesce(s.company, '') AS employer, coalesce(s.require_sales_role, false) AS role FROM records r LEFT JOIN sources s ON r.source_id = s.source_id),
 b AS (SELECT * REPLACE (CASE WHEN regexp_full_match(email, {q(EMAIL)}) AND list_contains(list_transform({mails('e')}, lambda x: lower(x)), lower(email)) THEN email ELSE '' END AS email,
  CASE WHEN length({_D}) BETWEEN 7 AND 15 AND regexp_matches(lower(e), '(^|[^0-9])' || regexp_escape(lower(phone)) || '($|[^0-9])') THEN phone ELSE '' END AS phone), email <> '' OR phone <> '' AS selected FROM a),
 c AS (SELECT *, email <> '' AND {_FAKE_MAIL} AS fm, phone <> '' AND (len(list_distinct(string_split({_NAT}, ''))) <= 1 OR {_NAT} IN ('1234567890','0123456789','9876543210','1234567','12345678','123456789')) AS fp FROM b),
 d AS (SELECT * REPLACE (CASE WHEN fm THEN '' ELSE email END AS email, CASE WHEN fp THEN '' ELSE phone END AS phone, CASE WHEN contains(lower(e), lower(title)) THEN title ELSE '' END AS title,
  CASE WHEN company <> '' AND contains(lower(e), lower(company)) THEN company ELSE employer END AS company) FROM c)
 SELECT record_id, lower(email) AS email, phone, title, company, CASE WHEN length(e) > 12000 THEN 'evidence_too_long' WHEN NOT contains(name, ' ') OR length(name) < 4 OR length(name) > 100 OR contains(name, '@') THEN 'invalid_name'
  WHEN NOT contains(lower(e), lower(name)) OR lower(name) IN ('contact us', 'sales team', 'our team', 'learn more') THEN 'name_without_evidence' WHEN regexp_matches(name, '{_FAKE}') OR contains(lower(e), 'lorem ipsum') THEN 'placeholder_name'
  WHEN email = '' AND phone = '' THEN CASE WHEN fm OR fp THEN 'placeholder_contact' WHEN selected THEN 'contact_without_evidence' ELSE 'missing_contact' END
  WHEN role AND NOT regexp_matches(CASE WHEN title <> '' THEN title ELSE e END, {q(_ROLE)}) THEN 'non_sales_role' END AS reason FROM d"""


def checked_records(spark, d):
    """Records validated against their evidence, with their source's company and role rule."""
    s = table(spark, d, "sources").select("source_id", F.col("company").alias("employer"), "require_sales_role", T.real_host(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("real"))
    r = spread(table(spark, d, "records").select("record_id", "source_id", "page_url", "name", "title", "company", "email", "phone", "evidence")).join(small(s), "source_id", "left")
    return X.validated(r.withColumn("real", F.coalesce("real", F.lit(False))), "employer", "require_sales_role", "real")


@query("h06_validated", _VALID)
def h06_validated(spark, d):
    """Accepted values of every record, and why it is refused."""
    return checked_records(spark, d).select("record_id", "email", "phone", "title", "company", "reason")


@query("h06_rejections", f"SELECT reason, count(*) AS n FROM ({_VALID}) WHERE reason IS NOT NULL GROUP BY 1")
def h06_rejections(spark, d):
    """Refused records by reason."""
    return checked_records(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("h07_shared_contacts", f"""WITH s AS (SELECT source_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS h FROM sources)
 SELECT source_id, CASE WHEN source_id % 3 = 2 THEN 'phone' ELSE 'email' END AS kind, CASE source_id % 3 WHEN 0 THEN 'sales@' || h WHEN 1 THEN 'ann@' || h ELSE '555-555-0' || lpad((source_id % 1000)::VARCHAR, 3, '0') END AS value,
 CASE WHEN source_id % 3 = 0 THEN 'company inbox on this page' ELSE 'page header/footer' END AS place FROM s""")
def h07_shared_contacts(spark, d):
    """The contact that a site gives for all, from pages written around every source: an own mailbox in the text, an own address in
    the header, or a number in the footer; other sites' mailboxes never count."""
    s = table(spark, d, "sources").select("source_id", "url")
    h = F.regexp_replace(F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)), "^www\\.", "")
    kind = F.col("source_id") % 3
    number = F.concat(F.lit("555-555-0"), F.lpad((F.col("source_id") % 1000).cast("string"), 3, "0"))
    page = F.concat(
        F.lit("<body><header>Info@other.example "), F.when(kind == 1, F.concat(F.lit("<a href='mailto:Ann@"), h, F.lit("'>Ann</a>"))).otherwise(""), F.lit("</header><p>support@other.example "),
        F.when(kind == 0, F.concat(F.lit("Sales@"), h)).otherwise(F.concat(F.lit("ann.lee@"), h)), F.lit("</p><footer>"), number, F.lit("</footer></body>"),
    )
    lines = H.page_lines(s.withColumn("html", page), "source_id", "html").join(small(s), "source_id")
    return X.shared_contacts(lines.withColumn("real", F.lit(False)), "source_id", "url", "real")


@query("h08_one_per_person", f"""WITH v AS ({_VALID}), k AS (SELECT v.record_id, r.page_url, lower(substr({clean('r.name')}, 1, 200)) AS n, v.email, v.phone, v.title FROM v JOIN records r ON v.record_id = r.record_id WHERE reason IS NULL AND r.page_url IS NOT NULL),
 u AS (SELECT page_url, n, email, phone, min(record_id) AS pos, max_by(title, record_id) AS title FROM k GROUP BY 1, 2, 3, 4)
 SELECT page_url, pos, title, (email <> '' AND count(*) OVER (PARTITION BY page_url, email) > 1) OR (phone <> '' AND count(*) OVER (PARTITION BY page_url, phone) > 1) OR regexp_matches(email, '^(info|sales|contact|hello|support|office|admin|team|enquiries|inquiries)@') AS shared FROM u""")
def h08_one_per_person(spark, d):
    """Accepted records of every page, one for each person, and whether they share a contact."""
    ok = checked_records(spark, d).where("reason IS NULL AND page_url IS NOT NULL").withColumnRenamed("record_id", "pos")
    return X.one_per_person(ok, "page_url", "pos").select("page_url", "pos", "title", (F.col("contact_scope") == "shared").alias("shared"))


def _one(c: str) -> str:
    return f"(CASE WHEN length(coalesce({c}, '')) <= 300 THEN {clean(c)} ELSE '' END)"


_N = _one("name")


@query("h12_entities", f"""WITH e AS (SELECT record_id, {_N} AS name, {_one('title')} AS title, {_one('email')} AS email, {_one('phone')} AS phone, {_one('company')} AS company FROM records),
 k AS (SELECT * FROM e WHERE len(string_split(name, ' ')) BETWEEN 2 AND 8 AND length(name) <= 100 AND NOT contains(name, '@'))
 SELECT record_id, s AS syntax, 'Person' AS type, name, title, email, phone, company FROM k, (SELECT unnest(['json-ld', 'microdata']) AS s)
 UNION ALL SELECT record_id, 'json-ld', 'Organization', company, '', '', '', company FROM e WHERE company <> ''""")
def h12_entities(spark, d):
    """Persons and organisations of pages that declare every record in JSON-LD and in Microdata."""
    r = spread(table(spark, d, "records").select("record_id", "name", "title", "email", "phone", "company"))
    v = lambda c: F.coalesce(F.col(c), F.lit(""))
    firm = F.struct(F.lit("Organization").alias("@type"), v("company").alias("name"))
    person = F.to_json(F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("Person").alias("@type"), v("name").alias("name"), v("title").alias("jobTitle"),
        F.array(F.concat(F.lit("mailto:"), v("email"))).alias("email"), v("phone").alias("telephone"), firm.alias("worksFor"),
    ))
    graph = F.to_json(F.struct(F.lit("http://schema.org").alias("@context"), F.array(firm, F.struct(F.lit("Place").alias("@type"), F.lit("x").alias("name"))).alias("@graph")))
    script = lambda j: F.concat(F.lit('<script type="application/ld+json">'), F.replace(j, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    item = F.concat(
        F.lit('<div itemscope itemtype="https://schema.org/Person"><b itemprop="name">'), _part("name"), F.lit('</b><i itemprop="jobTitle">'), _part("title"), F.lit('</i><meta itemprop="email" content="'), _part("email"),
        F.lit('"><span itemprop="telephone">'), _part("phone"), F.lit('</span><div itemprop="worksFor" itemscope itemtype="https://schema.org/Organization"><span itemprop="name">'), _part("company"), F.lit("</span></div></div>"),
    )
    page = F.concat(F.lit("<body>"), script(person), script(graph), F.lit('<script type="application/ld+json">{broken</script>'), item, F.lit("</body>"))
    return H.entities(r.select("record_id", page.alias("html")), "record_id", "html").select("record_id", "syntax", "type", "name", "title", "email", "phone", "company")
