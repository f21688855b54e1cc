"""Best representative of each duplicate group: field by field, the usable value that trust and currency prefer.

Every field is decided by one mergeable maximum per group, so the shuffle carries one row per group and map task and
no group is ever gathered. Currency of values is reasoned from data: from the dated rows of all groups the precedence of
values (a is followed by b more often than b by a) is learned and closed over intermediate values that a group need not
hold; an undated value is outdated if its group holds a value that the closed precedence places after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.registry import query
from pageloom.llm.template_residue import _sql as residue_sql
from pageloom.llm.template_residue import residue
from pageloom.session import small, spread, table, written

# Marks of a cut or masked value, stand-ins for a missing one, what surrounds a name, a whole address.
CUT = "(?:…|\\.\\.\\.)\\s*$|^\\s*(?:…|\\.\\.\\.)"
MASKED = "[*•█]{2,}|[…]|(?:^|[^\\p{L}])[Xx]{3,}(?:[^\\p{L}]|$)"
STAND_INS = "(?i)^[\\s\\p{P}]*(?:n\\s*[./]?\\s*a|tbd|tba|tbc|none|null|nil|unknown|undefined|see (?:profile|site|notes|website)|to be (?:announced|confirmed|determined)|not (?:listed|given|available|known)|on request|call office|email hidden|hidden|tel|phone|email|x{2,}|various|vacant|pending|contact us)?[\\s\\p{P}]*$"
AROUND_NAME = "(?i)\\([^)]*\\)|“[^”]*”|\"[^\"]*\"|\\b(?:dr|mr|mrs|ms|mx|prof|jr|sr|cpa|mba|phd|esq|ii|iii)\\b\\.?|^\\s*contact:"
WORD = "\\p{L}[\\p{L}'’-]*\\p{L}"
# Last, First with a written-out first name; SURNAME First; or first and last word written out.
FULL_WORDS = f"^[^,]*{WORD}[^,]*,[^\\p{{L}}]*{WORD}|^[^\\p{{L}},]*\\p{{Lu}}{{3,}}[^\\p{{L}}'’,-]+{WORD}|^[^\\p{{L}},]*{WORD}[^,]*[^\\p{{L}}'’,-]{WORD}[^\\p{{L}}]*$"
EMAIL = "^\\s*(?:mailto:)?[\\p{L}\\p{N}._%+'-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)*\\.\\p{L}{2,}\\s*$"
EXTENSION = "(?i)\\s*(?:,|;)?\\s*(?:ext|extension|x|durchwahl)\\.?\\s*\\d+\\s*$"
FAKE_PHONE = "^1?(?:0{7,}|1{10,}|9{10,}|1234567890|0123456789)$"


def usable(field: str, value: Column) -> Column:
    """Whether a value of name, email, phone or title is there, genuine and whole; NULL and blank values are not."""
    ok = value.isNotNull() & ~value.rlike(CUT) & ~value.rlike(STAND_INS)
    if field == "email":
        return ok & value.rlike(EMAIL) & ~value.rlike(MASKED)
    if field == "phone":
        digits = F.regexp_replace(F.regexp_replace(value, EXTENSION, ""), "\\D", "")
        return ok & ~value.rlike(MASKED) & (F.length(digits) >= 10) & ~digits.rlike(FAKE_PHONE)
    if field == "name":
        return ok & F.regexp_replace(value, AROUND_NAME, " ").rlike(FULL_WORDS) & ~residue(value)
    return ok & value.rlike("\\p{L}.*\\p{L}") & ~residue(value)


def best_values(df: DataFrame, group: str, row_id: str, fields: dict[str, Column], trust: Column, at: str) -> DataFrame:
    """group, field_name, row_id of the row whose value survives, for groups of two rows or more.

    fields: usability by field name. Trusted rows come first, then the latest ``at`` (NULL is oldest), then the
    largest row_id. A NULL group is no group; a field without usable value gives no row; repeated rows count as rows.
    """
    order = F.struct(trust.cast("int").alias("t"), F.col(at).alias("at"), F.col(row_id).alias("id"))
    best = [F.max(F.when(ok, order)).alias(f"__{name}") for name, ok in fields.items()]
    got = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *best).where("__n > 1")
    rows = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(f"__{n}.id").alias(row_id)) for n in fields))
    return got.select(group, F.inline(rows)).where(F.col(row_id).isNotNull()).select(group, "field_name", row_id)


#: A precedence needs this many observed transitions more than its reverse.
SUPPORT = 3


def learned_precedence(values: DataFrame, keys: list[str], value: str, first: str, kind: str) -> DataFrame:
    """kind, before, after: values that follow each other in this order at least SUPPORT times more often than reversed.

    values: one row per distinct value of a group (kind is one of keys), ``first``: its first date; undated ones are left
    out, values of one date have no order. A group is ordered in two levels, inside its hours and over its hours, so
    that a group with a third of all values is no single task.
    """
    d = values.where(F.col(first).isNotNull()).select(*keys, F.col(value).alias("after"), F.col(first).alias("__at"), F.date_trunc("hour", first).alias("__h"))
    here = F.struct(F.col("__at").alias("at"), F.col("after").alias("v"))
    d = d.withColumn("__prev", F.lag(here).over(Window.partitionBy(*keys, "__h").orderBy("__at", "after")))
    hours = d.groupBy(*keys, "__h").agg(F.max(here).alias("last"))
    hours = hours.withColumn("__last", F.lag("last").over(Window.partitionBy(*keys).orderBy("__h"))).where("__last IS NOT NULL").select(*keys, "__h", "__last")
    inner = d.where("__prev IS NOT NULL").select(*keys, "after", "__at", "__prev")
    outer = d.where("__prev IS NULL").join(hours, [*keys, "__h"]).select(*keys, "after", "__at", F.col("__last").alias("__prev"))
    steps = inner.unionByName(outer).where(F.col("__prev.at") < F.col("__at")).select(kind, F.col("__prev.v").alias("before"), "after")
    pair = F.struct(F.least("before", "after").alias("a"), F.greatest("before", "after").alias("b"))
    net = steps.groupBy(kind, pair.alias("p")).agg(F.sum(F.when(F.col("before") < F.col("after"), 1).otherwise(-1)).alias("n")).where(F.abs("n") >= SUPPORT)
    up = F.col("n") > 0
    return net.select(kind, F.when(up, F.col("p.a")).otherwise(F.col("p.b")).alias("before"), F.when(up, F.col("p.b")).otherwise(F.col("p.a")).alias("after"))


def closed(edges: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    """kind, before, after of all pairs that the edges connect over any number of steps, from the given ``before`` values on.

    Every round joins the newly found pairs with the edges and is written, until no pair is new; values that precede
    each other (a cycle) have no order.
    """
    edges = written(edges)
    found = fresh = written(edges.join(starts.distinct(), [kind, "before"], "left_semi"))
    step = edges.select(kind, F.col("before").alias("after"), F.col("after").alias("__next"))
    while fresh.head(1):
        fresh = fresh.join(step, [kind, "after"]).select(kind, "before", F.col("__next").alias("after")).where("before <> after").distinct()
        fresh = written(fresh.join(found, [kind, "before", "after"], "left_anti"))
        found = found.unionByName(fresh)
    back = found.select(kind, F.col("after").alias("before"), F.col("before").alias("after"))
    return found.join(back, [kind, "before", "after"], "left_anti")


def distinct_values(df: DataFrame, group: str, row_id: str, fields: dict[str, tuple[Column, Column]], trust: Column, at: str) -> DataFrame:
    """group, field_name, value, first (its first date), open (whether a row of it is undated), best (trust, date and id of
    its best row). fields: usability and comparable value by name; NULL groups and values that aren't usable are left out."""
    best = F.struct(trust.cast("int").alias("t"), F.col(at).alias("at"), F.col(row_id).alias("id"))
    parts = F.array(*(F.struct(F.lit(n).alias("field_name"), F.when(ok, v).alias("value")) for n, (ok, v) in fields.items()))
    long = df.where(F.col(group).isNotNull()).select(group, F.col(at).alias("__at"), best.alias("__best"), F.inline(parts)).where(F.col("value").isNotNull())
    return long.groupBy(group, "field_name", "value").agg(F.min("__at").alias("first"), F.max(F.col("__at").isNull()).alias("open"), F.max("__best").alias("best"))


def current_rows(values: DataFrame, group: str, row_id: str) -> DataFrame:
    """group, field_name, row_id of the topologically latest value of every group and field with an undated value.

    values: as :func:`distinct_values` gives them. Trusted rows come first; a value is superseded if its group holds
    a value that the closed precedence places after it; among the others the latest date (NULL is oldest), then the
    largest row_id decides. If all are superseded, which a cycle can't cause, all stay.
    """
    key = [group, "field_name"]
    values = written(values)
    edges = learned_precedence(values, key, "value", "first", "field_name")
    values = values.join(values.where("open").select(*key).distinct(), key, "left_semi")
    several = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    mine = values.join(several, key, "left_semi").select(*key, "value")
    order = closed(edges, mine.select("field_name", F.col("value").alias("before")), "field_name")
    beaten = (
        mine.withColumnRenamed("value", "before").join(order, ["field_name", "before"])
        .join(mine.withColumnRenamed("value", "after"), [*key, "after"], "left_semi").select(*key, F.col("before").alias("value")).distinct()
    )
    marked = values.join(beaten.withColumn("__beaten", F.lit(1)), [*key, "value"], "left")
    rank = F.struct(F.col("best.t").alias("t"), F.col("__beaten").isNull().cast("int").alias("free"), F.col("best.at").alias("at"), F.col("best.id").alias("id"))
    return marked.groupBy(*key).agg(F.max(rank).alias("__r")).select(group, "field_name", F.col("__r.id").alias(row_id))


FIELDS = ("name", "email", "phone", "title")


def trusted_records(spark, sf_dir) -> DataFrame:
    """Records with the approval kind of their source; a missing source is not trusted."""
    sources = table(spark, sf_dir, "sources").select("source_id", (F.col("approval_kind") == "operator").alias("trusted"))
    records = spread(table(spark, sf_dir, "records").select("lead_id", "record_id", "source_id", "extracted_at", *FIELDS))
    return records.join(small(sources), "source_id", "left")


def _usable_sql(f: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ok = f"{f} IS NOT NULL AND NOT regexp_matches({f}, {q(CUT)}) AND NOT regexp_matches({f}, {q(STAND_INS)})"
    if f == "email":
        return f"{ok} AND regexp_matches({f}, {q(EMAIL)}) AND NOT regexp_matches({f}, {q(MASKED)})"
    if f == "phone":
        digits = f"regexp_replace(regexp_replace({f}, {q(EXTENSION)}, '', 'g'), '[^0-9]', '', 'g')"
        return f"{ok} AND NOT regexp_matches({f}, {q(MASKED)}) AND length({digits}) >= 10 AND NOT regexp_matches({digits}, {q(FAKE_PHONE)})"
    body = f"regexp_matches(regexp_replace({f}, {q(AROUND_NAME)}, ' ', 'g'), {q(FULL_WORDS)})" if f == "name" else f"regexp_matches({f}, {q('\\p{L}.*\\p{L}')})"
    return f"{ok} AND {body} AND NOT coalesce({residue_sql(f)}, false)"


_P2 = " UNION ALL ".join(
    f"""SELECT lead_id, '{f}' AS field_name, record_id FROM (SELECT lead_id, record_id, row_number() OVER (PARTITION BY lead_id ORDER BY
    (coalesce(approval_kind, '') = 'operator') DESC, extracted_at DESC NULLS LAST, record_id DESC) AS r FROM g WHERE {_usable_sql(f)}) WHERE r = 1"""
    for f in FIELDS
)


@query("p2_found", f"""WITH g AS (SELECT r.*, s.approval_kind FROM records r LEFT JOIN sources s ON r.source_id = s.source_id
WHERE lead_id IN (SELECT lead_id FROM records GROUP BY 1 HAVING count(*) > 1)) {_P2}""")
def p2_found(spark, sf_dir):
    """The surviving record of every field of every lead with several records."""
    return best_values(trusted_records(spark, sf_dir), "lead_id", "record_id", {f: usable(f, F.col(f)) for f in FIELDS}, F.coalesce("trusted", F.lit(False)), "extracted_at")


def comparable(field: str) -> Column:
    """Spelling by which values of a field are told apart."""
    return F.regexp_replace(field, "[^0-9]", "") if field == "phone" else F.lower(F.trim(F.col(field)))


def _values_sql(fields: tuple[str, ...]) -> str:
    same = {f: f"regexp_replace({f}, '[^0-9]', '', 'g')" if f == "phone" else f"lower(trim({f}))" for f in fields}
    return " UNION ALL ".join(f"SELECT lead_id, '{f}' AS field_name, {same[f]} AS v, extracted_at AS ts, coalesce(approval_kind, '') = 'operator' AS t, record_id AS id FROM r WHERE {_usable_sql(f)}" for f in fields)


def _current_sql(fields: tuple[str, ...]) -> str:
    return f"""WITH RECURSIVE r AS (SELECT r.*, s.approval_kind FROM records r LEFT JOIN sources s ON r.source_id = s.source_id),
 l AS ({_values_sql(fields)}), d AS (SELECT lead_id, field_name, v, min(ts) AS f, bool_or(ts IS NULL) AS o FROM l GROUP BY 1, 2, 3),
 st AS (SELECT field_name, v AS a, f, lag(v) OVER w AS b, lag(f) OVER w AS g FROM d WHERE f IS NOT NULL WINDOW w AS (PARTITION BY lead_id, field_name ORDER BY f, v)),
 n AS (SELECT field_name, least(a, b) AS x, greatest(a, b) AS y, sum(CASE WHEN b < a THEN 1 ELSE -1 END) AS n FROM st WHERE g < f GROUP BY 1, 2, 3),
 e AS (SELECT field_name, CASE WHEN n > 0 THEN x ELSE y END AS x, CASE WHEN n > 0 THEN y ELSE x END AS y FROM n WHERE abs(n) >= {SUPPORT}),
 c AS (SELECT * FROM e UNION SELECT c.field_name, c.x, e.y FROM c JOIN e ON c.field_name = e.field_name AND c.y = e.x WHERE c.x <> e.y),
 k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.field_name = c.field_name AND z.x = c.y AND z.y = c.x)),
 op AS (SELECT DISTINCT lead_id, field_name FROM d WHERE o),
 be AS (SELECT DISTINCT p.lead_id, p.field_name, p.v FROM d p JOIN k ON k.field_name = p.field_name AND k.x = p.v JOIN d q ON q.lead_id = p.lead_id AND q.field_name = p.field_name AND q.v = k.y)
 SELECT lead_id, field_name, id AS record_id FROM (SELECT l.*, row_number() OVER (PARTITION BY l.lead_id, l.field_name ORDER BY l.t DESC, (be.v IS NULL) DESC, l.ts DESC NULLS LAST, l.id DESC) AS r
 FROM l JOIN op ON l.lead_id = op.lead_id AND l.field_name = op.field_name LEFT JOIN be ON be.lead_id = l.lead_id AND be.field_name = l.field_name AND be.v = l.v) WHERE r = 1"""


def current_values(spark, sf_dir, fields: tuple[str, ...]) -> DataFrame:
    used = {f: (usable(f, F.col(f)), comparable(f)) for f in fields}
    return current_rows(distinct_values(trusted_records(spark, sf_dir), "lead_id", "record_id", used, F.coalesce("trusted", F.lit(False)), "extracted_at"), "lead_id", "record_id")


@query("p2_current_values", _current_sql(FIELDS))
def p2_current_values(spark, sf_dir):
    """For leads and fields with undated values: the record of the value that currency reasoning holds for the latest."""
    return current_values(spark, sf_dir, FIELDS)


@query("p2_current_titles", _current_sql(("title",)))
def p2_current_titles(spark, sf_dir):
    """The same for titles alone."""
    return current_values(spark, sf_dir, ("title",))
