"""Duplicates hidden by formatting differences: canonical text, 128-bit key, counts with map-side combining.

The canonical form of a URL keeps scheme, host, the words and numbers of the path in their order, the query
fields as a sorted list and the fragment's words; blanks, invisible characters, case, punctuation and escapes go.
Counting shuffles one (key, check) per distinct page and map task: the aggregate is a hash aggregate over
fixed-width columns, so a page with a third of all rows is combined before the shuffle. The 128-bit key goes with an
independent check of the text and its length: texts that collide in the key differ in the check and stay apart, and
``p3_collisions`` reports such keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.registry import query
from pageloom.session import spread, table, written

# Characters that leave no trace on a page, and the pattern of an absolute address.
INVISIBLE = "[\\u00ad\\u034f\\u061c\\u115f\\u17b4\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufe00-\\ufe0f\\ufeff]"
NOT_WORD = "[^\\p{L}\\p{N}\\p{M}]+"
PARTS = "(?s)^[^\\p{L}\\p{N}]*([A-Za-z][A-Za-z0-9+.-]*)\\s*:[\\s/\\\\]*([^/\\\\?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
CUT = "\u0001"
SEEDS = (11, 29)


def words(text: Column) -> Column:
    """Unescaped lower-case words and numbers of a text, one blank between them."""
    plain = F.when(text.contains("%"), F.coalesce(F.try_url_decode(text), text)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), NOT_WORD, " "))


def url_parts(url: Column) -> Column:
    """Array of scheme, host, path, query, fragment as written; a single element if the text is no absolute address."""
    seen = F.regexp_replace(url, INVISIBLE, "")
    seen = F.when(seen.contains("&"), F.regexp_replace(seen, "(?i)&(?:amp|#38|#x26);(?:amp;)*", "&")).otherwise(seen)
    return F.split(F.regexp_replace(seen, PARTS, f"$1{CUT}$2{CUT}$3{CUT}$4{CUT}$5"), CUT)


def host_form(host: Column) -> Column:
    """Host in lower case, without blanks, doubled separators and punctuation at its ends."""
    h = F.regexp_replace(F.lower(host), "[\\s\\u00a0\\u3000]+", "")
    h = F.regexp_replace(F.regexp_replace(h, "[\\u2010-\\u2015]", "-"), "([.:-])[.:-]+", "$1")
    return F.regexp_replace(h, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def query_form(text: Column) -> Column:
    """Fields of a query in sorted order, each as its words; empty fields count as punctuation."""
    fields = F.filter(F.transform(F.split(text, "[&;]"), words), lambda x: x != "")
    return F.when(text == "", text).otherwise(F.array_join(F.array_sort(fields), "&"))


def canonical_url(df: DataFrame, url: str, out: str = "canonical") -> DataFrame:
    """Add the canonical text of a URL column: NULL for NULL; texts that are no address keep their words."""
    p = "__parts"
    df = df.withColumn(p, url_parts(F.col(url)))
    full = F.concat_ws(
        CUT,
        F.lower(F.get(p, 0)),
        host_form(F.get(p, 1)),
        words(F.get(p, 2)),
        query_form(F.get(p, 3)),
        words(F.get(p, 4)),
    )
    return df.withColumn(out, F.when(F.size(p) == 5, full).when(F.col(url).isNotNull(), words(F.get(p, 0)))).drop(p)


def keyed(df: DataFrame, text: str) -> DataFrame:
    """Add the 128-bit key (h1, h2) and the independent check of a text column."""
    return df.withColumns({
        "h1": F.xxhash64(F.lit(SEEDS[0]), F.col(text)),
        "h2": F.xxhash64(F.lit(SEEDS[1]), F.col(text), F.length(text)),
        "check": F.crc32(F.encode(F.col(text), "utf-8")) * 4096 + F.length(text) % 4096,
    })


KEY = ("h1", "h2", "check")


def count_copies(df: DataFrame, scope: list[str], text: str, row_id: str) -> DataFrame:
    """One row per distinct (scope, text): scope, h1, h2, check, first_id (smallest id) and copies.

    Rows whose text is NULL are left out; a NULL scope is a scope of its own; repeated rows are copies; an empty
    table gives no row. Texts that collide in the 128-bit key differ in the check and stay apart.
    """
    return _groups(keyed(df.where(F.col(text).isNotNull()).select(*scope, row_id, text), text), scope, row_id)


def _groups(rows: DataFrame, scope: list[str], row_id: str) -> DataFrame:
    return rows.groupBy(*scope, *KEY).agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies_of_first(df: DataFrame, scope: list[str], text: str, row_id: str) -> DataFrame:
    """Scope, first_id and row_id for every row that repeats an earlier (smaller) id with the same text in its scope.

    The texts are read and canonicalized once: the fixed-width keys are written to the shared scratch folder and read
    twice from there. Linear in the rows: every copy is paired with the first of its group only. The rows meet the combined groups in
    one equi-join that adaptive execution splits where one key is hot; nothing is gathered per group.
    """
    rows = written(keyed(df.where(F.col(text).isNotNull()).select(*scope, row_id, text), text).drop(text))
    groups = _groups(rows, scope, row_id).where(F.col("copies") > 1)
    groups = groups.select("first_id", *(F.col(c).alias(f"__{c}") for c in (*scope, *KEY)))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) if c in scope else F.col(c) == F.col(f"__{c}") for c in (*scope, *KEY)]
    return rows.join(groups, on).where(F.col(row_id) != F.col("first_id")).select(*scope, "first_id", row_id)


def collided(df: DataFrame, scope: list[str], text: str, row_id: str) -> DataFrame:
    """The 128-bit keys that stand for more than one text, with the number of texts; empty in all likelihood."""
    return count_copies(df, scope, text, row_id).groupBy(*scope, "h1", "h2").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")


# The oracle states the canonical form on its own: unescape, drop what is invisible, keep words and numbers.
_SEEN = "regexp_replace(regexp_replace(url, '[\\x{00ad}\\x{034f}\\x{061c}\\x{115f}\\x{17b4}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{fe00}-\\x{fe0f}\\x{feff}]', '', 'g'), '(?i)&(?:amp|#38|#x26);(?:amp;)*', '&', 'g')"
_ADDRESS = "'(?s)^[^\\p{L}\\p{N}]*([A-Za-z][A-Za-z0-9+.-]*)\\s*:[\\s/\\\\]*([^/\\\\?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$'"


def _said(text: str) -> str:
    return f"trim(regexp_replace(lower(url_decode(replace({text}, '+', ' '))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"


def _group(n: int) -> str:
    return f"regexp_extract(u, {_ADDRESS}, {n})"


_HOST = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_group(2)}), '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g'), '[\\x{{2010}}-\\x{{2015}}]', '-', 'g'), '([.:-])[.:-]+', '\\1', 'g'), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
_FIELDS = f"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({_group(4)}, '[&;]'), lambda f: {_said('f')}), lambda f: f <> '')), '&')"
_PAGES = f"""WITH s AS (SELECT url_id, campaign_id, {_SEEN} AS u FROM discovered_urls WHERE url IS NOT NULL), k AS (SELECT url_id, campaign_id, CASE WHEN regexp_matches(u, {_ADDRESS})
 THEN lower({_group(1)}) || chr(1) || {_HOST} || chr(1) || {_said(_group(3))} || chr(1) || {_FIELDS} || chr(1) || {_said(_group(5))} ELSE {_said('u')} END AS k FROM s)"""


@query("p3_found", f"{_PAGES} SELECT a AS url_id_a, url_id AS url_id_b FROM (SELECT url_id, min(url_id) OVER (PARTITION BY campaign_id, k) AS a FROM k) WHERE a <> url_id")
def p3_found(spark, sf_dir):
    """Pairs (smallest url_id, other url_id) of one page of a campaign."""
    urls = canonical_url(spread(table(spark, sf_dir, "discovered_urls").select("campaign_id", "url_id", "url")), "url")
    got = copies_of_first(urls, ["campaign_id"], "canonical", "url_id")
    return got.select(F.col("first_id").alias("url_id_a"), F.col("url_id").alias("url_id_b"))


@query("p3_pages", f"{_PAGES} SELECT campaign_id, min(url_id) AS url_id, count(*) AS copies FROM k GROUP BY campaign_id, k")
def p3_pages(spark, sf_dir):
    """One row per page of a campaign: its smallest url_id and the number of copies."""
    urls = canonical_url(spread(table(spark, sf_dir, "discovered_urls").select("campaign_id", "url_id", "url")), "url")
    return count_copies(urls, ["campaign_id"], "canonical", "url_id").select("campaign_id", F.col("first_id").alias("url_id"), "copies")


@query("p3_collisions", "SELECT campaign_id, 0::BIGINT AS texts FROM discovered_urls WHERE false")
def p3_collisions(spark, sf_dir):
    """Keys of 128 bits that stand for several pages."""
    urls = canonical_url(spread(table(spark, sf_dir, "discovered_urls").select("campaign_id", "url_id", "url")), "url")
    return collided(urls, ["campaign_id"], "canonical", "url_id").select("campaign_id", "texts")
