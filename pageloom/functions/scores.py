"""Explainable relevance of a link as Column expressions: intent gates, exclusions, score, reasons, adjustments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.numbers import posterior_rate, yield_delta
from pageloom.functions.urls import DOCUMENT_HOSTS, SCHEDULING_HOSTS, SOCIAL_HOSTS, bound, on_hosts, parts, unescaped

# Phrases of person pages, of work pages, of noise, of editorial, product, company and contact pages, in their groups.
DIRECT_TARGETS = ("team", "staff", "people", "profile", "bio", "biography", "leadership")
PLURAL_ROLE_TARGETS = ("agents", "reps", "representatives")
SALES_ROLE_TARGETS = ("sales team", "sales representative", "sales rep", "sales agent")
PRIORITY_TARGETS = (
    "team", "staff", "people", "representative", "rep", "dealer", "partner", "agent", "executive", "sales", "contact", "about", "directory", "member",
    "profile", "bio", "biography", "leadership",
)
EDITORIAL = ("blog", "article", "news", "careers", "vacancies", "privacy", "terms")
PRODUCT = ("product", "device", "software", "emv credit card machines")
DIRECT_NOISE = (
    "collateral", "document", "document sharing", "social", "deck", "sheet", "playbook", "brochure", "schedule", "scheduling", "calendar", "booking",
    "appointment", "login", "sign in", "signin", "business agent", "business rep", "business representative",
)
COMPANY_PAGE_TARGETS = ("about", "about us", "who we are", "our company", "our story", "meet us")
CONTACT_PAGE_TARGETS = ("contact", "contact us")
# Path segments of taxonomy lists, segments that are no person's name, hosts without person pages.
TAXONOMY_SEGMENTS = ("tag", "tags", "category", "categories", "topic", "topics")
NO_PERSON_SEGMENTS = ("login", "portal", "business", "directory", "search", "find", "contact", "about", "apply", "application", "support", "resources")
CLOSED_HOSTS = (*SOCIAL_HOSTS, *DOCUMENT_HOSTS, *SCHEDULING_HOSTS)
NO_SIGNAL = "No strong relevance signal yet"
EDGE = "[\\p{L}\\p{N}_]"


def plain(text: Column) -> Column:
    """Lower case, hyphens and underscores as blanks."""
    return F.translate(F.lower(text), "-_", "  ")


def _with_plural(term: str) -> str:
    t = term.lower().replace("-", " ").replace("_", " ")
    return t + ("s?" if len(t) > 2 and not t.endswith("s") else "")


def mentions(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a plain text holds one of a few fixed terms as words; a plural s doesn't matter."""
    return text.rlike(f"(?<!{EDGE})(?:{'|'.join(map(_with_plural, terms))})(?!{EDGE})")


def holds(text: Column, term: Column) -> Column:
    """Whether a plain text holds a term of a column as words; a plural s doesn't matter. Blank terms are held by none."""
    t = F.translate(term, "-_", "  ")
    quoted = F.concat(F.lit(f"(?<!{EDGE})\\Q"), F.replace(t, F.lit("\\E"), F.lit("")), F.when((F.length(t) > 2) & ~t.endswith("s"), "\\Es?").otherwise("\\E"), F.lit(f"(?!{EDGE})"))
    # Most terms aren't there at all, which a plain search tells.
    return F.when((t != "") & F.contains(text, t), F.rlike(text, quoted)).otherwise(False)


def terms_of(terms: Column) -> Column:
    """Distinct terms in lower case without blanks around, in their order; NULL counts as none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def _seen(url: Column, label: Column) -> dict[str, Column]:
    """What the rules look at: host, decoded path and label of a link; invalid addresses have an empty host and path."""
    a = parts(url)
    return {"h": F.coalesce(a["host"], F.lit("")), "p": F.coalesce(unescaped(a["path"]), F.lit("")), "l": F.coalesce(label, F.lit(""))}


def _near(x: Column) -> Column:
    return plain(F.concat_ws(" ", x["p"], x["l"]))


def _intent(x: Column) -> Column:
    near = _near(x)
    segments = F.filter(F.transform(F.split(x["p"], "/"), plain), lambda s: s != "")
    # rep/<name>: a role's segment and then one that may be a person.
    named = F.exists(
        F.zip_with(segments, F.slice(segments, 2, F.size(segments)), lambda a, b: a.isin("rep", "representative") & b.isNotNull() & ~b.isin(*NO_PERSON_SEGMENTS)), lambda v: F.coalesce(v, F.lit(False))
    )
    listed = F.exists(F.split(F.lower(x["p"]), "/"), lambda s: s.isin(*TAXONOMY_SEGMENTS))
    targets = mentions(near, (*DIRECT_TARGETS, *PLURAL_ROLE_TARGETS, *SALES_ROLE_TARGETS))
    return ~on_hosts(x["h"], CLOSED_HOSTS) & ~listed & ~mentions(near, DIRECT_NOISE) & (targets | named)


def direct_intent(url: Column, label: Column) -> Column:
    """Whether path or label describe a page of people: no closed host, taxonomy list or noise, and a target or a role's name."""
    return bound(_seen(url, label), _intent)


def page_tier(url: Column, label: Column) -> Column:
    """1 for pages about a firm, 2 for contact pages, else NULL; closed hosts, noise, editorial and product pages have none."""

    def tier(x: Column) -> Column:
        near = _near(x)
        shut = on_hosts(x["h"], CLOSED_HOSTS) | mentions(near, (*DIRECT_NOISE, *EDITORIAL, *PRODUCT))
        return F.when(shut, None).when(mentions(near, COMPANY_PAGE_TARGETS), 1).when(mentions(near, CONTACT_PAGE_TARGETS), 2)

    return bound(_seen(url, label), tier)


def low_value(url: Column, label: Column, kind: Column, start: Column) -> Column:
    """Whether a page without direct intent can never pass; sitemaps and starting pages always may."""
    return (kind == "page") & ~F.coalesce(start, F.lit(False)) & ~direct_intent(url, label)


def link_priority(url: Column, label: Column) -> Column:
    """Crawl order of a link inside a site: +35 for work pages, -20 for editorial, -25 for product pages."""

    def order(x: Column) -> Column:
        near = _near(x)
        return F.when(mentions(near, PRIORITY_TARGETS), 35).otherwise(0) + F.when(mentions(near, EDITORIAL), -20).otherwise(0) + F.when(mentions(near, PRODUCT), -25).otherwise(0)

    return bound(_seen(url, label), order)


def excluded_terms(x: Column, rules: Column, context: Column) -> Column:
    """The rules that exclude a link: path: phrases of the path, domain: or bare hosts, else phrases of host, path, label and context."""

    def hit(rule: Column) -> Column:
        domain = F.regexp_replace(F.trim(F.regexp_replace(rule, "^domain:", "")), "\\.+$", "")
        bare = rule.startswith("domain:") | rule.rlike("^[a-z0-9-]+(?:\\.[a-z0-9-]+)+$")
        return (
            F.when(rule.startswith("path:"), holds(plain(x["p"]), F.trim(F.substring(rule, 6, 1_000_000))))
            .when(bare, (x["h"] == domain) | F.endswith(x["h"], F.concat(F.lit("."), domain))).otherwise(holds(plain(F.concat_ws(" ", x["h"], x["p"], x["l"], context)), rule))
        )

    return F.filter(rules, hit)


def rank(url: Column, label: Column, context: Column, keywords: Column, sales_terms: Column, exclusions: Column, region: Column) -> Column:
    """Struct of score and reasons: -100 for excluded links, else the sum of the parts, each with its reason.

    NULL texts and lists count as empty; an invalid address is judged by its label and context.
    """
    near_by = F.coalesce(context, F.lit(""))

    def scored(x: Column) -> Column:
        near, text, out = x["n"], x["t"], x["e"]
        industry, sales = x["k"], x["s"]
        few = lambda found: F.array_join(F.slice(found, 1, 3), ", ")
        rules = [
            (x["d"], 35, F.lit("Direct contact or person page (+35)")),
            (F.size(industry) > 0, 25, F.concat(F.lit("Industry: "), few(industry), F.lit(" (+25)"))),
            (F.size(sales) > 0, 20, F.concat(F.lit("Sales role: "), few(sales), F.lit(" (+20)"))),
            (holds(text, F.lower(F.coalesce(region, F.lit("")))), 10, F.lit("Region mentioned (+10; not verified)")),
            (mentions(near, EDITORIAL), -20, F.lit("Editorial, legal or recruitment page (-20)")),
            (mentions(near, PRODUCT), -25, F.lit("Product, device or software page (-25)")),
        ]
        score = sum((F.when(c, points).otherwise(0) for c, points, _ in rules), F.lit(0))
        reasons = F.array_compact(F.array(*(F.when(c, why) for c, _, why in rules)))
        open_ = F.struct(score.alias("score"), F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(NO_SIGNAL))).alias("reasons"))
        shut = F.struct(F.lit(-100).alias("score"), F.transform(F.slice(out, 1, 3), lambda t: F.concat(F.lit("Excluded phrase: "), t)).alias("reasons"))
        return F.when(F.size(out) > 0, shut).otherwise(open_)

    def looked(x: Column) -> Column:
        near = _near(x)
        text = plain(F.concat_ws(" ", x["p"], x["l"], near_by))
        found = lambda terms: F.filter(terms_of(terms), lambda t: holds(text, t))
        return bound({"n": near, "t": text, "e": excluded_terms(x, terms_of(exclusions), near_by), "d": _intent(x), "k": found(keywords), "s": found(sales_terms)}, scored)

    return bound(_seen(url, label), looked)


def adjusted(ranked: Column, productive: Column, fetched: Column, reviewed: Column, start: Column) -> Column:
    """Struct of the current score and its reasons: the yield of the origin moves it within 0 to 100, a reviewed source adds 10
    up to 100, an explicit start is worth 90 at least; excluded links stay as they are. NULL counts are 0, NULL flags false."""
    p, n = F.coalesce(productive, F.lit(0)), F.coalesce(fetched, F.lit(0))
    known, first = F.coalesce(reviewed, F.lit(False)), F.coalesce(start, F.lit(False))
    note = (
        F.when(yield_delta(p, n) < 0, F.concat(F.lit("Site stored no validated contacts on "), n.cast("string"), F.lit(" fetched pages (-15)")))
        .when(yield_delta(p, n) > 0, F.concat(F.lit("Site stored contacts on "), p.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" fetched pages (+10)")))
    )

    def moved(x: Column) -> Column:
        r, d = x["r"], x["d"]
        score = F.when(d != 0, F.greatest(F.lit(0), F.least(F.lit(100), r["score"] + d))).otherwise(r["score"])
        score = F.when(known, F.least(F.lit(100), score + 10)).otherwise(score)
        score = F.when(first, F.greatest(score, F.lit(90))).otherwise(score)
        more = F.array_compact(F.array(x["w"], F.when(known, "Source has human-reviewed contacts (+10)"), F.when(first, "Explicit starting source")))
        return F.when(r["score"] < 0, r).otherwise(F.struct(score.alias("score"), F.concat(r["reasons"], more).alias("reasons")))

    return bound({"r": ranked, "d": yield_delta(p, n), "w": note}, moved)


def query_adjustment(sites: Column, good: Column) -> Column:
    """Points of a search query by the share of its sites that were good: 40 x (rate - 1/2), rounded half to even, from two sites on."""
    return F.when(sites >= 2, F.bround(F.lit(40.0) * (posterior_rate(good, sites) - 0.5)).cast("int")).otherwise(0)


def family_adjustment(good: Column, rejected: Column, empty: Column) -> Column:
    """Points of a site family by its outcomes: -60 after a rejection without success, +15 after a success, -20 after nothing was found."""
    return F.when(good > 0, 15).when(rejected > 0, -60).when(empty > 0, -20).otherwise(0)
