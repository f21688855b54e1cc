"""What is made of a page's cards, as column expressions and windows: inference of visible contacts, validation against the
evidence, the site's shared contact, one row per person.

Input are the rows of :func:`pageloom.functions.html.raw_cards` and :func:`~pageloom.functions.html.page_lines`; a page
has at most 500 cards, so its windows are small whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions import text as T
from pageloom.functions.html import DEFAULT_RECIPE, LINK_SELECTORS, page_lines, raw_cards
from pageloom.functions.urls import site_key

KINDS = ("email", "phone")
PATTERNS = {"email": T.EMAIL, "phone": T.PHONE}
# What no person is called, and the longest evidence, name, title, company, address and number.
NO_PERSON = ("contact us", "sales team", "our team", "learn more")
MOST_EVIDENCE, MOST_TEXT, MOST_NAME, MOST_EMAIL, MOST_PHONE = 12_000, 200, 100, 254, 80


def contact_key(kind: str, value: Column) -> Column:
    """What makes two spellings one contact: the address in lower case, the digits of a number."""
    return F.lower(value) if kind == "email" else T.digits(value)


def contacts_in(kind: str, text: Column) -> Column:
    """All addresses or numbers in a text as they are written, in their order."""
    return F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), F.lit(1))


def local_part(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1))


def with_visible_contacts(cards: DataFrame, lines: DataFrame, page_id: str, recipe: dict[str, str] | None = None) -> DataFrame:
    """Cards whose missing contact is filled from their text, with ``provenance`` (map of kind to selector or visible).

    A contact is inferred only where the recipe keeps the default link selector, the card lies outside page chrome, names
    one person and shows exactly one contact of the kind, which must not be in the page's chrome, no generic mailbox and
    in no other card: what several cards show is a shared line and is taken away from all that only show it.
    """
    full = {**DEFAULT_RECIPE, **(recipe or {})}
    d = cards.join(lines.select(page_id, F.col("chrome").alias("__chrome")), page_id, "left")
    open_ = F.col("evidence").isNotNull() & ~F.col("boxed") & (F.col("names") == 1)
    for kind in KINDS:
        there = T.usable_contact(kind, F.col(kind))
        d = d.withColumn(f"__from_{kind}", F.when(F.col(kind) != "", "selector"))
        if full[kind].strip() not in LINK_SELECTORS[kind]:
            continue
        keys = lambda text, kind=kind: F.array_distinct(F.transform(contacts_in(kind, text), lambda v: contact_key(kind, v)))
        one = F.get(contacts_in(kind, F.col("visible")), 0)
        ok = open_ & ~there & (F.size(keys(F.col("visible"))) == 1) & ~F.coalesce(F.array_contains(keys(F.col("__chrome")), contact_key(kind, one)), F.lit(False))
        if kind == "email":
            ok &= ~local_part(one).isin(*T.GENERIC_LOCALS)
        d = d.withColumn(f"__ok_{kind}", F.coalesce(ok, F.lit(False)))
        d = d.withColumns({f"__from_{kind}": F.when(F.col(f"__ok_{kind}"), "visible").otherwise(F.col(f"__from_{kind}")), kind: F.when(F.col(f"__ok_{kind}"), one).otherwise(F.col(kind))})
    for kind in KINDS:
        key = F.when(T.usable_contact(kind, F.col(kind)), contact_key(kind, F.col(kind)))
        d = d.withColumn("__k", key).withColumn("__n", F.when(F.col("__k").isNotNull(), F.count("__k").over(Window.partitionBy(page_id, "__k"))))
        repeated = (F.col(f"__from_{kind}") == "visible") & (F.col("__n") > 1)
        gone = F.coalesce(repeated, F.lit(False))
        d = d.withColumns({kind: F.when(gone, "").otherwise(F.col(kind)), f"__from_{kind}": F.when(gone, None).otherwise(F.col(f"__from_{kind}"))})
    given = F.array_compact(F.array(*(F.when(F.col(f"__from_{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"__from_{k}").alias("v"))) for k in KINDS)))
    return d.withColumn("provenance", F.map_from_entries(given)).select(*cards.columns, "provenance")


def within(part: Column, text: Column) -> Column:
    """Whether a text holds another, whatever the case."""
    return F.contains(F.lower(text), F.lower(part))


def validated(df: DataFrame, employer: str, require_sales: str, real: str) -> DataFrame:
    """Add ``reason`` (why a record is refused, NULL if it is accepted) and the accepted values of its fields.

    df: name, title, company, email, phone, evidence and the three named columns; NULL counts as empty. A person has
    two words and stands in the evidence; so do the contact, which must be whole and no template's, and the title and the
    company, or they are emptied (the company becomes the employer). require_sales asks for a sales role.
    """
    clean = {c: F.substring(T.normalize(F.coalesce(F.col(c), F.lit(""))), 1, n) for c, n in (("name", MOST_TEXT), ("title", MOST_TEXT), ("company", MOST_TEXT), ("email", MOST_EMAIL), ("phone", MOST_PHONE))}
    d = df.withColumns({"evidence": T.normalize(F.coalesce(F.col("evidence"), F.lit(""))), **clean})
    name, proof = F.col("name"), F.col("evidence")
    d = d.withColumn("__selected", (F.col("email") != "") | (F.col("phone") != ""))
    mails = F.transform(contacts_in("email", proof), F.lower)
    whole_mail = T.usable_contact("email", F.col("email")) & F.array_contains(mails, F.lower("email"))
    alone = F.concat(F.lit("(?i)(?<!\\d)\\Q"), F.replace(F.col("phone"), F.lit("\\E"), F.lit("")), F.lit("\\E(?!\\d)"))
    whole_phone = T.usable_contact("phone", F.col("phone")) & F.rlike(proof, alone)
    d = d.withColumns({"email": F.when((F.col("email") != "") & whole_mail, F.col("email")).otherwise(""), "phone": F.when((F.col("phone") != "") & whole_phone, F.col("phone")).otherwise("")})
    fake = {k: (F.col(k) != "") & ((T.placeholder_email if k == "email" else T.placeholder_phone)(F.col(k), F.col(real)) != "") for k in KINDS}
    d = d.withColumn("__fake", fake["email"] | fake["phone"]).withColumns({k: F.when(fake[k], "").otherwise(F.col(k)) for k in KINDS})
    d = d.withColumn("title", F.when(within(F.col("title"), proof), F.col("title")).otherwise(""))
    role = F.when(F.col("title") != "", F.col("title")).otherwise(proof)
    reason = (
        F.when(F.length(proof) > MOST_EVIDENCE, "evidence_too_long")
        .when(~name.contains(" ") | (F.length(name) < 4) | (F.length(name) > MOST_NAME) | name.contains("@"), "invalid_name")
        .when(~within(name, proof) | F.lower(name).isin(*NO_PERSON), "name_without_evidence")
        .when(T.placeholder_name(name) | F.lower(proof).contains("lorem ipsum"), "placeholder_name")
        .when((F.col("email") == "") & (F.col("phone") == ""), F.when(F.col("__fake"), "placeholder_contact").when(F.col("__selected"), "contact_without_evidence").otherwise("missing_contact"))
        .when(F.coalesce(F.col(require_sales), F.lit(False)) & ~role.rlike(T.SALES_ROLE), "non_sales_role")
    )
    company = F.when((F.col("company") != "") & within(F.col("company"), proof), F.col("company")).otherwise(F.coalesce(F.col(employer), F.lit("")))
    return d.withColumns({
        "reason": reason, "company": company, "email": F.lower("email"), "person_tags": T.tags(proof),
        "contact_scope": F.when((F.col("email") != "") & local_part(F.col("email")).isin(*T.GENERIC_LOCALS), "shared").otherwise("unknown"),
    }).drop("__selected", "__fake")


def shared_contacts(lines: DataFrame, page_id: str, source_url: str, real: str) -> DataFrame:
    """page_id, kind, value, place of the contact that a page's site gives for all: a generic mailbox of its own domain
    anywhere on the page, else an address of its own domain in the chrome, else a number in the chrome; others' addresses
    and template values never count. Pages without one give no row."""
    bare = site_key(F.col(source_url))
    own = lambda v: F.regexp_replace(F.lower(F.substring_index(v, "@", -1)), "\\.+$", "").isin(bare, F.concat(F.lit("www."), bare))
    genuine = lambda k, v: (T.placeholder_email if k == "email" else T.placeholder_phone)(v, F.col(real)) == ""
    inbox = F.get(F.filter(contacts_in("email", F.col("whole")), lambda v: local_part(v).isin(*T.GENERIC_LOCALS) & own(v) & genuine("email", v)), 0)
    mail = F.get(F.filter(contacts_in("email", F.col("chrome")), lambda v: own(v) & genuine("email", v)), 0)
    dial = F.get(F.filter(contacts_in("phone", F.col("chrome")), lambda v: genuine("phone", v)), 0)
    pick = (
        F.when(inbox.isNotNull(), F.struct(F.lit("email").alias("kind"), F.lower(inbox).alias("value"), F.lit("company inbox on this page").alias("place")))
        .when(mail.isNotNull(), F.struct(F.lit("email").alias("kind"), F.lower(mail).alias("value"), F.lit("page header/footer").alias("place")))
        .when(dial.isNotNull(), F.struct(F.lit("phone").alias("kind"), T.normalize(dial).alias("value"), F.lit("page header/footer").alias("place")))
    )
    return lines.select(page_id, pick.alias("s")).where("s IS NOT NULL").select(page_id, "s.*")


def with_shared_contact(cards: DataFrame, shared: DataFrame, page_id: str) -> DataFrame:
    """Cards of named people with a sales title in their evidence and no contact of their own get their page's shared one,
    which is written into the evidence as what it is; ``lent`` tells which cards did."""
    d = cards.join(shared.select(page_id, F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.col("place").alias("__place")), page_id, "left")
    title = T.normalize(F.coalesce(F.col("title"), F.lit("")))
    lent = F.col("__kind").isNotNull() & (F.coalesce("email", F.lit("")) == "") & (F.coalesce("phone", F.lit("")) == "") & (title != "") & title.rlike(T.SALES_ROLE) & within(title, F.col("evidence"))
    d = d.withColumn("lent", F.coalesce(lent, F.lit(False)))
    note = F.concat(F.col("evidence"), F.lit(" [Shared company contact shown on this page ("), F.col("__place"), F.lit("), not this person's own: "), F.col("__value"), F.lit("]"))
    return d.withColumns({"evidence": F.when(F.col("lent"), note).otherwise(F.col("evidence")), **{k: F.when(F.col("lent") & (F.col("__kind") == k), F.col("__value")).otherwise(F.col(k)) for k in KINDS}}).select(*cards.columns, "lent")


def one_per_person(records: DataFrame, page_id: str, pos: str) -> DataFrame:
    """Accepted records of a page, one for each name, address and number (the last at the place of the first); a contact
    that several of them have is shared."""
    key = [F.lower("name"), F.col("email"), F.col("phone")]
    w = Window.partitionBy(page_id, *key)
    d = records.withColumn("__last", F.max(pos).over(w)).withColumn("__first", F.min(pos).over(w)).where(F.col(pos) == F.col("__last"))
    d = d.withColumn(pos, F.col("__first")).drop("__last", "__first")
    for kind in KINDS:
        n = F.count(F.lit(1)).over(Window.partitionBy(page_id, kind))
        d = d.withColumn(f"__{kind}", (F.col(kind) != "") & (n > 1))
    return d.withColumn("contact_scope", F.when(F.col("__email") | F.col("__phone"), "shared").otherwise(F.col("contact_scope"))).drop("__email", "__phone")


def extracted(pages: DataFrame, page_id: str, html: str, source_url: str, employer: str, require_sales: str, recipe: dict[str, str] | None = None, share: bool = True) -> DataFrame:
    """Records of every page: page_id, pos, the fields, contact_scope, person_tags, provenance, name_cards, reason.

    Refused cards stay with their reason (``one_per_person`` runs over the accepted ones only).
    """
    site = pages.select(page_id, source_url, employer, require_sales)
    lines = page_lines(pages, page_id, html).join(site, page_id).withColumn("__real", T.real_host(F.regexp_extract(F.col(source_url), "^https?://([^/?#:]+)", 1)))
    cards = with_visible_contacts(raw_cards(pages, page_id, html, recipe), lines, page_id, recipe)
    if share:
        cards = with_shared_contact(cards, shared_contacts(lines, page_id, source_url, "__real"), page_id)
    cards = cards.join(lines.select(page_id, employer, require_sales, "__real"), page_id)
    got = validated(cards, employer, require_sales, "__real").withColumn("reason", F.when(F.col("evidence").isNull(), "missing_evidence_container").otherwise(F.col("reason")))
    if share:
        got = got.withColumns({"contact_scope": F.when(F.col("lent"), "shared").otherwise(F.col("contact_scope")), "provenance": F.when(F.col("lent"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.col("provenance"))})
    return got.drop(employer, require_sales, "__real", "visible", "names", "boxed", "lent")
