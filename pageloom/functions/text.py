"""Text functions as Column expressions: phrases, tags, contacts, placeholders, identities."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service tags, role words, address and number patterns.
TAGS = (
    ("merchant_services", "(?i)merchant (?:services|accounts?)|payment processing|credit card processing|card payments"),
    ("pos", "(?i)point[ -]of[ -]sale|\\bPOS\\b"),
    ("payroll", "(?i)\\bpayroll\\b|human resources|\\bHR services\\b"),
    ("funding", "(?i)business (?:funding|loans?|financing)|merchant cash advance|working capital"),
    ("telecom", "(?i)\\btelecom|\\bVoIP\\b|business (?:phone|internet)"),
    ("it_services", "(?i)managed (?:IT|services)|\\bMSP\\b|IT services|cybersecurity"),
    ("insurance", "(?i)business insurance|commercial insurance|insurance broker"),
)
SALES_ROLE = (
    "(?i)\\bsales\\b|account (?:executive|manager)|business development|(?:payment|merchant|POS|payroll|funding|telecom|insurance)"
    ".{0,25}(?:consultant|agent|advisor|broker|specialist)|independent (?:agent|rep)|\\breseller\\b|\\bISO\\b"
)
EMAIL = "(?i)[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9.-]+\\.[A-Z]{2,}"
NUMBER = "(?:\\+\\d[\\d ().-]{6,20}\\d|\\(?\\d{3}\\)?[ .-]\\d{3}[ .-]\\d{4})"
#: A number between characters that are no letters or digits.
PHONE = f"(?<![\\p{{L}}\\p{{N}}_]){NUMBER}(?![\\p{{L}}\\p{{N}}_])"
SEQUENTIAL = ("1234567890", "0123456789", "9876543210", "1234567", "12345678", "123456789")
GENERIC_LOCALS = ("info", "sales", "contact", "hello", "support", "office", "admin", "team", "enquiries", "inquiries")
# Reserved hosts, mail domains and mailboxes of templates, file endings, names of templates.
RESERVED_HOSTS = ("example.com", "example.org", "example.net")
RESERVED_SUFFIXES = (".example", ".test", ".invalid", ".localhost", ".local")
PLACEHOLDER_DOMAINS = (
    "domain.com", "yourdomain.com", "yoursite.com", "yourcompany.com", "yourwebsite.com", "mydomain.com", "mysite.com", "company.com", "website.com",
    "sample.com", "email.com", "test.com", "wixpress.com", "sentry.io", "sentry-cdn.com",
)
PLACEHOLDER_LOCALS = (
    "yourname", "your.name", "your_name", "name", "email", "youremail", "your.email", "user", "username", "john.doe", "johndoe", "jane.doe", "janedoe",
    "firstname.lastname", "first.last", "firstlast", "someone", "example", "test", "noreply", "no-reply", "donotreply", "do-not-reply",
)
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "bmp", "ico", "tif", "tiff", "css", "js", "pdf")
PLACEHOLDER_NAME = (
    "(?i)^(?:john|jane)\\s+doe$|^(?:your|full|first|last|member|staff|employee|agent|person|sample|team|contact|user|person's)\\s+(?:name|member)$"
    "|^first\\s*name\\s+last\\s*name$|^name\\s+(?:surname|lastname|last name)$|^lorem\\s+ipsum|^(?:test|demo)\\s+(?:user|person|name)$|^first\\s+last$"
)


def normalize(text: Column) -> Column:
    """Every run of white space (also no-break) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+", " "))


def phrase(text: Column, term: str) -> Column:
    """Whether a term occurs as words: hyphens and underscores are blanks, case and a plural s don't matter."""
    t = term.lower().replace("-", " ").replace("_", " ")
    plural = "s?" if len(t) > 2 and not t.endswith("s") else ""
    plain = F.translate(F.lower(text), "-_", "  ")
    return plain.rlike("(?:^|[^\\p{L}\\p{N}])" + re.sub(r"([^\w\s])", r"\\\1", t) + plural + "(?:[^\\p{L}\\p{N}]|$)")


def any_phrase(text: Column, terms: Column) -> Column:
    """Array of the terms (an array column) that occur in the text as words, in their order."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    word = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}]+", " "))
    hit = lambda t: (word(t) != "") & (F.contains(plain, F.concat(F.lit(" "), word(t), F.lit(" "))) | ((F.length(t) > 2) & ~F.endswith(t, F.lit("s")) & F.contains(plain, F.concat(F.lit(" "), word(t), F.lit("s ")))))
    return F.filter(terms, hit)


def lines(text: Column) -> Column:
    """Distinct lower-case lines in their order, without blank ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(F.lower(x))), lambda x: x != ""))


def tags(text: Column) -> Column:
    """Service tags of a text, in their fixed order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(t)) for t, p in TAGS)))


def emails(text: Column) -> Column:
    """All addresses of a text, lower case, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(" + EMAIL + ")"), F.lit(1)), F.lower)))


def phones(text: Column) -> Column:
    """Digits of all phone numbers of a text, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(" + PHONE + ")"), F.lit(1)), digits)))


def digits(value: Column) -> Column:
    """Digits of a value; empty for NULL."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")


def usable_contact(kind: str, value: Column) -> Column:
    """A whole address, or a number of 7 to 15 digits."""
    if kind == "email":
        return F.coalesce(value.rlike("(?i)^" + EMAIL[4:] + "$"), F.lit(False))
    return F.length(digits(value)).between(7, 15)


def reserved_host(host: Column) -> Column:
    """Whether a host is reserved for examples and tests, or lies below one that is; NULL and empty hosts are not."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), "\\.+$", "")
    below = reduce(or_, (F.endswith(h, F.lit(s)) for s in (*("." + x for x in RESERVED_HOSTS), *RESERVED_SUFFIXES)))
    return h.isin(*RESERVED_HOSTS) | below


def real_host(host: Column) -> Column:
    """Whether a host is there and not reserved."""
    return (F.coalesce(host, F.lit("")) != "") & ~reserved_host(host)


def placeholder_email(value: Column, real: Column | None = None) -> Column:
    """Why an address is a template value, or the empty text; reserved domains only count on a real site."""
    v = F.lower(F.coalesce(value, F.lit("")))
    local = F.when(v.contains("@"), F.regexp_replace(v, "@[^@]*$", "")).otherwise("")
    domain = F.substring_index(v, "@", -1)
    of = reduce(or_, ((domain == d) | F.endswith(domain, F.lit("." + d)) for d in PLACEHOLDER_DOMAINS))
    out = F.when(F.substring_index(domain, ".", -1).isin(*FILE_ENDINGS), "file name, not an email").when(of, "placeholder or framework domain").when(local.isin(*PLACEHOLDER_LOCALS), "placeholder mailbox name")
    return (out if real is None else out.when(reserved_host(domain) & real, "reserved example domain")).otherwise("")


def placeholder_phone(value: Column, real: Column | None = None) -> Column:
    """Why a number is a template value, or the empty text; numbers reserved for fiction only count on a real site."""
    d = digits(value)
    n = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    out = F.when(F.size(F.array_distinct(F.split(n, ""))) <= 1, "repeated digits").when(n.isin(*SEQUENTIAL), "sequential digits")
    return (out if real is None else out.when(n.rlike("^\\d{3}555(?:01\\d\\d|5555)$") & real, "reserved fictional number")).otherwise("")


def placeholder_name(value: Column) -> Column:
    """Whether a name is that of a template."""
    return F.coalesce(value.rlike(PLACEHOLDER_NAME), F.lit(False))


def safe_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.ltrim(value).rlike("^[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def has_controls(value: Column) -> Column:
    """Whether a text holds control or unassigned characters."""
    return F.coalesce(value.rlike("\\p{C}"), F.lit(False))


def identity(*values: Column) -> Column:
    """SHA-256 over the lower-case values joined by the unit separator; NULL counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.lower(F.coalesce(v, F.lit(""))) for v in values)), 256)


def token_estimate(text: Column) -> Column:
    """Upper estimate of the tokens of a request from its bytes."""
    return (F.ceil(F.octet_length(text) * 1.25) + 512).cast("long")


def passage(text: Column, name: Column, most: int, early: int, before: int) -> Column:
    """At most so many characters of a text: its beginning, or, where a name is first mentioned after ``early`` characters, from
    ``before`` characters ahead of the mention."""
    at = F.position(F.lower(name), F.lower(text))
    return F.when(at <= early, F.substring(text, 1, most)).otherwise(F.substring(text, at - before, F.lit(most)))
