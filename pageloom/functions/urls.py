"""URL functions as Column expressions: an address is taken apart by one regular expression and bound once per row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "\u0001"
# An absolute web address (scheme, host, port, path, query), tracking and trap parameters, paths and files without content.
PARTS = "(?is)^\\s*(https?)://(\\[[0-9a-f:.]+\\]|[^/?#@\\s:\\[\\]]+)(?::(\\d*))?((?:/[^?#]*?)?)(?:\\?([^#]*?))?(?:#.*?)?\\s*$"
TRACKING = ("gclid", "fbclid", "msclkid", "mc_cid", "mc_eid")
TRAPS = ("sort", "order", "filter", "session", "sessionid", "sid", "calendar", "replytocom")
SKIP_PATH = "(?i)/(?:login|logout|signin|signout|search|cart|checkout|calendar|wp-admin)(?:/|$)"
ASSETS = "(?i)\\.(?:pdf|jpe?g|png|gif|svg|webp|zip|exe|mp[34]|css|js|ico|woff2?|docx?|xlsx?)$"
LOCAL_HOST = "(?:^localhost|\\.localhost|\\.local|\\.internal)$"
PRIVATE_IP = "^(?:0|10|127|169\\.254|192\\.168|192\\.0\\.[02]|198\\.1[89]|198\\.51\\.100|203\\.0\\.113|172\\.(?:1[6-9]|2\\d|3[01])|100\\.(?:6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])|22[4-9]|23\\d|24\\d|25[0-5])\\."
IPV4 = "^\\d{1,3}(?:\\.\\d{1,3}){3}$"
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "or", "ne")
# IPv6 networks with public addresses, and those among them that aren't.
PUBLIC_IP6 = "^[23][0-9a-f]{3}:"
PRIVATE_IP6 = "^(?:2001:(?:0?db8:|[01]?[0-9a-f]{1,2}:|0[01][0-9a-f]{2}:|:)|2002:|3fff:0?[0-9a-f]{1,3}:)"
# Hosts that hold no person pages, and hosts and paths that are page chrome with the reason, in the order they are tried.
SOCIAL_HOSTS = ("facebook.com", "linkedin.com", "x.com", "twitter.com", "instagram.com", "tiktok.com", "youtube.com", "reddit.com", "bsky.app")
DOCUMENT_HOSTS = ("docs.google.com", "drive.google.com", "dropbox.com", "box.com", "docsend.com", "slideshare.net", "scribd.com", "notion.site", "notion.so")
SCHEDULING_HOSTS = ("calendly.com", "cal.com", "acuityscheduling.com", "calendar.google.com", "meetings.hubspot.com")
NOISE_HOSTS = (
    ("social profile or share link", (*SOCIAL_HOSTS, "pinterest.com", "threads.net")),
    ("document or file share", DOCUMENT_HOSTS),
    ("scheduling page", SCHEDULING_HOSTS),
    ("link shortener", ("goo.gl", "bit.ly", "t.co", "tinyurl.com", "ow.ly", "buff.ly", "lnkd.in", "rebrand.ly", "cutt.ly")),
    ("app store listing", ("apps.apple.com", "itunes.apple.com", "play.google.com", "chromewebstore.google.com")),
    ("review or event platform", ("trustpilot.com", "g2.com", "capterra.com", "luma.com", "eventbrite.com", "meetup.com")),
    ("policy page", ("policies.google.com",)),
)
NOISE_SUBDOMAINS = (
    ("login or app screen", ("auth", "login", "accounts", "sso", "signin", "dash", "dashboard", "app")),
    ("documentation or help site", ("docs", "help", "support", "developers")),
    ("CDN or asset host", ("cdn", "static", "assets")),
)
NOISE_PATHS = (
    ("share button", "(?i)/(?:sharer(?:\\.php)?|share|sharearticle|intent/(?:tweet|post))(?:/|$)"),
    ("signup or application form", "(?i)/(?:signup|sign-up|register|registration|apply|application)(?:/|$)"),
    ("legal page", "(?i)/(?:privacy(?:-policy)?|terms(?:-of-service|-of-use)?|legal|cookies?(?:-policy)?)(?:/|$)"),
    ("feed, sitemap or CDN helper", "(?i)(?:\\.(?:rss|atom)$|/(?:feed|rss|sitemap|cdn-cgi)(?:/|\\.xml|$))"),
    ("help or sponsorship page", "(?i)/(?:help|faq|sponsor|sponsors|sponsorship|pass-picker|tickets?)(?:/|$)"),
)


def bound(columns: dict[str, Column], body) -> Column:
    """Value of a function of named columns, each of them computed once per row."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))), body), 0)


def parts(url: Column) -> Column:
    """Struct of scheme, host, path and query of an address, NULL for NULL and for what is no valid web address.

    Valid: http or https, no credentials, the scheme's own port or none, no control characters or backslashes. The host
    is in lower case, without trailing dots, international names in their ASCII form, IPv6 addresses in brackets.
    """

    def checked(x: Column) -> Column:
        p = x["p"]
        scheme, port = F.lower(F.get(p, 0)), F.get(p, 2)
        raw = F.regexp_replace(F.lower(F.get(p, 1)), "\\.+$", "")
        host = F.when(raw.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), raw)), "\\.+$", "")).otherwise(raw)
        ok = (F.size(p) == 5) & ~x["u"].rlike("[\\x00-\\x1f\\\\]") & ((port == "") | (F.ltrim(port, F.lit("0")) == F.when(scheme == "https", "443").otherwise("80")))
        got = F.struct(scheme.alias("scheme"), host.alias("host"), F.get(p, 3).alias("path"), F.get(p, 4).alias("query"))
        return F.when(ok & (host != ""), got)

    return bound({"u": url, "p": F.split(F.regexp_replace(url, PARTS, f"$1{CUT}$2{CUT}$3{CUT}$4{CUT}$5"), CUT)}, checked)


def with_parts(url: Column, body) -> Column:
    """A function of an address's parts, which are taken apart once; NULL for invalid addresses."""
    return bound({"a": parts(url)}, lambda x: F.when(x["a"].isNotNull(), body(x["a"])))


def host(url: Column) -> Column:
    """Host of a valid address, else NULL."""
    return parts(url)["host"]


def _canonical(a: Column) -> Column:
    return F.concat(a["scheme"], F.lit("://"), a["host"], F.when(a["path"] == "", "/").otherwise(a["path"]), F.when(a["query"] != "", F.concat(F.lit("?"), a["query"])).otherwise(""))


def _origin(a: Column) -> Column:
    return F.concat(a["scheme"], F.lit("://"), a["host"])


def canonical_url(url: Column) -> Column:
    """Scheme, host, path (at least /) and query, without fragment; NULL for NULL and invalid addresses."""
    return with_parts(url, _canonical)


def origin(url: Column) -> Column:
    """scheme://host of the canonical address; NULL if there is none."""
    return with_parts(url, _origin)


def safe_origin(url: Column) -> Column:
    """Origin or the empty text."""
    return F.coalesce(origin(url), F.lit(""))


def unescaped(text: Column, plus: bool = False) -> Column:
    """Percent-decoded text; a plus stays a plus unless asked, malformed escapes stay as they are."""
    marked = F.regexp_replace(text if plus else F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    held = text.contains("%") | text.contains("+") if plus else text.contains("%")
    return F.when(held, F.coalesce(F.try_url_decode(marked), text)).otherwise(text)


def escaped(text: Column) -> Column:
    """Form-encoded text: letters, digits and -._~ as they are, blanks as plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decoded_path(url: Column) -> Column:
    """Percent-decoded path of a valid address, else NULL."""
    return with_parts(url, lambda a: unescaped(a["path"]))


def clean_url(url: Column) -> Column:
    """Canonical address without tracking parameters, the others sorted and encoded anew; NULL for addresses that lead to
    no content: local and private hosts, traversal, tool paths, files, filters and sessions, more than 8 parameters, 1500 characters."""

    def pair(f: Column) -> Column:
        key = F.substring_index(f, "=", 1)
        value = F.when(f.contains("="), F.substring(f, F.length(key) + 2, F.length(f))).otherwise("")
        return F.struct(unescaped(key, True).alias("k"), unescaped(value, True).alias("v"))

    def cleaned(x: Column) -> Column:
        a, path, q = x["a"], x["p"], x["q"]
        h = F.regexp_replace(a["host"], "^\\[|\\]$", "")
        six = a["host"].startswith("[")
        local = h.rlike(LOCAL_HOST) | (~six & ~h.contains(".")) | (h.rlike(IPV4) & h.rlike(PRIVATE_IP)) | (six & (~h.rlike(PUBLIC_IP6) | h.rlike(PRIVATE_IP6)))
        useless = path.rlike("(?:^|/)\\.\\.(?:/|$)") | path.contains("\\") | path.rlike(SKIP_PATH) | path.rlike(ASSETS)
        endless = (F.size(q) > 8) | (F.size(F.split(a["query"], "&")) > 40) | F.exists(q, lambda f: F.lower(f["k"]).isin(*TRAPS))
        query = F.array_join(F.transform(F.array_sort(q), lambda f: F.concat(escaped(f["k"]), F.lit("="), escaped(f["v"]))), "&")
        out = F.concat(_origin(a), F.when(a["path"] == "", "/").otherwise(a["path"]), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        return F.when(~(local | useless | endless) & (F.length(out) <= 1500), out)

    def content(a: Column) -> Column:
        fields = F.transform(F.filter(F.split(a["query"], "&"), lambda f: f != ""), pair)
        kept = F.filter(fields, lambda f: ~F.lower(f["k"]).startswith("utm_") & ~F.lower(f["k"]).isin(*TRACKING))
        return bound({"a": a, "p": unescaped(a["path"]), "q": kept}, cleaned)

    return with_parts(url, content)


def same_start(a: Column, b: Column) -> Column:
    """Whether two addresses clean to the same one; unusable ones never do."""
    return F.coalesce(clean_url(a) == clean_url(b), F.lit(False))


def plain_path(value: Column) -> Column:
    """Whether a text is a plain path: it starts with a slash and holds no escape, query, fragment, backslash, empty or dot-dot
    segment, white space or control character."""
    return F.coalesce(value.startswith("/") & ~value.rlike("[%?#\\\\\\s\\p{C}]|//|(?:^|/)\\.\\.(?:/|$)"), F.lit(False))


def site_key(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), "^www\\.", "")


def site_family(url: Column) -> Column:
    """Approximate registrable domain: two labels, three below a two-letter country with a second level."""

    def family(a: Column) -> Column:
        labels = F.filter(F.split(a["host"], "\\."), lambda x: x != "")
        n = F.size(labels)
        three = (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL) & (n > 2)
        keep = F.when(three, 3).otherwise(2)
        return F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), F.greatest(keep, F.lit(1))), ".")

    return with_parts(url, family)


def duplicate_key(url: Column) -> Column:
    """Scheme, host without www., path without trailing slash and query, as one text."""
    return with_parts(url, lambda a: F.concat_ws("\x1f", a["scheme"], F.regexp_replace(a["host"], "^www\\.", ""), F.regexp_replace(a["path"], "/+$", ""), a["query"]))


def page_kind(url: Column) -> Column:
    """start, team, about, contact or other, from the path; other for invalid addresses."""
    return bound({"p": F.lower(F.regexp_replace(decoded_path(url), "[-_]", " "))}, lambda x: _kind(x["p"]))


def _kind(p: Column) -> Column:
    return (
        F.when(F.regexp_replace(p, "/+", "") == "", "start").when(p.rlike("(?:^|[^a-z])(?:team|staff|people|agents?|representatives?|advisors?|leadership)(?:[^a-z]|$)"), "team")
        .when(p.rlike("(?:^|[^a-z])(?:about|who we are|our company)(?:[^a-z]|$)"), "about").when(p.rlike("(?:^|[^a-z])contacts?(?:[^a-z]|$)"), "contact").otherwise("other")
    )


def _bare(a: Column) -> Column:
    return F.regexp_replace(a["host"], "^www\\.", "")


def _same_site(a: Column, b: Column) -> Column:
    schemes = (a["scheme"] == b["scheme"]) | ((a["scheme"] == "http") & (b["scheme"] == "https"))
    return schemes & (_bare(a) == _bare(b)) & _bare(a).contains(".")


def same_site(a: Column, b: Column) -> Column:
    """Same website: equal or http to https, equal host but for one www., and a dotted host."""
    return F.coalesce(bound({"a": parts(a), "b": parts(b)}, lambda x: _same_site(x["a"], x["b"])), F.lit(False))


def in_scope(source_url: Column, approval_kind: Column, allowed_paths: Column, allow_homepage: Column, url: Column) -> Column:
    """Whether an address lies on the source's site and below one of its path prefixes (on a segment boundary)."""

    def inside(x: Column) -> Column:
        s, u = x["s"], x["u"]
        here = (_origin(s) == _origin(u)) | ((approval_kind == "operator") & _same_site(s, u))
        path = F.when(u["path"] == "", "/").otherwise(unescaped(u["path"]))
        home = (path == "/") & (u["query"] == "") & allow_homepage
        below = F.exists(allowed_paths, lambda p: (F.trim(p) != "") & ((path == F.rtrim(p, F.lit("/"))) | F.startswith(path, F.concat(F.rtrim(p, F.lit("/")), F.lit("/")))))
        return here & ~path.rlike("(?:^|/)\\.\\.(?:/|$)") & ~path.contains("\\") & (home | below)

    return F.coalesce(bound({"s": parts(source_url), "u": parts(url)}, inside), F.lit(False))


def on_hosts(h: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is, or lies below, one of a few domains."""
    return reduce(or_, ((h == d) | F.endswith(h, F.lit("." + d)) for d in domains))


def noise_reason(url: Column) -> Column:
    """Why an address is page chrome; NULL if it isn't."""

    def reason(a: Column) -> Column:
        h, path = a["host"], unescaped(a["path"])
        out = F.when(h.rlike("https?$") | a["path"].rlike("https?:?//"), "malformed link (URL pasted into another URL)")
        for why, domains in NOISE_HOSTS:
            out = out.when(on_hosts(h, domains), why)
        for why, names in NOISE_SUBDOMAINS:
            out = out.when(h.rlike("^[^.]*\\.[^.]*\\.") & h.rlike("^(?:(?:" + "|".join(names) + ")\\d*|[^.]*-cdn)\\."), why)
        for why, pattern in NOISE_PATHS:
            out = out.when(path.rlike(pattern), why)
        return out

    return with_parts(url, reason)


def denied(url: Column, domains: Column) -> Column:
    """Whether the host is, or lies below, one of an array of domains."""
    return F.coalesce(bound({"h": host(url)}, lambda x: F.exists(domains, lambda d: (x["h"] == d) | F.endswith(x["h"], F.concat(F.lit("."), d)))), F.lit(False))


def metadata_url(raw: Column) -> Column:
    """Cleaned form of an address given as metadata: it must be written without blanks around and control characters, with a
    lower-case scheme and at most 1500 characters; NULL otherwise."""
    ok = ~raw.rlike("^[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]$") & (F.length(raw) <= 1500) & ~unescaped(raw).rlike("\\p{C}") & raw.rlike("^https?://")
    return F.when(ok, clean_url(raw))


def redirect_class(authorized: Column, target: Column, allowed_paths: Column, allow_homepage: Column) -> Column:
    """Class of a redirect from an authorized address: unparsed (no target), invalid, same_origin, downgrade, canonical (same site,
    path in scope), canonical_path_out_of_scope, other_subdomain or cross_domain."""

    def kind(x: Column) -> Column:
        a, b = x["a"], x["b"]
        path = F.when(b["path"] == "", "/").otherwise(unescaped(b["path"]))
        below = F.exists(allowed_paths, lambda p: (F.trim(p) != "") & ((path == F.rtrim(p, F.lit("/"))) | F.startswith(path, F.concat(F.rtrim(p, F.lit("/")), F.lit("/")))))
        inside = ~path.rlike("(?:^|/)\\.\\.(?:/|$)") & ~path.contains("\\") & (((path == "/") & (b["query"] == "") & allow_homepage) | below)
        return (
            F.when(a.isNull() | b.isNull(), "invalid").when(_origin(a) == _origin(b), "same_origin").when((_bare(a) == _bare(b)) & (a["scheme"] == "https") & (b["scheme"] == "http"), "downgrade")
            .when(_same_site(a, b), F.when(inside, "canonical").otherwise("canonical_path_out_of_scope"))
            .when(F.endswith(_bare(b), F.concat(F.lit("."), _bare(a))) | F.endswith(_bare(a), F.concat(F.lit("."), _bare(b))), "other_subdomain").otherwise("cross_domain")
        )

    return F.when(F.coalesce(target, F.lit("")) == "", "unparsed").otherwise(bound({"a": parts(authorized), "b": parts(target)}, kind))
