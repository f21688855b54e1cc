"""Core functions and operators against direct statements of their rules, with nulls, empties, ties and repeats."""

import random
from datetime import datetime
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from pageloom.functions import dom
from pageloom.functions import extraction as X
from pageloom.functions import html as H
from pageloom.functions import numbers as N
from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.operators import admission, merge, windows
from pageloom.operators import aggregates as A
from pageloom.operators import joins as J
from pageloom.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("url, want", [
    ("HTTPS://Www.Acme.Example.:443/a?b=1#c", "https://www.acme.example/a?b=1"), ("http://acme.example", "http://acme.example/"), (None, None), ("", None),
    ("http://u:p@acme.example/", None), ("http://acme.example:8080/", None), ("mailto:x@acme.example", None), ("http://acme.example/a\\b", None), ("https://acme.example:80/", None), ("http://bücher.example/ä", "http://xn--bcher-kva.example/ä"),
    ("http://[2001:4860::8888]:80/x?", "http://[2001:4860::8888]/x"), (" http://acme.example/a b ", "http://acme.example/a b"), ("http://acme.example:x/", None), ("http://acme.example/a\nb", None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [
    ("http://acme.example/a?utm_source=x&b=2&a=1", "http://acme.example/a?a=1&b=2"), ("http://acme.example/login/", None), ("http://10.0.0.1/a", None), ("http://8.8.8.8/a", "http://8.8.8.8/a"),
    ("http://localhost/a", None), ("http://acme/a", None), ("http://acme.example/a.pdf", None), ("http://acme.example/a?sort=x", None), ("http://acme.example/%2e%2e/a", None), (None, None),
    ("http://acme.example/%7ea?q=%7e*+b%20c&e", "http://acme.example/%7ea?e=&q=~%2A+b+c"), ("http://acme.example/?%55tm_x=1&Sid=2", None), ("http://[::1]/", None), ("http://[2001:4860::8888]/", "http://[2001:4860::8888]/"), ("http://acme.example/?a=%zz", "http://acme.example/?a=%25zz"),
])
def test_clean_url(spark, url, want):
    assert one(spark, U.clean_url(F.col("u")), u=url) == want


def test_families_scope_and_noise(spark):
    assert one(spark, U.site_family(F.col("u")), u="http://a.b.acme.co.uk/") == "acme.co.uk"
    assert one(spark, U.site_family(F.col("u")), u="http://blog.acme.example/") == "acme.example"
    scope = lambda s, u, k="operator": one(spark, U.in_scope(F.col("s"), F.col("k"), F.array(F.lit("/team/")), F.lit(True), F.col("u")), s=s, u=u, k=k)
    assert scope("http://acme.example/", "https://www.acme.example/team/a")
    assert not scope("http://acme.example/", "https://www.acme.example/team/a", "policy")
    assert scope("http://acme.example/", "http://acme.example/") and not scope("http://acme.example/", "http://acme.example/teams")
    assert not scope("http://acme.example/", "http://acme.example/team/../x")
    assert one(spark, U.noise_reason(F.col("u")), u="https://www.facebook.com/x") == "social profile or share link"
    assert one(spark, U.noise_reason(F.col("u")), u="https://login.acme.example/") == "login or app screen"
    assert one(spark, U.noise_reason(F.col("u")), u="https://acme.example/privacy-policy/") == "legal page"
    assert one(spark, U.noise_reason(F.col("u")), u="https://acme.example/team") is None


def test_text_functions(spark):
    assert one(spark, T.normalize(F.col("t")), t=" a   b\n") == "a b"
    assert one(spark, T.phrase(F.col("t"), "sales-rep"), t="our Sales Reps") and not one(spark, T.phrase(F.col("t"), "rep"), t="report")
    assert one(spark, T.tags(F.col("t")), t="Payroll and POS") == ["pos", "payroll"]
    assert one(spark, T.emails(F.col("t")), t="A@b.example, a@B.example") == ["a@b.example"]
    assert one(spark, T.placeholder_phone(F.col("t")), t="+1 000 000 0000") == "repeated digits"
    assert one(spark, T.safe_cell(F.col("t")), t=" =1") == "' =1" and one(spark, T.safe_cell(F.col("t")), t=None) is None
    assert one(spark, T.lines(F.col("t")), t="B\na\n\nb ") == ["b", "a"]


def test_numbers(spark):
    want = {(2, 0): 0, (3, 0): -15, (1, 1): 0, (10, 2): 0, (3, 2): 10}
    for (fetched, productive), delta in want.items():
        assert one(spark, N.yield_delta(F.col("p"), F.col("f")), p=productive, f=fetched) == delta
    assert one(spark, N.posterior_rate(F.col("p"), F.col("f")), p=0, f=0) == 0.5
    assert [one(spark, N.percent_cap(F.col("n"), F.col("s")), n=25, s=s) for s in (1, 20, 0)] == [1, 5, 0]
    assert one(spark, N.retry_delay(F.col("n")), n=3) == 120


def test_interleave_matches_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(1, rng.randrange(2), f"o{rng.randrange(5)}", rng.randrange(4), pos) for pos in range(60)]
    got = windows.interleaved(spark.createDataFrame(rows, "s long, tier int, o string, pr int, pos int"), ["s"], "tier", "o", "pr", "pos").orderBy("place").collect()
    want = []
    for tier in (0, 1):
        queues = {}
        for r in sorted((r for r in rows if r[1] == tier), key=lambda r: (-r[3], r[4])):
            queues.setdefault(r[2], []).append(r)
        order = sorted(queues, key=lambda o: (-queues[o][0][3], queues[o][0][4], o))
        while any(queues.values()):
            want += [queues[o].pop(0)[4] for o in order if queues[o]]
    assert [r.pos for r in got] == want


def test_exact_admission_matches_the_fold(spark):
    rng = random.Random(6)
    rows = [(s, n, f"g{rng.randrange(6)}", rng.random() < .5, 8, 3) for s in range(7) for n in range(30)]
    df = spark.createDataFrame(rows, "s long, n int, g string, e boolean, slots int, cap int")
    got = {(r.s, r.n) for r in admission.admit_exact(df, "s", ["n"], "g", "e", "slots", "cap").collect()}
    want = set()
    for s in range(7):
        taken, seen = 0, set()
        for r in (r for r in rows if r[0] == s):
            if taken < 8 and (not r[3] or (len(seen) < 3 and r[2] not in seen)):
                taken += 1
                want.add((s, r[1]))
                if r[3]:
                    seen.add(r[2])
    assert got == want
    sep = admission.admit_separable(df, ["s"], [F.asc("n")], None, F.col("slots"))
    assert sep.count() == 7 * 8


def test_ranking_quality(spark):
    df = spark.createDataFrame([(1, 3, True), (1, 2, False), (1, 1, True), (2, 2, False), (2, 1, None)], "k long, s int, ok boolean")
    got = {r.k: r.average_precision for r in windows.average_precision(df, ["k"], [F.desc("s")], F.col("ok")).collect()}
    assert got[1] == pytest.approx((1 + 2 / 3) / 2) and got[2] == 0


def test_merges(spark):
    t = datetime(2025, 1, 1)
    old = spark.createDataFrame([(1, "a", "x", t, t), (2, "b", "y", t, t)], "k long, title string, co string, first_seen timestamp, last_seen timestamp")
    new = spark.createDataFrame([(1, "", "z", datetime(2025, 2, 1)), (3, None, "w", t)], "k long, title string, co string, at timestamp")
    got = {r.k: (r.title, r.co, r.first_seen, r.last_seen) for r in merge.upsert(old, new, ["k"], ["title", "co"], "at").collect()}
    assert got == {1: ("a", "z", t, datetime(2025, 2, 1)), 2: ("b", "y", t, t), 3: (None, "w", t, t)}
    rows = spark.createDataFrame([(1, "u"), (2, "u"), (3, None), (4, "v")], "pos long, url string")
    got = {r.pos: r.outcome for r in merge.import_outcomes(rows, spark.createDataFrame([("v",), (None,)], "u string"), F.col("url"), "pos", "u").collect()}
    assert got == {1: "would_create", 2: "duplicate_in_file", 3: "invalid", 4: "existing"}


def test_joins_keep_null_keys_apart(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id long, k long")
    b = spark.createDataFrame([(1,), (None,)], "k long")
    assert {r.id for r in J.having(a, b, ["k"]).collect()} == {1}
    assert {r.id for r in J.lacking(a, b, ["k"]).collect()} == {2, 3}
    assert J.best_per_key(spark.createDataFrame([], "k long, o long"), ["k"], [F.col("o")], ["o"]).count() == 0
    rules = spark.createDataFrame([(1, 5), (1, 3)], "k long, rule long")
    assert J.first_match(a, "id", rules, ["k"], F.lit(True), ["rule"], ["rule"]).collect()[0].asDict() == {"id": 1, "rule": 3}


def test_aggregates(spark):
    jobs = spark.createDataFrame([("o", "u", True), ("o", "u", None), ("o", "v", False), (None, "w", True)], "o string, u string, p boolean")
    r = A.yields(jobs, "o", "u", F.col("p")).first()
    assert (r.fetched, r.productive, r.delta) == (2, 1, 0)
    assert {(x.dimension, x.value): x.n for x in A.histograms(jobs, ["o", "p"]).collect()}[("o", None)] == 1
    r = A.overlap(jobs.select("u"), spark.createDataFrame([("u",), ("z",)], "u string"), ["u"]).first()
    assert (r.correct, r.false_positive, r.missed, r.expected) == (1, 2, 1, 2)


PAGE = """<html><head><script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "Person", "name": "Ann Lee", "email": "mailto:a@b.example", "worksFor": {"@type": "Organization", "name": "Acme"}}]}</script></head>
<body><nav><a href="/x">Menu</a></nav><div class="card"><h3>Bob Ray</h3><p class="role">Agent</p><a href="MAILTO:Bob%40b.example?subject=x">mail</a><a href="tel:+1 555 010 0100">call</a></div>
<div class="card" style="display:none"><h3>Hidden</h3></div><div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Cy Dow</span></div><p>Open <a href="../p?q=1">page</a> now</p></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://h.example/a/b", PAGE), (2, None, None), (3, "http://h.example/", "<p>broken <a href='x'")], "id long, u string, h string")
    got = H.links(pages, "id", "u", "h").where("id = 1").orderBy("pos").collect()
    assert [(r.url, r.label) for r in got][-1] == ("http://h.example/p?q=1", "page") and got[-1].context == "Open page now" and got[0].context == ""
    c = H.raw_cards(pages, "id", "h", {"row": "div.card", "name": "h3", "title": ".role"}).collect()
    assert [(r.name, r.title, r.email, r.phone, r.evidence) for r in c] == [("Bob Ray", "Agent", "Bob@b.example", "+1 555 010 0100", "Bob Ray Agent Bob@b.example mail +1 555 010 0100 call")]
    assert {(r.syntax, r.name, r.company) for r in H.entities(pages, "id", "h").collect()} == {("json-ld", "Ann Lee", "Acme"), ("microdata", "Cy Dow", "")}
    assert pages.where("id = 2").select(H.page_text(F.col("h")).alias("t")).first().t == ""
    many = spark.createDataFrame([(1, "http://h.example/", "<a href='x'>y</a>" * 5)], "id long, u string, h string")
    assert [r.truncated for r in H.links(many, "id", "u", "h", 3).collect()] == [True] * 3


@pytest.mark.parametrize("css, want", [
    ("div > p", ["a"]), ("div p", ["a", "b"]), ("p.x:not(.y)", ["a"]), ('[title="two, words"]', ["b"]), ("[data-k^='AB' i]", ["b"]), ("h3 + p", ["a"]), ("h3 ~ p", ["a"]), ("p:nth-child(2n)", ["a"]), ("p:first-child, i", ["b", "c"]),
    (":is(p, i):has(u)", ["c"]), ("#c u", ["d"]), ("*[id]:last-child", ["b", "c", "d"]),
])
def test_selectors(css, want):
    root = dom.tree("<div><h3>t</h3><p id=a class='x'>1</p><section><p id=b class='x y' title='two, words' data-k='abc'>2</p></section></div><i id=c><u id=d></u></i>")
    assert [n.get("id") for n in dom.select(root, dom.selector(css))] == want


def test_recipes_are_checked():
    assert H.checked_recipe({"row": ".a"})["name"] == H.DEFAULT_RECIPE["name"] and H.checked_recipe({"engine": "structured-v1"})
    for bad in ({"row": ""}, {"who": "p"}, {"row": "p["}, {"row": "p >"}, {"row": ":hover"}, {"engine": "x"}, {"name": 3}):
        with pytest.raises(ValueError):
            H.checked_recipe(bad)


def test_contacts_seen_in_cards(spark):
    card = lambda name, text, more="": f"<div class='team-card'><h3>{name}</h3><p class='title'>Sales Agent</p><p>{text}</p>{more}</div>"
    pages = [
        (1, card("Ann Lee", "ann@firm.site.com 212-555-7777") + card("Bo Ray", "bo@firm.site.com, 212-555-8888") + card("Cy Dow", "bo@firm.site.com")),
        (2, card("Di Fox", "info@firm.site.com") + card("Ed Gil", "e1@firm.site.com e2@firm.site.com") + "<footer>office@firm.site.com 212-555-9999</footer>" + card("Flo Hay", "212-555-9999")),
        (3, "<nav>" + card("Gus Ivy", "gus@firm.site.com") + "</nav>" + card("<b>Hal Joy</b></h3><h3>Ira Kim", "hal@firm.site.com") + card("Jo Lux", "jo@firm.site.com", "<footer>x@firm.site.com</footer>")), (4, None),
    ]
    df = spark.createDataFrame([(n, h, "https://www.firm.site.com/team", "Firm", True) for n, h in pages], "id long, h string, u string, firm string, sales boolean")
    got = {(r.name, r.email, r.phone, r.contact_scope, r.reason) for r in X.extracted(df, "id", "h", "u", "firm", "sales").collect()}
    assert got == {
        ("Ann Lee", "ann@firm.site.com", "212-555-7777", "unknown", None), ("Bo Ray", "", "212-555-8888", "unknown", None), ("Cy Dow", "", "", "unknown", "missing_contact"),
        # The site's generic mailbox on the page is lent; a number of the footer is nobody's.
        ("Di Fox", "info@firm.site.com", "", "shared", None), ("Ed Gil", "info@firm.site.com", "", "shared", None), ("Flo Hay", "info@firm.site.com", "", "shared", None),
        # Without one, an own address of the navigation is.
        ("Gus Ivy", "gus@firm.site.com", "", "shared", None), ("Hal Joy", "gus@firm.site.com", "", "shared", None), ("Jo Lux", "jo@firm.site.com", "", "unknown", None),
    }


def test_sources(spark, tmp_path):
    assert files.strict_json(b'\xef\xbb\xbf{"a": [1]}') == {"a": [1]}
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[" * 9 + "]" * 9, "x"):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    (tmp_path / "i.json").write_text('{"url":"http://a.example/"}\nbroken\n{"other":1}\n')
    assert [r.url for r in files.index_lines(spark, str(tmp_path / "i.json")).collect()] == ["http://a.example/"]
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a.example/1 </loc></url></urlset>'
    assert files.sitemap_entries(xml) == [("page", "http://a.example/1")] and files.sitemap_entries(b"<!DOCTYPE x><urlset/>") == []
    files.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().a == "'=1"


def test_split_agrees_with_the_standard_library(spark):
    urls = ["http://A.example:80/x?y#z", "https://b.example/p/../q", "http://c.example?x=1", "http://d.example/a b#?"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(U.parts(F.col("u")).alias("a")).select("a.*").collect()
    assert [(r.host, r.path, r.query) for r in got] == [(urlsplit(u).hostname, urlsplit(u).path, urlsplit(u).query) for u in urls]


def test_null_scopes_are_one_scope(spark):
    rows = [(None, n, f"h{n}", False, 2, 1) for n in range(6)] + [(1, n, "h", True, 3, 1) for n in range(4)]
    df = spark.createDataFrame(rows, "s long, pos int, host string, e boolean, slots int, cap int")
    got = admission.admit_exact(df, "s", ["pos"], "host", "e", "slots", "cap").collect()
    assert sorted((r.s or 0, r.pos) for r in got) == [(0, 0), (0, 1), (1, 0)]


@pytest.mark.parametrize("text, want", [("A555-555-01000", []), ("call 212-555-0199.", ["2125550199"]), ("(212) 555-0100, x+44 20 7946 0958", ["2125550100"]), ("212-555-0100 212-555-0101", ["2125550100", "2125550101"])])
def test_numbers_stand_alone(spark, text, want):
    assert one(spark, T.phones(F.col("t")), t=text) == want
