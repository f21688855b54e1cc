"""Training-data operators against brute force on small fixtures, with nulls, blanks, ties, repeats and empty tables."""

import itertools
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.llm import canonical_values as C
from pageloom.llm import contributor_caps as K
from pageloom.llm import eval_leaks as E
from pageloom.llm import format_duplicates as D
from pageloom.llm import incremental_dedup as I
from pageloom.llm import name_variants as V
from pageloom.llm import representatives as R
from pageloom.llm import sentences as S
from pageloom.llm import source_mixing as M
from pageloom.llm import template_residue as T

LISTS = [(1, "title", None, "Account Executive"), (2, "title", None, "Senior Account Executive"), (3, "title", None, "Sales Manager"), (101, "category", "pos", "Point of sale")]


def brute_distance(a, b):
    """Optimal string alignment with unit costs."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


# ---- 1
@pytest.mark.parametrize("value, want", [
    ("acct exec", 1), ("Sr. Account  Executive", 2), ("Executive - Account, serving Kolkaser Bay", 1), ("Acocunt Exeutive", 1), ("mgr of sales", 3), ("Senior Account Execut…", 2),
    ("Beekeeper", 0), ("TBD", 0), ("--", 0), ("?", 0), ("x" * 5000, 0),
])
def test_values_map(value, want):
    d = C.Dictionary([(r, f, [x for x in (label, code) if x]) for r, f, code, label in LISTS], {})
    assert d.map("title", value)[0] == want


def test_symmetric_deletes_find_all_within_the_bound():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))
        if brute_distance(a, b) <= 2:
            assert C.deletions(a, 2) & C.deletions(b, 2)
        assert C.weighted_distance(a, b, 99) <= brute_distance(a, b) + 1e-9


def test_map_values_frames(spark):
    ref = spark.createDataFrame(LISTS, "ref_id long, field_name string, code string, label string")
    values = spark.createDataFrame([("title", "Acct Exec", 2), ("title", None, 1), ("title", " ", 1), ("category", "P.O.S.", 1), ("title", "Puppeteer", 3)], "field_name string, value string, n long")
    got = {(r.field_name, r.value): r.ref_id for r in C.map_values(values, ref).collect()}
    assert got == {("title", "Acct Exec"): 1, ("category", "P.O.S."): 101, ("title", "Puppeteer"): 0}
    assert {r.ref_id for r in C.map_values(values, ref.limit(0)).collect()} == {0}
    assert C.map_values(values.limit(0), ref).count() == 0


def test_map_values_in_blocks(spark, monkeypatch):
    ref = spark.createDataFrame(LISTS, "ref_id long, field_name string, code string, label string")
    values = spark.createDataFrame([("title", "sr acct exec", 2), ("title", "sales mgr", 1)], "field_name string, value string, n long")
    whole = {(r.value, r.ref_id) for r in C.map_values(values, ref).collect()}
    monkeypatch.setattr(C, "BLOCK_ENTRIES", 2)
    assert {(r.value, r.ref_id) for r in C.map_values(values, ref).collect()} == whole


def test_blocks_aliases_and_initials(spark, monkeypatch):
    labels = ["Account Executive", "Senior Account Executive", "Sales Manager", "Vice President of Sales", "Human Resources Director", "Sales Operations Analyst", "Business Development Manager", "Business Data Manager", "Account Auditor"]
    ref = spark.createDataFrame([(n, "title", None, label) for n, label in enumerate(labels, 1)], "ref_id long, field_name string, code string, label string")
    want = {"AE": 1, "hr dir": 5, "VP of Sales": 4, "sales vp": 4, "vps": 4, "BDM": 7, "bd mgr": 7, "Accnt": 0, "Account E…": 1, "seller": 0, "acount exective": 1, "Manager, Sales": 3, "analyst sales ops": 6}
    values = spark.createDataFrame([("title", v, 1) for v in want], "field_name string, value string, n long")
    got = lambda more=None: {r.value: r.ref_id for r in C.map_values(values, ref, more).collect()}
    assert got() == want
    alias = spark.createDataFrame([("sales manager", "seller")], "label string, alias string")
    assert got(alias) == {**want, "seller": 3}
    monkeypatch.setattr(C, "BLOCK_ENTRIES", 2)
    assert got() == want and got(alias) == {**want, "seller": 3}


# ---- 2
@pytest.mark.parametrize("field, value, want", [
    ("name", "Ann Lee", True), ("name", "Lee, Ann", True), ("name", "LEE Ann", True), ("name", "LEE Ann C.", True), ("name", "Lee, Ann C.", True), ("name", "Ann Bo C.", False), ("name", "Dr. Ann (Annie) B. Lee, CPA", True), ("name", "Ann L.", False), ("name", "A. Lee", False), ("name", "A Lee", False),
    ("name", "Ann Le…", False), ("name", "{{ first_name }} {{ last_name }}", False), ("name", None, None), ("name", "", False), ("email", "a.b@c.example", True), ("email", "a***@c.example", False), ("email", "a.b@c", False),
    ("email", "…@c.example", False), ("email", "[email protected]", False), ("phone", "(555) 555-0101 x12", True), ("phone", "000-000-0000", False), ("phone", "555 555 ****", False), ("phone", "555-555-XXXX", False),
    ("phone", "+1 555", False), ("title", "Beekeeper", True), ("title", "n.a.", False), ("title", "Account Exec...", False), ("title", "to be announced", False),
])
def test_usable(spark, field, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(R.usable(field, F.col("v")).alias("x")).first().x
    assert bool(got) == bool(want)


def test_best_values_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, 4, None]), n, rng.choice(["Ann Lee", "A. Lee", "", None, "Bo Ray"]), rng.random() < .4, rng.choice([None, datetime(2025, 1, 1), datetime(2025, 1, 2)])) for n in range(60)] + [(9, 99, "Cy Dow", True, None)]
    df = spark.createDataFrame(rows, "g long, id long, name string, t boolean, at timestamp")
    got = {(r.g, r.id) for r in R.best_values(df, "g", "id", {"name": R.usable("name", F.col("name"))}, F.col("t"), "at").collect()}
    want = set()
    for g in (1, 2, 3, 4):
        ok = [r for r in rows if r[0] == g and r[2] in ("Ann Lee", "Bo Ray")]
        if sum(r[0] == g for r in rows) > 1 and ok:
            want.add((g, max(ok, key=lambda r: (r[3], r[4] or datetime(1, 1, 1), r[1]))[1]))
    assert got == want


def test_currency_reasoning(spark):
    day = [datetime(2025, 1, n) for n in range(1, 5)]
    rows = [(g, g * 10 + n, v, day[n]) for g in range(5) for n, v in enumerate(["a", "b"])] + [(g, g * 10 + n, v, day[n]) for g in range(5, 9) for n, v in enumerate(["b", "c"])]
    # x and y come in both orders, u, v and w in a circle.
    rows += [(g, g * 10 + n, v, day[n]) for g in range(10, 16) for n, v in enumerate("xy" if g % 2 else "yx")]
    rows += [(g, g * 10 + n, v, day[n]) for g in range(20, 32) for n, v in enumerate(["uv", "vw", "wu"][g % 3])]
    rows += [(90, 901, "c", None), (90, 902, "a", None), (91, 911, "x", None), (91, 912, "y", None), (92, 921, "u", None), (92, 922, "v", None), (93, 931, None, None), (94, 941, "a", None), (94, 942, "a", day[0]), (None, 951, "a", None)]
    df = spark.createDataFrame(rows, "g long, id long, v string, at timestamp")
    values = R.distinct_values(df, "g", "id", {"f": (F.col("v").isNotNull(), F.col("v"))}, F.lit(False), "at")
    assert {(r.before, r.after) for r in R.learned_precedence(values, ["g", "field_name"], "value", "first", "field_name").collect()} == {("a", "b"), ("b", "c"), ("u", "v"), ("v", "w"), ("w", "u")}
    assert {r.g: r.id for r in R.current_rows(values, "g", "id").collect()} == {90: 901, 91: 912, 92: 922, 94: 942}
    assert R.current_rows(values.limit(0), "g", "id").count() == 0


# ---- 3
def test_format_duplicates(spark):
    same = ["http://a.example/x-y?b=1&a=2", " HTTP://A.example./X%2dy/?a=2&&b=1 ", "<http://a.example/x_y?b=1&amp;a=2>", "http://a.example//x–y?a=2;b=1#", "http://a.example/x​-y?b=1&a=2"]
    other = ["https://a.example/x-y?b=1&a=2", "http://www.a.example/x-y?b=1&a=2", "http://a.example/xy?b=1&a=2", "http://a.example/y-x?b=1&a=2", "http://a.example/x-y?b=2&a=1", "no address", "", None]
    rows = [(1, n, u) for n, u in enumerate(same + other)] + [(2, 90, same[0]), (None, 91, same[0]), (None, 92, same[1])]
    urls = D.canonical_url(spark.createDataFrame(rows, "c long, id long, url string"), "url")
    got = {(r.first_id, r.id) for r in D.copies_of_first(urls, ["c"], "canonical", "id").collect()}
    assert got == {(0, n) for n in range(1, len(same))} | {(91, 92)}
    assert D.count_copies(urls, ["c"], "canonical", "id").where("first_id = 0").first().copies == len(same)
    assert D.collided(urls, ["c"], "canonical", "id").count() == 0 and D.count_copies(urls.limit(0), ["c"], "canonical", "id").count() == 0


# ---- 4
@pytest.mark.parametrize("text, want", [
    ("{{ name }}", True), ("Hi {{fname|there}}!", True), ("[Agent Name]", True), ("<%= x %>", True), ("%CITY%", True), ("__NAME__", True), ("Plans {small, medium, large} are on offer.", False), ("[Remote] on Fridays.", False),
    ("Prices from $ 9 per month.", False), ("use the % sign key, then 5", False), ("Lorem ipsum dolor sit amet", True), ("HTTP Error 503. The service is unavailable.", True), ("Room 503, ask for the key.", False),
    ("Her motto: “page not found, deal not lost”", False), ("LA PÁGINA SOLICITADA NO EXISTE", True), ("Please switch on JavaScript to view", True), ("She sells JavaScript training", False), ("Ann Lee", False), ("", False), (None, False),
    ("This tutorial shows the template language: write {{ name }} where the name of the customer goes, then save the file and look at the page again.", False), ("a" * 20000, False),
])
def test_residue(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.residue(F.col("t")).alias("x")).first().x is want


def test_wordings_are_learned_from_repetition(spark):
    rows = [(n, n % 9, f"The gremlins ate page {n}, come back later") for n in range(20)] + [(100 + n, n % 7, "Seven sources only say this") for n in range(70)]
    rows += [(200 + n, 1, "One source says this all the time") for n in range(50)] + [(300 + n, n, "too short") for n in range(20)] + [(400, None, None), (401, 3, ""), (402, None, "the GREMLINS ate page! come back later")]
    df = spark.createDataFrame(rows, "id long, s long, t string")
    assert {r.id for r in T.repeated_notices(df, "id", "t", "s").collect()} == {*range(20), 402}
    assert T.repeated_notices(df.limit(0), "id", "t", "s").count() == 0


# ---- 5
def test_batches_against_history(spark, tmp_path):
    old = [(1, "https://www.a.example/team/ann-lee", "Ann Lee"), (1, "http://a.example/list?page=2&dept=x", ""), (2, "http://a.example/only-two", ""), (1, None, None)]
    new = [
        (1, 5, 0, 10, "http://m.a.example/team/ann-lee.php?utm_source=x#top", "Ann Lee", True), (1, 5, 1, 11, "http://a.example/team/ann-leee", "Ann Leee", False), (1, 5, 2, 12, "http://a.example/team/anne-lee", "Ann Lee", True),
        (1, 5, 3, 13, "http://a.example/list?dept=x&page=2", "", True), (1, 5, 4, 14, "http://a.example/list?dept=x&page=3", "", False), (1, 5, 5, 15, "http://a.example/only-two", "", False), (1, 6, 0, 16, "http://a.example/only-two/index.html", "", True),
        (1, 6, 1, 17, "mailto:x@a.example", "", False), (1, 6, 2, 18, None, None, False), (1, 6, 3, 19, "http://", "", False), (1, 6, 4, 20, "http://", "", False),
    ]
    keys = lambda rows, schema, columns: I.exploded_keys(I.page_keys(spark.createDataFrame(rows, schema), "url", "label"), "c", columns)
    h = keys(old, "c long, url string, label string", [])
    b = keys([x[:6] for x in new], "c long, run long, pos int, id long, url string, label string", ["run", "pos", "id"])
    runs = I.SortedRuns(spark, str(tmp_path / "runs"))
    first = {r.id for r in I.repeated(runs, b, "run", "pos", "id").collect()}
    assert first < {x[3] for x in new if x[6]}
    runs.add(h)
    got = {r.id for r in I.repeated(runs, b, "run", "pos", "id").collect()}
    assert got == {x[3] for x in new if x[6]}
    # Run by run gives the same as all at once; each step opens the history anew.
    seen = set()
    for part in (h, b.where("run = 5"), b.where("run = 6")):
        store = I.SortedRuns(spark, str(tmp_path / "step"))
        if "run" in part.columns:
            seen |= {r.id for r in I.repeated(store, part, "run", "pos", "id").collect()}
        store.add(part)
    assert seen == got


def test_runs_compact_prune_and_reopen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGE_KEYS", 40)
    monkeypatch.setattr(I, "SAMPLED", 8)
    url = lambda n: f"http://a.example/{n % 7}/page-{n:04d}"
    keys = lambda ns, columns=(): I.exploded_keys(I.page_keys(spark.createDataFrame([(1, 9, n, n, url(n), "") for n in ns], "c long, run long, pos int, id long, url string, label string"), "url", "label"), "c", list(columns))
    for step in range(5):
        I.SortedRuns(spark, str(tmp_path / "s")).add(keys([*range(step * 60, step * 60 + 60)] * 2))
    store = I.SortedRuns(spark, str(tmp_path / "s"))
    assert sorted(r["tier"] for r in store.runs) == [0, 1] and store.bounds and store._read(store.runs).agg(F.sum("copies")).first()[0] == 600
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.name.startswith("run-")) == sorted(r["path"].rsplit("/", 1)[-1] for r in store.runs)
    got = I.repeated(store, keys(range(295, 303), ["run", "pos", "id"]), "run", "pos", "id")
    assert {r.id for r in got.collect()} == set(range(295, 300))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[range#\d+ (?:IN|INSET|=)|PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ =", plan)


def test_slips_of_both_sides_meet(spark, tmp_path):
    rows = [("http://a.example/team/jhon-smith-office", "Office of John Smith"), ("http://a.example/team/ann-lee", "Ann Lee"), ("http://a.example/x/boksem-office", "Branch office")]
    new = [("http://a.example/team/john-smithh-office", "Office of John Smith", True), ("http://a.example/team/anne-lee", "Anne Lee", False), ("http://a.example/x/boksen-office", "Branch office", False), ("http://a.example/team/jhn-smith-office", "", False)]
    h = I.exploded_keys(I.page_keys(spark.createDataFrame([(1, *x) for x in rows], "c long, url string, label string"), "url", "label"), "c", [])
    b = spark.createDataFrame([(1, 2, n, n, *x[:2]) for n, x in enumerate(new)], "c long, run long, pos int, id long, url string, label string")
    b = I.exploded_keys(I.page_keys(b, "url", "label"), "c", ["run", "pos", "id"])
    store = I.SortedRuns(spark, str(tmp_path / "s"))
    store.add(h)
    assert {r.id for r in I.repeated(store, b, "run", "pos", "id").collect()} == {n for n, x in enumerate(new) if x[2]}
    assert I.repeated(store, b.limit(0), "run", "pos", "id").count() == 0


# ---- 6
def test_caps_match_ranking(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), n, rng.choice([1, 2, 3, None]), rng.choice([datetime(2025, 1, 1, h, m) for h in (1, 2) for m in (0, 1)])) for n in range(200)]
    df = spark.createDataFrame(rows, "c long, o string, id long, s int, at timestamp").withColumn("cap", F.when(F.col("c") == 1, 7).when(F.col("c").isNull(), 0))
    got = {r.id for r in K.over_cap(df.withColumn("hour", F.date_trunc("hour", "at")), ["c", "o"], "cap", ["s", "hour", "at"], "id").collect()}
    want = set()
    for c, cap in ((1, 7), (None, 0)):
        for o in ("a", "b", None):
            g = sorted((r for r in rows if r[0] == c and r[1] == o), key=lambda r: (-(r[3] or 0), -r[4].timestamp(), r[2]))
            want |= {r[2] for r in g[cap:]}
    assert got == want
    assert K.over_cap(df.limit(0), ["c"], "cap", ["s"], "id").count() == 0


def test_equal_qualities_are_split_by_id(spark, monkeypatch):
    monkeypatch.setattr(K, "TIES", 16)
    df = spark.range(1000).select(F.lit(1).alias("c"), F.lit(None).cast("int").alias("s"), F.lit(333).alias("cap"), F.col("id"))
    assert {r.id for r in K.over_cap(df, ["c"], "cap", ["s"], "id").collect()} == set(range(333, 1000))
    share = K.with_share_cap(df.drop("cap").withColumn("c", F.when(F.col("id") < 400, 1)), ["c"], 0.25)
    assert {(r.c, r.cap) for r in share.select("c", "cap").distinct().collect()} == {(1, 100), (None, 150)}


# ---- 7
def test_companies(spark):
    pairs = [
        ("Zunrorab Miltogun Processing", "The ZunrorabMiltogun Proc.", True), ("Zunrorab Miltogun Processing", "Processing Zunrorab Miltogun, LLC", True), ("Zunrorab Miltogun Processing", "Znurorab & Miltgun", True),
        ("Zunrorab Miltogun Processing", "Zunrorab Miltogun Telecom", False), ("Zunrorab Miltogun Processing", "Zunrorab Fikhoful Processing", False), ("Balpikur Kambujus Insurance Agency", "BKIA", True),
        ("Corvohur Sokcilon Payments", "C. Sokcilon Payments", True), ("Zunrorab Miltogun Processing", "", False), ("Zunrorab Miltogun Systems", "Zunrorab Miltogun Sys (formerly Zunrorab Systems)", True),
    ]
    df = spark.createDataFrame(pairs, "x string, y string, want boolean").withColumn("a", V.company_core(F.col("x"))).withColumn("b", V.company_core(F.col("y")))
    for r in df.select("x", "y", "want", V.same_employer("a", "b").alias("got")).collect():
        assert bool(r.got) == r.want, (r.x, r.y)
    names = sorted({x for p in pairs[:5] for x in p[:2]} | {"", "???"})
    d = spark.createDataFrame([(n, None) for n in names] + [(None, None)], "n string, site string")
    got = {(r.a, r.b) for r in V.same_organisations(d, "n").collect()}
    assert ("Processing Zunrorab Miltogun, LLC", "Zunrorab Miltogun Processing") in got and ("Zunrorab Miltogun Processing", "Zunrorab Miltogun Telecom") not in got
    assert V.same_organisations(d.limit(0), "n").count() == 0


@pytest.mark.parametrize("a, b, want", [("margaret", "peggy", 1), ("alex", "alexandra", 1), ("alexander", "alexandra", 0), ("m", "margaret", 2), ("margaret", "margarte", 1), ("robert", "rosalind", 0)])
def test_first_names(a, b, want):
    assert V.compatible(a, b) == want == V.compatible(b, a)


def test_persons(spark):
    rows = [(1, "Margaret Ballihek", "f", "p1", None), (2, "Balllihek, Peggy", "f", None, None), (3, "Margaret Ballihek", "g", None, None), (4, "Robert Ballihek", "f", None, None), (5, "M. Ballihek", "f", "p1", None), (6, None, "f", "p1", None), (7, "Maggie", "f", "p1", None)]
    people = V.person_names(spark.createDataFrame(rows, "g long, name string, firm string, line string, mail string"), "name")
    assert {(r.a, r.b) for r in V.same_persons(people, "g").collect()} == {(1, 2), (1, 5)}


def test_links_carry_scores_and_nicknames_are_a_table(spark):
    rows = [(n, "Margaret Ballihek" if n % 2 else "Peggy Ballihek", "big", f"p{n // 2}", None) for n in range(1, 5)] + [(n, x, "big", None, None) for n, x in enumerate(("Bo Trakent", "Cyrus Lompwid", "Dieter Kervol", "Edwina Zusshaf", "Florian Grintbuk", "Gustav Perldonc"), 10)]
    df = spark.createDataFrame(rows, "g long, name string, firm string, line string, mail string")
    got = {(r.a, r.b): r.score for r in V.same_persons(V.person_names(df, "name"), "g").collect()}
    assert set(got) == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)} and got[2, 3] > got[1, 2] >= 0
    assert {(r.a, r.b) for r in V.same_persons(V.person_names(df, "name", {}), "g", {}).collect()} == {(1, 3), (2, 4)}
    names = spark.createDataFrame([("Zunrorab Miltogun Processing", "zunrorabmiltogun"), ("Zunrorab Miltogun Proc. LLC", None), ("ZMP", "zunrorabmiltogum"), ("ZMP", None), ("Zed Milk Pay Processing", "zedmilk")], "n string, site string")
    links = {(r.a, r.b): r.score for r in V.same_organisations(names, "n").collect()}
    assert set(links) == {("Zunrorab Miltogun Proc. LLC", "Zunrorab Miltogun Processing"), ("ZMP", "Zunrorab Miltogun Processing"), ("ZMP", "Zunrorab Miltogun Proc. LLC")} and all(x > 0 for x in links.values())


def test_all_evidence_of_a_lead_counts(spark):
    rows = [(1, "Margaret Ballihek", "f", "p1", None), (1, None, "f", "p2", "m1"), (1, None, "h", "p3", "m2"), (2, "M. Ballihek", "g", "p2", None), (3, "M. Ballihek", "g", "p9", "m1"), (4, "Peggy Ballihek", "h", "p8", None), (5, "M. Ballihek", "k", "p7", "m7")]
    people = V.person_names(spark.createDataFrame(rows, "g long, name string, firm string, line string, mail string"), "name")
    assert {(1, 2), (1, 3), (1, 4)} <= {(r.a, r.b) for r in V.same_persons(people, "g").collect()}
    assert not any(5 in (r.a, r.b) for r in V.same_persons(people, "g").collect())


def test_variants_are_never_broadcast(spark, monkeypatch):
    """exploded rows, which Catalyst takes for as few as the rows before, must not be collected into the driver."""
    plans, write = [], V.written
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(V, "written", lambda df: write(keep(df)))
    names = spark.createDataFrame([("Zunrorab Miltogun Processing", "zunrorabmiltogun"), ("Zunrorab Miltgun Processing", None), ("ZMP", "zunrorabmiltogum")], "company string, site string")
    assert ("ZMP", "Zunrorab Miltogun Processing") in {(r.a, r.b) for r in keep(V.same_organisations(names, "company")).collect()}
    sources = spark.createDataFrame([(0, "Zunrorab Miltogun Processing")], "source_id long, company string").withColumn("p", V.company_core(F.col("company")))
    records = spark.createDataFrame([(1, 1, 0, "Peggy Ballihek", "Zunrorab Miltogun Proc.", None, None), (2, 2, 0, "Margaret Ballihek", None, None, None)], "record_id long, lead_id long, source_id long, name string, company string, email string, phone string")
    people = V.person_names(keep(V.firm_of(records, write(sources))[1]), "name").withColumn("line", V.phone_line(F.col("phone")))
    assert {(r.a, r.b) for r in keep(V.same_persons(people, "lead_id")).collect()} == {(1, 2)}
    below = lambda lines, n: [x for x in itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :|+-")) > n, lines)]
    for plan in plans:
        lines = plan.splitlines()
        for k, x in enumerate(lines):
            if "BroadcastExchange" in x:
                assert not any("Generate " in y for y in below(lines[k + 1 :], len(x) - len(x.lstrip(" :|+-")))), plan


def test_variant_forms_are_all_deletions(spark):
    words = ["abc", "aab", "\u00e7\u00e9\u65e5\u672c", "zunrorab", "a", ""]
    rests = lambda w, n: {w} if not n else {w}.union(*(rests(w[:k] + w[k + 1 :], n - 1) for k in range(len(w))))
    d = spark.createDataFrame([(w, sorted(x for x in rests(w, n) if len(x) >= len(w) - n), n) for w in words for n in (1, 2) if len(w) > n], "w string, want array<string>, n int")
    for n in (1, 2):
        got = d.where(F.col("n") == n).select("w", F.array_sort(V.deletion_forms(F.col("w"), n)).alias("got"), F.array_sort(F.transform("want", lambda x: F.xxhash64(x))).alias("want"))
        assert all(r.got == r.want for r in got.collect())
    assert [len(r.x) for r in spark.createDataFrame([("",)], "w string").select(V.deletion_forms(F.col("w"), 2).alias("x")).collect()] == [1]


# ---- 8
def test_myers_matches_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ([rng.choice("abcd") for _ in range(rng.randint(a, b))] for a, b in ((1, 9), (0, 14)))
        masks = {}
        for i, x in enumerate(p):
            masks[x] = masks.get(x, 0) | 1 << i
        row = list(range(len(p) + 1))
        best = row[-1]
        for y in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i - 1] + (x != y), row[i] + 1, new[i - 1] + 1))
            row, best = new, min(best, new[-1])
        assert E.myers(masks, len(p), t) == best


def test_leaks(spark):
    word = lambda n: "".join(random.Random(n).choice("bcdfgklmnprstvz") + random.Random(n * 7 + k).choice("aeiou") for k in range(4))
    item = lambda s: f"Explain why the {word(s)} office of {word(s + 1)} in {word(s + 2)} kept {s + 300} cards although {word(s + 3)} {word(s + 4)} had asked {word(s + 5)} to hand back {s + 40} of them by {word(s + 6)}."
    stock = "Calls may be recorded for training and to keep a fair account of what was agreed with us."
    items = [(n, item(n * 50) + (" " + stock if n % 2 else "")) for n in range(1, 30)]
    whole, other = items[3][1], item(9000)
    words = whole.split()
    docs = [
        (1, "A note. " + whole, True), (2, whole.upper(), True), (3, "  ".join(words), True), (4, "He wrote " + " ".join(words[6:20]) + " once.", True), (5, "He wrote " + " ".join(words[6:13]) + " once.", False), (6, other, False),
        (7, " ".join(words[:8] + ["truly"] + words[8:15] + ["quite"] + words[16:]), True), (8, stock, False), (9, whole.replace("a", "а").replace("e", "е"), True), (10, "", False), (11, None, False), (12, whole[:40] + "­" + whole[40:], True),
    ]
    d = spark.createDataFrame([x[:2] for x in docs], "doc long, t string")
    i = spark.createDataFrame(items, "item long, t string")
    got = {(r.doc, r.item) for r in E.without_stock(E.leaked(d, i, "doc", "t", "item", "t"), "doc", "item").collect()}
    assert got == {(x[0], 4) for x in docs if x[2]}
    assert E.leaked(d, i.limit(0), "doc", "t", "item", "t").count() == 0


def test_least_passages_with_few_specific_words():
    build = lambda a, b, c, n: f"If {a} pays 3.5 per region and Yekaterina {b} pays 8.6 per form, decide whether the parked branch of {c} near the mill still earns {n} in June."
    name = lambda n: "".join(random.Random(n).choice("bcdfgklmnprstvz") + random.Random(n * 7 + k).choice("aeiou") for k in range(4)).title()
    items = [(n, [build(name(n * 9), name(n * 9 + 1), name(n * 9 + 2), n + 500)]) for n in range(300)]
    ja = "古い港の事務所では毎朝七時に窓口を開けて集まった手紙を棚へ移し、午後には誰もいない倉庫の鍵を確かめてから帰る決まりが長く守られてきた。"
    index = E.index_of([*items, (900, [ja])])
    part = f"pays 3.5 per region and Yekaterina {name(64)} pays 8.6 per"
    got = lambda t: {i for i, _ in index.leaks(t)}
    assert got(f"As seen before, {part} in full.") == {7} and got("As seen before, " + part.replace("region", "district") + " in full.") == {7}
    assert got(f"As seen before, {part.replace(name(64), 'Otherhol')} in full.") == set()
    assert got(build("Otherhol", name(64), "Elsehol", 77)) == set()
    assert got("彼は言った。" + ja[4:50] + "と。") == {900} == got(ja.replace("手紙", "書類")) and got("古い港の事務所では毎朝八時に店を閉める。") == set()


def test_stock_needs_different_texts_without_the_rest(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    says = lambda: f"Why did {name()} of {name()} ask {name()} for {rng.randint(100, 999)} cards after {name()} and {name()} had lost {name()} in {name()}."
    common = "Parcels that nobody has fetched within a week go back to the depot by the next van."
    first, second, twice = says(), says(), says()
    items = [(1, first + " " + second), (2, twice), (3, twice), (4, says() + " " + common), *((n, says()) for n in range(5, 40))]
    note = [name() for _ in range(150)]
    docs = [(n, " ".join(note[:n] + [name()] + note[n + 1 :]) + ". " + first) for n in range(60)]
    docs += [(n, " ".join(name() for _ in range(30)) + ". " + common) for n in range(100, 160)] + [(200, "So: " + twice)]
    d, i = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(items, "item long, t string")
    got = {(r.doc, r.item) for r in E.without_stock(E.leaked(d, i, "doc", "t", "item", "t"), "doc", "item").collect()}
    assert got == {(n, 1) for n in range(60)} | {(200, 2), (200, 3)}


def test_blocks_and_twins_change_no_leak(spark, monkeypatch):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    says = lambda: f"Why did {name()} of {name()} ask {name()} for {rng.randint(100, 999)} cards after {name()} and {name()} had lost {name()} in {name()}."
    one, twin, stock = says(), says() + " " + says(), "Calls may be recorded for training and to keep a fair account of what was agreed with us."
    items = [(1, one), (2, twin), (3, twin), (4, None), (5, " "), (6, stock), *((n, f"{says()} {stock}") for n in range(7, 30))]
    # One item stands whole in many documents, copies and others: no share of the documents makes it stock.
    docs = [(n, f"{says()} {says()} {one} {says()}") for n in range(30)] + [(n, says()) for n in range(30, 300)] + [(400, twin), (401, f"{says()} {stock}"), (402, None)]
    d, i = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(items, "item long, t string")
    found = lambda: {(r.doc, r.item) for r in E.without_stock(E.leaked(d, i, "doc", "t", "item", "t"), "doc", "item").collect()}
    want = {(n, 1) for n in range(30)} | {(400, 2), (400, 3), (401, 6)}
    assert found() == want
    monkeypatch.setattr(E, "BLOCK_TOKENS", 400)
    assert found() == want


def test_statistics_of_items_match_direct_counts(spark):
    items = [(n, [f"The Boksem office of Zunra {n} has {n % 3} cards left for Ann Lee and the others to hand out by Friday at noon.", "Ask the desk in Kolkaser Bay if in doubt about it all please."][: 1 + n % 2]) for n in range(12)]
    i = spark.createDataFrame([(n, " ".join(ss)) for n, ss in items], "item long, t string")
    (mine, known), = E.block_indexes(E.item_sentences(i, "item", "t")[0])
    want = E.index_of(items)
    got = E.Index(mine, known)
    assert got.pieces.keys() == want.pieces.keys() and got.idf == want.idf and got.specific == want.specific and got.names == want.names and got.shared_windows == want.shared_windows


def test_common_pieces_lose_no_leak():
    """windows that only pieces of common words that many items hold lead to are found like all others."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    items = [(n, [f"we kept the cards from all of our vans at {name()} {name()}"]) for n in range(60)]
    plain = "some of them were sent back when we had read it twice".split()
    items += [(100, [" ".join(plain)])] + [(101 + 3 * k + j, [" ".join([name(), *plain[k : k + E.PIECE], name()])]) for k in range(9) for j in range(3)]
    ja = "古い港の事務所では毎朝七時に窓口を開けて集まった手紙を棚へ移し、"
    items += [(200 + k, [ja + "".join(rng.choice("山川田町村森林石金水火土木空海") for _ in range(40)) + ja]) for k in range(20)]
    index, full = E.index_of(items), E.index_of(items)
    for x, held in full.common.items():
        full.pieces[x] = [(p, at) for p in held for at in held[p]]
    full.common = {}
    got = lambda t: {i for i, _ in index.leaks(t)}
    reworded = items[7][1][0].replace("from", "into").replace(" at ", " by ")
    assert index.common and got(reworded) == {7} and got("So: " + reworded + ".") == {7}
    assert got(" ".join(plain)) == {100} and got("we kept the cards from all of our vans at all") == set()
    found = 0
    for _ in range(600):
        t = E.tokens(rng.choice(items)[1][0] + " " + rng.choice(items)[1][0])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = [rng.choice(["truly", "the", "手", E.tokens(name())[0]])] * rng.randint(0, 1)
        found += bool(index.leaks(" ".join(t)))
        assert index.leaks(" ".join(t)) == full.leaks(" ".join(t))
    assert found > 100


# ---- 9
def test_mixing(spark):
    rng = random.Random(5)
    docs = [(n, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None]), rng.randint(1, 50)) for n in range(3000)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("d", 0.0, 3)]
    d = spark.createDataFrame(docs, "id long, s string, n long").withColumnRenamed("s", "source")
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    got = M.mixed(d, t, "id", "source", "n", total_tokens=40_000).collect()
    have = {s: sum(x[2] for x in docs if x[1] == s) for s in "abc"}
    for s, w, most in targets[:3]:
        mine = [r for r in got if r.source == s]
        rate = min(w * 40_000 / have[s], most)
        assert {r.repeats for r in mine} <= {int(rate), int(rate) + 1} - {0} and max(r.repeats for r in mine) <= most
        assert abs(sum(r.repeats for r in mine) - rate * sum(x[1] == s for x in docs)) <= 1
    assert len({r.id for r in got}) == len(got) and M.mixed(d.limit(0), t, "id", "source", "n").count() == 0


def test_mixing_sums_beyond_a_long_and_buckets_change_nothing(spark, monkeypatch):
    big = spark.createDataFrame([(n, "a") for n in range(4)], "id long, s string")
    got = M.systematic_copies(big, "s", "id", F.lit(4_000_000_000).cast("decimal(38,0)") * 1_000_000_000).collect()
    assert len(got) == 4 and all(abs(r.repeats - 4_000_000_000) <= 1 for r in got)
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("s"))
    pick = lambda: {(r.id, r.repeats) for r in M.systematic_copies(df, "s", "id", F.lit(300_000_000)).collect()}
    want = pick()
    monkeypatch.setattr(M, "BUCKET_ROWS", 2)
    assert pick() == want and 890 <= len(want) <= 910


def test_token_pieces_cover_the_text():
    text = " ".join(str(n) for n in range(40_000)) + "x" * 120_000
    assert "".join(M.pieces(text)) == text and max(map(len, M.pieces(text))) <= M.PIECE


# ---- 10
@pytest.mark.parametrize("text, want", [
    ("Dr. Lee paid 3.5 per cent. She left at 5 p.m. on Monday.", ["Dr. Lee paid 3.5 per cent.", "She left at 5 p.m. on Monday."]),
    ("It opens at 8 a.m. The page www.a.example/b.html is up. e.g. No. 5 of Acme Inc. sells.", ["It opens at 8 a.m.", "The page www.a.example/b.html is up.", "e.g. No. 5 of Acme Inc. sells."]),
    ("“Is it so? Yes,” said Ann. Then.Next!", ["“Is it so? Yes,” said Ann.", "Then.", "Next!"]), ("Our team\n\n- fax: none. Or so\nlong text that\ngoes on. End", ["Our team", "- fax: none. Or so", "long text that\ngoes on.", "End"]),
    ("古い用紙です！「はい。そうです」と言った。次。", ["古い用紙です！", "「はい。そうです」と言った。", "次。"]), ("ไทยหนึ่ง ไทยสอง", ["ไทยหนึ่ง", "ไทยสอง"]), ("पहला वाक्य। दूसरा है?", ["पहला वाक्य।", "दूसरा है?"]),
    ("В 2001 г. он ушёл, т. е. давно. Конец", ["В 2001 г. он ушёл, т. е. давно.", "Конец"]), ("Am 8. Mai z. B. kam er. Gut.", ["Am 8. Mai z. B. kam er.", "Gut."]), ("", []), (" \n ", []), (None, []),
])
def test_sentences(spark, text, want):
    got = S.split_sentences(spark.createDataFrame([(1, text, 0)], "doc long, text string, start_char int"), "doc", "text").orderBy("start_char").collect()
    assert [r.sentence for r in got] == want and all(text[r.start_char : r.end_char] == r.sentence for r in got)


@pytest.mark.parametrize("n", [300, 900, 9_000])
def test_quotations_and_bullet_lines_of_any_length(spark, n):
    said = "We call. " * (n // 9)
    text = f"She wrote: “{said}We end” on Monday. Then.\n- {said}End\n                         - deep. Mark\nLast. One"
    got = S.split_sentences(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text").orderBy("start_char").collect()
    assert [r.sentence for r in got] == [f"She wrote: “{said}We end” on Monday.", "Then.", f"- {said}End", "- deep. Mark", "Last.", "One"]


def test_private_characters_of_a_text_stay(spark):
    text = "A\ue000b\ue001c. D\ue002e\ue003f."
    got = S.split_sentences(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text").orderBy("start_char").collect()
    assert [r.sentence for r in got] == ["A\ue000b\ue001c.", "D\ue002e\ue003f."]


def test_sentences_of_a_long_text(spark):
    text = "One two 😀 three. " * 5000
    got = S.split_sentences(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text")
    assert got.count() == 5000 and got.agg(F.max("end_char")).first()[0] == len(text) - 1
