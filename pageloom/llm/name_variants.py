"""Variant spellings of names: canonical rewritings, exploded forms, equi-joins, scored by rewriting rarity.

Organisations: a name is rewritten to its core letters (legal forms, articles, joining words and a former name go) and
its kind (what the firm does, abbreviations written out). Cores are compared through their deletion variants, exploded
and equi-joined, so typos, merged words and other separators meet without comparing all pairs; initials and acronyms
join on their own forms together with the site's letters, and count only where the form is rare. Every link carries a
score: the rarity (bits) of the rewriting by which two names meet, less a bit for each edit. Persons: a name becomes first-name roots (nicknames,
spellings), initials and the surname's consonant skeleton with its deletion variants; forms meet only together with
evidence (the employer's core, a phone line or an address), and every pair is verified on the full names. Nicknames are a
table that can be given; without any, names meet by slips and initials only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.canonical_values import deletions, weighted_distance
from pageloom.llm.registry import query
from pageloom.llm.representatives import AROUND_NAME, CUT, usable
from pageloom.llm.template_residue import residue
from pageloom.session import small, spread, table, written

# Legal forms and other words that name no organisation, and kinds of firms with their short forms.
LEGAL = set("llc inc incorporated corp corporation co company ltd limited plc gmbh sa ag bv nv kg ohg srl sarl spa oy ab as pty llp lp the and und et y of formerly".split())
KINDS = """
processing: proc procg
telecom: tel telco telecommunications
business: bus biz
services: svcs srvcs serv svc
insurance: ins insur
agency: agcy agy
managed: mgd mngd
advisors: advs advisers adv
solutions: solns soln sols
networks: ntwks networks netw nwks
payroll: payr
partners: ptnrs partn
payments: pmts pymts
capital: cap captl
commerce: comm comrc
merchant: merch mercht
group: grp
point: pt
sale: sales
systems: sys syst
holdings: hldgs hldg
pos: pos
""".strip()
# First names with their short and other spellings.
ROOTS = """
margaret: maggie meg marge margie peggy greta; katherine: kate katie kathy kit katy kat catherine cathy cate; catherine: cathy cate kate cat katherine; elizabeth: liz lizzie beth betty eliza bess libby
robert: bob bobby rob robbie bert; william: bill billy will liam willy; richard: rick dick rich richie ricky; michael: mike mikey mick mickey; thomas: tom tommy; anthony: tony ant; edward: ed eddie ned ted teddy
alexander: alex xander sandy alec sasha lex; alexandra: alex sandra lexi sasha sandy alexa; aleksandr: sasha alexandr alex alexander sanya; samantha: sam sammie sammy; benjamin: ben benny benji; nathaniel: nate nathan nat
josephine: jo josie joey; jennifer: jen jenny jenn; deborah: deb debbie debby; patricia: pat patty trish tricia; victoria: vicky tori vic vickie; susannah: sue susie zanna susan suzy; isabella: bella izzy isa belle
theodore: ted teddy theo; frederick: fred freddie freddy fritz rick; bartholomew: bart barty; gregory: greg; leonard: leo len lenny; harold: hal harry; timothy: tim timmy; matthias: matt matze mathias matti
christopher: chris kit topher; maximilian: max maxi; cornelius: con corny neil; dorothea: dot dora dotty thea dorothy; augustina: tina gussie gus; henrietta: etta hettie hetty; philippa: pip pippa; rosalind: ros roz rosie
gwendolyn: gwen wendy gwenda; eleanor: ellie nora nell nellie ella; charlotte: lottie charlie lotte; cassandra: cass cassie sandra; jacqueline: jackie jacky jacqui; birgitta: birgit gitta britta; concepcion: concha conchita
guadalupe: lupe lupita; francisco: paco frank pancho fran francis; francois: frank francis; ignacio: nacho iggy; jose: pepe joe; jurgen: juergen; soren: soeren; zoe: zoey; lukasz: lucas lukas luke; yekaterina: ekaterina katya katia katja kate
dmitri: dima mitya dmitry dimitri; mohammed: mo muhammad mohamed mohammad; abdullah: abdul abdallah; lakshmi: laxmi; priyanka: priya; ananda: nanda; oluwaseun: seun; chukwuemeka: emeka chuka; xiaoming: xiao ming; hiroshi: hiro
""".strip()


def roots_of(table: str) -> dict[str, list[str]]:
    """Roots of every form in a table of "root: form form; root: form"."""
    out: dict[str, set[str]] = {}
    for entry in (x for line in table.splitlines() for x in line.split("; ")):
        root, forms = entry.split(": ")
        for f in (root, *forms.split()):
            out.setdefault(f, set()).add(root)
    for root in {r for rs in out.values() for r in rs}:
        out[root] = {root}
    return {f: sorted(r) for f, r in out.items()}


# ------------------------------------------------------------------ organisations
class Companies:
    """Rewrites company names: core words, kind, and whether two names mean one organisation."""

    def __init__(self):
        self.kind = {}
        for line in KINDS.splitlines():
            full, _, short = line.partition(": ")
            for w in (full, *short.split()):
                self.kind[w] = full
        self.near: dict[str, set[str]] = {}
        for w in {v for v in self.kind.values() if len(v) >= 5}:
            for x in deletions(w, 2):
                self.near.setdefault(x, set()).add(w)
        self.memo: dict[str, str | None] = {}

    def kind_of(self, word: str) -> str | None:
        """The kind word that a word is, or is a slip of; looked up by its own deletions, once per word."""
        if word in self.memo:
            return self.memo[word]
        got = self.kind.get(word)
        if got is None and 4 <= len(word) <= 14:
            near = set().union(*(self.near.get(x, ()) for x in deletions(word, 2)))
            got = min((w for w in near if abs(len(w) - len(word)) <= 2 and weighted_distance(word, w, 2) <= (1 if len(w) < 7 else 2)), default=None)
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = got
        return got

    def parse(self, name: str) -> tuple[list[str], str]:
        """Core words in their order and the kind (sorted words, '' if the name has none)."""
        text = re.sub(r"\(\s*(?:formerly|ex|vormals|previously)\b.*$", " ", name.lower())
        text = re.sub(r"\bp\.?\s*o\.?\s*s\b\.?|\bpoint[\s_-]+of[\s_-]+sale\b", " pos ", re.sub(r"\bs\.\s?a\b\.?", " ", text))
        core, kinds, skip = [], [], 0
        words = [w for w in re.findall(r"[^\W_]+", text) if w not in LEGAL]
        for at, w in enumerate(words):
            if at < skip:
                continue
            k = self.kind_of(w)
            if k == "point":
                # The words after it may be slips of "of sale".
                rest = words[at + 1 : at + 3]
                n = next((i for i, x in enumerate(rest) if len(x) <= 6 and weighted_distance(x, "sale", 2) <= 2), None)
                if n is not None and all(len(x) <= 3 for x in rest[:n]):
                    k, skip = "pos", at + n + 2
            if k is None:
                core.append(w)
            else:
                kinds.append(k)
        if {"point", "sale"} <= set(kinds):
            kinds = [k for k in kinds if k not in ("point", "sale")] + ["pos"]
        if not core and kinds:
            core, kinds = kinds, []
        return core, " ".join(sorted(set(kinds)))


def kinds_agree(a: Column, b: Column) -> Column:
    """Equal kinds, or one missing or part of the other."""
    return (a == b) | (a == "") | (b == "") | (F.size(F.array_except(F.split(a, " "), F.split(b, " "))) == 0) | (F.size(F.array_except(F.split(b, " "), F.split(a, " "))) == 0)


def starts_of(words: Column, kind: Column) -> Column:
    """Sorted first letters of the core words and of the kind's words, as an acronym would have them."""
    core = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    own = F.when(kind == "pos", "pos").otherwise(F.array_join(F.transform(F.split(kind, " "), lambda w: F.substring(w, 1, 1)), ""))
    return F.array_join(F.array_sort(F.split(F.concat(core, own), "")), "")


def same_employer(a: str, b: str) -> Column:
    """Whether two parsed names (structs of core, kind, words) of one source mean one organisation.

    Cores may differ by a slip or two per word and by word order; an initial or an acronym may stand for the words.
    """
    c1, c2, w1, w2 = (F.col(x) for x in (f"{a}.core", f"{b}.core", f"{a}.words", f"{b}.words"))
    k1, k2 = F.col(f"{a}.kind"), F.col(f"{b}.kind")
    n = F.least(F.length(c1), F.length(c2))
    most = F.when(n >= 14, 4).when(n >= 10, 3).otherwise(1)
    turned = (F.size(w2) == 2) & (F.levenshtein(c1, F.concat(F.get(w2, 1), F.get(w2, 0))) <= most)
    one = lambda x, y: (F.length(F.get(x, 0)) == 1) & (F.get(x, 0) == F.substring(F.get(y, 0), 1, 1)) & (F.levenshtein(F.get(x, 1), F.get(y, 1)) <= 2)
    initial = (F.size(w1) == 2) & (F.size(w2) == 2) & (one(w1, w2) | one(w2, w1))
    short = lambda w, k, c, v, m: (F.size(w) == 1) & (k == "") & F.length(c).between(3, 6) & (F.size(v) >= 2) & (F.array_join(F.array_sort(F.split(c, "")), "") == starts_of(v, m))
    named = (c1 != "") & (c2 != "")
    return named & (short(w1, k1, c1, w2, k2) | short(w2, k2, c2, w1, k1) | (kinds_agree(k1, k2) & ((F.levenshtein(c1, c2) <= most) | turned | initial)))


def company_core(name: Column) -> Column:
    """Struct of core letters (words in order) and kind of a company name; empty for NULL and nameless values."""

    @F.pandas_udf("core string, kind string, words array<string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Companies()
        for s in batches:
            got = [c.parse(n) if n else ([], "") for n in s]
            yield pd.DataFrame({"core": ["".join(g[0]) for g in got], "kind": [g[1] for g in got], "words": [g[0] for g in got]})

    return parse(name)


def deletion_forms(text: Column, edits: int) -> Column:
    """The text and every rest of it after deleting one (or two) characters, as 64-bit hashes."""
    cut = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    one = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: cut(text, i))
    hashes = F.concat(F.array(F.xxhash64(text)), F.transform(one, lambda f: F.xxhash64(f)))
    if edits > 1:
        # Each rest is cut once and its second cuts go on from there; the last rest has none beyond its end.
        after = lambda t, i: F.transform(F.sequence(i + 1, F.length(t)), lambda j: F.xxhash64(cut(t, j)))
        hashes = F.concat(hashes, F.flatten(F.transform(F.slice(one, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0))), after)))
    return F.array_distinct(hashes)


def unbroadcast(df: DataFrame) -> DataFrame:
    """A side that is joined by sorting, at any session threshold: Catalyst's estimate of exploded rows is that of the
    rows before, so it would collect hundreds of variants of each name into the driver."""
    return df.hint("merge")


def same_organisations(names: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of different names, a < b, that mean one organisation, with the score of the link.

    names: distinct names with ``site`` (letters of the host, may be NULL). NULL, empty and nameless values pair with
    nothing. A form is an equi-join key: cores by their deletion variants, initials and acronyms with what the site's
    letters must agree in, so that no key is as common as an acronym alone.
    """
    d = names.where(F.col(name).isNotNull() & F.col(name).rlike("\\p{L}"))
    d = d if "p" in d.columns else d.withColumn("p", company_core(F.col(name)))
    d = written(d.select(F.col(name).alias("n"), "site", "p.core", "p.kind", "p.words").where("core <> ''"))
    cores = written(d.select("core", "words").groupBy("core").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("n")))
    total = F.lit(float(max(1, d.count())))
    rarity = lambda n: F.log2(total / n)
    turned = F.when(F.size("words") == 2, F.concat(F.get("words", 1), F.get("words", 0)))
    forms = F.filter(F.array_distinct(F.array(F.col("core"), turned)), lambda x: x.isNotNull())
    k = cores.select("core", F.explode(forms).alias("form")).where(F.length("form") >= 4)
    # Forms are small and their variants many: a fixed number of partitions keeps their making spread out.
    k = k.repartition(int(k.sparkSession.conf.get("spark.sql.shuffle.partitions")), "form")
    long, short = k.where(F.length("form") >= 10), k.where(F.length("form") < 10)
    keys = long.select("core", "form", F.explode(deletion_forms(F.col("form"), 2)).alias("key")).unionByName(
        short.select("core", "form", F.explode(deletion_forms(F.col("form"), 1)).alias("key"))
    )
    left, right = keys.select(F.col("core").alias("c1"), F.col("form").alias("f1"), "key"), keys.where("core = form").select(F.col("core").alias("c2"), "key")
    cores2 = written(left.join(unbroadcast(right), "key").where((F.col("c1") != F.col("c2")) & (F.levenshtein("f1", "c2") <= 4)).select("c1", "c2").distinct())
    cores2 = cores2.unionByName(cores2.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"))).distinct()
    cores2 = cores2.unionByName(cores.select(F.col("core").alias("c1"), F.col("core").alias("c2")))
    # The more common of two cores tells how rare their meeting is.
    cores2 = cores2.join(cores.select(F.col("core").alias("c1"), F.col("n").alias("n1")), "c1").join(cores.select(F.col("core").alias("c2"), F.col("n").alias("n2")), "c2")
    cores2 = cores2.select("c1", "c2", (rarity(F.greatest("n1", "n2")) - F.levenshtein("c1", "c2")).alias("score"))
    a = d.select(F.col("n").alias("a"), F.col("core").alias("c1"), F.col("kind").alias("k1"))
    b = d.select(F.col("n").alias("b"), F.col("core").alias("c2"), F.col("kind").alias("k2"))
    kinds = kinds_agree(F.col("k1"), F.col("k2"))
    pairs = written(a.join(cores2, "c1").join(b, "c2").where(kinds & (F.col("a") < F.col("b"))).select("a", "b", "score"))
    # Initials and acronyms: a form of few letters means one organisation only where one site, or one core, has it.
    full = d.where((F.size("words") == 2) & (F.length(F.get("words", 0)) > 1))
    letters = starts_of(F.col("words"), F.col("kind"))
    acronyms = d.where((F.size("words") == 1) & (F.col("kind") == "") & F.length("core").between(3, 6) & (F.upper("n") == F.col("n")))
    acronyms = acronyms.select(F.col("n").alias("a"), F.col("site").alias("s1"), F.array_join(F.array_sort(F.split("core", "")), "").alias("key"))
    spelled = full.select(F.col("n").alias("b"), F.col("core").alias("c2"), F.col("site").alias("s2"), letters.alias("key"))
    spelled = written(spelled.join(acronyms.select("key").distinct(), "key", "left_semi"))
    common = spelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # An acronym's site must be that of the spelled name, or within two letters of its core.
    on_site = acronyms.withColumn("s2", F.col("s1")).join(spelled, ["key", "s2"]).select("a", "b", "key")
    cut = lambda df, c: df.where(F.length(c) >= 3).withColumn("v", F.explode(deletion_forms(F.col(c), 2)))
    by_core = cut(acronyms.where("s1 <> ''"), "s1").join(unbroadcast(cut(spelled, "c2")), ["key", "v"]).where(F.levenshtein("s1", "c2") <= 2).select("a", "b", "key")
    by_letters = on_site.unionByName(by_core).distinct().join(common, "key").select("a", "b", rarity(F.col("n")).alias("score"))
    initials = d.where((F.size("words") == 2) & (F.length(F.get("words", 0)) == 1))
    initials = initials.select(F.col("n").alias("a"), F.col("site").alias("s1"), F.concat_ws("|", F.get("words", 0), F.get("words", 1), "kind").alias("key"))
    rewritten = full.select(F.col("n").alias("b"), F.col("core").alias("c2"), F.col("site").alias("s2"), F.concat_ws("|", F.substring(F.get("words", 0), 1, 1), F.get("words", 1), "kind").alias("key"))
    meanings = rewritten.groupBy("key").agg(F.count_distinct(F.substring("c2", 1, 3)).alias("meanings"), F.count(F.lit(1)).alias("n"))
    by_initial = initials.join(rewritten.join(meanings, "key"), "key").where((F.col("meanings") == 1) | (F.levenshtein("s1", "c2") <= 2) | (F.col("s1") == F.col("s2")))
    by_initial = by_initial.withColumn("score", rarity(F.col("n")))
    # On one site an initial or an acronym stands for any name of the site that starts with its letter.
    brief = acronyms.select("a", F.col("s1").alias("site")).unionByName(initials.select("a", F.col("s1").alias("site"))).where("site <> ''")
    by_site = brief.join(d.select(F.col("n").alias("b"), "site", "core"), "site").where(F.lower(F.substring("a", 1, 1)) == F.substring("core", 1, 1))
    of_site = d.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    by_site = by_site.join(of_site, "site").withColumn("score", rarity(F.col("n")))
    more = by_letters.unionByName(by_initial.select("a", "b", "score")).unionByName(by_site.select("a", "b", "score"))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a <> b")
    return pairs.unionByName(more).groupBy("a", "b").agg(F.max("score").alias("score"))


# ------------------------------------------------------------------ persons
SITE_PREFIX = "^(?:www\\d*|m|team|pay|north|south|east|west|shop|go|web|info)\\."


def site_letters(url: Column) -> Column:
    """Letters of the name part of a URL's host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "://([^/?#:]+)", 1)), SITE_PREFIX, "")
    return F.regexp_replace(F.regexp_extract(host, "([^.]+)\\.[^.]+$", 1), "[^a-z]", "")


def phone_line(phone: Column) -> Column:
    """Digits of a usable phone with its extension."""
    marked = phone.contains("x") | phone.contains("X")
    ext = F.when(marked, F.regexp_extract(phone, "(?i)(?:ext|x)\\.?\\s*(\\d+)\\s*$", 1)).otherwise("")
    digits = F.regexp_replace(F.when(marked, F.regexp_replace(phone, "(?i)\\s*(?:ext|x)\\.?\\s*\\d+\\s*$", "")).otherwise(phone), "\\D", "")
    return F.when(usable("phone", phone), F.concat(F.substring(digits, -10, 10), F.lit("x"), ext))


ROOT_OF = roots_of(ROOTS)
SOFT = str.maketrans("wczjyq", "vksiik")


PLAIN_NAME = re.compile(r"[^\W\d_][^\W\d_]+ [^\W\d_][^\W\d_]+$")
CAPS_NAME = re.compile(r"[A-Z]{3,}\b")
AROUND = re.compile(AROUND_NAME)
VOWELS, DOUBLED = re.compile("[aeiouh]"), re.compile(r"(.)\1+")


def bones_of(last: str) -> str:
    """Consonant skeleton of a surname: like-sounding letters alike, no vowels after the first letter, no doubles."""
    soft = last.translate(SOFT)
    return DOUBLED.sub(r"\1", soft[0] + VOWELS.sub("", soft[1:]))


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text).lower().replace("ł", "l").replace("ø", "o").replace("đ", "d")
    return "".join(c for c in t if not unicodedata.combining(c))


def person_parts(name: str, roots: dict[str, list[str]] = ROOT_OF) -> tuple[str | None, str | None, str | None, list[str]]:
    """First name, surname, consonant skeleton of the surname and initials of the first name's roots."""
    if PLAIN_NAME.match(name) and not CAPS_NAME.match(name):
        first, last = fold(name).split()
        return first, last, bones_of(last), sorted({first[0], *(r[0] for r in roots.get(first, ()))})
    text = AROUND.sub(" ", name)
    comma = "," in text and re.search(r",\s*[^\W\d_]", text)
    words = re.findall(r"[^\W_]+", fold(text))
    if len(words) < 2:
        return None, None, None, []
    plain = re.findall(r"[^\W\d_]+", text)
    if comma:
        n = min(len(re.findall(r"[^\W_]+", fold(text.split(",")[0]))), len(words) - 1)
        last, first = words[max(n, 1) - 1], words[max(n, 1)]
    elif len(plain) > 1 and len(plain[0]) > 2 and plain[0].isupper() and not plain[1].isupper():
        last, first = words[0], words[1]
    else:
        last, first = words[-1], words[0]
    if len(last) < 2:
        return None, None, None, []
    return first, last, bones_of(last), sorted({first[0], *(r[0] for r in roots.get(first, ()))})


def compatible(a: str, b: str, roots: dict[str, list[str]] = ROOT_OF) -> int:
    """1: two first names may be one (equal, a shared root, or a slip); 2: one is the other's initial; 0: neither."""
    ra, rb = roots.get(a, [a]), roots.get(b, [b])
    if set(ra) & set(rb):
        return 1
    if len(a) == 1 or len(b) == 1:
        return 2 if {x[0] for x in (a, *ra)} & {x[0] for x in (b, *rb)} else 0
    if a in roots and b in roots:
        return 0
    for x in (a, *ra):
        for y in (b, *rb):
            n = min(len(x), len(y))
            if not (x in roots and y in roots) and n >= 4 and weighted_distance(x, y, 3) <= (2.7 if n >= 6 else 1.7):
                return 1
    return 0


def person_names(df: DataFrame, name: str, roots: dict[str, list[str]] = ROOT_OF) -> DataFrame:
    """Add ``first``, ``last``, ``skeleton`` and ``starts`` of a personal name; all NULL without a surname.

    NULL, cut and placeholder names have no parts.
    """

    @F.pandas_udf("first string, last string, skeleton string, starts array<string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [person_parts(n, roots) if n else (None, None, None, []) for n in s]
            yield pd.DataFrame(got, columns=["first", "last", "skeleton", "starts"])

    good = F.col(name).isNotNull() & ~F.col(name).rlike(CUT) & ~residue(F.col(name))
    return df.withColumn("__p", parse(F.when(good, F.col(name)))).select("*", "__p.*").drop("__p")


def firm_of(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames: records with ``employed`` (their company is their source's) and ``differs`` (it is written otherwise);
    and records with ``firm``: letters of the address's domain, else of the company, else of the source's company.

    A company's letters count as those of the most frequent company within one deletion, so single typos meet.
    """
    domain = F.regexp_replace(F.regexp_extract(F.lower("email"), "@(?:.*\\.)?([^.@]+)\\.[a-z]+$", 1), "[^a-z]", "")
    d = records.withColumn("mail", F.when(usable("email", F.col("email")), F.lower(F.trim("email")))).withColumn("domain", F.when(F.col("mail").isNotNull(), domain))
    own = sources.select("source_id", F.col("company").alias("own_name"), F.col("p").alias("own"))
    # A company written as its source's was parsed with it.
    named = d.join(small(own), "source_id", "left")
    named = named.withColumn("p", company_core(F.when(~F.col("company").eqNullSafe(F.col("own_name")), F.col("company"))))
    named = named.withColumn("p", F.when(F.col("company") == F.col("own_name"), F.col("own")).otherwise(F.col("p")))
    named = written(named.select(
        "record_id", "lead_id", "source_id", "name", "phone", "mail", "domain", F.col("p.core").alias("core"), F.col("own.core").alias("own_core"), (F.col("company") != F.col("own_name")).alias("differs"),
        F.coalesce(F.col("own").isNotNull() & ((F.col("company") == F.col("own_name")) | same_employer("own", "p")), F.lit(False)).alias("employed"),
    ))
    counts = named.where("core <> ''").groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", "core")
    variants = counts.where(F.length("core") >= 8).select("core", "n", F.explode(deletion_forms(F.col("core"), 1)).alias("key"))
    best = variants.groupBy("key").agg(F.max(rank).alias("b"))
    canon = variants.join(unbroadcast(best), "key").groupBy("core").agg(F.max("b").alias("c"))
    canon = written(canon.select("core", F.col("c.core").alias("canonical"), F.col("c.n").alias("n")))
    # Where a company is its source's, the more frequent of the two canonical cores counts.
    owned = sources.select("source_id", F.col("p.core").alias("core")).join(canon, "core").select("source_id", F.col("canonical").alias("own_canonical"), F.col("n").alias("own_n"))
    known, named = named, named.select("lead_id", "source_id", "name", "phone", "mail", "domain", "core", "own_core", "employed")
    named = named.join(canon, "core", "left").join(small(owned), "source_id", "left")
    own_too = F.coalesce(F.col("own_n") > F.coalesce("n", F.lit(0)), F.lit(False)) & F.col("employed")
    given = [F.when(F.col("domain") != "", F.col("domain")), F.when(own_too, F.col("own_canonical")), *(F.when(F.col(c) != "", F.col(c)) for c in ("canonical", "core", "own_canonical", "own_core"))]
    return known, named.withColumn("firm", F.coalesce(*given))


def same_persons(people: DataFrame, group: str, roots: dict[str, list[str]] = ROOT_OF) -> DataFrame:
    """Pairs (a, b), a < b, of groups (leads) that are one person, with the score of the link: the rarity of its evidence.

    people: group, first, last, skeleton, starts, firm, line (phone), mail. Two names are variants if their first names
    share a root or differ by a slip, or one is the other's initial, and their surnames differ by at most a slip or two.
    Variants are one person if they share the firm, or a phone line or an address; an initial needs the latter. All
    rows of a group tell its firms, lines and addresses, also those without a surname.
    """
    # Every firm, line and address of a group is evidence for each of its names, also from records without a whole name.
    kinds = F.array(*(F.struct(F.lit(c[0]).alias("e"), F.col(c).alias("v")) for c in ("firm", "line", "mail")))
    evidence = people.select(group, F.inline(kinds)).where("v IS NOT NULL").distinct()
    # Only values that several groups have can be evidence; the others make no forms.
    several = evidence.groupBy("e", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    evidence = evidence.join(unbroadcast(several), ["e", "v"])
    names = people.where("last IS NOT NULL").select(group, "first", "last", "skeleton", "starts").distinct()
    # Initials of all roots count inside a firm, so that nicknames with another first letter meet.
    values = F.when(F.col("e") == "f", F.transform("starts", lambda x: F.concat_ws("|", "v", x))).otherwise(F.array("v"))
    forms = names.join(unbroadcast(evidence), group).withColumn("x", F.explode(values))
    forms = forms.withColumn("k", F.explode(deletion_forms(F.col("skeleton"), 1)))
    forms = written(forms.select(group, "first", "last", "e", F.col("m").cast("int").alias("m"), F.xxhash64("e", "x", "k").alias("key")))
    a, b = (forms.select(F.col(group).alias(x), F.col("first").alias(f"f{x}"), F.col("last").alias(f"l{x}"), F.col("e").alias(f"e{x}"), F.col("m").alias(f"m{x}"), "key") for x in "ab")
    near = F.levenshtein("la", "lb") <= F.when(F.least(F.length("la"), F.length("lb")) >= 6, 3).otherwise(1)
    p = a.join(unbroadcast(b), "key").where((F.col("a") < F.col("b")) & (F.col("ea") == F.col("eb")) & near).select("a", "b", "fa", "fb", "ea", "ma").groupBy("a", "b", "fa", "fb", "ea").agg(F.min("ma").alias("m"))

    @F.pandas_udf("int")
    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[tuple[str, str], int] = {}
        for x, y in batches:
            out = []
            for k in zip(x, y):
                v = memo.get(k)
                if v is None:
                    v = memo[k] = compatible(*k, roots)
                    if len(memo) > 500_000:
                        memo.clear()
                out.append(v)
            yield pd.Series(out, dtype="int32")

    p = p.withColumn("c", first("fa", "fb")).where((F.col("c") == 1) | ((F.col("c") == 2) & (F.col("ea") != "f")))
    total = F.lit(float(max(2, people.select(group).distinct().count())))
    return p.groupBy("a", "b").agg(F.log2(total / F.min("m")).alias("score"))


@query("p7_found")
def p7_found(spark, sf_dir):
    """Leads of one person, sources of one organisation, and records whose company is their source's."""
    sources = table(spark, sf_dir, "sources").select("source_id", "company", site_letters(F.col("url")).alias("site")).where(F.col("company").rlike("\\S"))
    sources = written(sources.withColumn("p", company_core(F.col("company"))))
    records = spread(table(spark, sf_dir, "records").select("record_id", "lead_id", "source_id", "name", "company", "email", "phone"))
    names = sources.groupBy("company").agg(F.max("site").alias("site"), F.first("p").alias("p"))
    pairs = written(same_organisations(names, "company").select("a", "b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    s1, s2 = sources.select(F.col("source_id").alias("id_a"), F.col("company").alias("a")), sources.select(F.col("source_id").alias("id_b"), F.col("company").alias("b"))
    # Each result is written on its own: one plan over all three would be replanned whole after every stage.
    orgs = written(pairs.join(s1, "a").join(s2, "b").where("id_a < id_b").select(F.lit("org").alias("kind"), "id_a", "id_b").distinct())

    known, firms = firm_of(records, sources)
    both = known.where("employed AND differs")
    employers = written(both.select(F.lit("employer").alias("kind"), F.col("source_id").alias("id_a"), F.col("record_id").alias("id_b")))
    people = person_names(firms.select("lead_id", "name", "phone", "mail", "firm"), "name").withColumn("line", phone_line(F.col("phone")))
    people = written(people.drop("name", "phone"))
    persons = written(same_persons(people, "lead_id").select(F.lit("person").alias("kind"), F.col("a").alias("id_a"), F.col("b").alias("id_b")))
    return persons.unionByName(orgs).unionByName(employers)


@query("p7_links")
def p7_links(spark, sf_dir):
    """Links between spellings of organisations with their scores, and how many links each of the two spellings has."""
    sources = table(spark, sf_dir, "sources").select("company", site_letters(F.col("url")).alias("site")).where(F.col("company").rlike("\\S"))
    links = written(same_organisations(sources.groupBy("company").agg(F.max("site").alias("site")), "company"))
    degree = links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    one = lambda x: degree.select(F.col("n").alias(x), F.col("d").alias(f"links_{x}"))
    return links.join(one("a"), "a").join(one("b"), "b").select("a", "b", F.round("score", 3).alias("score"), "links_a", "links_b")
