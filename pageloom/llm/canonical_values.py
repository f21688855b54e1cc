"""Mapping free-entered values to a canonical list with a broadcast symmetric-delete dictionary.

The distinct values are counted with map-side combining, mapped once each in an Arrow UDF and joined back to their
rows. The dictionary holds every word of the list's labels, codes and known other names together with all its
deletion variants up to its edit bound, so that a word is looked up by its own deletions and a beginning in the sorted
words, never against the whole list. Initials are derived from the labels: of a whole label and of any run of its words.
Candidates are verified and ranked by a weighted Damerau-Levenshtein distance (doubled letters, swaps and neighbouring
keys cost less), entries by the words they cover, then by their frequency as exact values. Names that no rule gives
(synonyms) are no part of the operator: they come in an optional table of aliases.

The list is collected to the driver in blocks of at most BLOCK_ENTRIES entries, each broadcast on its own; a longer
list is served block by block and the best of all blocks wins. What a block needs to know of the others (which words the
whole list holds, how many entries begin with a word) goes with it, so the number of blocks changes no result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.registry import query
from pageloom.session import BROADCAST_BYTES, table

BLOCK_ENTRIES = 20_000

# Written short forms of single words.
SHORT = """
account: acct accts ac a/c acc accnt accounts
executive: exec execs
manager: mgr mngr mgmt
senior: sr snr sen
representative: rep repr reps
sales: sls sale's sale
director: dir
vice president: vp v.p
president: pres
revenue: rev
engineer: eng engr
business: biz bus
development: dev devel devt
consultant: cons consult cnslt
specialist: spec splst specialists
officer: off ofcr offr
merchant: merch
services: svcs srvcs serv svc srvs service
payments: payment pymts pmts
advisor: adviser advisers
point: pt
insurance: ins insur
commercial: comm comml comm'l
telecom: tel telco telecommunications telecoms telephony
solutions: solution solns soln
customer: cust
relations: rel relation
coordinator: coord co-ordinator coordinators
territory: terr
program: prog programme
franchise: franch
marketing: mktg
operations: ops
analyst: anlst
underwriting: uw
associate: assoc
branch: br
administrator: admin
general: gen
managing: mng mging
partner: ptnr partnership
technical: tech
human: hum
resources: res resource
regional: reg regl
district: dist
channel: chnl
independent: indep freelance
procurement: purchasing
key: ky
and: & + n
equipment: equip
systems: sys system
technology: technologies
brokerage: brokering brokers broker
managed: mgd
""".strip()

# Synonyms of the labels of this project's lists, which no rule derives; the table that p1_found passes.
SYNONYMS = """
Account Manager: client account manager
Sales Representative: salesperson; sales person; salesman
Outside Sales Representative: outside sales; outside representative
Inside Sales Representative: inside sales; inside representative
Customer Success Manager: csm
Merchant Services Consultant: merchant consultant
Point of Sale Specialist: pos specialist
Sales Engineer: presales engineer; pre sales engineer
Onboarding Specialist: on boarding specialist; merchant onboarding
Partner Manager: partnerships manager
Merchant services: card processing; payment processing; payments processing; credit card acquiring; card acquiring; merchant acquiring
Point of sale: till systems; cash register vendors; tills; epos
Payroll & HR: payroll services; wages human resources; human resources pay; payroll bureau; payroll
Business funding: funding; merchant cash advance; working capital; small business loans; business loans
Business telecom: telecom; business telephony; internet phone firms; voip providers; voip; phone internet
IT & managed services: it services; msp; outsourced it; information technology services; it support; managed it
Business insurance: insurance; commercial insurance; liability cover; insurance brokers; commercial lines
Equipment leasing: equipment; lease equipment; machinery leasing; gear rental; gear rental firms; equipment lease
Alarm and security: security; site security; burglar alarms; alarm systems; alarms; alarm; cctv installers; cctv
Energy brokerage: energy; electricity brokers; utility brokering; gas power broker; energy procurement; energy broker
Shipping and logistics: logistics; freight; 3pl; haulage delivery; parcel carriers; shipping
Marketing agency: marketing; ad agency; digital advertising firm; advertising; advertising agency; promotions agency
Commercial cleaning: cleaning; janitorial; office cleaners; contract cleaning
Print and signage: printing; sign makers; banners signs; print; signage
""".strip()

# Words a label may lack, stand-ins for a missing value, additions that are no part of a title, keys.
OPTIONAL = {"of", "and", "the", "for", "in", "a", "an", "to", "at"}
STAND_INS = {"n a", "na", "tbd", "tba", "none", "see profile", "see notes", "to be announced", "not listed", "unknown", "xx", "xxx", "see site", "nil", "null"}
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR = {a: {KEYS[r + dr][c + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and 0 <= r + dr < 3 and 0 <= c + dc < len(KEYS[r + dr])} for r, row in enumerate(KEYS) for c, a in enumerate(row)}

#: Distinct words (with short forms) of a whole list, 8 bytes each, that may go with a block.
MOST_KNOWN = BROADCAST_BYTES // 8
#: Tokens that a worker remembers.
MEMO = 200_000
#: Edits allowed for a word of the list, by its length.
BOUNDS = ((8, 3), (6, 2), (3, 1))


def bound(word: str) -> int:
    """Edits that a word of the list may differ by; digits never differ."""
    return 0 if any(c.isdigit() for c in word) else next((e for n, e in BOUNDS if len(word) >= n), 0)


def weighted_distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions), or infinity beyond ``most``."""
    n = len(b)
    before, row = None, [float(j) for j in range(n + 1)]
    for j in range(1, n + 1):
        row[j] = row[j - 1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i, x in enumerate(a, 1):
        new = [row[0] + (0.6 if i > 1 and x == a[i - 2] else 1.0)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.8 if y in NEAR.get(x, ()) else 1.0
            best = min(row[j - 1] + cost, row[j] + (0.6 if i > 1 and x == a[i - 2] else 1.0), new[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, before[j - 2] + 0.8)
            new.append(best)
        if min(new) > most:
            return float("inf")
        before, row = row, new
    return row[n]


def deletions(word: str, edits: int) -> set[str]:
    """The word and everything left of it after deleting up to ``edits`` characters."""
    out = {word}
    for k in range(1, min(edits, len(word) - 1) + 1):
        out.update(map("".join, combinations(word, len(word) - k)))
    return out


def plain(text: str) -> str:
    """Lower-case text without accents, escapes and invisible characters."""
    t = unicodedata.normalize("NFKD", text.replace("&amp;", "&"))
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()


def tokens(text: str) -> list[str]:
    """Words of a value: letters and digits; apostrophes and the slash of a/c join, runs of single letters are one word."""
    t = re.sub(r"\ba\s*/\s*c\b", "acct", plain(text))
    t = re.sub(r"\bn\s*/\s*a\b", "n a", t).replace("'", "").replace("’", "")
    got = re.findall(r"[^\W_]+|[&+]", t)
    out: list[str] = []
    run = ""
    for w in [*got, ""]:
        if len(w) == 1 and w.isalpha() and w.isascii():
            run += w
            continue
        if run:
            out.extend([run] if len(run) > 1 else [run])
            run = ""
        if w:
            out.append("and" if w in "&+" else w)
    return out


def short_forms() -> dict[str, str]:
    """Full words by short form."""
    lines = (line.partition(": ") for line in SHORT.splitlines())
    return {f.replace("/", "").replace("'", ""): full for full, _, forms in lines for f in forms.split()}


SHORT_OF = short_forms()


def full_words(ts: list[str]) -> list[str]:
    return [w for t in ts for w in SHORT_OF.get(t, t).split()]


def initials_of(words: list[str]) -> dict[str, tuple[str, ...]]:
    """Initials of every run of two words or more of a label, with and without the words it may lack, and what they stand for."""
    out: dict[str, tuple[str, ...]] = {}
    for own in (words, [w for w in words if w not in OPTIONAL]):
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                run = own[i:j]
                if run[0] not in OPTIONAL and run[-1] not in OPTIONAL:
                    out["".join(w[0] for w in run)] = tuple(w for w in run if w not in OPTIONAL)
    return {k: v for k, v in out.items() if k.isalpha() and len(v) > 1}


def parsed(entries: list[tuple[int, str, list[str]]], aliases: dict[str, list[str]]) -> Iterator[tuple[int, str, list[str], tuple[str, ...]]]:
    """(ref_id, field, words, needed words) of every name of the entries, their aliases (by lower-case label) included."""
    for ref_id, field, names in entries:
        for name in [n for own in names for n in (own, *aliases.get(own.lower(), ()))]:
            seq = full_words(tokens(name))
            if seq:
                yield ref_id, field, seq, tuple(w for w in seq if w not in OPTIONAL) or tuple(seq)


def known_forms(entries: list[tuple[int, str, list[str]]], aliases: dict[str, list[str]]) -> set[int]:
    """Hashes of (field, form) of all words of the entries and of their short forms."""
    words: dict[str, set[str]] = {}
    for _, field, _, need in parsed(entries, aliases):
        words.setdefault(field, set()).update(need)
    for ws in words.values():
        ws.update(f for f, full in SHORT_OF.items() if all(w in ws for w in full.split()))
    return {form_hash(field, w) for field, ws in words.items() for w in ws}


def form_hash(field: str, form: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(f"{field}\x1f{form}"), "big", signed=True)


class Dictionary:
    """The symmetric-delete index of one block of a canonical list and the mapping of values to its entries."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], frequency: dict[int, int], aliases: dict[str, list[str]] | None = None, known: np.ndarray | None = None, firsts: dict[tuple[str, str], int] | None = None):
        """entries: (ref_id, field, names); frequency: exact occurrences by ref_id; aliases: further names by lower-case label.

        known (sorted hashes of the forms of the whole list) and firsts (entries that begin with a word) are those of
        the entries themselves if they aren't given.
        """
        aliases = aliases or {}
        self.frequency = frequency
        self.known = np.array(sorted(known_forms(entries, aliases)), dtype="int64") if known is None else known
        self.phrases: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        self.exact: dict[tuple[str, str], int] = {}
        self.initials: dict[str, dict[str, set[tuple[str, ...]]]] = {}
        vocabulary: dict[str, set[str]] = {}
        first: dict[tuple[str, str], set[int]] = {}
        for ref_id, field, seq, need in parsed(entries, aliases):
            self.phrases.setdefault(field, []).append((ref_id, need))
            key = (field, " ".join(sorted(need)))
            self.exact[key] = max(ref_id, self.exact.get(key, ref_id), key=self.order)
            vocabulary.setdefault(field, set()).update(need)
            first.setdefault((field, need[0]), set()).add(ref_id)
            for k, run in initials_of(seq).items():
                self.initials.setdefault(field, {}).setdefault(k, set()).add(run)
        self.firsts = {k: len(v) for k, v in first.items()} if firsts is None else firsts
        self.vocabulary = vocabulary
        self.sorted = {f: sorted(ws) for f, ws in vocabulary.items()}
        self.index: dict[str, dict[str, list[tuple[str, str, int]]]] = {}
        for field, words in vocabulary.items():
            index = self.index.setdefault(field, {})
            forms = {w: w for w in words} | {s: f for s, f in SHORT_OF.items() if all(x in words for x in f.split())}
            for form, full in forms.items():
                for d in deletions(form, bound(form)):
                    index.setdefault(d, []).append((form, full, bound(form)))
        self.longest = max((len(f) for ix in self.index.values() for f in ix), default=0)
        # Entries by their words, so that a value meets only entries of which it may hold a word.
        self.holding: dict[str, dict[str, list[int]]] = {f: {} for f in self.phrases}
        for field, ps in self.phrases.items():
            for k, (_, need) in enumerate(ps):
                for w in set(need):
                    self.holding[field].setdefault(w, []).append(k)
        self.memo: dict[tuple[str, str], dict[str, float]] = {}

    def order(self, ref_id: int) -> tuple[int, int]:
        """Greater for the entry that a tie goes to: the more frequent, then the smaller id."""
        return self.frequency.get(ref_id, 0), -ref_id

    def is_known(self, field: str, token: str) -> bool:
        """Whether the whole list holds a token as a word or a short form."""
        h = form_hash(field, token)
        at = int(np.searchsorted(self.known, h))
        return at < len(self.known) and int(self.known[at]) == h

    def beginning(self, field: str, text: str) -> list[str]:
        """Words that begin with a text, by a search in the sorted words."""
        words = self.sorted.get(field, [])
        at, out = bisect_left(words, text), []
        while at < len(words) and words[at].startswith(text):
            out.append(words[at])
            at += 1
        return out

    def candidates(self, field: str, token: str) -> dict[str, float]:
        """Words of the list that a token may stand for, with the weighted distance."""
        got = self.memo.get((field, token))
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got, index, words = {}, self.index.get(field, {}), self.vocabulary.get(field, ())
            for w in (token, *SHORT_OF.get(token, "").split()):
                if w in words:
                    got[w] = 0.0
            for run in self.initials.get(field, {}).get(token, ()):
                for w in run if len(run) == len(token) else ():
                    got[w] = min(got.get(w, 9.0), 0.1)
            if 2 <= len(token) <= self.longest + 3 and token.isalpha() and token not in OPTIONAL:
                known, near = 0.25 if self.is_known(field, token) else 0.0, set()
                for d in deletions(token, 3 if len(token) > 6 else 2 if len(token) > 4 else 1):
                    near.update(index.get(d, ()))
                for form, full, most in near:
                    if abs(len(form) - len(token)) > most or form == token:
                        continue
                    x = weighted_distance(token, form, most)
                    if x <= most and x <= 0.45 * len(form):
                        for w in full.split():
                            got[w] = min(got.get(w, 9.0), 0.15 + known + x / max(4, len(form)) + (0.1 if form != w else 0))
                if len(token) >= 4:
                    for w in self.beginning(field, token):
                        if len(w) > len(token) + 1:
                            got[w] = min(got.get(w, 9.0), 0.5)
            if not got:
                # Initials with the letter of an "and" or "of" count where a token is no slip of a word.
                got = {w: 0.1 for run in self.initials.get(field, {}).get(token, ()) for w in run}
            self.memo[(field, token)] = got
        return got

    def exactly(self, field: str, ts: list[str]) -> int | None:
        """The entry whose words the tokens are, in any order, short forms and one token's initials written out."""
        key = lambda ws: (field, " ".join(sorted(w for w in ws if w not in OPTIONAL)))
        found = [self.exact.get(key(full_words(ts)))]
        for i, t in enumerate(ts):
            for run in self.initials.get(field, {}).get(t, ()):
                found.append(self.exact.get(key([*full_words(ts[:i]), *run, *full_words(ts[i + 1 :])])))
        found = [f for f in found if f is not None]
        # As written comes before initials written out.
        return found[0] if self.exact.get(key(full_words(ts))) is not None else max(found, key=self.order, default=None)

    def map(self, field: str, value: str) -> tuple[int, float]:
        """(ref_id, score) of the entry meant; (0, 0) if none fits."""
        ts = tokens(value)
        joined = " ".join(ts)
        if not ts or joined in STAND_INS or not any(c.isalpha() for c in joined) or field not in self.phrases:
            return 0, 0.0
        if (exact := self.exactly(field, ts)) is not None:
            return exact, 99.0
        units = ts + [a + b for a, b in zip(ts, ts[1:]) if len(a) > 1 or len(b) > 1]
        cut = bool(re.search(r"(?:…|\.\.\.?)\W*$", value.strip()))
        found = [self.candidates(field, t) for t in units]
        if cut:
            last = dict(found[len(ts) - 1])
            for w in self.beginning(field, ts[-1]):
                last[w] = min(last.get(w, 9.0), 0.2)
            found[len(ts) - 1] = last
        by_word: dict[str, list[tuple[float, int]]] = {}
        for i, c in enumerate(found):
            for w, x in c.items():
                by_word.setdefault(w, []).append((x + (0.05 if i >= len(ts) else 0), i))
        best: tuple[float, int, int] | None = None
        held: dict[int, int] = {}
        for w in by_word:
            for k in self.holding[field].get(w, ()):
                held[k] = held.get(k, 0) + 1
        for k, n_held in held.items():
            ref_id, need = self.phrases[field][k]
            if n_held < len(set(need)) and not (cut and len(need) > 1):
                continue
            used: set[int] = set()
            cost, missing = 0.0, 0
            for w in sorted(need, key=lambda w: len(by_word.get(w, ()))):
                at = next(((x, i) for x, i in sorted(by_word.get(w, ())) if i not in used or " " in SHORT_OF.get(units[i], "") or units[i] in self.initials.get(field, ())), None)
                if at is None:
                    missing += 1
                else:
                    cost += at[0]
                    used.add(at[1])
            if missing:
                # Only the end of a cut value may lack: the words present must be the first words of the entry.
                n = len(need) - missing
                if not cut or n < 1 or n < len(need) - 1 or any(w not in by_word for w in need[:n]) or (n == 1 and self.firsts.get((field, need[0]), 1) > 1):
                    continue
                cost += 0.5
            if len(need) == 1 and cost > (0.45 if len(need[0]) > 3 else 0):
                continue
            if cost > 0.42 * len(need) + 0.1:
                continue
            spare = sum(1 for i, t in enumerate(ts) if i not in used and t not in OPTIONAL and (self.is_known(field, t) or any(self.is_known(field, w) for w in SHORT_OF.get(t, "").split())))
            score = (len(need) - missing) - 0.9 * cost - 0.35 * spare
            if score < 0.3:
                continue
            rank = (score, self.frequency.get(ref_id, 0), -ref_id)
            if best is None or rank > best:
                best = rank
        return (-best[2], best[0]) if best else (0, 0.0)


def alias_table(spark: SparkSession) -> DataFrame:
    """label, alias: the synonyms of this project's lists as a table."""
    lines = (line.partition(": ") for line in SYNONYMS.splitlines())
    return spark.createDataFrame([(label, a.strip()) for label, _, names in lines for a in names.split(";")], "label string, alias string")


def map_values(values: DataFrame, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """ref_id for every distinct (field_name, value); 0 where no entry of the field's list fits.

    values: field_name, value, n (occurrences). reference: ref_id, field_name, code, label. aliases: label, alias, other
    names of entries. NULL and blank values are left out; an empty list maps everything to 0; very long values are
    looked up whole; ties go to the more frequent, then to the smaller entry.
    """
    values = values.where(F.col("value").isNotNull() & F.col("value").rlike("[^\\s\\u00a0\\u200b]"))
    spark = values.sparkSession
    total = reference.count()
    blocks = max(1, -(-total // BLOCK_ENTRIES))
    numbered = reference.withColumn("__block", F.pmod(F.xxhash64("ref_id"), F.lit(blocks)))
    counted = values.join(
        reference.select("ref_id", "field_name", F.explode(F.array_distinct(F.array("label", F.coalesce("code", "label")))).alias("value")), ["field_name", "value"],
    ).groupBy("ref_id").agg(F.sum("n").alias("n"))
    if aliases is not None:
        names = aliases.groupBy(F.lower("label").alias("__label")).agg(F.collect_set("alias").alias("names"))
        numbered = numbered.join(names, F.lower("label") == F.col("__label"), "left")
    else:
        numbered = numbered.withColumn("names", F.array().cast("array<string>"))

    def block(b: int):
        rows = numbered.where(F.col("__block") == b).join(counted, "ref_id", "left").select("ref_id", "field_name", "code", "label", "n", "names").collect()
        entries = [(r.ref_id, r.field_name, [x for x in (r.label, (r.code or "").replace("_", " ")) if x]) for r in rows]
        return entries, {r.ref_id: r.n or 0 for r in rows}, {r.label.lower(): sorted(r.names) for r in rows if r.label and r.names}

    known, firsts = None, None
    if blocks > 1:
        # Two passes over the blocks: first what each must know of all, then the lookups.
        forms, begin = np.array([], dtype="int64"), Counter()
        for b in range(blocks):
            entries, _, more = block(b)
            forms = np.union1d(forms, np.array(sorted(known_forms(entries, more)), dtype="int64"))
            begin.update({(f, need[0], r) for r, f, _, need in parsed(entries, more)})
            if len(forms) > MOST_KNOWN:
                raise ValueError(f"the list has more than {MOST_KNOWN} distinct words: split it by field or topic")
        known, firsts = forms, Counter((f, w) for f, w, _ in begin)
    # Few values are left once they are distinct; they are dealt out to all cores, whatever their number.
    wanted = values.select("field_name", "value").repartition(spark.sparkContext.defaultParallelism)
    best = None
    for b in range(blocks):
        entries, frequency, more = block(b)
        mine = None if firsts is None else {(f, need[0]): firsts[(f, need[0])] for _, f, _, need in parsed(entries, more)}
        given = spark.sparkContext.broadcast((entries, frequency, more, known, mine))

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            d = Dictionary(*given.value)
            for pdf in batches:
                got = [d.map(f, v) for f, v in zip(pdf["field_name"], pdf["value"])]
                yield pd.DataFrame({"field_name": pdf["field_name"], "value": pdf["value"], "ref_id": [g[0] for g in got], "score": [float(g[1]) for g in got], "n": [d.frequency.get(g[0], 0) for g in got]})

        part = wanted.mapInPandas(run, "field_name string, value string, ref_id long, score double, n long")
        best = part if best is None else best.unionByName(part)
    if blocks > 1:
        best = best.groupBy("field_name", "value").agg(F.max_by("ref_id", F.struct("score", "n", -F.col("ref_id"))).alias("ref_id"))
    return best.select("field_name", "value", "ref_id")


def typed_values(spark, sf_dir) -> DataFrame:
    """field_name, row_id, value of the free-typed columns."""
    titles = table(spark, sf_dir, "records").select(F.lit("title").alias("field_name"), F.col("record_id").alias("row_id"), F.col("title").alias("value"))
    kinds = table(spark, sf_dir, "sources").select(F.lit("category").alias("field_name"), F.col("source_id").alias("row_id"), F.col("category").alias("value"))
    return titles.unionByName(kinds).where(F.col("value").rlike("[^\\s\\u00a0\\u200b]"))


@query("p1_found")
def p1_found(spark, sf_dir):
    """The entry meant by every typed title and category that is not an entry letter for letter; 0 if none fits."""
    reference = table(spark, sf_dir, "reference_values")
    rows = typed_values(spark, sf_dir)
    values = rows.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    mapped = map_values(values, reference, alias_table(spark))
    exact = reference.select("field_name", F.explode(F.array("label", "code")).alias("value")).where(F.col("value").isNotNull()).distinct()
    open_ = mapped.join(F.broadcast(exact) if reference.count() <= BLOCK_ENTRIES else exact, ["field_name", "value"], "left_anti")
    return rows.join(open_, ["field_name", "value"]).select("field_name", "row_id", "ref_id")


@query("p1_misses")
def p1_misses(spark, sf_dir):
    """Values that fit no entry, with their number of rows."""
    values = typed_values(spark, sf_dir).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    mapped = map_values(values, table(spark, sf_dir, "reference_values"), alias_table(spark))
    return values.join(mapped.where("ref_id = 0"), ["field_name", "value"]).select("field_name", "value", "n")
