"""Deduplicating new batches against all history with multi-key sorted-neighbourhood runs.

A row has one sort key or two, both texts: the page as its address gives it (scope, host, words of the path, query),
and, where the last path part is a slip or short form of what the label names, the page as the label gives it. Keys are
persisted in runs: folders cut into key ranges and sorted within them, listed in a manifest from which a later session
opens them again. A new batch is sorted into the ranges it touches, only these are read, and every new key is compared
with the keys in the window around it: an equal neighbour is the same page, whatever the number of copies, and a near one
is the same page if both carry one label and differ by slips of its words. Accepted batches become runs of their own;
compaction merges the runs of a tier into one of the next and removes them.

Copies never widen a window, because each run and each batch holds a key once, combined before the shuffle; slips that
a label spells out meet as equal keys at any distance, so the window's width bounds only comparisons of two slips.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.registry import query
from pageloom.llm.format_duplicates import CUT, NOT_WORD, host_form, url_parts, words
from pageloom.session import scratch_dir, spread, table, written

# Hosts that serve the same page, query fields and path parameters that don't change it, file forms.
SAME_HOST = "^(?:(?:www\\d*|m|amp|mobile|wap)\\.)+(?=[^.]+\\.)|:(?:80|443)$"
EXTRAS = "^(?:utm_\\w+|utm|gclid|dclid|fbclid|msclkid|yclid|igshid|mc_[ce]id|_ga|_gl|src|ref|referrer|source|lang|hl|locale|view|print|amp|sid|s_id|phpsessid|jsessionid|aspsessionid\\w*|session_?id|cfid|cftoken)$"
FILES = "(?:/+(?:index|default|home)(?:\\.(?:x?html?|php\\d?|aspx?|jsp|cgi))*|\\.(?:x?html?|php\\d?|aspx?|jsp|cgi))+[^\\p{L}\\p{N}]*$"
PATH_PARAMETERS = ";\\s*\\w+\\s*=[^/;]*"
ACCENTS = ("áàâäãåāçćčéèêëēíìîïīñńóòôöõøōśšúùûüūýÿźżžłđ", "aaaaaaaccceeeeeiiiiinnooooooossuuuuuyyzzzld")

#: Keys to a range, sampled keys to a bound between ranges, neighbours on each side that are compared, runs to a tier.
RANGE_KEYS, SAMPLED, WIDTH, TIER = 50_000, 64, 2, 4


def plain_words(text: Column) -> Column:
    """Words of a label: lower case, without accents, one blank between them."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), *ACCENTS), NOT_WORD, " "))


def _slip(a: Column, b: Column) -> Column:
    """Whether word a is word b, a slip of it (two edits, three in a long word) or a short form (its letters in order, same first letter)."""
    letters = ~(a.rlike("\\p{N}") | b.rlike("\\p{N}"))
    most = F.when(F.length(b) >= 7, 3).when(F.length(b) >= 4, 2).otherwise(1)
    slip = (F.length(b) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 3) & (F.levenshtein(a, b) <= most)
    short = (F.length(a) < F.length(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & F.rlike(b, F.concat(F.lit("^"), F.array_join(F.split(a, ""), ".*")))
    return (a == b) | (letters & (slip | short))


def page_keys(df: DataFrame, url: str, label: str) -> DataFrame:
    """Add ``page`` (the address key), ``named`` (the key by label, NULL if it adds nothing), ``last`` (words of the last
    path part) and ``name`` (words of the label); keys of unusable addresses are NULL."""
    d = df.withColumn("__p", url_parts(F.col(url)))
    d = d.withColumns({
        "__host": F.when((F.size("__p") == 5) & F.lower(F.get("__p", 0)).isin("http", "https"), F.regexp_replace(host_form(F.get("__p", 1)), SAME_HOST, "")),
        "__path": F.regexp_replace(F.get("__p", 2), PATH_PARAMETERS, ""),
    })
    plain = F.lower(F.when(F.col("__path").contains("%"), F.coalesce(F.try_url_decode("__path"), F.col("__path"))).otherwise(F.translate("__path", "+", " ")))
    fields = F.filter(F.split(F.get("__p", 3), "[&;]"), lambda f: ~F.trim(F.lower(F.substring_index(f, "=", 1))).rlike(EXTRAS))
    fields = F.filter(F.transform(fields, words), lambda f: f != "")
    d = d.withColumns({
        "__segs": F.filter(F.transform(F.split(F.regexp_replace(plain, FILES, ""), "[/\\\\]+"), lambda s: F.trim(F.regexp_replace(s, NOT_WORD, " "))), lambda s: s != ""),
        "__query": F.when(F.get("__p", 3) == "", F.lit("")).otherwise(F.array_join(F.array_sort(fields), "&")),
    })
    d = d.withColumn("__slug", F.element_at(F.when(F.size("__segs") > 0, F.col("__segs")), -1))
    d = d.withColumns({"__s": F.split("__slug", " "), "__l": F.split(plain_words(F.col(label)), " ")})
    d = d.withColumn("__t", F.when(F.size("__l") >= F.size("__s"), F.slice("__l", F.size("__l") - F.size("__s") + 1, F.size("__s"))))
    differs = F.col("__slug") != F.array_join("__t", " ")
    names = differs & F.forall(F.zip_with("__s", "__t", _slip), lambda x: x)
    # At least one word of several, or half the letters of one, must agree as they are.
    names &= F.exists(F.zip_with("__s", "__t", lambda a, b: (a == b) | (F.levenshtein(a, b) * 3 <= F.length(b))), lambda x: x)
    parent = F.array_join(F.slice("__segs", 1, F.greatest(F.size("__segs") - 1, F.lit(0))), " ")
    usable = F.col("__host").rlike("\\p{L}|\\p{N}")
    key = lambda last: F.concat_ws(CUT, "__host", F.trim(F.concat_ws(" ", parent, last)), "__query")
    return d.withColumns({
        "last": F.when(F.col("__slug").isNull(), 0).otherwise(F.size("__s")),
        "name": F.coalesce(F.array_join("__l", " "), F.lit("")),
        "page": F.when(usable, key(F.col("__slug"))),
        "named": F.when(usable & names, key(F.array_join("__t", " "))),
    }).drop("__p", "__host", "__path", "__segs", "__query", "__slug", "__s", "__l", "__t")


def exploded_keys(df: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """One row per sort key: the given columns, k, last and name."""
    keys = F.filter(F.array("page", "named"), lambda k: k.isNotNull())
    d = df.select(*columns, F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("__scope"), "last", "name", F.explode(keys).alias("__key"))
    return d.select(*columns, F.concat_ws(CUT, "__scope", "__key").alias("k"), "last", "name")


def near(a: str, b: str) -> Column:
    """Whether two neighbours (structs of k, last, name) are one page by their label: same scope, host, query and path but
    for words of the last part, each of which is a slip of the other and of one word of the label that both carry."""
    part = lambda x, n: F.get(F.split(F.col(f"{x}.k"), CUT), n)
    ws = lambda x: F.split(part(x, 2), " ")
    label = F.split(F.col(f"{b}.name"), " ")
    n, tail = F.size(ws(b)), F.least(F.col(f"{a}.last"), F.col(f"{b}.last"))
    spelled = lambda x, y: F.exists(label, lambda t: _slip(x, t) & _slip(y, t))
    close = F.forall(F.zip_with(ws(a), ws(b), lambda x, y: (x == y) | ((_slip(x, y) | _slip(y, x)) & spelled(x, y))), lambda x: x)
    head = lambda x: F.slice(ws(x), 1, F.greatest(n - tail, F.lit(0)))
    alike = (F.col(f"{a}.name") == F.col(f"{b}.name")) & (F.col(f"{b}.name") != "") & (part(a, 0) == part(b, 0)) & (part(a, 1) == part(b, 1)) & (part(a, 3) == part(b, 3))
    return F.coalesce(F.when(alike & (tail > 0), (F.size(ws(a)) == n) & (head(a) == head(b)) & close), F.lit(False))


class SortedRuns:
    """Persisted history of sort keys: runs in key ranges, sorted within a range, and a manifest that lists them.

    Opening a path again, in this session or another, gives the runs of its last manifest. A manifest is written whole
    before it gets its name, and old runs go only after that, so a lost driver leaves a history that can be opened.
    """

    SCHEMA = "k string, last int, name string, copies long, range int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.bounds: list[str] = []
        self.runs: list[dict] = []
        self.version = self.made = 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(path))] if self._fs.exists(self._path(path)) else []
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if versions:
            self.version = max(versions)
            text = spark.read.text(f"{path}/manifest-{self.version:06d}.json", wholetext=True).first()[0]
            got = json.loads(text)
            self.bounds, self.runs, self.made = got["bounds"], got["runs"], got["made"]

    def _commit(self, runs: list[dict]) -> None:
        gone = [r["path"] for r in self.runs if r not in runs]
        old, self.runs, self.version = self.version, runs, self.version + 1
        to = f"{self.path}/manifest-{self.version:06d}.json"
        out = self._fs.create(self._path(to + ".new"), True)
        out.write(bytearray(json.dumps({"bounds": self.bounds, "runs": runs, "made": self.made}), "utf-8"))
        out.close()
        self._fs.rename(self._path(to + ".new"), self._path(to))
        for p in [*gone, *([f"{self.path}/manifest-{old:06d}.json"] if old else [])]:
            self._fs.delete(self._path(p), True)

    def range_of(self, k: Column) -> Column:
        """Number of the range that a key lies in: a binary search over the bounds."""
        if not self.bounds:
            return F.lit(0)
        steps = [1 << i for i in reversed(range(len(self.bounds).bit_length()))]
        bounds = F.lit(self.bounds)
        return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= k, at + step).otherwise(at))

    def _write(self, keys: DataFrame, tier: int) -> dict:
        self.made += 1
        at = f"{self.path}/run-{self.made:06d}"
        d = keys.withColumn("range", self.range_of(F.col("k")))
        d.repartition("range").sortWithinPartitions("range", "k").write.mode("overwrite").partitionBy("range").parquet(at)
        return {"path": at, "tier": tier}

    def _read(self, runs: list[dict]) -> DataFrame:
        parts = [self.spark.read.schema(self.SCHEMA).parquet(r["path"]) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _merged(keys: DataFrame, copies: Column) -> DataFrame:
        name = F.coalesce(F.min(F.when(F.col("name") != "", F.col("name"))), F.lit("")).alias("name")
        return keys.groupBy("k").agg(F.min("last").alias("last"), name, F.sum(copies).alias("copies"))

    def add(self, keys: DataFrame) -> None:
        """Persist the keys of an accepted batch as a run, each once with its copies; the first one settles the ranges."""
        distinct = self._merged(keys, F.lit(1))
        if not self.version:
            distinct = written(distinct)
            total = distinct.count()
            ranges = max(1, -(-total // RANGE_KEYS))
            # A bounded sample of keys gives the bounds; keys of equal hash are left out everywhere alike.
            one_in = max(1, total // (ranges * SAMPLED))
            sample = sorted(r.k for r in distinct.where(F.pmod(F.xxhash64("k"), F.lit(one_in)) == 0).select("k").collect()) if ranges > 1 else []
            self.bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
        self._commit([*self.runs, self._write(distinct, 0)])
        self.compact()

    def compact(self) -> None:
        """Merge the runs of every tier that holds TIER of them into one of the next tier, counts included."""
        while full := [t for t in {r["tier"] for r in self.runs} if sum(r["tier"] == t for r in self.runs) >= TIER]:
            t = min(full)
            mine = [r for r in self.runs if r["tier"] == t]
            run = self._write(self._merged(self._read(mine), F.col("copies")), t + 1)
            self._commit([*(r for r in self.runs if r["tier"] != t), run])

    def earlier(self, keys: DataFrame, order: Column) -> DataFrame:
        """k and ``since`` of every key of a batch whose page came earlier: in the history (then ``since`` is a NULL order) or in the batch.

        order: a struct by which the rows of the batch came. Only the ranges that the batch touches are read.
        """
        name = F.coalesce(F.min(F.when(F.col("name") != "", F.col("name"))), F.lit("")).alias("name")
        new = keys.groupBy("k").agg(F.min("last").alias("last"), name, F.min(order).alias("first"), F.max(order).alias("until"))
        new = new.withColumn("range", self.range_of(F.col("k")))
        both = new.select("range", "k", "last", "name", "first", "until")
        if self.runs:
            new = written(new)
            touched = [r.range for r in new.select("range").distinct().collect()]
            old = self._read(self.runs).where(F.col("range").isin(touched))
            if len(self.runs) > 1:
                old = old.groupBy("range", "k").agg(F.min("last").alias("last"), F.max("name").alias("name"))
            none = lambda c: F.lit(None).cast(new.schema[c].dataType).alias(c)
            both = new.select(*both.columns).unionByName(old.select("range", "k", "last", "name", none("first"), none("until")))
        w = Window.partitionBy("range").orderBy("k", F.col("first").isNotNull())
        me = F.struct("k", "last", "name", "first").alias("me")
        sides = [F.lag("me", n).over(w).alias(f"b{n}") for n in range(1, WIDTH + 1)] + [F.lead("me", n).over(w).alias(f"a{n}") for n in range(1, WIDTH + 1)]
        around = both.select("range", "k", "first", "until", me).select("range", "k", "first", "until", "me", *sides).where("first IS NOT NULL")
        same = [F.when(F.col("b1.k") == F.col("k"), F.array(F.col("b1.first")))]
        same += [F.when(near(s, "me"), F.array(F.col(f"{s}.first"))) for s in (*(f"b{n}" for n in range(1, WIDTH + 1)), *(f"a{n}" for n in range(1, WIDTH + 1)))]
        met = F.flatten(F.filter(F.array(F.array(F.col("first")), *same), lambda x: x.isNotNull()))
        # An order that is NULL stands for the history and comes before all others.
        since = F.when(F.exists(met, lambda x: x.isNull()), None).otherwise(F.array_min(met))
        return around.select("k", since.alias("since"), "until").where("since IS NULL OR since < until").select("k", "since")


def repeated(store: SortedRuns, keys: DataFrame, run: str, pos: str, row_id: str) -> DataFrame:
    """Ids of batch rows whose page the history has or an earlier row of the batch (smaller run, then smaller pos)."""
    order = F.struct(F.col(run).alias("run"), F.col(pos).alias("pos"))
    return keys.join(store.earlier(keys, order), "k").where(F.col("since").isNull() | (order > F.col("since"))).select(row_id).distinct()


def accepted_before(spark, sf_dir) -> DataFrame:
    """spec_id of every batch row whose page its campaign had accepted before: the history becomes the first run, and
    the specs handed in are one batch in the order of their runs."""
    history = page_keys(spread(table(spark, sf_dir, "discovered_urls").select("campaign_id", "url", "label")), "url", "label")
    store = SortedRuns(spark, scratch_dir(spark))
    store.add(exploded_keys(history, "campaign_id", []))
    batch = page_keys(spread(table(spark, sf_dir, "url_batches").select("campaign_id", "run_id", "pos", "spec_id", "url", "label")), "url", "label")
    new = written(exploded_keys(batch, "campaign_id", ["run_id", "pos", "spec_id"]))
    return repeated(store, new, "run_id", "pos", "spec_id")


@query("p5_found")
def p5_found(spark, sf_dir):
    """Batch rows whose page was accepted already in the same campaign."""
    return accepted_before(spark, sf_dir)


@query("p5_runs")
def p5_runs(spark, sf_dir):
    """duplicates_seen of every run that owns batch rows."""
    rows = table(spark, sf_dir, "url_batches").select("spec_id", "run_id")
    seen = accepted_before(spark, sf_dir).withColumn("dup", F.lit(1))
    return rows.join(seen, "spec_id", "left").groupBy("run_id").agg(F.count("dup").alias("duplicates_seen"))
