"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies.

Token counts come from a public tokenizer in one Arrow pass and are written once. Within a source the documents are
put in a random but reproducible order; the expected copies are integers in billionths, so prefix sums are exact and
don't depend on the order of additions and, as decimals, don't overflow. Prefix sums are built in two levels (sums per
hash bucket, then within a bucket); the buckets follow the number of documents, so a source with a third of all
documents is spread over all tasks and a bucket stays small.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.registry import query
from pageloom.session import spread, table, written

TOKENIZER = os.environ.get("PAGELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
UNIT = 1_000_000_000
#: Documents to a bucket of prefix sums, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 1 << 20
#: Longer texts are encoded in pieces of this many characters, cut at blanks.
PIECE = 50_000
# Fixed value: how the tokenizer's words are cut out of a text.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level tokenizer of a ranks file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, path: str = TOKENIZER) -> Column:
    """Column of the number of tokens of a text; 0 for NULL and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([0 if not t else sum(len(enc.encode_ordinary(p)) for p in pieces(t)) for t in s], dtype="int64")

    return count(F.col(text))


def pieces(text: str) -> Iterator[str]:
    """Pieces of at most PIECE characters, cut before a blank where there is one."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def systematic_copies(df: DataFrame, stratum: str, row_id: str, expected: Column, seed: int = 17) -> DataFrame:
    """Rows with ``repeats``: how many integers the running sum of expected copies crosses within the stratum.

    expected: copies in billionths; NULL counts as 0. A stratum may sum up to 10^28 copies. Each row gets the floor or the ceiling of its expected
    copies and a stratum's sum is met within one copy. Rows with 0 copies are left out; repeated rows are rows.
    """
    # The number of buckets decides who is summed together, never who is chosen: the order is that of the hash.
    buckets = 1 << min(MOST_BUCKETS.bit_length() - 1, max(6, (df.count() // BUCKET_ROWS).bit_length()))
    wide = "decimal(38,0)"
    d = df.withColumn("__e", F.coalesce(expected.cast(wide), F.lit(0).cast(wide))).withColumn("__h", F.xxhash64(F.lit(seed), row_id))
    d = d.withColumn("__b", F.shiftrightunsigned("__h", 64 - (buckets.bit_length() - 1)).cast("int"))
    sums = d.groupBy(stratum, "__b").agg(F.sum("__e").cast(wide).alias("__s"))
    before = Window.partitionBy(stratum).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(stratum).alias("__st"), F.col("__b").alias("__sb"), F.coalesce(F.sum("__s").over(before), F.lit(0)).cast(wide).alias("__base"))
    d = d.join(sums, F.col(stratum).eqNullSafe(F.col("__st")) & (F.col("__b") == F.col("__sb"))).drop("__st", "__sb")
    upto = F.sum("__e").over(Window.partitionBy(stratum, "__b").orderBy(F.shiftrightunsigned("__h", 1), "__h", row_id).rowsBetween(Window.unboundedPreceding, 0))
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), stratum), F.lit(UNIT))
    d = d.withColumn("__end", (F.col("__base") + upto.cast(wide) + offset).cast(wide))
    exact = F.expr(f"(__end div {UNIT}) - ((__end - __e) div {UNIT})")
    return d.withColumn("repeats", exact.cast("long")).where("repeats > 0").drop("__e", "__h", "__b", "__base", "__end")


def mixed(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: str, total_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, tokens, repeats of the documents chosen.

    Every source gets target_weight x total_tokens tokens in expectation, a document at most max_repeats copies: a
    source that is too small is used max_repeats times in full and stays below its weight. total_tokens: default all
    tokens of the sources of the list. Documents of other sources, with NULL source or without tokens are left out.
    """
    pool = docs.where(F.col(tokens) > 0).join(targets.select(source).distinct(), source, "left_semi")
    sizes = pool.groupBy(source).agg(F.sum(tokens).alias("have"))
    goal = F.lit(total_tokens) if total_tokens is not None else F.sum("have").over(Window.partitionBy(F.lit(1)))
    rates = sizes.withColumn("goal", goal.cast("double")).join(targets.select(F.col(source).alias("__t"), "target_weight", "max_repeats"), F.col(source) == F.col("__t"))
    rate = F.least(F.col("target_weight") * F.col("goal") / F.col("have"), F.greatest("max_repeats", F.lit(0)).cast("double"))
    rates = rates.select(F.col("__t"), F.round(rate * UNIT).cast("long").alias("__rate"))
    d = pool.join(rates, F.col(source) == F.col("__t")).drop("__t")
    return systematic_copies(d, source, doc_id, F.col("__rate"), seed).select(doc_id, source, tokens, "repeats")


def counted_documents(spark, sf_dir) -> DataFrame:
    """doc_id, source, tokens of the documents whose source has a target, written once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.join(table(spark, sf_dir, "mix_targets").select("source"), "source", "left_semi")
    return written(spread(docs).select("doc_id", "source", token_counts(docs, "text").alias("tokens")))


@query("p9_mix")
def p9_mix(spark, sf_dir):
    """The documents chosen with their repeats."""
    return mixed(counted_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens")


@query("p9_shares")
def p9_shares(spark, sf_dir):
    """Share of the tokens that every source of the list reached, beside its target."""
    targets = table(spark, sf_dir, "mix_targets")
    got = mixed(counted_documents(spark, sf_dir), targets, "doc_id", "source", "tokens")
    got = got.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    got = targets.select("source", "target_weight").join(got, "source", "left").fillna(0, ["documents", "tokens"])
    return got.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))
