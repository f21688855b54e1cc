"""File sources and sinks: strict JSON, NDJSON with bad lines, sitemaps, CSV exports, activity feeds."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import safe_cell

MOST_BYTES, MOST_DEPTH, MOST_SITEMAP = 256 << 10, 8, 2000


def strict_json(body: bytes | str):
    """A JSON document: UTF-8 (with or without mark), at most 256 KiB and 8 levels, no repeated keys, no NaN or infinity."""
    raw = body.encode() if isinstance(body, str) else body
    if len(raw) > MOST_BYTES:
        raise ValueError("document is too large")

    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError("repeated key")
        return dict(pairs)

    def constant(name):
        raise ValueError(f"{name} is no JSON value")

    def depth(x, at=1):
        if at > MOST_DEPTH:
            raise ValueError("document is too deep")
        for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            depth(v, at + 1)

    out = json.loads(raw.decode("utf-8-sig"), object_pairs_hook=unique, parse_constant=constant)
    depth(out)
    return out


def strict_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, document (canonical JSON text), error of every file of a folder; a bad file gives an error, no failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((p, json.dumps(strict_json(bytes(c)), sort_keys=True, separators=(",", ":"), ensure_ascii=False), None))
                except (ValueError, RecursionError) as e:
                    rows.append((p, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "document", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, document string, error string")


def index_lines(spark: SparkSession, path: str, schema: str = "url string") -> DataFrame:
    """Rows of NDJSON files; lines that are no JSON of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(schema.split()[0]).isNotNull())


def strict_texts(df: DataFrame, row_id: str, body: str) -> DataFrame:
    """row_id, document (canonical JSON text), error of every text of a column; a bad or NULL text gives an error, no failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, c in zip(pdf["i"], pdf["c"]):
                try:
                    rows.append((i, json.dumps(strict_json(c or ""), sort_keys=True, separators=(",", ":"), ensure_ascii=False), None))
                except (ValueError, RecursionError) as e:
                    rows.append((i, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[row_id, "document", "error"])

    return df.select(F.col(row_id).cast("long").alias("i"), F.col(body).alias("c")).mapInPandas(run, f"{row_id} long, document string, error string")


def decoded(body: Column, content_type: Column) -> Column:
    """Text of a response in the charset that its content type declares, UTF-8 without one or with an unknown one; bad bytes become
    replacement characters; NULL for NULL."""

    @F.pandas_udf("string")
    def read(b: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for raw, kind in zip(b, t):
            charset = (kind or "").split("charset=")[-1].split(";")[0].strip(" \"'") if "charset=" in (kind or "") else "utf-8"
            try:
                out.append(None if raw is None else bytes(raw).decode(charset, errors="replace"))
            except LookupError:
                out.append(bytes(raw).decode("utf-8", errors="replace"))
        return pd.Series(out, dtype=object)

    return read(body, content_type)


def sitemap_entries(body: bytes, most: int = MOST_SITEMAP) -> list[tuple[str, str]]:
    """(kind, address) of the first entries of a sitemap or sitemap index; gzip by its mark; [] for DTDs and other XML."""
    return sitemap(body, most)[0]


def sitemap(body: bytes, most: int = MOST_SITEMAP) -> tuple[list[tuple[str, str]], bool]:
    """The first entries of a sitemap, and whether it has more."""
    import xml.etree.ElementTree as ET

    try:
        raw = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
        root = None if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw[:4096], re.I) else ET.fromstring(raw)
    except (ET.ParseError, OSError, EOFError):
        root = None
    if root is None:
        return [], False
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    kind = {"urlset": "page", "sitemapindex": "sitemap"}.get(name(root))
    if not kind:
        return [], False
    children = list(root)
    return [(kind, e.text.strip()) for child in children[:most] for e in child if name(e) == "loc" and (e.text or "").strip()], len(children) > most


def sitemap_rows(df: DataFrame, row_id: str, body: str) -> DataFrame:
    """row_id, pos, kind, url, truncated of the entries of every body; NULL, broken and other XML give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, c in zip(pdf["i"], pdf["c"]):
                got, more = sitemap(bytes(c)) if c is not None else ([], False)
                rows.extend((i, n, k, u, more) for n, (k, u) in enumerate(got))
            yield pd.DataFrame(rows, columns=[row_id, "pos", "kind", "url", "truncated"]).astype({"pos": "int32"})

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(F.col(row_id).alias("i"), F.col(body).alias("c")).mapInPandas(run, f"{row_id} {kind}, pos int, kind string, url string, truncated boolean")


def sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, kind, url, truncated of all sitemap files of a folder."""
    return sitemap_rows(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html, saved_at of the HTML files of a folder, decoded as UTF-8."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(path)
    return got.select("path", decoded(F.col("content"), F.lit("text/html")).alias("html"), F.col("modificationTime").alias("saved_at"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header; texts that a spreadsheet would take for formulas are quoted."""
    df.select(*(safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").option("header", True).csv(path)


def append_activity(df: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    df.write.mode("append").json(path)


def activity_since(spark: SparkSession, path: str, after: float, limit: int) -> DataFrame:
    """The last ``limit`` events after a time, oldest first; torn lines are dropped."""
    rows = spark.read.schema("t double, lane string, kind string, text string").option("mode", "DROPMALFORMED").json(path)
    last = rows.where(F.col("t") > after).orderBy(F.desc("t"), "lane", "text").limit(limit)
    return last.orderBy("t", "lane", "text")
