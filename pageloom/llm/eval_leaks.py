"""Evaluation texts leaking into training text: pigeonhole pieces, then Myers' bit-parallel distance.

Items are few and known, documents are many: the items become a broadcast index of bounded size, the documents are
streamed once and only (document, item) pairs come out. Items of the same words are one text, searched once; its finds
hold for each of them. Every window of a passage's least length with a budget of k edits is split into k + 1 pieces, of
which one must occur unchanged. A piece of common words that many items hold is followed only for the items that have a
specific word near it in the text, or where a window of such pieces alone stands verbatim: no other window could count.
Each hit is verified by the bit-parallel distance of its windows around the hit. A verbatim window counts if no other item's text
holds it too, else with a specific word; a reworded one with a specific word and with most of its information (idf over
the items). Where a name, a number or a specific word is among what differs, two specific words and most of them must be
there, which keeps sentences built alike about other names and numbers apart. In unspaced scripts pairs of characters are
the words that may be specific. Stock sentences are those that several otherwise different items share, or that many
different texts hold without the rest of the item; copies of a text count once. An item that has nothing else keeps its
sentences, a document with the rest of an item is always found, and ``p8_stock`` lists what was set aside.

All statistics (stock, idf, rare and specific words, names, common pieces, shared windows) are computed once in Spark
over all items. Items of more than BLOCK_TOKENS words in all are served in blocks, each with its own broadcast and pass
over the documents; a block gets the statistics of its own words, so the number of blocks changes no result.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.registry import query
from pageloom.llm.sentences import split_sentences
from pageloom.session import small, spread, table, written

#: Words of the items that one broadcast index holds.
BLOCK_TOKENS = 2_000_000
#: Least passage: words, or characters where words aren't spaced.
LEAST_WORDS, LEAST_CHARS = 12, 40
EDITS = 2
PIECE = LEAST_WORDS // (EDITS + 1)
#: Share of a window's information that must be found again.
SAME = 0.72
#: Words (pairs of unspaced characters) of at most this share of the item sentences are specific; so many, and this share
#: of them, must be found again where names, numbers or specific words differ.
SPECIFIC, LEAST_SPECIFIC, SAME_SPECIFIC = 0.01, 2, 0.6
#: A sentence that so many items with different rests share is stock; so is one that more than so many times the texts
#: with the rest of its item (one text at least) hold without it.
STOCK_ITEMS, STOCK_LEAST = 3, 20
#: Least hashes of a text, by which near copies are told.
SKETCH = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) | 1, 0xC2B2AE3D27D4EB4F * (k + 1)) for k in range(4))
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝɡοαεικνρτυχ", "aeopcyxijshdqwgoaeikvptux")
TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|[^\W_぀-ヿ㐀-鿿豈-﫿฀-๿]+")
ASCII_TOKEN = re.compile("[a-z0-9]+")
CYRILLIC_WORD = re.compile(r"[Ѐ-ӿͰ-Ͽ]")
HIDDEN = re.compile("[­​-‏⁠-⁤﻿͏؜᠎︀-️]")


def tokens(text: str) -> list[str]:
    """Comparable tokens: words without case, accents, hidden characters and look-alikes; unspaced scripts by character."""
    if text.isascii():
        return ASCII_TOKEN.findall(text.lower())
    t = unicodedata.normalize("NFKD", HIDDEN.sub("", text).casefold())
    if not t.isascii():
        t = "".join(c for c in t if not unicodedata.combining(c) or c in "゙゚")
        t = unicodedata.normalize("NFC", t).replace("ł", "l").replace("ø", "o").replace("đ", "d")
    out = TOKEN.findall(t)
    if not t.isascii():
        out = [w.translate(LOOKALIKES) if not w.isascii() and CYRILLIC_WORD.search(w) and (mixed := w.translate(LOOKALIKES)).isascii() and mixed else w for w in out]
    return out


def unspaced(token: str) -> bool:
    return len(token) == 1 and token >= "฀" and token.isalpha()


def units(ts: list[str]) -> list[str]:
    """What can be specific: words, and pairs of neighbouring characters of unspaced scripts."""
    return [x for x in ts if not unspaced(x)] + [a + b for a, b in zip(ts, ts[1:]) if unspaced(a) and unspaced(b)]


def names_in(sentence: str) -> set[str]:
    """Tokens of a sentence that are written like names: with a capital after the first word."""
    return {t for w in sentence.split()[1:] if w.lstrip("\"'“„«‹¿¡([")[:1].isupper() for t in tokens(w)}


def myers(masks: dict[str, int], m: int, text: list[str]) -> int:
    """Least edit distance between a pattern of m tokens, given as bit masks, and any part of the text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for t in text:
        eq = masks.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


def hashed(words: Iterable[str]) -> int:
    """Signed 64-bit hash of a run of words."""
    return int.from_bytes(xxhash.xxh64_digest("\x1f".join(words)), "big", signed=True)


def runs(sentences: list[tuple[int, list[str], bool]]) -> list[list[tuple[int, str]]]:
    """Passages of an item: (sentence, word) of its own words; a stock sentence ends a run."""
    out: list[list[tuple[int, str]]] = [[]]
    for k, words, stock in sorted(sentences):
        if stock:
            out.append([])
        else:
            out[-1].extend((k, w) for w in words)
    return [r for r in out if r]


def is_dense(run: list[tuple[int, str]]) -> bool:
    return sum(unspaced(w) for _, w in run) * 2 > len(run)


def least_end(run: list[tuple[int, str]], at: int, dense: bool) -> int | None:
    """End of the least passage that starts at a word, None if the passage is over before."""
    chars = 0
    for end in range(at, len(run)):
        chars += len(run[end][1])
        if end + 1 - at >= LEAST_WORDS and (not dense or chars >= LEAST_CHARS):
            return end + 1
    return None


def pieces_and_windows(sentences: list[tuple[int, list[str], bool]]) -> tuple[set[int], set[int]]:
    """Hashes of all pieces and of all least windows of an item's passages."""
    pieces, windows = set(), set()
    for run in runs(sentences):
        words, dense = [w for _, w in run], is_dense(run)
        pieces.update(hashed(words[at : at + PIECE]) for at in range(len(words) - PIECE + 1))
        windows.update(hashed(words[at:end]) for at in range(len(words)) if (end := least_end(run, at, dense)))
    return pieces, windows


@dataclass
class Statistics:
    """What all items tell of a block's words: sentences with a word or unit, names, pieces by items, shared windows."""

    sentences: int
    items: int
    df: dict[str, int]
    unit_df: dict[str, int]
    names: set[str]
    often: dict[int, int]
    shared: set[int]


class Index:
    """Pieces of the passages of a block of items; items: (item_id, [(sentence, tokens, stock)])."""

    def __init__(self, items: list[tuple[int, list[tuple[int, list[str], bool]]]], known: Statistics):
        n = max(2, known.sentences)
        self.names, self.shared_windows = known.names, known.shared
        self.idf = {w: math.log(n / d) + 0.05 for w, d in known.df.items()}
        self.most = math.log(n) + 0.05
        rare = {w for w, d in known.df.items() if d <= max(2, 0.03 * n)}
        self.specific = {w for w, d in known.unit_df.items() if d <= max(2, SPECIFIC * n)}
        self.passages: list[tuple[int, list[tuple[int, str]]]] = [(i, run) for i, ss in items for run in runs(ss)]
        self.is_dense = [is_dense(run) for _, run in self.passages]
        self.own: dict[int, set[int]] = defaultdict(set)
        self.pieces: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for p, (i, run) in enumerate(self.passages):
            self.own[i] |= {k for k, _ in run}
            words = [w for _, w in run]
            for at in range(len(words) - PIECE + 1):
                self.pieces[tuple(words[at : at + PIECE])].append((p, at))
        few = max(2, SPECIFIC * known.items)
        every = self.pieces
        self.pieces = {x: at for x, at in every.items() if any(w in rare for w in x) or known.often.get(hashed(x), 1) <= few}
        # Pieces of common words by passage, and what makes a window around them count: a passage's specific units, or all
        # of a window that has neither these nor another piece and is no other item's.
        self.common: dict[tuple[str, ...], dict[int, list[int]]] = defaultdict(dict)
        for x in every.keys() - self.pieces.keys():
            for p, at in every[x]:
                self.common[x].setdefault(p, []).append(at)
        self.places: dict[str, set[int]] = defaultdict(set)
        self.plain: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        # A window that holds a piece and the text near it end within so many words of the piece.
        self.reach = (LEAST_CHARS if any(self.is_dense) else LEAST_WORDS) + 2 * PIECE
        for p in {p for held in self.common.values() for p in held}:
            words = [w for _, w in self.passages[p][1]]
            for u in units(words):
                if u in self.specific:
                    self.places[u].add(p)
            grams = [tuple(words[at : at + PIECE]) for at in range(len(words) - PIECE + 1)]
            for at, x in enumerate(grams):
                if x in self.common and (w := self.window(p, at)):
                    own = words[at : w[1]]
                    if all(y in self.common for y in grams[at : w[1] - PIECE + 1]) and not self.specific.intersection(units(own)) and hashed(own) not in self.shared_windows:
                        self.plain[x].append((p, at))
        # A piece is looked up from its rarest word, so that most words of a text cost one look.
        self.anchors: dict[str, tuple[int, ...]] = {}
        for x in every:
            at = min(range(PIECE), key=lambda k: known.df.get(x[k], 0))
            if at not in self.anchors.get(x[at], ()):
                self.anchors[x[at]] = (*self.anchors.get(x[at], ()), at)

    def sketch(self, text: str) -> list[int]:
        """Least hashes of a text's pieces that are no item's; near copies share most of them."""
        ts = tokens(text)
        pieces = {x for x in zip(*(ts[k:] for k in range(PIECE))) if x not in self.pieces}
        hashes = [int.from_bytes(hashlib.blake2b(" ".join(x).encode(), digest_size=8).digest(), "big") for x in pieces]
        return [min(((h * a + b) % (2**61 - 1) for h in hashes), default=0) for a, b in SKETCH]

    def window(self, p: int, at: int) -> tuple[int, int] | None:
        """Start and end of the least passage that starts at a word, None if the passage is over before."""
        end = least_end(self.passages[p][1], at, self.is_dense[p])
        return (at, end) if end else None

    def dense(self, p: int) -> bool:
        return self.is_dense[p]

    def built_alike(self, p: int, w: tuple[int, int], ts: list[str], at: int) -> bool:
        """Whether the text beyond a window goes on like the item's, but about another name or number."""
        words = [x for _, x in self.passages[p][1]]
        gram, span = (PIECE, LEAST_CHARS) if self.dense(p) else (2, LEAST_WORDS)
        for mine, other in ((words[w[1] : w[1] + span], ts[at + w[1] - w[0] :][:span]), (words[max(0, w[0] - span) : w[0]][::-1], ts[max(0, at - span) : max(0, at)][::-1])):
            same = next((n for n, (x, y) in enumerate(zip(mine, other)) if x != y), None)
            if same is None or not any(self.telling(x) and x not in other for x in mine[same:]):
                continue
            grams = [set(zip(*(x[same + k :] for k in range(gram)))) for x in (mine, other)]
            aligned = gram == 2 and sum(x in other[max(same, k - 1) : k + 2] for k, x in enumerate(mine) if k > same)
            if len(grams[0] & grams[1]) >= 2 or aligned >= 3:
                return True
        return False

    def telling(self, token: str) -> bool:
        return token in self.names or token in self.specific or any(c.isdigit() for c in token)

    def repeats(self, p: int, w: tuple[int, int], ts: list[str], at: int, near: list[str], distance: int) -> bool:
        """Whether a window within the budget of edits is the item's own text and not a sentence built alike."""
        pattern, have = [x for _, x in self.passages[p][1][w[0] : w[1]]], Counter(near)
        own, there = [x for x in units(pattern) if x in self.specific], set(units(near))
        kept = sum(1 for x in own if x in there)
        if kept < LEAST_SPECIFIC and self.built_alike(p, w, ts, at):
            return False
        if distance == 0:
            return kept > 0 or hashed(pattern) not in self.shared_windows
        lost = Counter(pattern) - have
        if kept < len(own) or any(self.telling(x) for x in lost):
            if kept < LEAST_SPECIFIC or kept < SAME_SPECIFIC * len(own):
                return False
        total = got = 0.0
        for x, c in Counter(pattern).items():
            weight = self.idf.get(x, self.most)
            total += c * weight
            got += min(c, have[x]) * weight
        return kept > 0 and got >= SAME * total

    def common_hits(self, ts: list[str], common: list[tuple[int, tuple[str, ...]]]) -> Iterator[tuple[int, int, int]]:
        """(passage, place in the text, place in the passage) of the pieces of common words around which a window may count."""
        spots = [(k, x) for k, x in enumerate(ts) if x in self.places]
        spots += [(k, a + b) for k, (a, b) in enumerate(zip(ts, ts[1:])) if not a.isascii() and unspaced(a) and unspaced(b) and a + b in self.places]
        spots.sort()
        where = [k for k, _ in spots]
        for at, x in common:
            held = self.common[x]
            near = {u for _, u in spots[bisect_left(where, at - self.reach) : bisect_right(where, at + self.reach)]}
            for p in {p for u in near for p in held.keys() & self.places[u]}:
                yield from ((p, at, pos) for pos in held[p])
            for p, start in self.plain.get(x, ()):
                if ts[at : at + (n := self.window(p, start)[1] - start)] == [w for _, w in self.passages[p][1][start : start + n]]:
                    yield p, at, start

    def leaks(self, text: str) -> set[tuple[int, int]]:
        """(item_id, sentence) of the passages found in a text."""
        ts = tokens(text)
        found: set[tuple[int, int]] = set()
        hits: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        anchors, pieces, common = self.anchors, self.pieces, []
        for here, word in enumerate(ts):
            for back in anchors.get(word, ()):
                at = here - back
                x = tuple(ts[at : at + PIECE]) if at >= 0 else ()
                for p, pos in pieces.get(x, ()):
                    hits[p][at - pos].append(pos)
                if x in self.common:
                    common.append((at, x))
        for p, at, pos in self.common_hits(ts, common) if common else ():
            hits[p][at - pos].append(pos)
        for p, diagonals in hits.items():
            item, words = self.passages[p]
            checked = set()
            span = LEAST_CHARS if self.dense(p) else LEAST_WORDS
            for shift, poss in diagonals.items():
                for pos in poss:
                    for start in range(max(0, pos - span + PIECE - EDITS), pos + 1):
                        if (start, shift) in checked:
                            continue
                        checked.add((start, shift))
                        w = self.window(p, start)
                        if w is None or w[1] < pos + PIECE or (item, words[(w[0] + w[1]) // 2][0]) in found:
                            continue
                        pattern = [x for _, x in words[w[0] : w[1]]]
                        budget = max(EDITS, len(pattern) * EDITS // LEAST_WORDS // 2)
                        near = ts[max(0, start + shift - budget - 1) : start + shift + len(pattern) + budget + 1]
                        # Every word that isn't there costs an edit, which rules most windows out before the distance.
                        there = set(near)
                        if sum(x not in there for x in pattern) > budget:
                            continue
                        masks: dict[str, int] = {}
                        for b, x in enumerate(pattern):
                            masks[x] = masks.get(x, 0) | 1 << b
                        distance = myers(masks, len(pattern), near)
                        if distance <= budget and self.repeats(p, w, ts, start + shift, near, distance):
                            found.add((item, words[(w[0] + w[1]) // 2][0]))
        return found


def stock_of(sentences: list[tuple[int, int, list[str]]]) -> set[tuple[str, ...]]:
    """Sentences that otherwise different items share, directly stated; the same rule as in :func:`item_sentences`."""
    having: dict[tuple[str, ...], set[int]] = defaultdict(set)
    own: dict[int, list[tuple[str, ...]]] = defaultdict(list)
    for i, _, t in sentences:
        having[tuple(t)].add(i)
    common = {t for t, ids in having.items() if len(ids) >= STOCK_ITEMS}
    for i, _, t in sentences:
        if tuple(t) not in common:
            own[i].append(tuple(t))
    return {t for t in common if len({tuple(own[i]) for i in having[t] if own[i]}) >= STOCK_ITEMS}


def index_of(items: list[tuple[int, list[str]]]) -> Index:
    """The index of items (item_id, sentences) with statistics counted directly, for few items and for tests."""
    split = [(i, k, tokens(s)) for i, ss in items for k, s in enumerate(ss)]
    stock = stock_of(split)
    by_item: dict[int, list[tuple[int, list[str], bool]]] = defaultdict(list)
    for i, k, t in split:
        by_item[i].append((k, t, tuple(t) in stock))
    pieces, windows = Counter(), Counter()
    for ss in by_item.values():
        x, y = pieces_and_windows(ss)
        pieces.update(x)
        windows.update(y)
    known = Statistics(
        len(split), len(by_item), Counter(w for _, _, t in split for w in set(t)), Counter(w for _, _, t in split for w in set(units(t))),
        {w for _, ss in items for s in ss for w in names_in(s)}, pieces, {h for h, n in windows.items() if n > 1},
    )
    return Index(sorted(by_item.items()), known)


def item_sentences(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the sentences (item, k, tokens, units, names, stock, shared_by) of one item for each text, and
    the members (item, same) of every text. Sentences without a word and NULL texts are left out.

    Stock: shared by STOCK_ITEMS items or more whose other sentences differ; an item without any other keeps it.
    """

    @F.pandas_udf("tokens array<string>, units array<string>, names array<string>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            split = [tokens(x) for x in s]
            yield pd.DataFrame({"tokens": split, "units": [sorted(set(units(t))) for t in split], "names": [sorted(names_in(x)) for x in s]})

    parts = split_sentences(items, item_id, item_text).select(F.col(item_id).cast("long").alias("item"), F.col("start_char").alias("k"), parsed("sentence").alias("p"))
    parts = written(parts.select("item", "k", "p.*").where(F.size("tokens") > 0))
    whole = F.array_sort(F.collect_list(F.struct("k", "tokens")))
    words_of = lambda c: F.transform(c, lambda x: x["tokens"])
    texts = parts.groupBy("item").agg(words_of(whole).alias("t")).select("item", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"))
    first = texts.groupBy("h1", "h2").agg(F.min("item").alias("same"))
    members = written(texts.join(first, ["h1", "h2"]).select("item", "same"))
    own = parts.join(members.where("item = same").select("item"), "item", "left_semi").withColumn("s", F.xxhash64("tokens"))
    common = own.groupBy("s").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("s")
    rest = own.join(common, "s", "left_anti").groupBy("item").agg(F.xxhash64(words_of(whole)).alias("rest"))
    stock = own.join(common, "s", "left_semi").join(rest, "item").groupBy("s").agg(F.count_distinct("rest").alias("shared_by")).where(F.col("shared_by") >= STOCK_ITEMS)
    own = own.join(stock, "s", "left")
    alone = own.groupBy("item").agg(F.min(F.col("shared_by").isNotNull()).alias("only_stock"))
    own = own.join(alone, "item").withColumn("stock", F.col("shared_by").isNotNull() & ~F.col("only_stock"))
    return written(own.select("item", "k", "tokens", "units", "names", "stock", "shared_by")), members


def block_indexes(sentences: DataFrame) -> Iterator[tuple[list, Statistics]]:
    """Items and statistics of every block; what is collected is bounded by the words of a block."""
    total = sentences.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.count(F.lit(1)), F.count_distinct("item")).first()
    blocks = max(1, -(-total[0] // BLOCK_TOKENS))
    items = sentences.groupBy("item").agg(F.collect_list(F.struct("k", "tokens", "stock")).alias("ss")).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for b, ss in zip(pdf["block"], pdf["ss"]):
                for kind, hs in zip("pw", pieces_and_windows([(x["k"], list(x["tokens"]), bool(x["stock"])) for x in ss])):
                    rows.extend((b, kind, h) for h in hs)
            yield pd.DataFrame(rows, columns=["block", "kind", "h"])

    # Words and units by sentences, names, pieces and windows by items: counts over all items, with the blocks that have them.
    of_kind = lambda kind, c: F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("v")))
    words = sentences.select("item", F.inline(F.concat(of_kind("d", "tokens"), of_kind("u", "units"), of_kind("n", "names"))))
    words = words.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "kind", "v")
    runs_ = items.mapInPandas(hashes, "block long, kind string, h long").select("block", "kind", F.col("h").cast("string").alias("v"))
    counted = words.unionByName(runs_).groupBy("kind", "v").agg(F.count(F.lit(1)).alias("n"), F.collect_set("block").alias("blocks"))
    # Pieces and windows of one item only say nothing.
    counted = counted.where(F.col("kind").isin("d", "u", "n") | (F.col("n") > 1))
    counted = written(counted.select("kind", "v", "n", F.explode("blocks").alias("block"))) if blocks > 1 else counted.select("kind", "v", "n", F.lit(0).alias("block"))
    for b in range(blocks):
        got: dict[str, dict[str, int]] = {k: {} for k in "dunpw"}
        for r in counted.where(F.col("block") == b).collect():
            got[r.kind][r.v] = r.n
        mine = [(r.item, sorted((x.k, list(x.tokens), x.stock) for x in r.ss)) for r in items.where(F.col("block") == b).collect()]
        yield sorted(mine), Statistics(total[1], total[2], got["d"], got["u"], set(got["n"]), {int(h): n for h, n in got["p"].items()}, {int(h) for h in got["w"]})


def leaked(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """doc_id, item_id of every document that carries a passage of an item, with the sentence's place, whether the item
    has several sentences of its own (``several``) and the sketch of the document.

    NULL and empty texts carry nothing; an empty item list gives no row; texts are searched whole, whatever their
    length; items of the same text are all found; repeated rows give one result.
    """
    return _leaked(docs, *item_sentences(items, item_id, item_text), doc_id, text, item_id)


def _leaked(docs: DataFrame, sentences: DataFrame, members: DataFrame, doc_id: str, text: str, item_id: str) -> DataFrame:
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where(F.length("t") > 0)
    for block in block_indexes(sentences):
        given = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            index = Index(*given.value)
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["d"], pdf["t"]):
                    got = index.leaks(t)
                    sketch = index.sketch(t) if got else None
                    rows.extend((d, i, k, len(index.own[i]) > 1, sketch) for i, k in got)
                yield pd.DataFrame(rows, columns=["d", "same", "k", "several", "sketch"])

        hits = texts.mapInPandas(run, "d long, same long, k long, several boolean, sketch array<long>")
        out = hits if out is None else out.unionByName(hits)
    found = out.join(small(members), "same")
    return found.select(F.col("d").alias(doc_id), F.col("item").alias(item_id), F.col("k").alias("sentence"), "several", "sketch")


def stock_in_texts(hits: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """item_id, sentence, texts of the stock among hits: far more different texts hold the sentence alone than with others of its item.

    A sentence that is all its item has is never stock. Near copies, which share a least hash, are one text. How many
    documents there are is no part of the rule.
    """
    key = [item_id, "sentence"]
    often = written(hits.where("several").groupBy(key).agg(F.count_distinct(doc_id).alias("n")).where(F.col("n") > STOCK_LEAST).select(*key))
    if not often.head(1):
        return often.withColumn("texts", F.lit(0).cast("long"))
    texts = hits.join(often.select(item_id).distinct(), item_id, "left_semi").select(*key, "sketch").distinct()
    # Copies with other slips share some other hash, so each hash hands the least label on.
    texts = written(texts.withColumn("text", F.get("sketch", 0)))
    for n in (*range(1, len(SKETCH)), 0):
        texts = texts.withColumn("h", F.get("sketch", n))
        least = texts.groupBy(item_id, "h").agg(F.min("text").alias("least"))
        texts = written(texts.join(least, [item_id, "h"]).select(*key, "sketch", F.col("least").alias("text")))
    texts = texts.groupBy(item_id, "text").agg(F.min("sentence").alias("sentence"), (F.min("sentence") == F.max("sentence")).alias("one"))
    total = texts.groupBy(item_id).agg(F.count(F.lit(1)).alias("total"))
    alone = texts.where("one").groupBy(key).agg(F.count(F.lit(1)).alias("alone")).join(total, item_id)
    alone = alone.where(F.col("alone") > STOCK_LEAST * (1 + F.col("total") - F.col("alone")))
    return alone.join(often, key, "left_semi").select(*key, F.col("alone").alias("texts"))


def without_stock(hits: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """Distinct (doc_id, item_id) of hits whose sentence is no stock among the texts."""
    return hits.join(stock_in_texts(hits, doc_id, item_id), [item_id, "sentence"], "left_anti").select(doc_id, item_id).distinct()


def searched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The hits of the evaluation items in the documents, written once, and the items' sentences."""
    sentences, members = item_sentences(table(spark, sf_dir, "eval_items"), "item_id", "text")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return written(_leaked(docs, sentences, members, "doc_id", "text", "item_id")), sentences


@query("p8_found")
def p8_found(spark, sf_dir):
    """Documents with each evaluation item they carry, in part or in whole."""
    return without_stock(searched(spark, sf_dir)[0], "doc_id", "item_id")


@query("p8_items")
def p8_items(spark, sf_dir):
    """Items that leaked, with the number of documents that carry them."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


@query("p8_stock")
def p8_stock(spark, sf_dir):
    """Sentences of items set aside as stock: shared by so many items, or held alone by so many different texts."""
    hits, sentences = searched(spark, sf_dir)
    by_items = sentences.where("stock").select(F.col("item").alias("item_id"), F.col("k").cast("long").alias("start_char"), F.lit("items").alias("shared_by"), F.col("shared_by").alias("n"))
    by_texts = stock_in_texts(hits, "doc_id", "item_id").select("item_id", F.col("sentence").alias("start_char"), F.lit("texts").alias("shared_by"), F.col("texts").alias("n"))
    return by_items.unionByName(by_texts)
