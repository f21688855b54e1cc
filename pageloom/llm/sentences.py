"""Sentence boundaries across languages and scripts, in SQL expressions only.

Terminators that end no sentence (decimals, addresses, initials, abbreviations, quoted speech, list marks) are
replaced one for one by a private-use character, so every offset of the masked text is an offset of the original.
Bullet lines and quotations, of whatever length, are found by one forward pass each: the text is cut around them and
the terminators inside are masked, so no rule looks back over a bounded span. The masked text is split at
script-specific zero-width boundaries; sentences are cut from the original text, which restores whatever was masked.
Offsets are prefix sums over blocks, linear in practice even for texts with a million sentences. Nothing is shuffled:
one row in, its sentences out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.registry import query
from pageloom.session import spread, table

#: Private-use characters: a masked terminator, the end of a bullet line, and the cuts around spans.
MASK, BREAK, OPEN, SHUT = "\ue000", "\ue001", "\ue002", "\ue003"
# Terminators, quotation pairs, abbreviations by how they behave, months that follow ordinals.
MARKS_OF_END = ".!?…。！？｡।॥؟۔"
ENDS = f"[{MARKS_OF_END}]"
QUOTES = (("„", "“”"), ("“", "”"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』"))
#: Never the end of a sentence.
TITLES = (
    "Mr Mrs Ms Mx Dr Drs Prof Sr Sra Srta Dra Jr St Ste Capt Gen Col Lt Sgt Maj Cmdr Rev Hon Pres Gov Sen Rep Messrs Mmes "
    "Hr Dipl Ing Hrn Frl Ud Uds Arq Fig Figs Abb Tab Sec Sect Ch Vol Eds Art Nrn ext est approx ca bzw vgl evtl ggf inkl zzgl "
    "e.g i.e pág págs pag aprox env av vs cf ibid núm tel Tel cap ул пер пл просп г-н г-жа стр рис тел д डॉ د"
).split()
#: No end when a number follows.
BEFORE_NUMBER = "No Nos no nos n nr Nr p pp S д кв корп стр гл № Nº nº".split()
#: No end when the text goes on in lower case, with a number or inside the clause.
MIXED = "etc Inc Ltd Co Corp Cos Bros LLC PLC PhD Ph.D U.S U.K U.N E.U S.A S.L a.m p.m A.M P.M UU usw др пр Cie dept Dept a.m p.m".split()
#: Abbreviations of two written parts; the last two may also end a sentence.
PAIRS = [x.split("_") for x in "z_B u_a d_h u_U o_ä i_A z_T s_o s_u v_a p_ex p_ej т_е т_ч и_о EE_UU т_д т_п".split()]
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert"
MARKS = "[ \\t]*+(?:[•◦▪‣·*–—-]|#{1,6}|\\d{1,3}[.)])[ \\t]++"
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CLOSE = "”»›’\\\")\\]」』"
GOES_ON = "\\s+[\\p{Ll}$&(—–-]"
BEFORE = f"(?:^|[\\s{BREAK}(\\[“„«¿¡/,;:–—-]|\\p{{Ll}}\\p{{Ll}}[.!?])"
#: A bullet line: up to its last letter or number (the terminators inside belong to the line), the rest, the line break.
LINE = f"(?<![^\\n])({MARKS}(?:[^\\n]*[\\p{{L}}\\p{{N}}])?)([^\\n]*+)\\n"
#: Pieces to a block of prefix sums.
BLOCK = 64


def _words(words: list[str]) -> str:
    return "|".join(w.replace(".", "\\.") for w in sorted(set(words), key=lambda w: (-len(w), w)))


def _mask() -> str:
    """One terminator that ends no sentence. Each rule starts with the terminator, so text between costs one test."""
    dots = [
        "(?=\\.)",
        "(?=\\s*\\p{Ll})(?<=\\.\\.\\.)",
        "(?=\\p{Lu}(?!\\p{L}))(?<=(?:Ph|(?:^|\\P{L})\\p{Lu})\\.)",
        f"(?=\\s*\\S)(?!\\s*\\n\\s*\\n)(?<={BEFORE}(?:{_words(TITLES)})\\.)",
        f"(?=\\s*\\p{{N}})(?<={BEFORE}(?:{_words(BEFORE_NUMBER)})\\.)",
        f"(?=\\s*\\p{{Lu}})(?<={BEFORE}\\p{{Lu}}\\.)",
        f"(?=\\s+(?:{MONTHS})\\b)(?<=\\d\\.)",
        f"(?=[,;:)]|{GOES_ON})(?!\\s*\\n{MARKS})(?<={BEFORE}(?:{_words(MIXED)})\\.)",
        f"(?=\\s+(?:\\p{{Ll}}|\\p{{N}}|\\p{{Lu}}\\.))(?<={BEFORE}[гчв]\\.)",
    ]
    for first, second in PAIRS:
        dots.append(f"(?=\\s?{second}\\.)(?<={BEFORE}{first}\\.)")
        goes_on = GOES_ON if second in ("UU", "д", "п") else "\\s*\\S"
        dots.append(f"(?={goes_on})(?<={BEFORE}{first}\\.\\s?{second}\\.)")
    return f"(?={ENDS})(?:" + "|".join([
        "[.!?](?=[\\p{Ll}\\p{N}_/])(?<=[\\p{L}\\p{N}_/@-].)",
        f"\\.(?:{'|'.join(dots)})",
        "…(?=\\s*\\p{Ll})",
    ]) + ")"


def _boundary() -> str:
    """Zero-width places between two sentences of the masked text."""
    caseless, no_gap = "[\\p{Lo}&&[^\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u9fff]]", "。！？｡।॥؟۔"
    # One look at the character before rules most places out.
    return f"(?<=[.!?…{no_gap}{CLOSE}\\n{BREAK}\\u0e00-\\u0e7f])(?:" + "|".join([
        f"(?<={BREAK})",
        f"(?=\\s)(?<=[.!?…][{CLOSE}]{{0,3}})",
        "(?=[\\p{Lu}“„«¿¡])(?<=[.!?][”»]{0,1})",
        f"(?<=[{no_gap}])(?![{no_gap}{CLOSE}.!?])",
        f"(?<=[{CLOSE}])(?![{CLOSE}])(?<=[{no_gap}][{CLOSE}]{{1,2}})",
        "(?<=\\n)(?:" + "|".join([
            "(?=[ \\t]*\\r?\\n)",
            # A line break ends a sentence unless the next line goes on in lower case, after a comma, or mid-sentence
            # in a script without case.
            f"(?=[ \\t]*[^\\s\\p{{Ll}}])(?<![,،、，][ \\t]{{0,3}}\\r?\\n)(?!(?<={caseless}[ \\t]{{0,3}}\\n)[ \\t]*{caseless})",
            f"(?={MARKS}\\S)",
        ]) + ")",
        "(?=[ \\t]+[\\u0e00-\\u0e7f])(?<=[\\u0e00-\\u0e7f])",
    ]) + ")"


def _quotation() -> str:
    """A quotation whose terminators end no sentence; one just before the closing mark does if a blank and a capital follow."""
    out = []
    for a, b in QUOTES:
        inside = f"{a}[^{a}{b}]*"
        out += [f"{inside}(?={ENDS}[{b}]\\s+\\p{{Lu}})", f"{inside}+[{b}]"]
    return "|".join(out)


MASKED = _mask()
BOUNDARY = _boundary()
QUOTATION = _quotation()


def within(marked: Column) -> Column:
    """The text without its cuts, every terminator between OPEN and SHUT masked."""
    pieces = F.split(marked, f"[{OPEN}{SHUT}]")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, MARKS_OF_END, MASK * len(MARKS_OF_END))).otherwise(p)), "")


def masked(text: Column) -> Column:
    """The text with every terminator that ends no sentence replaced by one private-use character, bullet lines ending in
    BREAK, and a line break after its end."""
    plain = F.concat(F.translate(text, BREAK + OPEN + SHUT, MASK * 3), F.lit("\n"))
    lined = within(F.regexp_replace(plain, LINE, f"{OPEN}$1{SHUT}$2{BREAK}"))
    quoted = F.when(F.translate(text, "".join(a for a, _ in QUOTES), "") != text, within(F.regexp_replace(lined, QUOTATION, f"{OPEN}$0{SHUT}"))).otherwise(lined)
    return F.regexp_replace(quoted, MASKED, MASK)


def _starts(lengths: Column) -> Column:
    """Start of every piece: prefix sums in blocks, so that the cost stays linear in the number of pieces."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x))
    firsts = F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    inner = lambda b: F.slice(
        F.aggregate(part(b), F.array(F.element_at(F.col("__firsts"), b + 1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), F.lit(1), F.size(part(b))
    )
    return firsts, F.flatten(F.transform(blocks, inner))


def split_sentences(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, start_char, end_char (code points from 0, end exclusive) and sentence for every sentence.

    NULL and blank texts have no sentence; a text without any terminator is one sentence per heading, bullet or
    paragraph; white space at both ends is left out; repeated rows give repeated rows.
    """
    out = ("start_char", "end_char", "sentence")
    d = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    d = d.withColumn("__pieces", F.split(masked(F.col("__text")), BOUNDARY))
    d = d.withColumn("__lens", F.transform("__pieces", lambda p: F.length(p)))
    firsts, starts = _starts(F.col("__lens"))
    d = d.withColumn("__firsts", firsts).withColumn("__starts", starts)
    d = d.select("__id", "__text", F.posexplode(F.arrays_zip("__pieces", "__starts")).alias("__n", "__p"))
    piece, at = F.col("__p.__pieces"), F.col("__p.__starts")
    left = F.ltrim(piece, F.lit(SPACES + BREAK))
    body = F.rtrim(left, F.lit(SPACES + BREAK))
    start = at + F.length(piece) - F.length(left)
    d = d.where(F.length(body) > 0).select(
        F.col("__id").alias(doc_id), start.cast("int").alias(out[0]), (start + F.length(body)).cast("int").alias(out[1]), "__text",
    )
    return d.withColumn(out[2], F.expr(f"substring(__text, {out[0]} + 1, {out[1]} - {out[0]})")).drop("__text")


@query("p10_found")
def p10_found(spark, sf_dir):
    """Every sentence of every document."""
    return split_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "start_char", "end_char")
