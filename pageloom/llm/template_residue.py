"""Template residue and error-page text: delimiter-specific placeholder grammars and multilingual notice patterns.

Everything is one pass of JVM-side regular expressions per field; nothing is shuffled. Quoted speech, code spans and
single placeholders inside a tutorial are taken out before matching, so a text that talks about templates, errors or
scripts is no case. Patterns use no look-around, so the same text runs in other SQL engines.

Wordings that no pattern knows are learned from repetition: a text that stands word for word in the records of many
sources, numbers apart, tells of the sites' software and not of a person. Its key is two hashes, combined before the
shuffle; sources count, not records, so a source with a third of all records has one vote.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.registry import query
from pageloom.session import spread, table, written

# What a placeholder may be called, and the patterns of residue, filler, failures, notices and scripts.
SLOT = "[\\p{L}_][\\p{L}\\p{N}_ .:|'-]{0,40}"
SLOT_WORDS = "(?:insert|your|name|email|e-mail|phone|mobile|address|title|company|office|city|date|first|last|field|agent|bio|here|nombre|nom|vorname|nachname|tagline|manager|staff|user|person|rep|contact|role|department|territory|region|recipient|client|customer)"
PLACEHOLDERS = [
    "\\{\\{[^{}]{1,80}\\}\\}", "\\{%[^{}]{1,80}%\\}", "<%[^<>]{1,80}%>", "&lt;[^&;]{1,80}&gt;", f"<<\\s*{SLOT}\\s*>>",
    f"[$#]\\{{\\s*{SLOT}\\s*\\}}", f"@@{SLOT}@@", f"%%{SLOT}%%", f"\\$\\$\\s*{SLOT}\\$\\$", f"__{SLOT}__", f"\\*\\|{SLOT}\\|\\*",
    f"\\(\\(\\s*{SLOT}\\)\\)", f"\\[\\[\\s*{SLOT}\\]\\]", f"%{SLOT}%",
    "\\{\\s*[\\p{L}\\p{N}_][\\p{L}\\p{N}_ .|-]{0,40}\\}",
    f"\\[[^\\[\\]]{{0,30}}\\b{SLOT_WORDS}\\b[^\\[\\]]{{0,30}}\\]", f"\\[[^\\[\\]]{{0,20}}_[^\\[\\]]{{0,20}}\\]", "\\[(?:first|last)[_ ]?(?:name)?\\]",
    "<!--", "\\btodo\\b\\s*[:-]", "\\btodo add\\b",
]
FILLER = [
    "\\blorem ipsum\\b", "\\bdolor sit\\s*amet\\b", "\\but enim ad minim\\b", "\\bconsectetur\\b", "\\bx{3,}(?:\\s+x{2,})+\\b", "\\basdf\\b", "\\bqwerty\\b",
    "\\b(?:text text text|test test test|bla bla bla|foo bar)\\b", "\\b(?:goes|go|comes) here\\b[.!]?", "\\bbody copy\\b.{0,20}\\bfollow\\b", "\\bsample (?:paragraph|text|person|name)\\b",
    "\\bclick (?:here )?to edit\\b", "\\bedit or remove this text\\b", "\\badd your own text\\b", "\\bdescribe your (?:team member|item)\\b", "\\bwrite a short bio\\b",
    "\\b(?:placeholder|dummy|blind|filler) text\\b", "\\bunder construction\\b", "\\btext will follow\\b", "\\bcontent coming soon\\b", "\\bblindtext\\b",
    "\\b(?:person|member|staff|employee|full|agent|contact) name \\d", "\\bteam member \\d", "\\b(?:insert|your|add) (?:full |first |last )?name\\b", "\\bname surname\\b",
    "\\bvorname nachname\\b", "\\bfirst ?name last ?name\\b", "\\bnombre apellido", "\\bpr[eé]nom nom\\b", "\\b(?:jane|john) (?:q\\. )?(?:sample|doe|public)\\b", "\\b(?:max|erika) mustermann\\b",
]
FAILURES = [
    "#(?:name\\?|ref!|n/a\\b|value!|div/0!|null!|num!)", "\\[object object\\]", "\\b(?:null|undefined|nan|none)[ ,]+(?:null|undefined|nan|none)\\b", ":\\s*(?:undefined|null|nan)\\b",
    "\\btraceback \\(most recent", "\\bfatal(?: error)?:", "\\bwarning: (?:undefined|division|include|require)", "\\bcall to undefined\\b", "\\bundefined (?:array key|index|variable|method|offset)\\b",
    "\\b(?:key|type|value|attribute|name|index|reference|syntax)error: ", "\\bnullpointerexception\\b", "\\bexception in thread\\b", "\\bstack ?trace\\b",
]
NOTICES = [
    "\\b(?:http )?(?:error|fehler|erreur)\\s*:?\\s*[45]\\d\\d\\b", "\\b[45]\\d\\d\\s+(?:forbidden|not found|unauthorized|bad gateway|service|internal|gone|error)", "\\b404 [–—-]", "\\bpage (?:you (?:asked|requested|are looking).{0,40})?(?:was |could )?not (?:be )?found\\b",
    "\\bpage you (?:asked|requested)\\b", "\\bseite (?:wurde )?nicht gefunden\\b", "\\bpage introuvable\\b", "\\bp[aá]gina (?:solicitada )?no (?:existe|encontrada|se encuentra)", "ページが見つかりません", "страница не найдена",
    "\\bservice is (?:temporarily |currently )?unavailable\\b", "\\bupstream did not answer\\b", "\\bsomething went wrong\\b", "\\bdatabase connection\\b.{0,20}\\b(?:could|can|fail|refus|lost|error)", "\\btoo many requests\\b", "\\bretry after \\d+ second",
    "\\baccess (?:to this page |to this site )?(?:was |is |has been )?(?:refused|denied|forbidden|blocked)\\b", "\\bsession (?:has )?expired\\b", "\\bsign in again\\b", "\\baccount is suspended\\b",
    "\\bchecking (?:that|if|whether) you are (?:a )?human\\b", "\\bchecking your browser\\b", "\\bjust a moment\\b", "\\bbrowser is (?:out of date|outdated|not supported)\\b", "\\bloading,? please wait\\b", "\\bverify (?:that )?you are human\\b",
]
SCRIPTS = [
    "\\b(?:enable|activate|allow|switch on|turn on|need|needs|requires?|activez?|activer|aktivieren|habilite|habilitar|active|включите|ativar)\\b[^.!?。]{0,40}\\bjava ?scripts?\\b", "\\bjava ?scripts?\\b[^.!?。]{0,30}\\b(?:is |are )?(?:disabled|required|turned off|switched off|blocked|deaktiviert|desactivado)\\b",
    "javascriptを有効", "\\bscripts? turned off\\b", "\\buse scripts to show\\b", "\\bnoscript\\b",
]
#: Patterns that only count when they are the whole field.
WHOLE = ["\\[[\\p{L}_][^\\[\\]]{0,40}\\](?:[ ,]+\\[[\\p{L}_][^\\[\\]]{0,40}\\])*", "(?:contact: )?[fl]name(?: [fl]name)?", "(?:null|undefined|nan|none|n\\.?n\\.?)", "(?:contact: )?(?:heading|headline|title|text) goes here", "error"]


def _by_first_letter(patterns: list[str]) -> str:
    """One pattern for lower-case text: alternatives at a word's start meet only the words of their first letter."""
    words: dict[str, list[str]] = {}
    rest = []
    for p in patterns:
        group = re.match(r"\\b\(\?:([^()|]+(?:\|[^()|]+)+)\)(?!\?)", p)
        heads = [h + p[group.end():] for h in group[1].split("|")] if group else [p[2:]] if p.startswith("\\b") else [p]
        for h in heads:
            if (group or p.startswith("\\b")) and h[0].isalnum() and not h[1:2] in ("{", "?", "*", "+"):
                words.setdefault(h[0], []).append(h[1:])
            else:
                rest.append("\\b" + h if group or p.startswith("\\b") else h)
    return "|".join(["\\b(?:" + "|".join(f"{a}(?:{'|'.join(b)})" for a, b in sorted(words.items())) + ")", *rest])


QUOTED = "“[^”]*”|„[^“”]*[“”]|«[^»]*»|`[^`]*`|<code>[^<]*</code>"
TUTORIAL = "\\b(?:syntax|tutorial|snippet|documentation|template language|code sample|merge tags?)\\b"
RESIDUE = "(?iu)" + "|".join(PLACEHOLDERS)
TROUBLE = _by_first_letter(FILLER + FAILURES + NOTICES + SCRIPTS)
#: A text without any of these holds no placeholder.
SLOT_MARKS = ("{", "[", "<", "%", "@@", "__", "$$", "*|", "((", "&lt;", "&LT;", "todo", "TODO", "Todo")
ENTIRE = "(?iu)^\\s*(?:" + "|".join(WHOLE) + ")\\s*$"
#: A text about templates may show placeholders up to this share of its characters.
TUTORIAL_DENSITY = 0.15


def residue(text: Column) -> Column:
    """Whether a text holds template residue, filler, a failure value, a notice or a scripts-required text.

    NULL, empty and blank texts hold none. Quotations and code spans never count; placeholders in a text that speaks of
    template syntax count only from a density of TUTORIAL_DENSITY on.
    """
    held = lambda marks: reduce(or_, (text.contains(m) for m in marks))
    plain = F.when(held(("“", "„", "«", "`", "<code>")), F.regexp_replace(text, QUOTED, " ")).otherwise(text)
    bare = F.when(held(SLOT_MARKS), plain.rlike(RESIDUE)).otherwise(False)
    dense = F.length(F.regexp_replace(plain, RESIDUE, "")) <= F.length(plain) * (1 - TUTORIAL_DENSITY)
    slots = F.when(bare, ~plain.rlike("(?i)" + TUTORIAL) | dense).otherwise(False)
    return F.coalesce(slots | F.lower(plain).rlike(TROUBLE) | text.rlike(ENTIRE), F.lit(False))


def fields_with_residue(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """row_id and field_name for every field that :func:`residue` finds; repeated rows give repeated results."""
    marks = F.filter(F.array(*(F.when(residue(F.col(f)), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return df.select(F.col(row_id), F.explode(marks).alias("field_name"))


#: A text of so many words or more in so many sources or more is a notice.
LEAST_WORDS, LEAST_SOURCES = 3, 8


def repeated_notices(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """row_id of every row whose text, letters only, stands in LEAST_SOURCES sources or more.

    NULL, empty and shorter texts are none; rows without source have no vote, but are found; repeated rows give repeated
    results.
    """
    letters = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^\\p{L}]+", " "))
    keys = df.select(row_id, F.col(source).alias("__source"), letters.alias("__k")).where(F.col("__k").rlike(f"^[^ ]+(?: [^ ]+){{{LEAST_WORDS - 1}}}"))
    keys = written(keys.select(row_id, "__source", F.xxhash64("__k").alias("h1"), F.xxhash64(F.lit(5), "__k").alias("h2")))
    votes = keys.where("__source IS NOT NULL").select("h1", "h2", "__source").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(votes.where(F.col("n") >= LEAST_SOURCES), ["h1", "h2"], "left_semi").select(row_id)


def _sql(col: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    any_of = lambda text, patterns: "(" + " OR ".join(f"regexp_matches({text}, {q('(?i)' + p)})" for p in patterns) + ")"
    plain = f"regexp_replace({col}, {q(QUOTED)}, ' ', 'g')"
    taken = plain
    for p in PLACEHOLDERS:
        taken = f"regexp_replace({taken}, {q('(?i)' + p)}, '', 'g')"
    dense = f"length({taken}) <= length({plain}) * {1 - TUTORIAL_DENSITY}"
    slots = f"({any_of(plain, PLACEHOLDERS)} AND (NOT regexp_matches({plain}, {q('(?i)' + TUTORIAL)}) OR {dense}))"
    return f"({slots} OR {any_of(plain, FILLER + FAILURES + NOTICES + SCRIPTS)} OR regexp_matches({col}, {q(ENTIRE.replace('(?iu)', '(?i)'))}))"


_KEY = "trim(regexp_replace(lower(evidence), '[^\\p{L}]+', ' ', 'g'))"
_REPEATED = f"""SELECT record_id FROM records WHERE {_KEY} IN (SELECT {_KEY} FROM records WHERE source_id IS NOT NULL AND len(string_split({_KEY}, ' ')) >= {LEAST_WORDS} GROUP BY 1 HAVING count(DISTINCT source_id) >= {LEAST_SOURCES})"""


def residue_fields(spark, sf_dir) -> DataFrame:
    """record_id, field_name of names and evidence texts with residue, by pattern or by repetition."""
    records = table(spark, sf_dir, "records")
    marked = fields_with_residue(spread(records.select("record_id", "name", "evidence")), "record_id", ["name", "evidence"])
    learned = repeated_notices(spread(records.select("record_id", "source_id", "evidence")), "record_id", "evidence", "source_id")
    return marked.unionByName(learned.withColumn("field_name", F.lit("evidence"))).distinct()


@query("p4_found", f"""SELECT record_id, 'name' AS field_name FROM records WHERE {_sql('name')} UNION SELECT record_id, 'evidence' FROM records WHERE {_sql('evidence')} UNION SELECT record_id, 'evidence' FROM ({_REPEATED})""")
def p4_found(spark, sf_dir):
    """Names and evidence texts that hold residue instead of, or beside, content."""
    return residue_fields(spark, sf_dir)


@query("p4_clean", f"SELECT record_id FROM records WHERE NOT coalesce({_sql('name')}, false) AND NOT coalesce({_sql('evidence')}, false) AND record_id NOT IN ({_REPEATED})")
def p4_clean(spark, sf_dir):
    """Records that may be kept: neither field holds residue."""
    return table(spark, sf_dir, "records").select("record_id").join(residue_fields(spark, sf_dir), "record_id", "left_anti")


@query("p4_learned", _REPEATED)
def p4_learned(spark, sf_dir):
    """Records whose evidence is a notice by repetition alone, without any list of wordings."""
    return repeated_notices(spread(table(spark, sf_dir, "records").select("record_id", "source_id", "evidence")), "record_id", "evidence", "source_id")
