"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: letters A-Z lower-cased, copyright statements dropped, punctuation
and white space made one space, equivalent spellings made equal.  Its SHA-256 is then joined to the digests
of known licences: entire texts to licence texts, and entire lines to licence notices.

The form of an entire text does not depend on where its lines break.  A copyright statement starts at "copyright" with
a sign or a year (or at the sign with a year) and ends with its paragraph, or before the words that open the next
sentence of a licence (``OPENERS``), so it takes holders and years with it, on however many lines.  In a single line
it ends with the line at the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfolds.llm.licence_texts import KNOWN

# Spellings that the licence matching guidelines hold equal (canonical form on the right).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favourite", "favorite"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
    (" and or ", " or "),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "“”‘’–—·•\ue000\u2029"  # quotes, dashes and bullets that stand for ASCII ones, and the two signs below
START, PARAGRAPH = "\ue000", "\u2029"  # a copyright statement's start, and the end of a paragraph
_GAP = r"[ \t\r\n*#/;:%-]*"
COPYRIGHT = rf"copyright{_GAP}(\(c\)|©|[0-9]{{4}}|<year>|\[yyyy\]|\{{yyyy\}})|\(c\){_GAP}[0-9]{{4}}|©"
# Words with which licences go on after a copyright statement.
OPENERS = [
    "all rights reserved",
    "distributed under",
    "everyone is permitted",
    "licensed under",
    "permission is",
    "permission to",
    "redistribution and use",
    "released under",
    "spdx license identifier",
    "this",
    "you may",
]
RESERVED = " all rights reserved "
PUNCTUATION = r"[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f©]+"
NO_ID = -(1 << 63)


def _statement(end: str) -> str:
    """A copyright statement up to ``end``, the text's end or an opener, which is group 1."""
    return f"{START}[^{end}]*?({end}|\\z| (?:{'|'.join(OPENERS)}) )"


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER + MARKS, LOWER + " " * len(MARKS))


def _spelt(low: Column) -> Column:
    """Letters, punctuation and the spellings of one word, lines kept apart; statements of copyright are marked by their start."""
    signed = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    t = F.when(signed, F.regexp_replace(low, COPYRIGHT, START)).otherwise(low)
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), PUNCTUATION, " ")
    for a, b in SPELLINGS:
        if " " not in a:
            t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _without_statement(t: Column) -> Column:
    """A folded text without its copyright statements and paragraph ends."""
    cut = F.when(F.contains(t, F.lit(START)), F.regexp_replace(t, _statement(PARAGRAPH), " $1")).otherwise(t)
    cut = F.regexp_replace(F.replace(cut, F.lit(PARAGRAPH), F.lit(" ")), " +", " ")
    return F.when(F.contains(t, F.lit(START)) | F.contains(t, F.lit(PARAGRAPH)), cut).otherwise(t)


def _phrases(t: Column) -> Column:
    """Spellings of several words, and the reservation of rights."""
    for a, b in SPELLINGS:
        if " " in a:
            t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.replace(t, F.lit(RESERVED), F.lit(" ")))


def _units(lines: Column) -> Column:
    """The canonical forms of the whole text (first) and of each of its lines.  Each step is a ``transform`` of its own, so that
    it runs once a unit: inside one, an expression used twice is computed twice."""
    whole = F.translate(F.regexp_replace(lines, "\n *\n[ \n]*", PARAGRAPH), "\n", " ")
    units = F.concat(F.array(whole), F.split(lines, "\n"))
    units = F.transform(units, lambda t: F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), " +", " "))
    return F.transform(F.transform(units, _without_statement), _phrases)


def canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its canonical units (``_units`` of column ``text``) as column ``units``."""
    steps = df.withColumn("units", _lower(F.col(text).cast("string")))
    return steps.withColumn("units", _spelt(F.col("units"))).withColumn("units", _units(F.col("units")))


def _digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical.cast("binary"), 256))


def known(spark, rows=KNOWN) -> DataFrame:
    """(licence, digest) of (licence, text) rows: a small table, one row per known text."""
    df = spark.createDataFrame(rows, "licence string, text string")
    return canonical(df).select("licence", _digest(F.col("units")[0]).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of the canonical text; null if nothing is left of it),
    licence (whose text the whole document is, else null), n_notices (lines that are a known text),
    notices (their licences, distinct, sorted, comma-joined).

    Null and empty texts have no digest.  Equal texts get equal rows; rows without or with repeated doc_id
    are scanned like others.
    """
    licences = known(docs.sparkSession) if licences is None else licences
    kind = docs.schema["doc_id"].dataType
    text = F.col("text").cast("string")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    # unit 0 is the whole text, the others are its lines; one row of units per document leaves each task
    digests = F.transform("units", _digest)
    base = canonical(base).select("d", "h", digests.alias("digests"))
    lines = F.filter(F.slice("digests", 2, F.greatest(F.size("digests") - 1, F.lit(0))), lambda x: x.isNotNull())
    units = F.concat(F.slice("digests", 1, 1), lines)
    units = base.select("d", "h", F.posexplode(units).alias("unit", "digest"))
    found = units.join(F.broadcast(licences), "digest", "left")  # as many rows as known texts
    whole, line = F.col("unit") == 0, (F.col("unit") > 0) & F.col("licence").isNotNull()
    out = found.groupBy("d", "h").agg(
        F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.sum(whole.cast("long")).alias("copies"),
        F.sum(line.cast("long")).alias("n"),
        F.collect_set(F.when(line, F.col("licence"))).alias("notices"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        F.when(F.col("d") != NO_ID, F.col("d")).cast(kind).alias("doc_id"),
        "digest",
        "licence",
        F.expr("n div copies").alias("n_notices"),
        F.array_join(F.sort_array("notices"), ",").alias("notices"),
    )


def scan_sql(rows=KNOWN) -> str:
    """The same scan of ``documents`` as DuckDB SQL (doc_id unique)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def words(x: str) -> str:
        x = f"translate(coalesce({x}, ''), {quote(UPPER + MARKS)}, {quote(LOWER + ' ' * len(MARKS))})"
        x = f"regexp_replace({x}, {quote(COPYRIGHT)}, {quote(START)}, 'g')"
        return f"regexp_replace(replace({x}, '&', ' and '), {quote(PUNCTUATION)}, ' ', 'g')"

    def spelt(x: str, several: bool) -> str:
        for a, b in SPELLINGS:
            if (" " in a) == several:
                x = f"replace({x}, {quote(a)}, {quote(b)})"
        return x

    # a statement is cut out of each paragraph: what stands before its sign, and what follows from an opener on
    opener = f"(.*?) (({'|'.join(OPENERS)}) .*)$"

    def without(p: str) -> str:
        p = f"(' ' || regexp_replace({p}, '\\s+', ' ', 'g') || ' ')"
        parts = f"string_split(regexp_replace({p}, ' +', ' ', 'g'), {quote(START)})"
        rest = f"list_transform(({parts})[2:], lambda r: regexp_extract(r, {quote(opener)}, 2))"
        return f"(({parts})[1] || ' ' || array_to_string({rest}, ' '))"

    def unit(paragraphs: str) -> str:
        x = f"array_to_string(list_transform({paragraphs}, lambda p: {without('p')}), ' ')"
        x = spelt(f"regexp_replace(' ' || {x} || ' ', ' +', ' ', 'g')", True)
        return f"trim(replace({x}, {quote(RESERVED)}, ' '))"

    def digest(x: str) -> str:
        return f"case when {x} <> '' then sha256({x}) end"

    def whole(x: str) -> str:
        return unit(f"regexp_split_to_array({x}, '\\n *\\n[ \\n]*')")

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""
with known as (
  select digest, min(licence) as licence
  from (select licence, {digest("u")} as digest from (select licence, {whole("l")} as u from (
    select licence, {spelt(words("t"), False)} as l from (values {values}) v(licence, t))))
  where digest is not null group by digest
), docs as (
  select doc_id, {spelt(words("text"), False)} as l from documents
), whole as (
  select doc_id, {digest("u")} as digest from (select doc_id, {whole("l")} as u from docs)
), lines as (
  select doc_id, {digest("u")} as digest
  from (select doc_id, {unit("[line]")} as u from (select doc_id, unnest(string_split(l, chr(10))) as line from docs))
), notices as (
  select doc_id, count(*) as n_notices, string_agg(distinct licence, ',' order by licence) as notices
  from lines join known using (digest) group by doc_id
)
select w.doc_id, w.digest, k.licence, coalesce(n.n_notices, 0) as n_notices, coalesce(n.notices, '') as notices
from whole w left join known k using (digest) left join notices n using (doc_id)
"""
