"""Licence scans by canonical digests.

A text is brought into canonical form (lower case; copyright lines left out; punctuation and white space become single spaces;
equivalent spellings become one), and SHA-256 digests of it are looked up among those of known licence texts, in a hash join.
Three units are looked up: the whole document, every line, and every run of as many words as a known text has that begins with
the words it begins with; so a known text is found within other words and however it is wrapped. Only DataFrame functions are
used; documents are read once and not shuffled. A canonical form is made only of documents with a word that every match needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_texts import KNOWN

#: Equivalent spellings (fixed values), looked for between spaces.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("fulfil", "fulfill"),
    ("whilst", "while"), ("merchantibility", "merchantability"), ("v", "version"), ("ver", "version"),
)

#: A line that names the holder of the rights: a copyright word or sign and then a sign, a year or a place for one. A line of a
#: licence that happens to begin with the word stays.
COPYRIGHT = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©).*$"
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Words with which a run must begin to be looked up, and least letters of a word that is asked for first.
OPENING, HINT = 3, 5


def canonical(text: Column) -> Column:
    """Canonical form, with a space at either end."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, SEPARATORS, "  "), F.lit(" "))  # two spaces, so that neighbours both match
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.regexp_replace(out, " +", " ")


def _digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def digest(text: Column) -> Column:
    return _digest(canonical(text))


def hints(forms: list[str]) -> list[str]:
    """Few stems of which every canonical form holds one; empty if there are forms without a word that would do.

    A word that has several spellings counts by the letters these have in common.
    """
    stems = {}
    for a, b in SPELLINGS:
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        stems[b] = min(stems.get(b, b), b[:same], key=len)
    of = [{stems.get(w, w) for w in form.split() if len(stems.get(w, w)) >= HINT} for form in forms]
    out: list[str] = []
    while of:
        counts: dict[str, int] = {}
        for words in of:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        if not counts:
            return []
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        out.append(best)
        of = [words for words in of if not any(best in w for w in words)]
    return out


def find_licences(docs: DataFrame, known: DataFrame, most_known: int = 100_000) -> DataFrame:
    """``doc_id, scope, line, license_id``: one row per known licence text that is a whole document, a line, or a run of words.

    ``scope`` is ``text`` (``line`` is then 0), ``line`` (counted from 1) or ``run`` (``line`` is the first word, counted from 1 in
    the canonical form). ``known`` has ``license_id, text``; the driver reads it, up to ``most_known`` rows, more are refused.
    Texts without a letter or digit, and nulls, match nothing. Texts with one digest give one row per identifier. Of a very
    long text each line, and each run that begins like a known text, is a row. Null ids stay null, repeated rows are each
    answered, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    forms = known.where("text IS NOT NULL AND license_id IS NOT NULL").select("license_id", F.trim(canonical(F.col("text"))).alias("form"))
    rows = forms.where("form <> ''").distinct().limit(most_known + 1).collect()
    if len(rows) > most_known:
        raise ValueError(f"more than {most_known} known texts")
    words = {r["form"]: r["form"].split(" ") for r in rows}
    listed = spark.createDataFrame([(r["license_id"], f" {r['form']} ") for r in rows], "license_id string, form string")
    listed = F.broadcast(listed.select("license_id", _digest(F.col("form")).alias("d")))  # at most most_known digests
    starts = {(" ".join(w[:OPENING]), len(w)) for w in words.values()}
    starts = F.broadcast(spark.createDataFrame(sorted(starts), "opening string, size int"))
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("text IS NOT NULL")
    needed = F.lit(not words)
    for stem in hints(list(words)):
        needed = needed | F.lower("text").contains(stem)
    read = read.where(needed) if hints(list(words)) else read
    blank = digest(F.lit(""))
    whole = F.array(F.struct(F.lit("text").alias("scope"), F.lit(0).cast("long").alias("line"), digest(F.col("text")).alias("d")))
    lines = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct(F.lit("line").alias("scope"), (i + 1).cast("long").alias("line"), digest(t).alias("d"))
    )
    units = read.select("doc_id", F.explode(F.concat(whole, lines)).alias("u")).select("doc_id", "u.*")
    form = read.select("doc_id", F.split(F.trim(canonical(F.col("text"))), " ").alias("words"))
    openings = F.transform("words", lambda w, i: F.concat_ws(" ", *(F.get(F.col("words"), i + k) for k in range(OPENING))))
    # a text shorter than an opening begins with itself
    places = form.select("doc_id", "words", F.posexplode(openings).alias("at", "opening"))
    short = sorted({w[0] for w in words.values() if len(w) < OPENING} | {" ".join(w) for w in words.values() if 1 < len(w) < OPENING})
    if short:
        more = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get(F.col("words"), i + 1)))
        for part in (F.col("words"), more):
            places = places.unionByName(form.select("doc_id", "words", F.posexplode(part).alias("at", "opening")).where(F.col("opening").isin(short)))
    runs = places.join(starts, "opening").where(F.col("at") + F.col("size") <= F.size("words"))
    run = F.concat(F.lit(" "), F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " "), F.lit(" "))
    runs = runs.select("doc_id", F.lit("run").alias("scope"), (F.col("at") + 1).cast("long").alias("line"), _digest(run).alias("d"))
    units = units.unionByName(runs.distinct() if short else runs).where(F.col("d") != blank)
    return units.join(listed, "d").select("doc_id", "scope", "line", "license_id")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    return find_licences(table(spark, sf_dir, "documents"), known)


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g')"
    out = f"' ' || regexp_replace({out}, '{SEPARATORS}', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"regexp_replace({out}, ' +', ' ', 'g')"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP6_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}),
listed AS (SELECT DISTINCT license_id, {_sql_canonical("text")} AS c FROM known),
units AS (
  SELECT doc_id, 'text' AS scope, CAST(0 AS BIGINT) AS line, text AS t FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', CAST(i AS BIGINT), string_split(text, chr(10))[i]
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
),
canon AS (SELECT doc_id, scope, line, {_sql_canonical("t")} AS c FROM units),
form AS (SELECT doc_id, c FROM canon WHERE scope = 'text' AND trim(c) <> ''),
hit AS (SELECT doc_id, f.c, license_id, l.c AS k FROM form f JOIN listed l ON contains(f.c, l.c)),
run AS (
  SELECT doc_id, license_id, list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + len(k) - 1) = k) AS places
  FROM (SELECT doc_id, license_id, string_split(trim(c), ' ') AS w, string_split(trim(k), ' ') AS k FROM hit)
)
SELECT doc_id, scope, line, license_id FROM canon JOIN listed USING (c) WHERE trim(c) <> ''
UNION ALL
SELECT doc_id, 'run', CAST(unnest(places) AS BIGINT), license_id FROM run
"""
