"""Operator 9, licence scans, in built-in functions only: digests of normalised texts joined with known digests.

A text is normalised once: lower case, copyright lines away, punctuation and blanks to single blanks, equivalent spellings to
one. Entire texts are hash-joined with the digests of known licence texts. Notices stand among other text, so the lines of a document,
and its paragraphs of several lines, are exploded and hash-joined as well. The known digests are broadcast where there are at most
``MOST_BROADCAST`` of them; beyond that the join is Spark's to plan, so any number may be known. Units shorter or longer than every known text are not digested. Known from the start are the texts
and notices of :mod:`.licence_texts`; :func:`known_folder` reads more.

Defined cases: a null text counts as empty and matches nothing, nor does a text or unit of which nothing is left; a line that
occurs again counts again; repeated rows are all reported; a column that bears a name of the result gives way to it, all other columns are kept,
whatever their names; texts may be of any length; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import KNOWN
from .shared import fresh_names, quoted

#: Beginnings of words that count as the same, and words that do.
STEMS = [("licenc", "licens"), ("organis", "organiz"), ("recognis", "recogniz"), ("authoris", "authoriz"), ("utilis", "utiliz"), ("neighbour", "neighbor"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("programme", "program"), ("cancelled", "canceled")]
WORDS = [("http", "https"), ("version", "v"), ("whilst", "while"), ("sub license", "sublicense"), ("non commercial", "noncommercial")]
COPYRIGHT = r"(?m)^[^\n]*(?:copyright (?:\(c\)|[0-9])|\(c\) [0-9]|©)[^\n]*$"
_WORD = r"a-z0-9\x{80}-\x{10FFFF}"
#: Punctuation with the blanks around it, and several blanks.
MARKS = rf" ?(?:[^{_WORD} \n]+ *)+| {{2,}}"
#: Known digests, of about 150 bytes each, that are broadcast.
MOST_BROADCAST = 50_000
BREAK = r"\n *\n[ \n]*"


def normal(text: Column) -> Column:
    """Normalised lines, with a blank at either end of each."""
    low = F.lower(text)
    some = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    low = F.when(some, F.regexp_replace(low, COPYRIGHT, " ")).otherwise(low)
    out = F.concat(F.lit(" "), F.replace(F.regexp_replace(low, MARKS, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in STEMS:
        out = F.replace(out, F.lit(f" {a}"), F.lit(f" {b}"))
    for a, b in WORDS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return out


def one_line(normalised: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(normalised, F.lit("\n"), F.lit(" ")), " {2,}", " "))


def _digest(line: Column) -> Column:
    return F.coalesce(F.sha2(line, 256), F.lit(""))  # never null, so that a join has nothing to filter


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """Digests of known licence texts, (digest, licence, size of the normalised text), one row a digest. ``known``: pairs, or a frame (licence, text)."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "licence string, text string")
    line = one_line(normal(F.coalesce("text", F.lit(""))))
    rows = rows.select(_digest(line).alias("digest"), "licence", F.length(line).alias("size")).where("size > 0")
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.first("size").alias("size"))


def known_folder(spark: SparkSession, path: str) -> DataFrame:
    """Known licences from a folder of whole texts, each named by its file: frames for :func:`known_digests`."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.txt$", "").alias("licence"), F.col("value").alias("text"))


RESULT = ["text_licence", "n_lines", "n_licence_lines", "n_licence_paragraphs", "licences"]


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` with text_licence (of the entire text), n_lines, n_licence_lines, n_licence_paragraphs (of several lines) and licences (of lines and paragraphs, sorted).

    One small job finds how many known texts there are, and their least and greatest size."""
    low, high, n = known.agg(F.min("size"), F.max("size"), F.count(F.lit(1))).first()
    k1, k2, norm = fresh_names(docs, "k1", "k2", "norm")
    text = F.coalesce("text", F.lit(""))
    keys = [F.xxhash64(text).alias(k1), F.xxhash64(F.lit(1), text).alias(k2)]  # what is found depends on the text alone
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    lines = F.transform(F.split(norm, "\n"), lambda x: unit("line", F.trim(x)))
    several = F.filter(F.transform(F.split(norm, BREAK), lambda x: F.btrim(x, F.lit(" \n"))), lambda x: F.contains(x, F.lit("\n")))
    paragraphs = F.transform(several, lambda x: unit("paragraph", one_line(x)))
    units = F.filter(F.concat(F.array(unit("text", one_line(F.col(norm)))), lines, paragraphs), lambda x: F.length(x["unit"]).between(low or 1, high or 0))
    digests = known.select("digest", "licence")
    found = docs.select(*keys, normal(text).alias(norm)).select(k1, k2, F.posexplode(units).alias("pos", "u")).select(k1, k2, "pos", "u.kind", _digest(F.col("u.unit")).alias("digest"))
    found = found.join(F.broadcast(digests) if n <= MOST_BROADCAST else digests, "digest").select(k1, k2, "pos", "kind", "licence").distinct()
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    found = found.groupBy(k1, k2).agg(
        F.min(of("text", F.col("licence"))).alias("text_licence"), F.count(of("line", F.lit(1))).alias("n_licence_lines"), F.count(of("paragraph", F.lit(1))).alias("n_licence_paragraphs"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") != "text", F.col("licence")))), ",").alias("licences"),
    )
    keep = [c for c in docs.columns if c not in RESULT]
    out = docs.select(*quoted(keep), *keys, F.size(F.split(text, "\n")).cast("long").alias("n_lines")).join(found, [k1, k2], "left")
    values = {"n_licence_lines": F.coalesce("n_licence_lines", F.lit(0)), "n_licence_paragraphs": F.coalesce("n_licence_paragraphs", F.lit(0)), "licences": F.coalesce("licences", F.lit(""))}
    return out.select(*quoted(keep), *[values.get(c, F.col(c)).alias(c) for c in RESULT])


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licences(docs, known_digests(spark)).drop("text")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g'), '{MARKS}', ' ', 'g')"
    out = f"' ' || replace({out}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for a, b in STEMS:
        out = f"replace({out}, ' {a}', ' {b}')"
    for a, b in WORDS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return out


def _line_sql(normalised: str) -> str:
    return f"trim(regexp_replace(replace({normalised}, chr(10), ' '), ' {{2,}}', ' ', 'g'))"


ORACLE_SQL = f"""
WITH k AS (SELECT sha256({_line_sql("n")}) AS digest, min(l) AS licence FROM (SELECT l, {_sql("t")} AS n FROM (VALUES {", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in KNOWN)}) v(l, t)) GROUP BY 1),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_sql("coalesce(text, '')")} AS n FROM documents),
u AS (SELECT r, 0 AS kind, trim(unnest(string_split(n, chr(10)))) AS unit FROM d UNION ALL
      SELECT r, 1, {_line_sql("p")} FROM (SELECT r, trim(unnest(regexp_split_to_array(n, '{BREAK}')), ' ' || chr(10)) AS p FROM d) WHERE contains(p, chr(10))),
f AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
      FROM (SELECT r, kind, sha256(unit) AS digest FROM u WHERE unit <> '') JOIN k USING (digest) GROUP BY r)
SELECT doc_id, licence AS text_licence, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(n0, 0) AS BIGINT) AS n_licence_lines, CAST(coalesce(n1, 0) AS BIGINT) AS n_licence_paragraphs, coalesce(licences, '') AS licences
FROM d LEFT JOIN f USING (r) LEFT JOIN k ON digest = sha256({_line_sql("n")})
"""
