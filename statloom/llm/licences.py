"""Licence texts found by the digest of their canonical form, in DataFrame functions only.

The canonical form is lower case, without copyright statements and title lines, with one spelling of words that are
written in several ways, and with all punctuation and white space as single spaces. A document whose whole canonical text
has the digest of a known licence is that licence; lines are looked up by the same digest as notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.frames import cut_lineage, need
from .licence_texts import known_notices, known_texts

#: Spellings that count as equal.
EQUAL = {"acknowledgement": "acknowledgment", "analogue": "analog", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled", "capitalisation": "capitalization",
         "catalogue": "catalog", "centre": "center", "customise": "customize", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
         "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licencing": "licensing", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
         "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
         "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial", "sub license": "sublicense", "https": "http", "copyright owner": "copyright holder"}
#: Lines of the form of a copyright statement: with a mark, a year or a name. A line of running text that begins with the word stays.
_MARK, _YEAR, _REST = r"(?:\(c\)|©|&copy;)", r"(?:[12][0-9]{3}|[0-9]{2}xx|[\[<{(]?(?:yyyy|year)s?\b)", r"[^\n]{0,200}$"
_NO_NAME = "Notices?|Holders?|Owners?|Licen[cs]e[sd]?|Laws?|Acts?|Statements?|Interests?|Protections?|Treat(?:y|ies)|Rights?|And|Or|In|Of|Is|Disclaimers?|Infringements?"
COPYRIGHT = (r"(?m)^[^\p{L}\p{N}\n]*?(?:(?i:(?:portions\s+)?copyright[^\p{L}\p{N}\n]*?(?:" + _MARK + "|" + _YEAR + ")" + _REST + "|" + _MARK + r"[^\p{L}\p{N}\n]*?(?:copyright\b|" + _YEAR + ")" + _REST + "|©" + _REST
             + r"|all rights reserved[^\p{L}\p{N}\n]*$)|Copyright:?[ \t]+(?:(?:by|the)[ \t]+)*(?!(?:" + _NO_NAME + r")\b)\p{Lu}" + _REST + ")")
#: First lines that only name a licence.
_NAMES = ("the|a|an|and|mit|expat|x11|isc|zlib|libpng|0bsd|bsd|freebsd|netbsd|berkeley|apache|gnu|mozilla|artistic|creative|commons|cc0|legal|code|foundation|lesser|library|general|public|free|documentation|universal|clause|zero|two|three|"
          "new|modified|revised|simplified|original|style|version|open|source|software|wtfpl|gpl|lgpl|mpl|gfdl|v?[0-9]+(?:\\.[0-9]+)*|licen[cs]es?")
TITLE = r"\A\s*+(?:(?=[^\n]{0,80}(?:licen[cs]e|bsd|wtfpl))(?:[^\p{L}\p{N}\n]*+(?:" + _NAMES + r")(?![\p{L}\p{N}]))+[^\p{L}\p{N}\n]*+\n\s*+)+(?=\S)"
#: In every bundled notice, so that other lines need no digest for them.
MENTIONS = r"(?i)licen[cs]e"
SIGNS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‐-―‘-‟ ]+"


def canonical(text: Column) -> Column:
    """The canonical form; null as empty."""
    raw = F.coalesce(text, F.lit(""))
    bare = F.lower(F.when(raw.rlike(r"(?i)copyright|\(c\)|©|&copy;|all rights reserved"), F.regexp_replace(raw, COPYRIGHT, " ")).otherwise(raw))
    body = F.when(bare.rlike(r"\A\s*+[^\n]{0,80}(?:licen[cs]e|bsd|wtfpl)"), F.regexp_replace(bare, TITLE, "")).otherwise(bare)
    plain = F.trim(F.regexp_replace(body, SIGNS, " "))
    same = plain
    for a, b in EQUAL.items():
        same = F.regexp_replace(same, rf"\b{a}(s?)\b", f"{b}$1")
    return F.when(plain.rlike(r"\b(?:" + "|".join(EQUAL) + ")"), same).otherwise(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: dict[str, str] | list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of licence texts, by default the bundled ones; texts with equal forms have the name that sorts first."""
    rows = known_texts() if texts is None else texts.items() if isinstance(texts, dict) else texts
    rows = spark.createDataFrame(sorted(rows), "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame | None = None, notices: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the digest of its canonical text, the licence it is, and the notices among its lines.

    Returns doc_id, digest, licence (null if none), n_notices (lines that are a known notice) and notices (their
    distinct names, sorted, comma-joined; '' if none), one row per input row. A null text is empty and no licence. Lines
    are looked up as wholes, each by itself. Repeated rows have rows of their own. Other columns are ignored. An empty
    table gives no rows. `licences` and `notices` are tables (digest, licence) of any size, by default the bundled ones.
    With `notices` given, every line is looked up; the bundled ones all have a word that spares most lines the digest.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    licences = known(spark) if licences is None else licences
    lines = F.split("text", "\n", -1)
    if notices is None:
        notices = known(spark, known_notices())
        lines = F.when(F.col("text").rlike(MENTIONS), F.filter(lines, lambda x: x.rlike(MENTIONS))).otherwise(F.array().cast("array<string>"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = cut_lineage(d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", digest(F.col("text")).alias("digest"), lines.alias("lines")))
    lines = slim.select("rid", F.explode("lines").alias("line")).select("rid", digest(F.col("line")).alias("digest"))
    said = (lines.join(notices.select("digest", "licence"), "digest").groupBy("rid")
            .agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")))
    whole = slim.select("rid", "doc_id", "digest").join(licences.select("digest", "licence"), "digest", "left")
    return whole.join(said, "rid", "left").select("doc_id", "digest", "licence", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
