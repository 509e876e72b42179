"""Licence scan: whole texts and single lines against digests of known licence texts. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flightlens.llm.common import read_documents
from flightlens.llm.license_texts import LICENSES, NOTICES

# Equivalent spellings, fixed values: word -> its canonical form.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "customisation": "customization",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "holder": "owner",
    "holders": "owners", "http": "https", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organisations": "organizations", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}

# A line with a copyright sign or word followed by a year or a place for one, and "all rights reserved" on its own.
COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^a-z0-9\n]*(?:\(c\)|©)?[^a-z0-9\n]*(?:[0-9]{4}|year|yyyy)[^\n]*$"
    r"|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)


def folded(text: Column) -> Column:
    """Lower case, without copyright lines, every run of other signs than letters, digits and newlines one space."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " ")


def one_line(fold: Column) -> Column:
    return F.trim(F.regexp_replace(fold, r"[ \n]+", " "))


def words(line: Column) -> Column:
    """Number of words of a folded line."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def digest(line: Column) -> Column:
    """Digest of a folded line after canonical spelling, word by word."""
    spelled = lambda w: F.coalesce(*[F.when(w == a, F.lit(b)) for a, b in SPELLINGS.items()], w)
    return F.sha2(F.array_join(F.transform(F.split(line, " "), spelled), " "), 256)


def known_digests(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(license, digest, words); texts with equal canonical form keep the first name."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, text string")
    line = rows.select("license", one_line(folded(F.col("text"))).alias("line"))
    return line.groupBy(digest(F.col("line")).alias("digest"), words(F.col("line")).alias("words")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, licenses: dict[str, str] = LICENSES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, license, n_notices, notices): the licence a whole text is, and the licence notices among its lines.

    Texts and lines are brought to one form (case, signs, copyright lines, equivalent spellings), digested, and joined by
    digest with the known texts. The known tables are arguments of fixed size, so they are broadcast. A spelling replaces
    one word by one word, so a folded text can match only if it has as many words as some known text; others are not
    digested, which loses nothing.

    One row per input row. Null and empty texts match nothing. ``notices`` lists the distinct names found, sorted and
    comma-joined; ``n_notices`` counts lines, repeats included. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    whole, lines = known_digests(spark, licenses), known_digests(spark, notices)
    counts = lambda known: [r[0] for r in known.select("words").distinct().collect()]  # noqa: E731  a few numbers
    of_texts, of_lines = counts(whole), counts(lines)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), folded(F.col("text")).alias("_fold"))
    trimmed = F.transform(F.split("_fold", "\n"), lambda x: F.trim(x))
    short = F.filter(trimmed, lambda x: words(x).isin(of_lines))
    rows = rows.select("doc_id", "_row", short.alias("_lines"), one_line(F.col("_fold")).alias("_text"))
    rows = rows.withColumn("_text", F.when(words(F.col("_text")).isin(of_texts), digest(F.col("_text"))))
    named = rows.join(F.broadcast(whole.select(F.col("digest").alias("_text"), "license")), "_text", "left")
    each = named.select("doc_id", "_row", "license", F.explode_outer("_lines").alias("_line"))
    each = each.withColumn("_line", digest(F.col("_line")))
    found = each.join(F.broadcast(lines.select(F.col("digest").alias("_line"), F.col("license").alias("_notice"))), "_line", "left")
    # all lines of a row are in one task, so the sums combine before the shuffle to one row each
    return (
        found.groupBy("_row", "doc_id", "license")
        .agg(F.count("_notice").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("_notice")), ",").alias("notices"))
        .drop("_row")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir))
