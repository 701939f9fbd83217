"""Words of a text as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What separates words: blanks for the word pattern [^\x20\x09-\x0D]+, and for letters and digits all other ASCII characters.
BLANKS = "[\\x20\\x09-\\x0D]+"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same for texts whose capitals are not lowered yet, where only the number of words counts.
NOT_ALNUM_CASED = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other characters as they are: lower() is the quick way where a text has no others."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, separator: str) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, a hash of the text: equal rows, and only they, have equal doc_id and th, so joins on both serve repeated rows alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without the rows of gone (doc_id, th), other rows of the same id or without one left alone."""
    gone = gone.select("doc_id", "th").distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["th"]), "left_anti")
