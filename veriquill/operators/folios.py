"""Printed page numbers: which number each page of a document carries, by votes of the numbers that stand alone on its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import materialize

# How many numbering sequences are looked for, the greatest roman number, and what separates and surrounds page numbers.
RUNS, GREATEST_ROMAN = 4, 39
BETWEEN, AROUND = "[\\s|/•·–—‒―]+", "()[]{}.,:;-–—−*•·"
ROMAN = "^x{0,3}(?:ix|iv|v?i{0,3})$"
#: The numbers from 1 to GREATEST_ROMAN, by tens and ones.
ROMANS = [t + o for t in ("", "x", "xx", "xxx") for o in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")][1:]


def roman(value: Column) -> Column:
    """Numerals in lower case, null beyond GREATEST_ROMAN."""
    return F.get(F.array(*map(F.lit, ROMANS)), (value - 1).cast("int"))


def candidates(text: Column) -> Column:
    """Numbers of 1 to 4 digits without a leading zero, and roman numerals, that stand alone: array<struct<kind, value, upper>>."""
    words = F.filter(F.transform(F.split(text, BETWEEN), lambda w: F.btrim(w, F.lit(AROUND))), lambda w: w != "")
    arabic = lambda w: w.rlike("^[1-9][0-9]{0,3}$")
    known = F.array(*map(F.lit, ROMANS))
    found = F.filter(words, lambda w: arabic(w) | F.lower(w).rlike(ROMAN))
    return F.transform(
        found,
        lambda w: F.struct(
            F.when(arabic(w), "arabic").otherwise("roman").alias("kind"),
            F.when(arabic(w), w.cast("int")).otherwise(F.array_position(known, F.lower(w)).cast("int")).alias("value"),
            (~arabic(w) & (w == F.upper(w))).alias("upper"),
        ),
    )


def folio_labels(pages: DataFrame) -> DataFrame:
    """doc_id, page, label: printed labels by votes, for pages (doc_id, page from 1, text); pages without one are left out.

    Each page votes once for each kind and shift (value less page) that it carries. The shift with most votes, of equals the one of the
    earliest page, then arabic, then the smallest, is a run if it has 3 percent of the pages with text, two at least, or three after the
    first run; its pages vote no more. Runs label their pages and those between them that no other run has; earlier runs come first.
    """
    sizes = pages.groupBy("doc_id").agg(F.count_if(F.trim("text") != "").alias("full"))
    votes = pages.where(F.trim("text") != "").select("doc_id", "page", F.inline(candidates(F.col("text")))).select("doc_id", "page", "kind", (F.col("value") - F.col("page")).alias("shift"), "upper")
    votes = materialize(votes.groupBy("doc_id", "page", "kind", "shift").agg(F.sum(F.col("upper").cast("int")).alias("upper")))
    left, runs = votes, None
    for turn in range(RUNS):
        tally = left.groupBy("doc_id", "kind", "shift").agg(F.count("*").alias("support"), F.min("page").alias("first"), F.max("page").alias("last"), F.sum("upper").alias("upper"))
        best = tally.groupBy("doc_id").agg(F.min_by(F.struct("kind", "shift", "support", "first", "last", "upper"), F.struct(-F.col("support"), "first", "kind", "shift")).alias("b"))
        least = F.greatest(F.lit(3 if turn else 2), F.ceil(F.col("full") * 3 / 100))
        found = materialize(best.join(sizes, "doc_id").where(F.col("b.support") >= least).select("doc_id", "b.*", F.lit(turn).alias("turn")))
        runs = found if runs is None else runs.unionByName(found)
        won = left.join(found.select("doc_id", "kind", "shift"), ["doc_id", "kind", "shift"]).select("doc_id", "page")
        # a document whose best shift is no run has no further ones
        left = materialize(left.join(found.select("doc_id"), "doc_id", "left_semi").join(won, ["doc_id", "page"], "left_anti"))
    rows = runs.select("doc_id", "turn", "kind", "shift", "support", "upper", F.explode(F.sequence("first", "last")).alias("page"))
    carried = votes.select("doc_id", "page", "kind", "shift", F.lit(True).alias("own"))
    rows = rows.join(carried, ["doc_id", "page", "kind", "shift"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    first = rows.groupBy("doc_id", "page").agg(F.min_by(F.struct("kind", "shift", "support", "upper"), F.struct(~F.col("own"), "turn")).alias("r"))
    value = F.col("page") + F.col("r.shift")
    letters = roman(value)
    label = F.when(value < 1, None).when(F.col("r.kind") == "arabic", value.cast("string")).otherwise(F.when(F.col("r.upper") * 2 > F.col("r.support"), F.upper(letters)).otherwise(letters))
    return first.select("doc_id", "page", label.alias("label")).where("label is not null")


def printed_labels(pages: DataFrame, native: DataFrame) -> DataFrame:
    """doc_id, page, label: a document's own labels (native: doc_id, page, label) where they say something, else those by votes.

    Own labels say nothing if all are empty, if they are the pages' numbers, or if fewer than half of the pages have a different one.
    """
    own = native.select("doc_id", "page", F.trim(F.coalesce("label", F.lit(""))).alias("label"))
    told = own.groupBy("doc_id").agg(F.max(F.col("label") != "").alias("some"), F.bool_and(F.col("label") == F.col("page").cast("string")).alias("plain"), F.count_distinct("label").alias("kinds"), F.count("*").alias("n"))
    told = told.where(F.col("some") & ~F.col("plain") & (F.col("kinds") >= F.col("n") * 0.5)).select("doc_id")
    kept = own.join(told, "doc_id", "left_semi").where("label <> ''")
    return kept.unionByName(folio_labels(pages.join(told, "doc_id", "left_anti")))
