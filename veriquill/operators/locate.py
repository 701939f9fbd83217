"""Where cited quotes and claims stand: exact, fuzzy, in fragments, as an area; on the cited page, its neighbours, then anywhere in the document.

Cites are rows (doc_id, cite_id, page, quote) and maybe claim; they meet pages (doc_id, page, text) by equal document and page, so nothing is
searched but the pages that a cite may mean. Exact quotes are found in columns; only what is left over goes to Python, in Arrow batches.
Null quotes and texts are empty and found nowhere. A cited page beyond the document's is taken for the nearest one, no page for the last.
Cites of documents without pages stay, and are found nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import matching
from ..functions.text import SETTLED, numbers, squash
from ..sources.shared import materialize
from .evidence import BLOCK, blocks

MATCH = "method string, score double, first_word int, last_word int, places int, matched string"
#: Methods that verify a quote, and the squashed characters from which a quote is searched in the whole document.
VERIFIED = ("exact", "fuzzy", "fragments")
WHOLE_DOCUMENT = 24
#: k-grams of lost quotes that are broadcast (16 bytes each and what a map needs for them).
FEW_GRAMS = 500_000


def _matches(find: Callable[[str, str], matching.Match | None], texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    rows = []
    for text, want in zip(texts, wanted, strict=True):
        found = find(text, want) if text is not None and want is not None else None
        rows.append((*found, matching.matched_text(text, want, found)) if found else (None,) * 6)
    out = pd.DataFrame(rows, columns=["method", "score", "first_word", "last_word", "places", "matched"])
    return out.astype({"score": "float64", "first_word": "Int32", "last_word": "Int32", "places": "Int32"})


def _located(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
    return _matches(matching.locate, texts, quotes)


def _aligned(texts: pd.Series, claims: pd.Series) -> pd.DataFrame:
    return _matches(matching.align, texts, claims)


def _normal_squash(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else matching.squashed(t) for t in texts], dtype=object)


def located(text: Column, quote: Column) -> Column:
    """The best match of each quote; none where the text is null."""
    return F.pandas_udf(_located, MATCH)(text, quote)


def aligned(text: Column, claim: Column) -> Column:
    return F.pandas_udf(_aligned, MATCH)(text, claim)


def full_squash(text: Column) -> Column:
    """squash() after normal form KC: texts with characters that it may change are squashed in Python, the others in columns."""
    odd = ~text.rlike(f"^{SETTLED}$")
    return F.coalesce(F.pandas_udf(_normal_squash, "string")(F.when(odd, text)), squash(text))


def exact_match(text: Column, quote: Column) -> Column:
    """MATCH of a quote that stands on a page letter by letter and with its numbers, null if it does not; repeated quotes may overlap.

    The page's words are squashed one by one and joined by blanks, and the quote's letters may have a blank between them, so places and
    lengths in that text say which words a match covers and whether it begins and ends with a word.
    """
    split = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+", ""), "\\s+")
    words = F.filter(F.transform(split, lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("i"))), lambda x: squash(x.w) != "")
    q = squash(F.coalesce(quote, F.lit("")))
    # a column worked out once for all uses in f
    once = lambda c, f: F.transform(F.array(c), f)[0]
    letters = F.regexp_replace(q, "(?<=.)(?=.)", " ?")
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def places(line: Column) -> Column:
        cut = F.split(line, F.concat(F.lit("(?="), letters, F.lit(")")))
        sizes = F.transform(cut, lambda p: F.length(p))
        starts = once(sizes, lambda n: F.transform(n, lambda _, k: F.aggregate(F.slice(n, F.lit(1), k), F.lit(0), lambda a, x: a + x)))
        # the first piece begins with the quote or before it
        return F.filter(starts, lambda at: (at > 0) | F.regexp_like(line, F.concat(F.lit("^"), letters)))

    def span(line: Column, at: Column) -> Column:
        held = F.regexp_substr(F.substr(line, at + 1), F.concat(F.lit("^"), letters))
        stop, first = at + F.length(held), blanks(F.substr(line, F.lit(1), at))
        before, after = (F.substr(line, k, F.lit(1)) for k in (at, stop + 1))
        whole = ((at == 0) | (before == " ")) & ((stop == F.length(line)) | (after == " "))
        return F.struct(whole.alias("whole"), first.cast("int").alias("first"), (first + blanks(held)).cast("int").alias("last"))

    need = numbers(F.coalesce(quote, F.lit("")))
    has = lambda ws, s: F.size(F.array_except(need, numbers(F.array_join(F.transform(F.slice(ws, s.first + 1, s.last - s.first + 1), lambda x: x.w), " ")))) == 0
    spans = lambda line: F.transform(places(line), lambda at: span(line, at))
    line = lambda ws: F.array_join(F.transform(ws, lambda x: squash(x.w)), " ")
    on_page = lambda ws, s: F.struct(s.whole.alias("whole"), F.get(ws, s.first).i.alias("first"), F.get(ws, s.last).i.alias("last"))
    ok = once(words, lambda ws: F.transform(F.filter(once(line(ws), spans), lambda s: has(ws, s)), lambda s: on_page(ws, s)))
    best = once(ok, lambda o: F.when(F.exists(o, lambda s: s.whole), F.filter(o, lambda s: s.whole)).otherwise(o))
    match = once(
        best,
        lambda b: F.struct(
            F.lit("exact").alias("method"),
            F.when(F.get(b, F.lit(0)).whole, 1.0).otherwise(matching.INSIDE_WORD).alias("score"),
            F.get(b, F.lit(0)).first.alias("first_word"),
            F.get(b, F.lit(0)).last.alias("last_word"),
            F.least(F.size(b), F.lit(matching.MOST_PLACES)).alias("places"),
            F.array_join(F.slice(split, F.get(b, F.lit(0)).first + 1, F.get(b, F.lit(0)).last - F.get(b, F.lit(0)).first + 1), " ").alias("matched"),
        ),
    )
    found = (F.length(q) >= matching.LEAST_QUOTE) & F.contains(squash(F.coalesce(text, F.lit(""))), q)
    return F.when(found, F.get(F.filter(F.array(match), lambda m: m.places > 0), F.lit(0)))


def with_match(rows: DataFrame, name: str, text: str, quote: str, where: Column | None = None) -> DataFrame:
    """rows and a column with the MATCH of each quote in its text, null for none and where `where` does not hold."""
    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = rows.withColumn(name, F.when(wanted, exact_match(F.col(text), F.col(quote))))
    rest = F.when(wanted & F.col(name).isNull(), F.col(text))
    rows = rows.withColumn("_rest", located(rest, F.col(quote)))
    return rows.withColumn(name, F.coalesce(name, F.when(F.col("_rest.method").isNotNull(), F.col("_rest")))).drop("_rest")


def known_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, text and squashed text (s), worked out and written once for all searches."""
    return materialize(pages.select("doc_id", "page", "text", full_squash(F.col("text")).alias("s")))


def _cited(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """cites with their number of pages (n_pages), null for a document without pages, and the page that each means (hint)."""
    sizes = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return cites.join(sizes, "doc_id", "left").withColumn("hint", F.greatest(F.lit(1), F.least("page", "n_pages")).cast("long"))


def _page(pages: DataFrame, name: str, text: str) -> DataFrame:
    return pages.select("doc_id", F.col("page").alias(name), F.col("text").alias(text))


def on_cited_page(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """cites, n_pages, hint, and text of the cited page."""
    return _cited(cites, pages).join(_page(pages, "hint", "text"), ["doc_id", "hint"], "left")


def locate_on_page(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """on_cited_page() and here: the best match there."""
    return with_match(on_cited_page(cites, pages), "here", "text", "quote")


def verified(match: str) -> Column:
    return F.coalesce(F.col(f"{match}.method").isin(*VERIFIED), F.lit(False))


def quote_grams(far: DataFrame) -> DataFrame:
    """row, gram: hashes of the k-grams of squashed quotes (row, doc_id, q) with their document, to find pages that may hold one.

    They are broadcast up to FEW_GRAMS and joined by a shuffle beyond: by the size of far's file alone, without that of what is made of it, they would
    be broadcast however many there are.
    """
    starts = F.sequence(F.lit(1), F.length("q") - BLOCK + 1)
    grams = far.select("row", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64("doc_id", F.substr("q", i, F.lit(BLOCK)))))).alias("gram"))
    many = (far.agg(F.sum(F.length("q") - BLOCK + 1)).first()[0] or 0) > FEW_GRAMS
    return grams.hint("merge") if many else F.broadcast(grams)


def locate(cites: DataFrame, pages: DataFrame, neighbours: int = 1) -> DataFrame:
    """cites with n_pages, hint, text, found_page, stage and match: the cited page if the quote is verified there, else the nearest neighbour
    that verifies it (the earlier of two), else the nearest page of the document that holds it letter by letter, else what the cited page
    has, or nothing. Each row of cites comes out once, whatever its ids; pages have one row for each document and number."""
    pages = pages.select("doc_id", "page", "text")
    numbered = materialize(cites.select(F.monotonically_increasing_id().alias("row"), F.struct(*cites.columns).alias("cite"), "doc_id", "page", "quote"))
    rows = materialize(locate_on_page(numbered, pages))
    lost = rows.where(~verified("here"))
    steps = [F.struct(F.lit(2 * d - (sign < 0)).alias("turn"), (F.col("hint") + sign * d).alias("near")) for d in range(1, neighbours + 1) for sign in (-1, 1)]
    probes = lost.select("row", "doc_id", "quote", "n_pages", F.inline(F.array(*steps))).where(F.col("near").between(1, F.col("n_pages")))
    probes = with_match(probes.join(_page(pages, "near", "near_text"), ["doc_id", "near"]), "there", "near_text", "quote")
    # matches are told apart in the aggregates: a filter on them would be pushed into the joins below, where no Python runs
    near = materialize(probes.groupBy("row").agg(F.min_by(F.struct("near", "there"), F.when(verified("there"), F.col("turn"))).alias("close")).where("close is not null"))
    # what is still lost meets the pages of its document that share a block with it; only such documents are squashed
    far = materialize(lost.join(near, "row", "left_anti").select("row", "doc_id", "hint", "quote", full_squash(F.col("quote")).alias("q")))
    far = far.where(F.length("q") >= WHOLE_DOCUMENT)
    sought = known_pages(pages.join(far.select("doc_id").distinct(), "doc_id", "left_semi"))
    held = sought.select("doc_id", "page", F.explode(F.array_distinct(F.transform(blocks(F.col("s")), lambda b: F.xxhash64("doc_id", b)))).alias("gram"))
    held = held.join(quote_grams(far), "gram").select("row", "doc_id", "page").distinct().join(far, ["row", "doc_id"])
    held = held.join(sought, ["doc_id", "page"]).where(F.contains("s", "q"))
    held = with_match(held, "found", "text", "quote")
    nearest = F.when(verified("found"), F.struct(F.abs(F.col("page") - F.col("hint")), "page"))
    away = held.groupBy("row").agg(F.min_by(F.struct(F.col("page").alias("far"), "found"), nearest).alias("away")).where("away is not null")
    out = rows.join(near, "row", "left").join(away, "row", "left")
    stage = F.when(verified("here"), "hint").when(F.col("close").isNotNull(), "near").when(F.col("away").isNotNull(), "document").when(F.col("here").isNotNull(), "area").otherwise("page")
    match = F.when(verified("here"), F.col("here")).otherwise(F.coalesce("close.there", "away.found", "here"))
    found = F.when(verified("here"), F.col("hint")).otherwise(F.coalesce("close.near", "away.far", "hint"))
    return out.select("cite.*", "n_pages", "hint", "text", found.alias("found_page"), stage.alias("stage"), match.alias("match"))


def resolve(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, cite_id, page, method, score, source, first_word, last_word, matched for cites with a quote and a claim, one row each.

    A verified quote comes from the model; else the claim may be aligned with the cited page; else an area of the page is shown, else the
    page. matched is the page's text that is shown.
    """
    rows = locate(cites, pages)
    sure = F.col("stage").isin("hint", "near", "document")
    rows = rows.withColumn("claimed", aligned(F.when(~sure, F.col("text")), F.col("claim")))
    by_claim = F.col("claimed.method").isNotNull()
    pick = lambda a, b, c: F.when(sure, a).when(by_claim, b).otherwise(c)
    field = lambda f: pick(F.col(f"match.{f}"), F.col(f"claimed.{f}"), F.col(f"match.{f}"))
    return rows.select(
        "doc_id",
        "cite_id",
        pick(F.col("found_page"), F.col("hint"), F.col("hint")).alias("page"),
        F.coalesce(F.when(~sure & by_claim, F.lit("block")).otherwise(F.col("match.method")), F.lit("page")).alias("method"),
        F.round(F.coalesce(field("score"), F.lit(0.0)), 4).alias("score"),
        pick(F.lit("model"), F.lit("aligned"), F.lit("none")).alias("source"),
        field("first_word").alias("first_word"),
        field("last_word").alias("last_word"),
        field("matched").alias("matched"),
    )
