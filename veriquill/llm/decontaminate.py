"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations.

A benchmark item is cut into item-sized windows: WINDOW consecutive words, or all its words if it has fewer. A document holds a window only
if it holds every shingle of it, so one shingle of each window suffices as its prefix: the rarest, by counts over all documents. Document
words join the prefixes; the prefix's place in its window bounds where the window would have to start (position) and the document's number
of words where it may (length); what is left is compared word by word.

Up to BROADCAST_WINDOWS windows, the prefixes are broadcast and windows compared where they are met. Beyond it, words and prefixes are joined
by a shuffle that carries no text, and the documents of the matches are joined once more to be compared.

Defined results: null and blank texts have no words, hits or windows. Each row comes out once, also repeated ones. Items without words
match nothing; repeated items count once for each item_id. Without documents there are no rows, without items no hits. Words of equal
count are told apart by their place in the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spark_io import materialize
from .words_sql import NOT_ALNUM, NOT_ALNUM_CASED, lower_ascii, with_key, without_rows, words

WINDOW = 10
#: About 100 bytes each.
BROADCAST_WINDOWS = 200_000


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window (its words) of every item; equal windows of an item once."""
    items = benchmark.select("item_id", words(lower_ascii(F.col("text")), NOT_ALNUM).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - WINDOW, F.lit(0))
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, WINDOW))).alias("window")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """window, at, word: each distinct window's rarest word over all documents (the first of equals) and its place."""
    places = windows.select("window").distinct().select("window", F.posexplode("window").alias("at", "word"))
    known = places.select("word").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    counts = docs.select(F.explode(words(lower_ascii(F.col("text")), NOT_ALNUM)).alias("word")).join(known, "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "word", "left").select("window", "at", "word", F.coalesce("n", F.lit(0)).alias("n"))
    best = ranked.groupBy("window").agg(F.min(F.struct("n", "at", "word")).alias("p"))
    return best.where("p.n > 0").select("window", "p.at", "p.word")


def _found(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, th, window, start: where windows stand."""
    prefix = materialize(prefixes(windows, docs))
    split = docs.select("doc_id", "th", words(lower_ascii(F.col("text")), NOT_ALNUM).alias("w"))
    start = (F.col("pos") - F.col("at")).alias("start")
    equal = F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window")
    if windows.count() <= BROADCAST_WINDOWS:
        placed = split.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefix), "word").select("doc_id", "th", "w", "window", start)
        return placed.where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.size("w"))).where(equal).select("doc_id", "th", "window", "start")
    prefix = prefix.withColumn("id", F.xxhash64("window"))
    ends = prefix.select("id", "at", "word", F.size("window").alias("n"))
    placed = split.select("doc_id", "th", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word")).join(ends, "word").select("doc_id", "th", "id", "n", "n_words", start)
    placed = placed.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))).groupBy("doc_id", "th", "id").agg(F.collect_set("start").alias("starts"))
    # documents with matches, each with its text once; equal rows have equal matches
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))
    matched = split.dropDuplicates(["doc_id", "th"]).join(placed.withColumnsRenamed({"doc_id": "m_id", "th": "m_th"}), same).join(prefix.select("id", "window"), "id")
    return matched.select("doc_id", "th", "w", "window", F.explode("starts").alias("start")).where(equal).select("doc_id", "th", "window", "start")


def _contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of contamination(), and th."""
    docs = with_key(docs)
    windows = materialize(item_windows(benchmark))
    found = materialize(_found(docs, windows))
    spans = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("window")).alias("stop")))).alias("spans"))
    # words in the union of the spans: each span adds what lies beyond all before it
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.stop - F.greatest(acc.upto, s.start))).alias("n"), F.greatest(acc.upto, s.stop).alias("upto")),
        lambda acc: acc.n,
    )
    # a window that several items share stands for their set
    sets = windows.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("names"))
    names = found.select("doc_id", "th", "window").distinct().join(sets, "window").select("doc_id", "th", "names").distinct()
    items = names.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("items"))
    null = F.lit(None)
    hits = spans.select("doc_id", "th", hit.cast("long").alias("n_hit"), null.cast("array<string>").alias("items")).unionByName(items.select("doc_id", "th", null.cast("long").alias("n_hit"), "items"))
    hits = hits.groupBy("doc_id", "th").agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"))
    base = docs.select("doc_id", "th", F.size(words(F.col("text"), NOT_ALNUM_CASED)).cast("long").alias("n_words"))
    out = base.join(hits.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"}), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs (doc_id, text)."""
    return _contamination(docs, benchmark).drop("th")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, all columns kept."""
    return without_rows(docs, _contamination(docs, benchmark).where("contaminated"))
