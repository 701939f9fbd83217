"""Pages, sections, quotes and citations."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import STOP_WORDS, claim_tokens, numbers, squash
from ..sources.shared import materialize

#: Quotes are a query set: their k-grams and the short ones are broadcast up to these numbers, joined by a shuffle (short ones: in blocks) beyond.
QUOTE_GRAMS, QUOTE_BLOCK = 2_000_000, 20_000
MIN_QUOTE = 4
#: Characters of a block. A quote of 2 * BLOCK - 1 characters or more holds a whole block of each text that contains it.
BLOCK = 12


def blocks(s: Column) -> Column:
    """A squashed text cut into runs of BLOCK characters; what is left at its end is no block."""
    return F.regexp_extract_all(s, F.lit(f".{{{BLOCK}}}"), 0)


def locate_exact(texts: DataFrame, quotes: DataFrame, key: list[str]) -> DataFrame:
    """key, item_id, guarded: texts that contain a quote after squashing; guarded if they also have all the quote's numbers.

    Squashed texts are cut into blocks; blocks meet the equal k-grams of the quotes, and only texts that share one are searched. Quotes that
    are too short for this are held against all texts. Texts are told apart by key and a hash; a null key is a key. Repeated texts come once
    each time they occur, repeated quotes too.
    """
    wanted = quotes.select("item_id", squash(F.col("text")).alias("q"), F.array_distinct(numbers(F.col("text"))).alias("need")).where(F.length("q") >= MIN_QUOTE)
    # texts are squashed once, for their blocks, for the search and for short quotes
    have = materialize(texts.select(*key, squash(F.col("text")).alias("s"), F.array_distinct(numbers(F.col("text"))).alias("have")).withColumn("row", F.xxhash64(*key, "s")))
    guarded = (F.size(F.array_except("need", "have")) == 0).alias("guarded")
    long = wanted.where(F.length("q") >= 2 * BLOCK - 1)
    grams = long.select(F.xxhash64("q").alias("qh"), F.explode(F.transform(F.sequence(F.lit(1), F.length("q") - BLOCK + 1), lambda i: F.substr("q", i, F.lit(BLOCK)))).alias("gram")).distinct()
    grams = F.broadcast(grams) if grams.count() <= QUOTE_GRAMS else grams
    pairs = have.select("row", F.explode(F.array_distinct(blocks(F.col("s")))).alias("gram")).join(grams, "gram").select("row", "qh").distinct()
    found = have.join(pairs, "row").join(long.withColumn("qh", F.xxhash64("q")), "qh").where(F.contains("s", "q")).select(*key, "item_id", guarded)
    short = wanted.where(F.length("q") < 2 * BLOCK - 1)
    n = short.count()
    turns = max(1, -(-n // QUOTE_BLOCK)) if n else 0
    for k in range(turns):
        part = short if turns == 1 else short.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == k)
        found = found.unionByName(have.join(F.broadcast(part), F.contains(have.s, part.q)).select(*key, "item_id", guarded))
    return found


def locate_pages(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id, page, last_page, guarded: where whole quotes stand, page breaks left out of account.

    docs: doc_id, text with one page a line. A quote on one page has page = last_page; one that spans pages has the first and last of them.
    guarded if these pages together have all the quote's numbers. Equal spans of a quote come once.
    """
    docs, quotes = docs.select("doc_id", "text"), quotes.select("item_id", "text").distinct()
    wanted = quotes.select("item_id", F.col("text").alias("quote"))
    held = locate_exact(docs, quotes, ["doc_id", "text"]).select("doc_id", "text", "item_id").distinct().join(wanted, "item_id")
    rows = held.select("doc_id", "item_id", squash(F.col("quote")).alias("q"), F.array_distinct(numbers(F.col("quote"))).alias("need"), squash(F.col("text")).alias("s"), F.split("text", "\n").alias("pages"))
    rows = rows.where(F.contains("s", "q")).withColumn("sizes", F.transform("pages", lambda p: F.length(squash(p))))
    # q has letters and digits only; a split before each occurrence leaves pieces whose lengths add up to the places, overlapping ones too
    pieces = F.transform(F.split("s", F.concat(F.lit("(?="), "q", F.lit(")"))), lambda p: F.length(p))
    rows = rows.withColumn("pieces", pieces).select("*", F.posexplode("pieces").alias("k", "piece"))
    start = F.aggregate(F.slice("pieces", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    rows = rows.where((F.col("k") > 0) | F.startswith("s", "q")).withColumn("start", start)
    ended = lambda at: F.aggregate("sizes", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), lambda a, x: F.struct((a.upto + x).alias("upto"), (a.n + (a.upto + x <= at).cast("int")).alias("n")), lambda a: a.n)
    rows = rows.withColumn("page", ended(F.col("start")) + 1).withColumn("last_page", ended(F.col("start") + F.length("q") - 1) + 1)
    have = F.flatten(F.transform(F.slice("pages", F.col("page"), F.col("last_page") - F.col("page") + 1), numbers))
    guarded = F.size(F.array_except("need", have)) == 0
    return rows.select("doc_id", "item_id", F.col("page").cast("long").alias("page"), F.col("last_page").cast("long").alias("last_page"), guarded.alias("guarded")).distinct()


def section_nodes(pages: DataFrame, fan: int = 4) -> DataFrame:
    """A tree of sections over pages: the document, runs of fan * fan pages and runs of fan pages, flattened in preorder."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    levels = []
    for depth, width in ((0, None), (1, fan * fan), (2, fan)):
        lo = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(width).cast("long"))) if width else F.lit(1).cast("long")
        rows = last.select("doc_id", "n", lo.alias("lo"))
        hi = F.least("n", F.col("lo") + width - 1) if width else F.col("n")
        levels.append(rows.select("doc_id", F.concat_ws("-", F.lit("n"), F.lit(depth), "lo").alias("node_id"), F.lit(depth).cast("long").alias("depth"), "lo", hi.alias("hi")))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


#: Pages of one sorted run: long documents are swept in several.
SPAN = 4096


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sections and pages of runs in order of their places; a section comes before the page that it starts on.

    The sections that are open lie on a heap, the best one on top; those that have ended leave it when they come up.
    """
    now, heap, starting, at_page = None, [], [], None
    for rows in batches:
        out = []
        for doc, span, at, kind, depth, lo, hi, node in rows.itertuples(index=False):
            if (doc, span) != now:
                now, heap, starting, at_page = (doc, span), [], [], None
            if kind == 0:
                if at_page != lo:
                    starting, at_page = [], lo
                entry = (-depth, hi - lo, -lo, node if isinstance(node, str) else tuple(node), hi)
                starting.append(entry)
                heapq.heappush(heap, entry)
                continue
            best = min(starting) if at_page == at else None
            while best is None and heap:
                if heap[0][4] >= at:
                    best = heap[0]
                else:
                    heapq.heappop(heap)
            if best:
                out.append((doc, at, best[3] if isinstance(best[3], str) else list(best[3])))
        yield pd.DataFrame(out, columns=["doc_id", "page", "node"])


def deepest_section(pages: DataFrame, nodes: DataFrame, name: str = "node_id") -> DataFrame:
    """doc_id, page and the node (column `name`) of each page's section: one that starts there first, then the deepest, narrowest, latest and first by name.

    name is a text or an array. Sections (doc_id, name, depth, lo, hi) without a range, or with one that runs backwards, are left out; pages without a section, too. Each
    document is swept once in order of pages, SPAN pages at a time: a section that reaches over several runs takes part in each.
    """
    kind = nodes.schema[name].dataType.simpleString()
    last = pages.groupBy("doc_id").agg(F.max("page").cast("long").alias("last"))
    ranged = nodes.where((F.col("lo") <= F.col("hi")) & F.col("depth").isNotNull()).join(last, "doc_id").where(F.col("lo") <= F.col("last"))
    run = lambda c: F.floor(F.greatest(c, F.lit(0)) / SPAN).cast("long")
    span = F.explode(F.sequence(run(F.col("lo")), run(F.greatest("lo", F.least("hi", "last")))))
    long = lambda c: F.col(c).cast("long").alias(c)
    sections = ranged.select("doc_id", span.alias("span"), F.col("lo").cast("long").alias("at"), F.lit(0).alias("kind"), long("depth"), long("lo"), long("hi"), F.col(name).alias("node"))
    none = [F.lit(-1).cast("long").alias(c) for c in ("depth", "lo", "hi")]
    shown = pages.where("doc_id is not null and page is not null").select("doc_id", run(F.col("page")).alias("span"), F.col("page").cast("long").alias("at"), F.lit(1).alias("kind"), *none, F.lit(None).cast(kind).alias("node"))
    stream = sections.unionByName(shown).repartition("doc_id", "span").sortWithinPartitions("doc_id", "span", "at", "kind")
    doc = pages.schema["doc_id"].dataType.simpleString()
    return stream.mapInPandas(_sweep, f"doc_id {doc}, page long, node {kind}").withColumnRenamed("node", name)


def citations(messages: DataFrame, pages_per: int = 9) -> DataFrame:
    """A stream of citations from assistant turns: conv_id, idx (in answer order), page, verified, read."""
    rows = messages.where("role = 'assistant'").select("conv_id", "turn", (F.length("text") % pages_per + 1).cast("long").alias("page"), (F.length("text") % 3 != 0).alias("verified"))
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return rows.select("conv_id", idx.alias("idx"), "page", "verified", (F.col("page") % 4 != 0).alias("read"))


def sources(cites: DataFrame) -> DataFrame:
    """Citations of each page: how many, and their ids in answer order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda i: F.concat(F.lit("c"), i.cast("string"))), ",")
    return cites.groupBy("conv_id", "page").agg(F.count("*").alias("refs"), ids.alias("citation_ids"))


def answer_stats(cites: DataFrame) -> DataFrame:
    return cites.groupBy("conv_id").agg(
        F.count("*").alias("n_cites"), F.count_if("verified").alias("n_verified"), F.count_if(~F.col("verified")).alias("n_page_only"), F.count_if(~F.col("read")).alias("n_unread"), F.count_distinct("page").alias("n_pages")
    )


def page_runs(rows: DataFrame, key: str, page: str) -> DataFrame:
    """Consecutive pages as one text, such as 5,7-9."""
    distinct = rows.select(key, F.col(page).alias("p")).distinct()
    island = distinct.select(key, "p", (F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p"))).alias("island"))
    runs = island.groupBy(key, "island").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x.t), ",").alias("runs"))


def densest_window(texts: DataFrame, quotes: DataFrame, accept: float = 0.55) -> DataFrame:
    """item_id, doc_id, pos, share: where a quote's tokens stand closest. Frames hold 1.5 times the quote's tokens, 8 at least; the weights
    of its distinct tokens in a frame count once; the first best frame of each quote and document is kept if its share is at least `accept`."""
    few = F.broadcast if quotes.count() <= QUOTE_BLOCK else lambda rows: rows
    quoted = quotes.select("item_id", claim_tokens(F.col("text")).alias("toks"))
    quoted = quoted.select("item_id", F.greatest(F.lit(8), F.floor(F.size("toks") * 1.5)).cast("int").alias("win"), F.explode(F.array_distinct("toks")).alias("tok"))
    quoted = quoted.where(~F.col("tok").isin(STOP_WORDS) & (F.length("tok") > 1))
    quoted = quoted.withColumn("w", F.least(F.length("tok"), F.lit(8)) + F.when(F.col("tok").rlike("[0-9]"), 3).otherwise(0))
    total = quoted.groupBy("item_id").agg(F.sum("w").alias("total"))
    # a frame's score is at most the weight of all the quote's tokens that the text has: only texts that can reach `accept` are walked. Texts are dealt
    # out once by document, so that these weights add up where the text is; tokens that no quote has go no further. Repeated texts of a document only raise the bound
    held = texts.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(F.array_distinct(claim_tokens(F.col("text")))).alias("tok"))
    most = held.join(few(quoted.select("item_id", "tok", "w")), "tok").groupBy("doc_id", "item_id").agg(F.sum("w").alias("most"))
    able = materialize(most.join(few(total), "item_id").where(F.col("most") >= F.col("total") * (accept - 1e-6)).select("doc_id", "item_id"))
    words = able.join(few(quoted), "item_id")
    places = texts.join(able.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(claim_tokens(F.col("text"))).alias("pos", "tok"))
    places = places.join(few(quoted.select("tok").distinct()), "tok", "left_semi")
    hits = places.join(words, ["doc_id", "tok"]).select("doc_id", "item_id", "pos", "tok", "w", "win")
    # a token counts in a frame if it is its last occurrence there: those from pos up to its next occurrence or the frame's end
    order = Window.partitionBy("doc_id", "item_id", "tok").orderBy("pos")
    ends = hits.select("*", F.least(F.lead("pos").over(order), F.col("pos") + F.col("win")).alias("upto"))
    ends = ends.withColumn("upto", F.coalesce("upto", F.col("pos") + F.col("win")))
    steps = ends.select("doc_id", "item_id", F.col("pos").alias("at"), F.col("w").alias("d")).unionByName(ends.select("doc_id", "item_id", F.col("upto").alias("at"), (-F.col("w")).alias("d")))
    steps = steps.groupBy("doc_id", "item_id", "at").agg(F.sum("d").alias("d"))
    running = steps.select("*", F.sum("d").over(Window.partitionBy("doc_id", "item_id").orderBy("at")).alias("score"))
    best = running.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "at"), F.struct("score", -F.col("at"))).alias("b"))
    out = best.join(few(total), "item_id").select("item_id", "doc_id", F.col("b.at").cast("long").alias("pos"), F.round(F.col("b.score") / F.col("total"), 6).alias("share"))
    return out.where(F.col("share") >= accept)


def folio_votes(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, shift, support: how far the numbers that pages carry are from their places, by majority; the smallest of equals."""
    carried = pages.select("doc_id", "page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[^0-9.,])([1-9][0-9]{0,3})(?![0-9.,])"), 1))).alias("v"))
    votes = carried.groupBy("doc_id", (F.col("v").cast("long") - F.col("page")).alias("shift")).agg(F.count_distinct("page").alias("support"))
    return votes.groupBy("doc_id").agg(F.max_by(F.struct("shift", "support"), F.struct("support", -F.col("shift"))).alias("b")).select("doc_id", "b.shift", "b.support")


def dense_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, text for all pages from 1 to the last one known; those not known are empty."""
    every = pages.groupBy("doc_id").agg(F.max("page").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("page"))
    return every.join(pages, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def offset_notes(labels: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """doc_id, shift, hits: how far pages are from their numeric labels, where enough of them agree."""
    shifts = labels.where(F.col("label").rlike("^[0-9]+$")).groupBy("doc_id", (F.col("page") - F.col("label").cast("long")).alias("shift")).agg(F.count("*").alias("hits"))
    best = shifts.groupBy("doc_id").agg(F.sum("hits").alias("total"), F.min_by(F.struct("shift", "hits"), F.struct(-F.col("hits"), "shift")).alias("b"))
    return best.where((F.col("b.hits") >= least) & (F.col("b.hits") >= F.col("total") * share)).select("doc_id", "b.shift", "b.hits")


def inverse_frequency(terms: DataFrame, key: str, total: int) -> DataFrame:
    """term, df, idf: rare terms weigh most; those with digits less."""
    counts = terms.select(key, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    damped = F.when(F.col("term").rlike("[0-9]"), 0.3).otherwise(1.0)
    return counts.withColumn("idf", F.round(F.log(F.lit(float(total)) / (F.col("df") + 1) + 1) * damped, 6))


def hashed_embedding(terms: DataFrame, key: str, size: int = 64) -> DataFrame:
    """key, bucket, v: the entries of a normalised bag of words; a term's hash gives its bucket and sign, its count its weight."""
    byte = lambda first: F.conv(F.substring(F.md5("term"), first, 2), 16, 10).cast("long")
    weights = terms.groupBy(key, "term").agg((F.log(F.count("*").cast("double")) + 1).alias("w"))
    signed = weights.select(key, (byte(1) % size).alias("bucket"), F.when(byte(9) % 2 == 1, F.col("w")).otherwise(-F.col("w")).alias("w"))
    sums = signed.groupBy(key, "bucket").agg(F.sum("w").alias("v"))
    return sums.withColumn("v", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key))), 6))


def kept_contexts(contexts: DataFrame, most: int, longest: int = 8000) -> DataFrame:
    """contexts (answer_id, read_seq, page, cited, text) that a score may use, with place: `most` of an answer, cited pages first and then by the order of
    reading, in which they are numbered; each page once, from when it was first read, its text cut to `longest` characters."""
    first = Window.partitionBy("answer_id", "page").orderBy("read_seq")
    once = contexts.withColumn("_turn", F.row_number().over(first)).withColumn("cited", F.max("cited").over(Window.partitionBy("answer_id", "page"))).where("_turn = 1").drop("_turn")
    kept = once.withColumn("_rank", F.row_number().over(Window.partitionBy("answer_id").orderBy(F.desc("cited"), "read_seq", "page"))).where(F.col("_rank") <= most).drop("_rank")
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("read_seq", "page"))
    return kept.withColumn("place", place).withColumn("text", F.substring("text", 1, longest))
