"""Canonical tables, read from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page, text: the lines of each document are its pages, from 1."""
    docs = read(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return docs.select("doc_id", (F.col("at") + 1).cast("long").alias("page"), "text")


#: Lines of a text that make a page of a report, and pages that a section of each level holds.
REPORT_LINES, SECTION, CHAPTER = 12, 4, 16


def first_words(text: Column, n: int) -> Column:
    """The first n words of a text, white space between them; the rest of the text is not cut."""
    return F.slice(F.split(text, "\\s+", n + 1), 1, n)


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """report_pages() with n, the report's pages."""
    docs = read(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    pages = docs.select("doc_id", "lines", F.posexplode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(REPORT_LINES))).alias("k", "first"))
    n = F.floor((F.size("lines") - 1) / REPORT_LINES) + 1
    pages = pages.select("doc_id", n.alias("n"), (F.col("k") + 1).cast("long").alias("page"), F.slice("lines", F.col("first") + 1, REPORT_LINES).alias("lines"))
    word = lambda k, n: F.array_join(F.slice(F.split(F.get("lines", F.lit(0)), " "), k, n), " ")
    amount = lambda x: F.format_number(x, 0)
    a, b = F.col("doc_id") * 37 + F.col("page") * 1009, F.col("doc_id") * 11 + F.col("page") * 211
    table = [F.lit("£m 2025/26 2024/25"), F.concat(word(1, 2), F.lit(" "), amount(a), F.lit(" ("), amount(b), F.lit(")")), F.concat(F.lit("Capital expenditure "), amount(a + b), F.lit(" n/m"))]
    head = [F.concat(F.lit("Annual Report "), F.col("page")), F.lit(""), F.lit("Review of the period"), F.concat(F.lit("Net sales of the "), word(1, 3), F.lit(" busi-")), F.concat(F.lit("ness rose to £"), amount(a), F.lit(" million."))]
    foot = F.when(F.col("page") % 5 == 0, F.array(F.concat(word(1, 2), F.lit(" "), F.col("page")))).otherwise(F.array().cast("array<string>"))
    return pages.select("doc_id", "n", "page", F.array_join(F.concat(F.array(*head), F.col("lines"), F.array(F.lit(""), *table), foot), "\n").alias("text"))


def report_pages(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page, text: reports made of documents, REPORT_LINES lines a page with a running head, a heading, a word cut at a line's end and a
    table of two rows; every fifth page has its number at its end."""
    return _reports(spark, folder).select("doc_id", "page", "text")


def outlines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, created_at, tree: JSON outlines of reports, sections of SECTION pages in chapters of CHAPTER pages under one root. Every fifth
    document's tree has things in it that are no nodes, and each document an older tree that is no JSON."""
    # a section's first page is that of its chapter and of the root too, so one pass over the pages tells what all nodes say
    said = F.slice(first_words(F.col("text"), 37), 8, 30)
    rows = _reports(spark, folder).where((F.col("page") - 1) % SECTION == 0).select("doc_id", "n", F.col("page").alias("lo"), said.alias("w"))
    words = lambda n: F.array_join(F.slice("w", 1, n), " ")
    rows = rows.select("doc_id", "n", "lo", words(4).alias("title"), words(30).alias("summary"))

    def fields(name: str, width: int | None) -> list[Column | str]:
        hi = F.least("n", F.col("lo") + width - 1) if width else F.col("n")
        return ["title", F.concat_ws("-", F.lit("n"), F.lit(name), "lo").alias("node_id"), F.col("lo").alias("start_index"), hi.alias("end_index"), "summary"]

    def above(rows: DataFrame, width: int | None, *node: Column | str) -> DataFrame:
        lo = F.col("lo") - (F.col("lo") - 1) % width if width else F.lit(1).cast("long")
        inside = F.transform(F.array_sort(F.collect_list(F.struct("lo", F.struct(*node).alias("node")))), lambda x: x.node)
        up = rows.groupBy("doc_id", lo.alias("lo")).agg(F.max("n").alias("n"), inside.alias("nodes"))
        return up.select("doc_id", "n", "lo", F.get("nodes", F.lit(0)).title.alias("title"), F.get("nodes", F.lit(0)).summary.alias("summary"), "nodes")

    tree = above(above(rows, CHAPTER, *fields("2", SECTION)), None, *fields("1", CHAPTER), "nodes").select("doc_id", *fields("0", None), "nodes")
    text = F.to_json(F.array(F.struct("title", "node_id", "start_index", "end_index", "summary", "nodes")))
    odd = F.concat(F.lit('["no node", null, {"title": "Backwards", "start_index": 9, "end_index": 3}, {"title": "  ", "start_index": "1", "end_index": "1"}, '), F.substr(text, F.lit(2)))
    newest = F.when(F.col("doc_id") % 5 == 0, odd).otherwise(text)
    made = [F.struct(F.lit(at).alias("created_at"), t.alias("tree")) for at, t in (("2025-02-01T00:00:00", newest), ("2025-01-01T00:00:00", F.lit("[{")))]
    return tree.select("doc_id", F.inline(F.array(*made)))


def report_questions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, question_id, text: two questions about each report, one about an amount."""
    docs = read(spark, folder, "documents").where("text is not null").select("doc_id", first_words(F.col("text"), 10).alias("w"))
    part = lambda k, n: F.array_join(F.slice("w", k, n), " ")
    asked = F.array(F.concat(F.lit("How much were net sales of the "), part(1, 3), F.lit(" business?")), F.concat(F.lit("What is said of "), part(5, 6), F.lit("?")))
    return docs.select("doc_id", F.posexplode(asked).alias("k", "text")).select("doc_id", F.col("k").cast("long").alias("question_id"), "text")


def cites(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, cite_id, page, quote, claim: one citation of each document. The quote's words come from one of its pages as they are, with a
    word left out, as two fragments or in reverse; the page may be one off; the claim is the page's first words."""
    docs = read(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    page = (F.pmod(F.col("doc_id"), F.size("lines")) + 1).cast("int")
    docs = docs.select("doc_id", page.alias("p"), F.split(F.get("lines", page - 1), " ").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    kind = F.pmod("doc_id", F.lit(4))
    quote = F.when(kind == 0, part(3, 12)).when(kind == 1, F.concat_ws(" ", part(3, 4), part(8, 13))).when(kind == 2, F.concat(part(2, 8), F.lit(" ... "), part(14, 8))).otherwise(F.array_join(F.reverse(F.slice("w", 1, 12)), " "))
    shifted = F.col("p") + F.pmod(F.floor(F.col("doc_id") / 4), F.lit(3)) - 1
    return docs.select("doc_id", F.lit(1).cast("long").alias("cite_id"), shifted.cast("long").alias("page"), quote.alias("quote"), part(1, 25).alias("claim"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """answer_id, raw, most_pages: an answer about each document, made of its first page's words, with cites in one of six forms."""
    docs = read(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    docs = docs.select("doc_id", F.size("lines").alias("most_pages"), F.split(F.get("lines", F.lit(0)), " ").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    quote = part(2, 9)
    tags = F.array(
        F.concat(F.lit('<cite doc="d" page="1" quote="'), quote, F.lit('"/>')),
        F.concat(F.lit("<cite quote=“"), quote, F.lit("” page='p. 1'>here</cite>")),
        F.concat(F.lit('<cite page=1-2 quote="'), part(2, 4), F.lit(' ... '), part(8, 5), F.lit('" / >')),
        F.concat(F.lit('<cite page="99999" quote="'), quote, F.lit('"/> and <cite page=1/>')),
        F.concat(F.lit('<cite page="1" quote="'), quote, F.lit(' <cite page=2 quote="&quot;'), quote, F.lit('&quot;"/>')),
        F.concat(F.lit('| a | **b** <cite page=1 /> | '), quote, F.lit(' |\n\n<cite page="none"/>')),
    )
    raw = F.concat(F.lit("Intro by J. Smith. "), part(1, 12), F.lit(" "), F.element_at(tags, (F.pmod("doc_id", F.lit(6)) + 1).cast("int")), F.lit("\n- "), part(3, 20), F.lit(" <cite page=1/>."))
    return docs.select(F.col("doc_id").alias("answer_id"), raw.alias("raw"), "most_pages")


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """answer_id, seq, ts, at, kind, call_id, tool, pages, piece, most_pages: how each of answers() came about. Even ones have calls with results, a
    word on the way to them and the answer in five pieces; odd ones have items that appear and calls that have run. Every seventh has no end."""
    raw = answers(spark, folder)
    cut = lambda k: F.substring("raw", F.floor(F.length("raw") * k / 5).cast("int") + 1, (F.floor(F.length("raw") * (k + 1) / 5) - F.floor(F.length("raw") * k / 5)).cast("int"))

    def event(kind: str, at: int, call_id: str = "", tool: str = "", pages: Column | None = None, piece: Column | str = "") -> Column:
        piece = piece if isinstance(piece, Column) else F.lit(piece)
        made = F.array().cast("array<int>") if pages is None else pages.cast("array<int>")
        return F.struct(F.lit(at).cast("long").alias("after"), F.lit(kind).alias("kind"), F.lit(call_id).alias("call_id"), F.lit(tool).alias("tool"), made.alias("pages"), piece.alias("piece"))

    page, read = (F.col("answer_id") % 7 + 1).cast("int"), "get_page_content"
    got = F.when(F.col("answer_id") % 3 == 0, F.lit(None)).otherwise(F.array(page, page + 1))
    text = lambda at: [event("text", at + 40 * k, piece=cut(k)) for k in range(5)]
    even = [event("start", 0), event("text", 300, piece="Let me look. "), event("call", 500, "c1", "get_document_structure"), event("result", 900, "c1"), event("call", 1500, "c2", read, F.array(page, page + 1)), event("call", 1520, "c3", "search", None), event("result", 1900, "c2", pages=got), event("result", 2000, "c3"), *text(2600)]
    odd = [event("start", 0), event("added", 200, "i1", "reasoning"), event("added", 400, "i2", "function_call"), event("called", 450, "c1", read, F.array(page), "i2"), event("added", 500, "i3", "function_call"), event("called", 520, "c2", "get_document", None, "i3"), event("added", 900, "i4", "message"), *text(950)]
    events = raw.select("answer_id", "most_pages", F.posexplode(F.when(F.col("answer_id") % 2 == 0, F.array(*even, event("end", 3000))).otherwise(F.array(*odd, event("end", 3000)))).alias("seq", "e"))
    events = events.where((F.col("answer_id") % 7 != 5) | (F.col("e.kind") != "end"))
    at = F.col("answer_id") * 1000 + F.col("e.after") + 1_750_000_000_000
    return events.select("answer_id", F.col("seq").cast("long").alias("seq"), F.timestamp_millis(at).alias("ts"), at.alias("at"), "e.kind", "e.call_id", "e.tool", "e.pages", "e.piece", F.col("most_pages").cast("long").alias("most_pages"))


def numbered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """pages with printed numbers at their end: the first two in roman numerals, the others from 1; every fifth page has none."""
    p = pages(spark, folder)
    folio = F.when(F.col("page") % 5 == 4, "").when(F.col("page") == 1, "i").when(F.col("page") == 2, "ii").otherwise((F.col("page") - 2).cast("string"))
    return p.select("doc_id", "page", F.concat_ws(" ", "text", F.lit("|"), folio).alias("text"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, role, text."""
    return read(spark, folder, "conversations")


def limiter_operations(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, user_id, at, op, n from events."""
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "hit").when(kind == "purchase", "refund").when(kind == "error", "record").otherwise("ask")
    return read(spark, folder, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), op.alias("op"), F.when(kind == "click", 2).otherwise(1).alias("n"))


def html_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, heading, n_links of raw web pages."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"),
        F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"),
    )
