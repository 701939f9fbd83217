"""Bands, reasons, frames, addresses and page lists of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MOST_PAGES = 2000


def score_band(share: Column) -> Column:
    return F.when(share >= 0.8, "high").when(share >= 0.5, "medium").when(share.isNotNull(), "low")


def usage_level(used: Column) -> Column:
    return F.when(used >= 1, "exhausted").when(used > 0.8, "low").when(used.isNotNull(), "ok").otherwise("off")


def skip_reason(disabled: Column, no_key: Column, empty: Column, no_contexts: Column) -> Column:
    """Why an answer isn't scored; the first reason that holds."""
    return F.when(disabled, "disabled").when(no_key, "no_api_key").when(empty, "empty_answer").when(no_contexts, "no_contexts")


def expand_pages(spec: Column, last: Column) -> Column:
    """The pages of a list such as 5,7-9, sorted, within 1 to last; a range holds at most MOST_PAGES and may run backwards."""

    def pages(part: Column) -> Column:
        a, b = (F.element_at(F.split(part, "-"), k).try_cast("bigint") for k in (1, -1))
        lo, hi = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), last)
        return F.when(lo <= hi, F.sequence(lo, F.least(hi, lo + MOST_PAGES - 1))).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, " *, *"), pages))))


def frame(name: Column, data: Column) -> Column:
    """One event as text, as browsers read it from a stream."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))


def parse_frames(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """key, n, name, data: the events of each body; comments are ignored, data lines joined."""
    split = rows.select(key, F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n").alias("frames"))
    kept = F.filter("frames", lambda f: f.rlike("(?m)^(?:event|data):"))
    each = split.select(key, F.posexplode(kept).alias("at", "frame"))
    lines = F.split("frame", "\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:"))), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return each.select(key, (F.col("at") + 1).cast("long").alias("n"), F.coalesce(F.element_at(field("event"), -1), F.lit("message")).alias("name"), F.array_join(field("data"), "\n").alias("data"))


def json_lines(rows: DataFrame, line: str, schema: str) -> DataFrame:
    """rows whose line is a JSON object, with its fields."""
    return rows.where(F.col(line).rlike("^\\s*\\{")).withColumn("parsed", F.from_json(line, schema)).where("parsed is not null").select(*rows.columns, "parsed.*")


def client_address(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, or the peer's where that is none."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(first.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"), first).otherwise(peer)


#: Groups of an address of the longer kind; eight of them, or fewer around one gap.
_GROUP = "[0-9A-Fa-f]{1,4}"
_SIDE = f"(?:{_GROUP}(?::{_GROUP})*)?"


def is_address(text: Column) -> Column:
    """Whether a text is an address of four numbers, or of eight groups with at most one gap."""
    gap = text.rlike(f"^{_SIDE}::{_SIDE}$") & (F.size(F.regexp_extract_all(text, F.lit(_GROUP), 0)) <= 7)
    return text.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$") | text.rlike(f"^{_GROUP}(?::{_GROUP}){{7}}$") | gap


def forwarded_address(forwarded: Column, peer: Column, hops: int = 0) -> Column:
    """The first of the forwarded addresses, or with `hops` the one that so many proxies put last; the peer's where that is none."""
    entries = F.split(F.coalesce(forwarded, F.lit("")), ",")
    chosen = F.trim(F.try_element_at(entries, F.lit(-hops if hops else 1)))
    return F.when(is_address(chosen), chosen).otherwise(peer)


def imported_id(session: Column, old: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", session, old), 256), 1, 32)


def batch_stream(events: DataFrame) -> DataFrame:
    """user_id, at, kind: one ordered stream of each batch, opened by batch_start and closed by batch_done and done."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    body = events.select("user_id", F.row_number().over(order).cast("long").alias("at"), F.col("event_type").alias("kind"))
    ends = events.groupBy("user_id").agg(F.count("*").alias("n"))
    marks = F.array(*[F.struct(at.cast("long").alias("at"), F.lit(k).alias("kind")) for at, k in ((F.lit(0), "batch_start"), (F.col("n") + 1, "batch_done"), (F.col("n") + 2, "done"))])
    return body.unionByName(ends.select("user_id", F.inline(marks)))
