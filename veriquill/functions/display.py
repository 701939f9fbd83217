"""How names, sizes, times and amounts are shown, and how loose ones are read, as columns."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F

# Names that Windows keeps for devices, the longest names, units of sizes in MiB.
RESERVED = ["con", "prn", "aux", "nul", *(f"{d}{k}" for d in ("com", "lpt") for k in range(1, 10))]
LONGEST_NAME, LONGEST_TITLE, LONGEST_SHOWN, LONGEST_SAFE = 80, 120, 255, 150
IN_MIB = {"B": 1 / 1048576, "KiB": 1 / 1024, "kB": 1 / 1024, "MiB": 1.0, "MB": 1.0, "GiB": 1024.0, "GB": 1024.0}


def fixed(x: Column, places: int) -> Column:
    """A number with that many places, without signs between thousands: the nearest to the double's exact value, of two equally near ones the even one."""
    x = x.cast("double")
    # format_string rounds the shortest decimal text of a double, half up; format_number its exact value, but not below one unit of the last place
    text = F.call_function("format_number", x, F.lit("0." + "0" * places if places else "0"))
    half = float(f"5e-{places + 1}")
    up = x >= half if Decimal(half) > Decimal(f"5e-{places + 1}") else x > half
    return F.when((x >= 0) & (x < 10.0**-places), F.when(up, f"{10.0**-places:.{places}f}").otherwise(f"{0:.{places}f}")).otherwise(text)


def short_name(name: Column, most: int = 20) -> Column:
    """The first 7 and last 10 characters of a long name."""
    text = F.when(F.coalesce(name, F.lit("")) == "", "document.pdf").otherwise(name)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, 7), F.lit("..."), F.right(text, F.lit(10)))).otherwise(text)


def byte_size(n: Column, largest: str = "GB") -> Column:
    """12 B, 3.4 KB, 120 MB; nothing for a negative or unknown size. Sizes beyond `largest` (KB, MB or GB) are told in it."""
    show = lambda v: F.when(v >= 100, fixed(F.round(v), 0)).otherwise(fixed(v, 1))
    text = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    units = ("KB", "MB", "GB")[: ("KB", "MB", "GB").index(largest) + 1]
    for i, unit in enumerate(units, 1):
        told = F.concat(show(n / 1024**i), F.lit(f" {unit}"))
        text = text.otherwise(told) if unit == largest else text.when(n / 1024**i < 1024, told)
    return F.when(n.isNull() | (n < 0), "").otherwise(text)


def clock(seconds: Column) -> Column:
    """Minutes and seconds of a running timer: 1:05."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def duration(ms: Column) -> Column:
    """850 ms, 4.2 s, 12 s, 1 min 05 s; nothing for a negative or unknown time."""
    s = ms / 1000
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), F.lpad(F.floor(s % 60 + 0.5).cast("string"), 2, "0"), F.lit(" s"))
    text = F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(s < 10, F.concat(fixed(s, 1), F.lit(" s"))).when(s < 60, F.concat(F.floor(s + 0.5).cast("string"), F.lit(" s"))).otherwise(minutes)
    return F.when(ms.isNull() | (ms < 0), "").otherwise(text)


def cost(usd: Column) -> Column:
    """~$0.0043 below a cent, ~$0.043 from there on."""
    return F.when(usd.isNull() | F.isnan(usd), "").otherwise(F.concat(F.lit("~$"), F.when(usd < 0.01, fixed(usd, 4)).otherwise(fixed(usd, 3))))


def day_label(at: Column, now: Column) -> Column:
    """Today, Yesterday, or month and day, with the year after 300 days."""
    days = F.datediff(now, at)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days > 300, F.date_format(at, "MMM d, yyyy")).otherwise(F.date_format(at, "MMM d"))


def utc_text(at: Column) -> Column:
    """Whole seconds, for sessions whose time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def en_dash(text: Column) -> Column:
    """An en dash between the numbers of a range; in 1-2-3 the first only, as digits belong to one range."""
    return F.regexp_replace(text, "([0-9])-([0-9])", "$1–$2")


def clean_title(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "[\\x00-\\x20\\x7F]+", " ")), 1, LONGEST_TITLE)


def _plain_letters(names: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names], dtype=object)


def ascii_letters(text: Column) -> Column:
    """Letters without their accents, ligatures taken apart; what is then not ASCII goes. Only texts with such characters go to Python."""
    odd = text.rlike("[^\\x00-\\x7F]")
    return F.when(odd, F.pandas_udf(_plain_letters, "string")(F.when(odd, text))).otherwise(text)


def base_name(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), "([^\\\\/]*)$", 1)


def stem_of(name: Column) -> Column:
    """A storage name's stem of letters, digits, _ and -; accents go, other runs become _."""
    edges = lambda s: F.btrim(s, F.lit("_-"))
    stem = F.regexp_replace(ascii_letters(F.regexp_replace(base_name(name), "(?i)\\.pdf$", "")), "[^A-Za-z0-9_-]+", "_")
    stem = edges(F.substring(edges(stem), 1, LONGEST_NAME - 4))
    return F.when(stem == "", "report").when(F.lower(stem).isin(RESERVED), F.concat(F.lit("doc_"), stem)).otherwise(stem)


def slug(name: Column) -> Column:
    """A storage name that ends in .pdf."""
    return F.concat(stem_of(name), F.lit(".pdf"))


def shown_name(name: Column, instead: Column) -> Column:
    """A file's own name, control characters and runs of blanks as one blank; instead of nothing, the other name."""
    told = F.substring(F.trim(F.regexp_replace(F.regexp_replace(base_name(name), "[\\x00-\\x1f\\x7f]", " "), "\\s+", " ")), 1, LONGEST_SHOWN)
    return F.when(told == "", instead).otherwise(told)


def safe_name(name: Column) -> Column:
    """A file's name without folders, control characters and signs that file systems refuse, ending in .pdf."""
    own = F.regexp_replace(F.regexp_replace(base_name(name), "[\\x00-\\x1f\\x7f]", ""), '[<>:"|?*]', "_")
    stem = F.btrim(F.regexp_replace(own, "(?i)\\.pdf$", ""), F.lit(" ."))
    stem = F.rtrim(F.substring(stem, 1, LONGEST_SAFE - 4), F.lit(" ."))
    return F.concat(F.when(stem == "", "report").otherwise(stem), F.lit(".pdf"))


def mib(text: Column) -> Column:
    """A size such as 348MiB in MiB; an unknown unit counts as one, no number as NaN."""
    number, unit = (F.regexp_extract(text, "([0-9.]+)\\s*([A-Za-z]*)", k) for k in (1, 2))
    factor = F.coalesce(*[F.when(unit == u, f) for u, f in IN_MIB.items()], F.lit(1.0))
    return F.coalesce(F.try_to_number(number, F.lit("999999999999.999")).cast("double") * factor, F.lit(float("nan")))


def score(value: Column) -> Column:
    """A loose number in 0 to 1 with four places; null for what is none, NaN or infinite."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 4))
