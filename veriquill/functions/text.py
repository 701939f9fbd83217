"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = "[0-9]+(?:[.,][0-9]+)*"

# Words that say nothing about where a passage stands.
STOP_WORDS = (
    "the of and to in a for on by is was at as with from that an or be are this it its were has have had which will would also than their "
    "there been not but our we us may can such other more"
).split()

# Ligatures and what they stand for, odd spaces, characters that are dropped.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
ODD_SPACES = "\u00a0\u2007\u2009\u202f\u3000"
LINE_SPACES = "\u2028\u2029"
DROPPED = "\ufffe\u0002\u00ad\u200b\u200c\u200d\u2060\ufeff\uffff"


def squash(text: Column) -> Column:
    """Letters and digits only, case folded."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "[^\\p{L}\\p{N}]", "")


#: Characters that no normal form changes, but for those that squash() drops; other texts are normalised in Python.
SETTLED = "[\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u2010-\\u201F\\u2026\\u20AC]*"


def numbers(text: Column) -> Column:
    """Numbers of a text, without commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))


def claim_tokens(text: Column) -> Column:
    """Numbers without commas, and runs of letters, in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(NUMBER + "|\\p{L}+"), 0)
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x))


def clean_text(text: Column) -> Column:
    """Newlines as LF, ligatures and odd spaces written out, control characters and trailing blanks gone, at most one empty line in a row."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.translate(text, ODD_SPACES + LINE_SPACES + DROPPED, " " * len(ODD_SPACES) + "\n" * len(LINE_SPACES))
    for mark, letters in LIGATURES.items():
        text = F.replace(text, F.lit(mark), F.lit(letters))
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n")
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def strip_markers(text: Column) -> Column:
    """Text without [[cN]] and the blanks before them; at the start of a line its indent stays and the blanks after them go.

    The text is cut at the markers and put together again, each part with the blanks on the side that its place asks for removed.
    """
    at_start = lambda s: s.rlike("(?:^|\\n)[ \\t]*\\z")
    joined = lambda s, part: F.when(at_start(s), F.concat(s, F.ltrim(part, F.lit(" \t")))).otherwise(F.concat(F.rtrim(s, F.lit(" \t")), part))
    parts = F.split(text, "\\[\\[c[0-9]+\\]\\]")
    return F.aggregate(F.slice(parts, 2, 1 << 30), F.get(parts, F.lit(0)), joined)


def redact_keys(text: Column, least: int = 1, signs: str = "") -> Column:
    """Keys by their first characters only: those with `least` characters after them at least, of letters, digits, _, - and `signs`."""
    return F.regexp_replace(text, f"(sk-|gsk_|xai-|tgp_|AIza)[A-Za-z0-9_{signs}-]{{{least},}}", "$1...")


def make_title(text: Column, most: int = 60) -> Column:
    """A short title: white space collapsed; a long one is cut at its last blank, if that is not in the first half."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    head = F.substring(flat, 1, most)
    blank = most - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (blank >= most // 2), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(cut, "[ .,;:-]+$", ""), F.lit("…")))
