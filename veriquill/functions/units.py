"""What a page says piece by piece: its sentences and the rows of its tables, line by line. A helper for Python table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from .terms import ENDINGS, LETTERS_KEPT, LETTERS_LEFT, TERM

# Words that are figures, years, ends of sentences, short forms that end none, signs of running heads, and limits in words.
FIGURE = re.compile(r"[(£$€-]*[0-9][0-9,.]*[%)]*|n/m|-")
YEARS, YEAR = re.compile(r"[0-9]{4}/[0-9]{2}"), re.compile(r"(?:19|20)[0-9]{2}")
ENDS = re.compile("[.!?][)\\]”’\"']*$")
SHORT_FORMS = frozenset("no. nos. vs. etc. approx. inc. ltd. co. st. dr. mr. mrs. ms.".split())
BEGINNERS = "“‘(£$0123456789"
RUNNING = re.compile(r"(?:^|\s)[0-9]{1,3}$|^[0-9]{1,3}\s|annual report|interim report|\bpage\s+[0-9]+", re.IGNORECASE)
RUNNING_WORDS, RUNNING_LINES = 12, 3
HEADER_WORDS, ROW_WORDS, LABEL_WORDS, HEADING_WORDS = 8, 18, 12, 7
NO_HEADING_END = (".", ",", ";", ":", "-", "?", "!", ")")
LEAST_WORDS, LIST_WORDS = 3, 40
SOFT = str.maketrans("", "", "\ufffe\u00ad\x02")
#: White space that is no single blank.
ODD_SPACE = re.compile(r"\s\s|[^\S ]")
#: Where a sentence may end: ENDS and the blank after it; terms as in terms.terms(), and what texts of single words do not have.
STOP, SAID, NO_WORD = re.compile("[.!?][)\\]”’\"']* "), re.compile(TERM), re.compile("[0-9'’]")
DIGIT, LETTERS, SUFFIXES = re.compile("[0-9]"), bytes(c if 97 <= c <= 122 else 32 for c in range(256)), frozenset(ENDINGS)


class Unit(NamedTuple):
    """said: words as they stand on the page, with single blanks; joined: places of words whose hyphen only ends a line; text as it is told; label of a row."""

    said: str
    joined: list[int]
    is_row: bool
    text: str
    label: str


def is_figure(word: str) -> bool:
    return FIGURE.fullmatch(word) is not None


def states_amount(text: str) -> bool:
    """Whether a text has a figure of three signs or more that is no year."""
    return (DIGIT.search(text) is not None or "n/m" in text) and any(len(w) > 2 and is_figure(w) and not YEAR.fullmatch(w) for w in (x.strip(".,;:") for x in text.split()))


def stem(term: str) -> str:
    """The stem of one term, as in terms.terms()."""
    if term[0] <= "9":
        return term.replace(",", "")
    first, _, last = term.replace("’", "'").partition("'")
    word = first if last == "s" else first + last
    return word[: LETTERS_LEFT if word[LETTERS_LEFT:] in SUFFIXES else LETTERS_KEPT]


def stems(text: str) -> str:
    """terms.terms() of a text, with blanks between them."""
    text = text.lower()
    if NO_WORD.search(text):
        return " ".join(map(stem, SAID.findall(text)))
    return " ".join([word[: LETTERS_LEFT if word[LETTERS_LEFT:] in SUFFIXES else LETTERS_KEPT] for word in text.encode("ascii", "replace").translate(LETTERS).decode().split()])


def figures_at_end(words: list[str]) -> int:
    return next((k for k, w in enumerate(reversed(words)) if not is_figure(w)), len(words))


def kind_of(line: str, words: list[str] | None = None) -> str:
    """blank, header (of columns), row, heading or prose; words: those of the line, if they are known."""
    words = line.split() if words is None else words
    if not words:
        return "blank"
    if len(words) <= HEADER_WORDS and sum(bool(YEARS.fullmatch(w)) for w in words) >= 2:
        return "header"
    figures = figures_at_end(words)
    if 2 <= figures < len(words) <= ROW_WORDS and len(words) - figures <= LABEL_WORDS:
        return "row"
    if len(words) <= HEADING_WORDS and line[0].isupper() and not line.endswith(NO_HEADING_END) and not any(map(is_figure, words)):
        return "heading"
    return "prose"


def body(lines: list[str]) -> list[str]:
    """Lines without running heads and feet: short ones with a page number or the report's name among the first and last three that say something."""
    told = [k for k, line in enumerate(lines) if line]
    edge = {k for k in told[:RUNNING_LINES] + told[-RUNNING_LINES:] if len(lines[k].split()) <= RUNNING_WORDS and RUNNING.search(lines[k]) and not ENDS.search(lines[k])}
    return [line for k, line in enumerate(lines) if k not in edge]


def shown(said: str, joined: list[int]) -> str:
    """Words with single blanks; a hyphen at a line's end goes with the blank after it."""
    if not joined:
        # a word may be nothing but soft signs
        return said.translate(SOFT) if "\u00ad" in said or "\ufffe" in said or "\x02" in said else said
    text = ""
    for k, word in enumerate(said.split(" ")):
        word = word.translate(SOFT)
        text += (" " if k and k - 1 not in joined else "") + (word[:-1] if k in joined and word.endswith("-") else word)
    return text


class Reader:
    """Lines of a page one after another: prose gathers until something else ends it."""

    def __init__(self):
        self.lines: list[str] = []
        self.n = 0
        self.joined: list[int] = []
        self.columns: list[str] = []

    def read(self, line: str) -> Iterator[Unit]:
        plain, n = (line, line.count(" ") + 1) if line and not ODD_SPACE.search(line) else (None, 0)
        # a long line is prose, whatever its words are
        words = line.split() if n <= ROW_WORDS else []
        kind = "prose" if n > ROW_WORDS else kind_of(line, words)
        # within a sentence, a short line is no heading
        if kind == "prose" or (kind == "heading" and self.lines and not ENDS.search(self.lines[-1])):
            self._gather(" ".join(words) if plain is None else plain, n or len(words))
            return
        yield from self.rest()
        if kind == "header":
            self.columns = [w for w in words if YEARS.fullmatch(w)]
        elif kind == "row":
            yield self._row(words)

    def _gather(self, line: str, n: int) -> None:
        """A line with single blanks between its n words."""
        self.lines.append(line)
        self.n += n
        if line.endswith("-") and len(line) - line.rfind(" ") > 3 and line[-2].isalpha():
            self.joined.append(self.n - 1)

    def _row(self, words: list[str]) -> Unit:
        cut = len(words) - figures_at_end(words)
        cells = [f"{w} ({self.columns[k]})" if k < len(self.columns) else w for k, w in enumerate(words[cut:])]
        label = " ".join(words[:cut])
        return Unit(" ".join(words), [], True, f"{label}: {', '.join(cells)}", label)

    def rest(self) -> Iterator[Unit]:
        """The sentences gathered so far."""
        said, joined, first, at = " ".join(self.lines), self.joined, 0, 0
        self.lines, self.joined, self.n = [], [], 0
        for end in (*self._ends(said), len(said)) if said else ():
            sentence = said[first:end]
            n = sentence.count(" ") + 1
            places = [j - at for j in joined if at <= j < at + n] if joined else []
            yield Unit(sentence, places, False, shown(sentence, places), "")
            first, at = end + 1, at + n

    @staticmethod
    def _ends(said: str) -> Iterator[int]:
        """Where sentences end but for the last one."""
        for found in STOP.finditer(said):
            end = found.end() - 1
            word, after = said[said.rfind(" ", 0, found.start()) + 1 : end], said[end + 1]
            if (after.isupper() or after in BEGINNERS) and word.lower() not in SHORT_FORMS and len(word.rstrip(".!?")) > 1:
                yield end


def units(text: str) -> Iterator[Unit]:
    """Sentences and rows of a page, without headings, running heads, and what is no statement: under three words, or a long list without an end."""
    reader = Reader()
    for line in [*body([x.strip() for x in re.split("\r\n|\r|\n", text)]), ""]:
        for unit in reader.read(line):
            if len(unit.text.split(None, LEAST_WORDS)) >= LEAST_WORDS and (unit.is_row or unit.said.count(" ") + 1 < LIST_WORDS or ENDS.search(unit.said)):
                yield unit
