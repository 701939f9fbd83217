"""Fill-in-middle examples: texts cut in three and put together in another order around sentinels.

A table-driven automaton over bytes reads a text once. Its state holds how far a sentinel has been spelt, how many bytes of a character are
still to come and what the byte before was; its transitions say where characters and units (characters, words or lines) begin and where sentinels end. All of
that follows from the last three bytes, so a text is cut into blocks that are read side by side, each from three bytes before it; at the
beginning of a document the automaton begins anew. The first scan counts transitions per block. The second pass finds the block that a cut falls
in from those counts and the cut's place in that block.

Defined results: a null or empty text is plain and its output empty. A text that holds a sentinel is plain, as its parts could not be told
apart. A row without an id is cut by the hash of the bare prefix. Repeated rows come out alike, once each; no documents give no rows. Texts of
any length are read whole, about PIECE bytes of several or one longer text at a time. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes and rows read at once, bytes of a block, and bytes that the automaton's state follows from.
PIECE, ROWS, BLOCK, MEMORY = 4 << 20, 2048, 512, 3
UNIT, SENTINEL, CHARACTER = 1, 2, 4
BLANKS = b" \t\n\v\f\r"
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


@functools.lru_cache(8)
def automaton(unit: str = "character", sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[np.ndarray, np.ndarray]:
    """(next state, transition) for each state and byte; state 0 is the beginning of a text.

    A state is (spelt, to come, before): the longest beginning of a sentinel that the text ends with, the bytes that a character still has,
    and whether the byte before was a blank, a newline, something else or nothing.
    """
    words = [s.encode() for s in sentinels]
    begun = {w[:k] for w in words for k in range(len(w))}
    if MEMORY < max(map(len, words)) or unit not in ("character", "word", "line"):
        raise ValueError("sentinels of at most three bytes; units are characters, words or lines")

    def step(state: tuple[bytes, int, str], byte: int) -> tuple[tuple[bytes, int, str], int]:
        spelt, to_come, before = state
        grown = spelt + bytes([byte])
        after = next(grown[k:] for k in range(len(grown) + 1) if grown[k:] in begun)
        inside = 0x80 <= byte < 0xC0
        rest = max(0, to_come - 1) if inside else (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
        kind = "newline" if byte == 10 else "blank" if byte in BLANKS else "letter"
        begins = before == "nothing" or (not inside and (unit == "character" or (unit == "line" and before == "newline") or (unit == "word" and kind == "letter" and before in ("blank", "newline"))))
        return (after, rest, kind), UNIT * begins + SENTINEL * any(grown.endswith(w) for w in words) + CHARACTER * (not inside)

    states = {(b"", 0, "nothing"): 0}
    rows: list[list[tuple[int, int]]] = []
    while len(rows) < len(states):
        state = list(states)[len(rows)]
        found = [step(state, byte) for byte in range(256)]
        rows.append([(states.setdefault(after, len(states)), told) for after, told in found])
    table = np.array(rows)
    return table[:, :, 0].astype(np.uint8), table[:, :, 1].astype(np.uint8)


class Scan:
    """Transitions of several texts that stand one after another in `data`, each from starts[i] to starts[i + 1]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str = "character"):
        after, told = automaton(unit)
        after, told = after.ravel(), told.ravel()
        n = max(1, -(-len(data) // BLOCK))
        padded = np.zeros(MEMORY + n * BLOCK, np.uint8)
        padded[MEMORY : MEMORY + len(data)] = data
        anew = np.zeros(len(padded), bool)
        anew[MEMORY + starts[:-1][starts[:-1] < starts[1:]]] = True
        side_by_side = lambda x: np.lib.stride_tricks.as_strided(x, (MEMORY + BLOCK, n), (x.itemsize, BLOCK * x.itemsize))
        state, self.marks = np.zeros(n, np.uint16), np.empty((BLOCK, n), np.uint8)
        for k, (byte, begins) in enumerate(zip(side_by_side(padded), side_by_side(anew), strict=True)):
            state[begins] = 0
            at = (state << 8) | byte
            state = after[at].astype(np.uint16)
            if k >= MEMORY:
                self.marks[k - MEMORY] = told[at]
        self.marks[BLOCK - (n * BLOCK - len(data)) :, -1:] = 0
        self.upto = {kind: np.concatenate([[0], np.cumsum((self.marks & kind > 0).sum(0))]) for kind in (UNIT, SENTINEL, CHARACTER)}

    def before(self, kind: int, places: np.ndarray) -> np.ndarray:
        """How many transitions of a kind stand before these places."""
        block, rest = places // BLOCK, places % BLOCK
        inside = (self.marks[:, np.minimum(block, self.marks.shape[1] - 1)] & kind > 0) & (np.arange(BLOCK)[:, None] < rest)
        return self.upto[kind][block] + inside.sum(0)

    def unit_at(self, ranks: np.ndarray) -> np.ndarray:
        """Where units begin, by their numbers among all units."""
        block = np.searchsorted(self.upto[UNIT], ranks, side="right") - 1
        counted = np.cumsum(self.marks[:, block] & UNIT, axis=0, dtype=np.int32)
        return block * BLOCK + (counted > ranks - self.upto[UNIT][block]).argmax(0)


def _examples(ids: list[int | None], texts: pa.Array, unit: str) -> pa.RecordBatch:
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    data = np.frombuffer(raw, np.uint8)
    draws = np.array([[int(h[k : k + 8], 16) for k in (0, 8, 16, 24)] for h in (hashlib.sha256(b"1:%s" % (b"" if i is None else b"%d" % i)).hexdigest() for i in ids)], np.int64).reshape(len(ids), 4)
    scan = Scan(data, starts, unit)
    units, found = scan.before(UNIT, starts), np.diff(scan.before(SENTINEL, starts))
    n = np.diff(units)
    plain = (n == 0) | (found > 0) | (draws[:, 2] % 100 >= 100 - PLAIN_PERCENT)
    ends = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    cuts = np.repeat(starts[1:, None], 2, axis=1)
    inner = ends < n[:, None]
    cuts[inner] = scan.unit_at((units[:-1, None] + ends)[inner])
    chars = scan.before(CHARACTER, np.column_stack([starts[:-1], cuts]).ravel()).reshape(-1, 3)
    forms, outputs = [], []
    for a, b, (p, m), is_plain, draw in zip(starts[:-1].tolist(), starts[1:].tolist(), cuts.tolist(), plain.tolist(), draws[:, 3].tolist(), strict=True):
        prefix, middle, suffix = (b"%s%s" % (s.encode(), raw[x:y]) for s, x, y in ((PREFIX, a, p), (MIDDLE, p, m), (SUFFIX, m, b)))
        forms.append("plain" if is_plain else "spm" if draw % 100 < SPM_PERCENT else "psm")
        outputs.append(bytes(raw[a:b]) if is_plain else suffix + prefix + middle if forms[-1] == "spm" else prefix + suffix + middle)
    spans = [pa.array(np.diff(chars, axis=1)[:, k], mask=plain) for k in (0, 1)]
    columns = [pa.array(ids, pa.int64()), pa.array(n), pa.array(forms, pa.string()), *spans, pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most ROWS rows and PIECE bytes, or of one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and (held + size > PIECE or k - first == ROWS):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)


def fill_in_middle(docs: DataFrame, unit: str = "character") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null where plain), output of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                yield _examples(piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.string()), unit)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts stand between the sentinels, in the order that the form says."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    text = lambda *order: F.concat(*[F.get(parts, F.lit(k)) for k in order])
    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)
