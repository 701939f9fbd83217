"""Substring dedup with a log-structured fingerprint index: every run of 13 words that an earlier document holds is removed.

A run is an immutable, sorted set of window fingerprints: those of the documents of one range of ids, with about RUN_CHARS of text. Runs are
cut into buckets by fingerprint, so that all runs merge bucket by bucket; a fingerprint belongs to the earliest run that has it. The owner of
a fingerprint sends the words of its window to each run that has it too, neighbouring windows as one span of text. A run removes what those
windows and its own earlier documents cover, after comparing the words: an equal fingerprint alone removes nothing. compact() merges runs
into one that still says which run owns a fingerprint; later batches merge with it alone and get the words from the index's documents.

Fingerprints have 64 bits; inside a bucket a sorted run is stored as the gaps between them, in as few bytes as the largest gap needs.
Inside a run, windows that differ under one fingerprint are told apart by their words. Across runs a repeat would be missed only if a
different window of a still earlier run had its fingerprint: at 5e9 windows about 0.7 such pairs are expected among all.

Defined results: null and blank texts have no words and lose none. Documents without an id come after all others and do not remove from
each other. Repeated rows come out once each; rows of one id do not remove from each other. No documents give no rows and no runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .spark_io import partitions
from .word_hash import Words, slices

WINDOW = 13
#: Text for one run, and windows for one bucket.
RUN_CHARS = 8 << 20
BUCKET_WINDOWS = 2 << 20
#: owners: the run that owns each fingerprint (int64), null for a run that has its own only.
RUN_SCHEMA = "run long, bucket int, n long, width int, gaps binary, owners binary"
WANTED_SCHEMA = "run long, n long, width int, gaps binary, claimants binary"
SPAN_SCHEMA = "run long, span binary"
NO_ID = (1 << 63) - 1
#: Runs from here on hold documents without an id; they own nothing.
NO_ID_RUN = 1 << 40
#: Pairs of words compared at once.
COMPARED = 1 << 18


class Index(NamedTuple):
    """What later batches need: the runs of fingerprints, and the documents (run, doc_id, text) behind them."""

    runs: DataFrame
    docs: DataFrame


def pack(sorted_hashes: np.ndarray) -> tuple[int, bytes]:
    """Sorted uint64 as gaps of a fixed number of bytes."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return width, gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(n: int, width: int, data: bytes) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return np.cumsum(gaps.view(np.uint64).reshape(-1), dtype=np.uint64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the fingerprint, so a sorted run is cut in place."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def same_words(one: Words, i: np.ndarray, two: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of one is word j of two, byte by byte."""
    same = np.zeros(len(i), bool)
    for first in range(0, len(i), COMPARED):
        a, b = i[first : first + COMPARED], j[first : first + COMPARED]
        at = np.flatnonzero(one.stops[a] - one.starts[a] == two.stops[b] - two.starts[b])
        if len(at):
            x, y = one.starts[a[at]], two.starts[b[at]]
            n = one.stops[a[at]] - x
            begin = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(begin, n)
            same[first + at] = np.logical_and.reduceat(one.raw[np.repeat(x, n) + step] == two.raw[np.repeat(y, n) + step], begin)
    return same


def same_windows(one: Words, a: np.ndarray, two: Words, b: np.ndarray) -> np.ndarray:
    """Whether the windows that begin at words a of one and b of two have equal words. Neighbours share words: each stretch is compared once."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1))))
    windows = np.diff(first, append=len(a))
    pairs = windows + WINDOW - 1
    base = np.cumsum(pairs) - pairs
    step = np.arange(pairs.sum()) - np.repeat(base, pairs)
    bad = np.concatenate(([0], np.cumsum(~same_words(one, np.repeat(a[first], pairs) + step, two, np.repeat(b[first], pairs) + step))))
    at = np.repeat(base - first, windows) + np.arange(len(a))
    return bad[at + WINDOW] == bad[at]


class _Text:
    """Bytes and word borders of several Words as one."""

    def __init__(self, parts: list[Words]):
        shift = np.cumsum([0, *[len(p.raw) for p in parts]])
        join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
        self.raw = join([p.raw for p in parts], np.uint8)
        self.starts, self.stops = (join([getattr(p, c) + s for p, s in zip(parts, shift)], np.int64) for c in ("starts", "stops"))


class _Run:
    """Windows of one run's documents. keys: 64-bit fingerprints; at: first word of each; rank: the rank of each window's document id."""

    def __init__(self, docs: pa.Table):
        docs = docs.combine_chunks()
        ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()
        self.batches, first = [], 0
        keys, at, rank, parts = [], [], [], []
        ranks = np.unique(ids, return_inverse=True)[1]
        base = 0
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                words = Words(part.column("text").cast(pa.string()), fold_ascii=False)
                hashes, where = words.windows(WINDOW)
                keys.append(hashes)
                at.append(where + base)
                rank.append(ranks[first + words.doc[where]])
                parts.append(words)
                self.batches.append((part, words.offsets + base))
                base += len(words.hashes)
                first += part.num_rows
        self.n_words = base
        self.keys, self.at, self.rank = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, at, rank))
        self.keys = self.keys.astype(np.uint64)
        self.text = _Text(parts)

    def _window(self, k: int) -> bytes:
        t, a = self.text, self.at[k]
        return b" ".join(t.raw[t.starts[w] : t.stops[w]].tobytes() for w in range(a, a + WINDOW))

    def _own(self) -> np.ndarray:
        """Windows that an earlier document of this run holds."""
        hit = np.zeros(len(self.keys), bool)
        order = np.lexsort((self.at, self.rank, self.keys))
        if not len(order):
            return hit
        head = np.concatenate(([True], self.keys[order[1:]] != self.keys[order[:-1]]))
        owner = np.empty(len(order), np.int64)
        owner[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = np.flatnonzero(self.rank > self.rank[owner])
        same = same_windows(self.text, self.at[later], self.text, self.at[owner[later]])
        hit[later[same]] = True
        for key in np.unique(self.keys[later[~same]]):
            first: dict[bytes, int] = {}
            alike = np.flatnonzero(self.keys == key)
            names = [self._window(k) for k in alike]
            for k, name in zip(alike, names, strict=True):
                first[name] = min(first.get(name, NO_ID), self.rank[k])
            hit[alike] = [self.rank[k] > first[name] for k, name in zip(alike, names, strict=True)]
        return hit

    def covered(self, spans: pa.Array) -> np.ndarray:
        """Which words are in a window of an earlier run (spans: texts of those windows) or of an earlier document of this one."""
        hit = self._own()
        if len(spans):
            theirs = Words(spans, fold_ascii=False)
            keys, at = theirs.windows(WINDOW)
            keys, first = np.unique(keys, return_index=True)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
                mine = np.flatnonzero((keys[place] == self.keys) & ~hit)
                hit[mine] = same_windows(self.text, self.at[mine], theirs, at[first[place[mine]]])
        delta = np.zeros(self.n_words + WINDOW + 1, np.int32)
        np.add.at(delta, self.at[hit], 1)
        np.add.at(delta, self.at[hit] + WINDOW, -1)
        return np.cumsum(delta)[: self.n_words] > 0

    def first_windows(self, wanted: np.ndarray) -> np.ndarray:
        """The first word of the first window of each wanted fingerprint, -1 for none."""
        order = np.lexsort((self.at, self.keys))
        keys = self.keys[order]
        if not len(keys):
            return np.full(len(wanted), -1)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, self.at[order[place]], -1)

    def spans(self, at: np.ndarray) -> list[bytes]:
        """The text of the windows that begin at these words, neighbours as one."""
        at = np.sort(at)
        begin = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        end = np.append(begin, len(at))[1:] - 1
        t = self.text
        return [t.raw[t.starts[at[a]] : t.stops[at[b] + WINDOW - 1]].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _runs(buckets: int):
    def build(docs: pa.Table) -> pa.Table:
        keys = np.unique(_Run(docs).keys)
        cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
        rows, run = [], docs.column("run")[0].as_py()
        for k in np.flatnonzero(np.diff(cuts)):
            mine = keys[cuts[k] : cuts[k + 1]]
            rows.append((run, int(k), len(mine), *pack(mine), None))
        return _table(RUN_SCHEMA, rows)

    return build


def _merged(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fingerprints of a bucket with their runs, sorted by fingerprint, then run; and the place of each fingerprint's first."""
    parts, owners = [], []
    for run, n, width, gaps, owner in zip(*(runs.column(c).to_pylist() for c in ("run", "n", "width", "gaps", "owners")), strict=True):
        parts.append(unpack(n, width, gaps))
        owners.append(np.full(n, run, np.int64) if owner is None else np.frombuffer(owner, np.int64))
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    run = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.lexsort((run, keys))
    keys, run = keys[order], run[order]
    head = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return keys, run, np.flatnonzero(head)[np.cumsum(head) - 1]


def _wanted(since: int):
    """For each owner, the fingerprints that runs from `since` on have too, and these runs."""

    def wanted(runs: pa.Table) -> pa.Table:
        keys, run, first = _merged(runs)
        at = np.flatnonzero((first != np.arange(len(keys))) & (run >= since) & (run[first] < NO_ID_RUN))
        owner = run[first[at]]
        order = np.argsort(owner, kind="stable")
        at, owner = at[order], owner[order]
        rows, begin = [], np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(begin, np.append(begin, len(at))[1:], strict=True):
            rows.append((int(owner[a]), int(b - a), *pack(keys[at[a:b]]), run[at[a:b]].tobytes()))
        return _table(WANTED_SCHEMA, rows)

    return wanted


def _compacted(runs: pa.Table) -> pa.Table:
    keys, run, first = _merged(runs)
    one = np.flatnonzero((first == np.arange(len(keys))) & (run < NO_ID_RUN))
    rows = [(int(run[one].min()), runs.column("bucket")[0].as_py(), len(one), *pack(keys[one]), run[one].tobytes())] if len(one) else []
    return _table(RUN_SCHEMA, rows)


def _spans(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Texts that a run sends to the runs that have its fingerprints too."""
    rows = []
    if docs.num_rows and wanted.num_rows:
        run = _Run(docs)
        columns = [wanted.column(c).to_pylist() for c in ("n", "width", "gaps", "claimants")]
        keys = np.concatenate([unpack(n, w, g) for n, w, g, _ in zip(*columns, strict=True)])
        claimants = np.concatenate([np.frombuffer(c, np.int64) for c in columns[3]])
        at = run.first_windows(keys)
        order = np.argsort(claimants, kind="stable")
        order = order[at[order] >= 0]
        at, claimants = at[order], claimants[order]
        begin = np.flatnonzero(np.diff(claimants, prepend=-1))
        for a, b in zip(begin, np.append(begin, len(at))[1:], strict=True):
            rows += [(int(claimants[a]), span) for span in run.spans(at[a:b])]
    return _table(SPAN_SCHEMA, rows)


def run_bounds(docs: DataFrame, n_runs: int | None = None) -> tuple[list[int], int]:
    """(ids that end a run, characters in all): ranges of doc_id with about equal amounts of text, RUN_CHARS at most but for single ids."""
    chars = docs.where("doc_id is not null").agg(F.sum(F.length("text"))).first()[0] or 0
    # several ranges for each run, so that runs come out about equal; their number follows the text, as that of the runs does
    pieces = 4 * max(n_runs or partitions(docs), chars // RUN_CHARS + 1)
    lengths = docs.select("doc_id", F.length("text").alias("n")).where("doc_id is not null").repartitionByRange(pieces, "doc_id")
    sums = lengths.groupBy(F.spark_partition_id().alias("piece")).agg(F.max("doc_id").alias("last"), F.sum("n").alias("n")).orderBy("last").collect()
    total = sum(r["n"] or 0 for r in sums)
    n_runs = n_runs or max(partitions(docs), total // RUN_CHARS)
    bounds, held = [], 0
    for r in sums:
        held += r["n"] or 0
        if held * n_runs >= total:
            bounds.append(r["last"])
            held = 0
    return bounds[:-1], total


def with_runs(docs: DataFrame, bounds: list[int], first: int = 0) -> DataFrame:
    """docs with a run number: the range of doc_id; rows without an id are dealt over runs from NO_ID_RUN on."""
    ends = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, ids.to_numpy()))

    rest = F.pmod(F.xxhash64("text"), F.lit(partitions(docs))) + NO_ID_RUN
    return docs.withColumn("run", F.when(F.col("doc_id").isNull(), rest).otherwise(place(F.coalesce("doc_id", F.lit(0))) + first))


def build_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """The index runs of docs (run, doc_id, text): one row for each run and bucket."""
    return docs.groupBy("run").applyInArrow(_runs(buckets), RUN_SCHEMA)


def compact(runs: DataFrame) -> DataFrame:
    """One run in place of all: every fingerprint once, with the run that owns it. Later batches merge with it alone."""
    return runs.groupBy("bucket").applyInArrow(_compacted, RUN_SCHEMA)


def _result(docs: pa.Table, spans: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _table(OUT_SCHEMA, [])
    run, rows = _Run(docs), []
    gone = run.covered(spans.column("span").combine_chunks() if spans.num_rows else pa.array([], pa.binary()))
    for part, offsets in run.batches:
        for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True)):
            words = (text or b"").split()
            lost = gone[offsets[i] : offsets[i + 1]]
            kept = b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x] if lost.any() else words)
            rows.append((doc_id, len(words), int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept))
    return _table(OUT_SCHEMA, rows)


OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary"


def remove_repeats(docs: DataFrame, history: Index | None = None, buckets: int | None = None, n_runs: int | None = None, first: int = 0) -> tuple[DataFrame, Index]:
    """(result, index) for a batch of documents whose ids are all above those of the history.

    result: doc_id, n_words, n_removed, kept_sha256, kept_text for each row. index: the batch's own runs, numbered from `first` on, which
    must be above the history's numbers, and its documents. history: the index of earlier batches with as many buckets, its runs compacted
    or not.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds, chars = run_bounds(docs, n_runs)
    buckets = buckets or max(partitions(docs), chars // 6 // BUCKET_WINDOWS)
    dealt = with_runs(docs, bounds, first).repartition(partitions(docs), "run")
    runs = build_runs(dealt, buckets)
    wanted = (runs if history is None else runs.unionByName(history.runs)).groupBy("bucket").applyInArrow(_wanted(first), WANTED_SCHEMA)
    owners = dealt if history is None else dealt.unionByName(history.docs.select(*dealt.columns))
    spans = owners.groupBy("run").cogroup(wanted.groupBy("run")).applyInArrow(_spans, SPAN_SCHEMA)
    out = dealt.groupBy("run").cogroup(spans.groupBy("run")).applyInArrow(_result, OUT_SCHEMA)
    return out, Index(runs, dealt)
