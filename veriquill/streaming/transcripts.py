"""Runs as they are shown: stateful over a stream of events, and over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.cites import CiteStream
from ..functions.transcripts import Shown, Step, Transcript

SHOWN = "answer_id long, seq long, place int, kind string, step int, label string, pages string, elapsed_ms long, text string, n int, page long, quote string, claim string"
COLUMNS = ["seq", "at", "kind", "call_id", "tool", "pages", "piece"]
#: A run that is silent for so many ms of event time is over.
IDLE_MS = 600_000
#: The state store that several state variables of a key need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_FACTS = "thinking int, turn_at long, steps int, turns int, called boolean, called_at long, ended boolean, last_seq long"
_TEXT = "raw string, released boolean, most_pages long, held string, at int, n int, dropped int, edge string"
_WAITING = "kind string, step int, label string, pages string, elapsed_ms long, text string, n int, page long, quote string, claim string"
_STEP = "step int, tool string, pages array<int>, since long, took long"


def _pages(value) -> list[int] | None:
    return None if value is None else [int(p) for p in value]


def _taken(run: Transcript, rows: Iterator[tuple]) -> Iterator[tuple]:
    for seq, at, kind, call_id, tool, pages, piece in rows:
        for place, shown in enumerate(run.take(kind, int(at), call_id or "", tool or "", _pages(pages), piece or "")):
            yield (seq, place, *shown)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["answer_id", "seq", "place", *Shown._fields])
    return out.astype({"step": "Int32", "elapsed_ms": "Int64", "n": "Int32", "page": "Int64"})


class _Runs(StatefulProcessor):
    """A run's facts and text are values, shown things that wait a list, open calls and items that appeared are maps; a timer ends silent runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts, self.text = handle.getValueState("facts", _FACTS), handle.getValueState("text", _TEXT)
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open, self.appeared = handle.getMapState("open", "call_id string", _STEP), handle.getMapState("appeared", "item string", "at long")

    def _load(self, most_pages: int | None) -> tuple[Transcript, int]:
        run = Transcript(most_pages)
        if not self.facts.exists():
            return run, -1
        *facts, last_seq = self.facts.get()
        for name, value in zip(Transcript.FACTS, facts, strict=True):
            setattr(run, name, value)
        run.raw, run.released, run.most_pages, *stream = self.text.get()
        run.stream = CiteStream(run.most_pages, *stream)
        run.waiting = [Shown(*w) for w in self.waiting.get()]
        run.open = {k[0]: Step(v[0], v[1], list(v[2]), v[3], v[4]) for k, v in self.open.iterator()}
        run.open = dict(sorted(run.open.items(), key=lambda x: x[1].step))
        run.appeared = {k[0]: v[0] for k, v in self.appeared.iterator()}
        return run, last_seq

    def _save(self, run: Transcript, last_seq: int) -> None:
        self.facts.update((*[getattr(run, f) for f in Transcript.FACTS], last_seq))
        self.text.update((run.raw, run.released, run.most_pages, *run.stream.state()))
        self.waiting.clear()
        if run.waiting:
            self.waiting.put([tuple(w) for w in run.waiting])
        for state, rows in ((self.open, {k: tuple(s) for k, s in run.open.items()}), (self.appeared, {k: (at,) for k, at in run.appeared.items()})):
            state.clear()
            for k, row in rows.items():
                state.updateValue((k,), row)

    def _end_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        known = events["most_pages"].dropna()
        run, last = self._load(int(known.iloc[0]) if len(known) else None)
        # an event that comes again, or late, has been shown
        events = events[events["seq"] > last].drop_duplicates("seq")
        out = [(key[0], *row) for row in _taken(run, events[COLUMNS].itertuples(index=False))]
        if len(events):
            self._save(run, int(events["seq"].iloc[-1]))
        self._end_timers()
        if not run.ended and len(events):
            self.handle.registerTimer(int(events["at"].max()) + IDLE_MS)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, last = self._load(None)
        at = expiredTimerInfo.getExpiryTimeInMs() - IDLE_MS
        out = [] if run.ended else [(key[0], *row) for row in _taken(run, iter([(last + 1, at, "end", None, None, None, None)]))]
        for state in (self.facts, self.text, self.waiting, self.open, self.appeared):
            state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def shown_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What readers see (SHOWN) of a stream of events (answer_id, seq, ts, at in ms, kind, call_id, tool, pages array<int>, piece, most_pages).

    A run's events come in order of seq from batch to batch; the rows do not depend on how they are cut into batches. A run that is silent
    for IDLE_MS of event time ends there. The session needs the state store STORE.
    """
    return events.withWatermark("ts", late).groupBy("answer_id").transformWithStateInPandas(_Runs(), SHOWN, "Append", "EventTime")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, run, last = None, Transcript(), -1
    for rows in batches:
        out = []
        for answer, most, *event in rows[["answer_id", "most_pages", *COLUMNS]].itertuples(index=False):
            if answer != now:
                now, run, last = answer, Transcript(None if most is None or most != most else int(most)), -1
            if event[0] > last:
                last = event[0]
                out += [(answer, *row) for row in _taken(run, iter([tuple(event)]))]
        yield _frame(out)


def shown(events: DataFrame) -> DataFrame:
    """shown_stream() of a table of whole runs: dealt by run, sorted and walked through. Events without a run or a number are left out."""
    rows = events.where("answer_id is not null and seq is not null").repartition("answer_id").sortWithinPartitions("answer_id", "seq")
    return rows.select("answer_id", "most_pages", *COLUMNS).mapInPandas(_walk, SHOWN)


def folded(shown_rows: DataFrame) -> DataFrame:
    """answer_id, text, steps, open_steps, n_citations: what the shown rows of a run come to. A step or cite that comes again replaces itself."""
    order = F.struct("seq", "place")
    steps = shown_rows.where("step is not null").groupBy("answer_id", "step").agg(F.max_by("label", order).alias("label"), F.max_by("kind", order).alias("kind"))
    steps = steps.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "label"))), lambda x: x.label), "; ").alias("steps"), F.count_if(F.col("kind") == "step").alias("open_steps"))
    tokens = shown_rows.where("kind = 'token'").groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "place", "text"))), lambda x: x.text), "").alias("text"))
    cites = shown_rows.where("kind = 'citation'").groupBy("answer_id").agg(F.count_distinct("n").alias("n_citations"))
    out = shown_rows.select("answer_id").distinct().join(steps, "answer_id", "left").join(tokens, "answer_id", "left").join(cites, "answer_id", "left")
    return out.select("answer_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("steps", F.lit("")).alias("steps"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("open_steps", "n_citations")])
