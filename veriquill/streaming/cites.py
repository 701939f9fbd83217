"""Cite tags in answers that arrive piece by piece, as a keyed stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cites import Cite, CiteStream

STATE = "most_pages long, held string, at int, n int, dropped int, edge string"
EVENTS = "answer_id long, seq long, place int, text string, n int, page long, quote string, dropped int"


def _pieces(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows, ended = [], False
    pieces = pd.concat(batches).sort_values("seq")
    if state.exists:
        stream = CiteStream(*state.get)
    else:
        known = pieces["most_pages"].dropna() if "most_pages" in pieces else []
        stream = CiteStream(int(known.iloc[0]) if len(known) else None)
    for seq, piece, last in pieces[["seq", "piece", "last"]].itertuples(index=False):
        for place, event in enumerate(stream.feed(piece or "", final=bool(last))):
            cite = event if isinstance(event, Cite) else None
            rows.append((key[0], seq, place, None if cite else event, cite and cite.n, cite and cite.page, cite and cite.quote, stream.dropped))
        ended = ended or bool(last)
    if ended:
        state.remove()
    else:
        state.update((stream.most_pages, *stream.state()))
    out = pd.DataFrame(rows, columns=["answer_id", "seq", "place", "text", "n", "page", "quote", "dropped"])
    yield out.astype({"n": "Int32", "page": "Int64"})


def scan_stream(pieces: DataFrame) -> DataFrame:
    """Texts and cites of answers, as EVENTS, from a stream of pieces (answer_id, seq, piece, last, and most_pages if known).

    The pieces of an answer come in order of seq from batch to batch, the last one marked so. Joined by seq and place, the events are those
    of the whole answer, however it is cut; null pieces are empty. dropped counts the tags of the answer that went so far.
    """
    return pieces.groupBy("answer_id").applyInPandasWithState(_pieces, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
