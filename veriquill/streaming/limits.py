"""Rates, progress and folds over event streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trailing_count(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """event_id, n: events of the same user in the time up to each, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", "user_id", at.alias("at")).select("event_id", F.count("*").over(frame).alias("n"))


class Allowance:
    """At most `limit` events in a window of `seconds`; times are microseconds. A limit of 0 allows all."""

    def __init__(self, limit: int, seconds: int, taken: list[int] | None = None):
        self.limit, self.window, self.taken = limit, seconds * 1_000_000, deque(taken or ())

    def _wait(self, since: int) -> int:
        """Whole seconds, one at least."""
        return max(1, -(-since // 1_000_000))

    def use(self, op: str, at: int, n: int = 1) -> int:
        """Seconds to wait, 0 if the operation is allowed or needs no leave.

        hit: n events at once, all or none; ask: whether one would be allowed; record: one in any case; refund: the n latest go; reset: all go.
        """
        while self.taken and at - self.taken[0] >= self.window:
            self.taken.popleft()
        over = len(self.taken) + n - self.limit
        if op in ("refund", "reset"):
            for _ in range(min(n, len(self.taken)) if op == "refund" else len(self.taken)):
                self.taken.pop()
        elif op == "record" and self.limit > 0:
            self.taken.append(at)
        elif op == "ask" and self.limit > 0 and len(self.taken) >= self.limit:
            return self._wait(self.taken[0] + self.window - at)
        elif op == "hit" and self.limit > 0 and n > 0:
            if over > 0:
                return self._wait(self.window if n > self.limit else self.taken[over - 1] + self.window - at)
            self.taken.extend([at] * n)
        return 0


USED = "event_id long, allowed boolean, retry_after long"


def _waits(rows: pd.DataFrame, allowance: Allowance) -> pd.DataFrame:
    waits = [allowance.use(op, at, n) for op, at, n in rows[["op", "at", "n"]].itertuples(index=False)]
    return pd.DataFrame({"event_id": rows["event_id"], "allowed": [w == 0 for w in waits], "retry_after": waits})


def _walk(limit: int, seconds: int):
    """Rows sorted by user, part and time, batch by batch; the last part of a batch may go on in the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, allowance = None, Allowance(limit, seconds)
        for rows in batches:
            waits = []
            for part, op, at, n in rows[["part_id", "op", "at", "n"]].itertuples(index=False):
                if part != now:
                    now, allowance = part, Allowance(limit, seconds)
                waits.append(allowance.use(op, at, n))
            yield pd.DataFrame({"event_id": rows["event_id"], "allowed": [w == 0 for w in waits], "retry_after": waits})

    return run


def limited(ops: DataFrame, limit: int = 3, seconds: int = 86_400) -> DataFrame:
    """event_id, allowed, retry_after for operations (event_id, user_id, at in microseconds, op, n) as Allowance.use() takes them.

    After a pause of a whole window nothing that came before counts, so the operations between two pauses are folded for themselves: they are
    dealt by user and part, sorted, and walked through in one call a partition. A part is known by its user and the operation that opens it.
    """
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = ops.select("event_id", "user_id", "at", "op", "n", (F.col("at") - F.lag("at").over(order) >= seconds * 1_000_000).cast("int").alias("cut"))
    rows = rows.withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(order))
    rows = rows.withColumn("part_id", F.concat_ws(" ", F.coalesce(F.col("user_id").cast("string"), F.lit("-")), "part"))
    rows = rows.repartition("part_id").sortWithinPartitions("part_id", "at", "event_id")
    return rows.select("event_id", "part_id", "at", "op", "n").mapInPandas(_walk(limit, seconds), USED)


def sliding_limiter(events: DataFrame, limit: int = 3, seconds: int = 86_400) -> DataFrame:
    """event_id, allowed, retry_after: at most `limit` events of a user in the window; refused events are not counted."""
    return limited(events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit("hit").alias("op"), F.lit(1).alias("n")), limit, seconds)


def limit_stream(ops: DataFrame, limit: int = 3, seconds: int = 86_400) -> DataFrame:
    """limited() over a stream of operations; those of a user come in order of time from batch to batch."""

    def run(key: tuple, batches, state: GroupState):
        allowance = Allowance(limit, seconds, list(state.get[0]) if state.exists else None)
        out = _waits(pd.concat(batches).sort_values(["at", "event_id"]), allowance)
        state.update((list(allowance.taken),))
        yield out

    return ops.groupBy("user_id").applyInPandasWithState(run, USED, "taken array<long>", "append", GroupStateTimeout.NoTimeout)


def high_water(events: DataFrame) -> DataFrame:
    """event_id, progress: the largest progress of a user so far, at most 0.95."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", F.round(F.least(F.lit(0.95), F.max(F.col("value") / 1000).over(order)), 6).alias("progress"))


def turns(events: DataFrame, gap_seconds: int = 86_400) -> DataFrame:
    """user_id, turn, n: events of a user without a gap longer than this between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_id", "ts", (at - F.lag(at).over(order)).alias("gap"))
    turn = F.sum(F.when(F.col("gap") > gap_seconds * 1_000_000, 1).otherwise(0)).over(order)
    return rows.select("user_id", turn.alias("turn")).groupBy("user_id", "turn").agg(F.count("*").alias("n"))


def fold(events: DataFrame) -> DataFrame:
    """One row for each user from the events in order: their kinds joined, the last kind, the last value of a purchase."""
    rows = events.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.substring(x.event_type, 1, 1)), "").alias("kinds"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"),
        F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("last_purchase"),
    )
    return rows


def batch_counts(events: DataFrame) -> DataFrame:
    """user_id, answered, failed, done: a batch is done when every question of it is decided."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count_if(kind == "purchase").alias("answered"), F.count_if(kind == "error").alias("failed"), F.bool_and(kind.isin("purchase", "error")).alias("done"))
