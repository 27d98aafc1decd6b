"""Sliding-log rate limiter: only admitted requests fill the log.

A trailing-window count is another thing, as it counts rejected requests too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admit(log: deque, at: float, quantity: int, period: float) -> tuple[bool, float]:
    """Whether a request is admitted, and else how long it has to wait; ``log`` is brought up to date."""
    while log and at - log[0] >= period:
        log.popleft()
    if len(log) < quantity:
        log.append(at)
        return True, 0.0
    return False, period - (at - log[0])


def limit(events: DataFrame, *, id: str, key: str, time: str, quantity: int, period: float) -> DataFrame:
    """(id, admitida, espera) of every event with a key and a time, in the order (time, id) within its key.

    A key's events are cut where a whole period stands empty: the log is empty
    then, so the pieces are independent and a busy key is many groups. Each
    piece streams through its task in order; only the log is held.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(key).alias("chave"), F.unix_micros(F.col(time).cast("timestamp")).alias("quando")).withColumn("passo", F.floor(F.col("quando") / F.lit(int(period * 1e6))))
    steps = rows.select("chave", "passo").distinct()
    order = Window.partitionBy("chave").orderBy("passo")
    # Two steps apart, at least one whole step between is empty.
    begins = F.when(F.col("passo") - F.lag("passo").over(order) <= 1, 0).otherwise(1)
    pieces = steps.withColumn("inicio", begins).withColumn("trecho", F.sum("inicio").over(order)).select("chave", "passo", "trecho")
    sorted_rows = rows.join(pieces, ["chave", "passo"]).repartition("chave", "trecho").sortWithinPartitions("chave", "trecho", "quando", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in batches:
            out = []
            for i, k, t, q in zip(batch["id"], batch["chave"], batch["trecho"], batch["quando"]):
                if (k, t) != current:
                    current, log = (k, t), deque()
                out.append((i, *admit(log, q / 1e6, quantity, period)))
            yield pd.DataFrame(out, columns=["id", "admitida", "espera"])

    return sorted_rows.select("id", "chave", "trecho", "quando").mapInPandas(run, "id bigint, admitida boolean, espera double")


def limit_stream(events: DataFrame, *, id: str, key: str, time: str, quantity: int, period: float, late: float | None = None) -> DataFrame:
    """The limiter on a stream: the log of each key is state; events of a micro-batch are taken in order of time.

    All times are event times. Events more than ``late`` seconds (a period,
    unless given) behind the latest are dropped by the watermark; state ends once the watermark is a period past the
    key's last admitted event, when its log has run empty, so that a replay at any
    speed gives the same. A key's events of one micro-batch are held at once.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    # The first watermark is time 0; a second ahead of it, no event is late before any came.
    ahead = 1000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["quando", "id"])
        out = [(i, k[0], *admit(log, q / 1e6, quantity, period)) for i, q in zip(rows["id"], rows["quando"])]
        state.update((list(log),))
        ends = int((max(log, default=0.0) + period) * 1000) + 1 + ahead
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "chave", "admitida", "espera"])

    timed = events.withColumn("_quando", F.timestamp_micros(F.unix_micros(F.col(time).cast("timestamp")) + ahead * 1000)).withWatermark("_quando", f"{period if late is None else late} seconds")
    rows = timed.select(F.col(id).cast("bigint").alias("id"), F.col(key).cast("string").alias("chave"), (F.unix_micros("_quando") - ahead * 1000).alias("quando"), "_quando")
    return rows.groupBy("chave").applyInPandasWithState(run, "id bigint, chave string, admitida boolean, espera double", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
