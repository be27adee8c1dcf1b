"""Structured Streaming: de-duplication across turns with state, and micro-batches of the engine.

The state of a conversation and the hash of a long text is the turn that it was first seen in, so a long conversation, or one with very many turns, is
spread over tasks; short texts have no state.  An entry is
never changed once written, so what was emitted for a turn stays as it is when turns are
replayed; a copy that arrives late from an earlier turn does not change later ones.  With ``ttl_seconds`` an entry goes that long after it
was made; a copy that comes later still is a first turn again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gistmill import schema as S
from gistmill.functions import bodies as B

OUTPUT = "conv_id long, turn long, text string, deduped string, first_turn long"


class FirstTurns(StatefulProcessor):
    """Keeps the first turn of a long text of a conversation."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "turn long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        turns: list[int] = []  # the text of a key is one, so only turns are held
        text = None
        for frame in rows:
            turns += [int(t) for t in frame["turn"]]
            text = frame["text"].iloc[0] if len(frame) else text
        if self.first.exists():
            first = self.first.get()[0]
        else:
            first = min(turns)
            self.first.update((first,))
        marker = B.repeat_marker(first, text, S.TAG)
        for at in range(0, len(turns), 1024):
            part = turns[at : at + 1024]
            yield pd.DataFrame({"conv_id": key[0], "turn": part, "text": text, "deduped": [marker if t > first else text for t in part], "first_turn": [min(first, t) if t <= first else first for t in part]})

    def close(self) -> None:
        pass


def dedup_stream(turns: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """R1 over a stream of (conv_id, turn, text): each turn once, in append mode.  The session's state store must be RocksDB.

    With ``ttl_seconds`` the stream follows the clock, so it does not end by itself when all is read (trigger ``once`` does).
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    long = F.coalesce(F.octet_length("text") >= S.DEDUP_FLOOR, F.lit(False))
    short = rows.filter(~long).select("conv_id", "turn", "text", F.col("text").alias("deduped"), F.col("turn").alias("first_turn"))
    keyed = rows.filter(long).withColumn("sha", F.sha2("text", 256)).groupBy("conv_id", "sha")
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)
    found = keyed.transformWithStateInPandas(statefulProcessor=FirstTurns(ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="None" if ttl is None else "ProcessingTime")
    return found.unionByName(short)


def distil_stream(requests: DataFrame, engine, sink: str, checkpoint: str):
    """A stream of (request_id, body) through the engine into Parquet, exactly once."""
    return engine.apply(requests).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
