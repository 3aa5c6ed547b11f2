"""Conversations as a stream: what each session still remembers, kept as state between runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MEMORY = "conv_id {id}, turn long, first_kept long, n_kept long, chars_kept long"


def remembered(kept: list[tuple[int, str, int]], limit: int) -> list[tuple[int, str, int]]:
    """The messages (turn, role, chars) left when the oldest are dropped, from one user message to the next, until they fit."""
    total = sum(m[2] for m in kept)
    while total > limit and kept:
        cut = next((i for i in range(1, len(kept)) if kept[i][1] == "user"), len(kept))
        total -= sum(m[2] for m in kept[:cut])
        kept = kept[cut:]
    return kept


class SessionMemory(StatefulProcessor):
    """Keeps for each conversation its last messages, at most `limit` characters of them; texts aren't kept."""

    def __init__(self, limit: int, idle_ms: int | None):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, not a list: it is fetched and stored by one call each
        self.kept = handle.getValueState("kept", "turns array<long>, roles array<string>, chars array<long>", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        # a trigger may bring a conversation's turns in any order
        new = sorted((r["turn"], r["role"], r["chars"]) for r in rows)
        had = self.kept.get()
        kept = list(zip(*had, strict=True)) if had else []
        for message in new:
            kept = remembered([*kept, message], self.limit)
            yield Row(conv_id=key[0], turn=message[0], first_kept=kept[0][0] if kept else None, n_kept=len(kept), chars_kept=sum(m[2] for m in kept))
        if kept:
            self.kept.update(tuple(list(x) for x in zip(*kept, strict=True)))
        elif had:
            self.kept.clear()

    def close(self) -> None:
        pass


def session_memory(turns: DataFrame, limit: int = 24_000, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, first_kept, n_kept, chars_kept) for every message of a stream of turns, once it has been said.

    Each conversation has its own state, as long as its messages' number fits `limit` characters, and loses it after
    idle_ms without a message.  System messages are no part of it; a null text has no characters.  Turns of a later
    trigger must follow those of earlier ones.  Needs the RocksDB state store (see rocksdb()).
    """
    own = turns.where("coalesce(role, '') <> 'system'").selectExpr("conv_id", "cast(turn as long) as turn", "coalesce(role, '') as role", "cast(coalesce(length(text), 0) as long) as chars")
    return own.groupBy("conv_id").transformWithState(
        statefulProcessor=SessionMemory(limit, idle_ms), outputStructType=MEMORY.format(id=own.schema["conv_id"].dataType.simpleString()), outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None"
    )


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """For streams started inside: state of transformWithState lives in RocksDB, with its changes in the checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
