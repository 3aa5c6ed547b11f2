"""Session state over restarts."""

import pytest
from pyspark.sql import Row

from textloom.session import fresh_path
from textloom.streaming.sessions import SessionMemory, remembered, rocksdb, session_memory


@pytest.mark.parametrize(
    ("kept", "limit", "want"),
    [
        ([(0, "user", 5), (1, "assistant", 5)], 10, [0, 1]), ([(0, "user", 5), (1, "assistant", 6)], 10, []), ([(0, "user", 5), (1, "assistant", 6), (2, "user", 3)], 10, [2]),
        ([(0, "assistant", 5), (1, "assistant", 6), (2, "user", 3), (3, "user", 1)], 3, [3]), ([(0, "user", 20)], 10, []), ([], 10, []),
    ],
)
def test_oldest_turns_go(kept, limit, want):
    assert [m[0] for m in remembered(kept, limit)] == want


def test_restarts_and_separate_conversations(spark):
    """Three runs find what earlier ones kept; conversations don't see each other; a run without input says nothing."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * (3 + (t * 7 + len(c)) % 9)) for c in ("a", "bb", "ccc") for t in range(9)] + [("a", 100, "system", "y" * 100), ("bb", 200, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    at = fresh_path(spark, "sessions")
    for where in ("turn < 3", "turn between 3 and 5", "turn > 5", "false"):
        df.where(where).write.mode("append").parquet(f"{at}/in")
        stream = session_memory(spark.readStream.schema(df.schema).parquet(f"{at}/in"), 30)
        with rocksdb(spark):
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    want = []
    for conv in ("a", "bb", "ccc"):
        kept = []
        for c, t, role, text in sorted(rows, key=lambda r: r[1]):
            if c == conv and role != "system":
                kept = remembered([*kept, (t, role or "", len(text or ""))], 30)
                want.append((c, t, kept[0][0] if kept else None, len(kept), sum(m[2] for m in kept)))
    assert sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{at}/out").collect()) == sorted(want)
    assert any(n < 9 for *_, n, _ in want)


def test_a_trigger_fetches_and_stores_a_conversation_once():
    """Every call on the state is a message to the JVM and back."""
    calls, store = [], {}

    class State:
        def get(self):
            calls.append("get")
            return store.get("kept")

        def update(self, value):
            calls.append("update")
            store["kept"] = value

        def clear(self):
            calls.append("clear")
            store.clear()

    class Handle:
        def getValueState(self, name, schema, ttl):  # noqa: N802
            return State()

    memory = SessionMemory(10, None)
    memory.init(Handle())
    said = lambda *turns: [tuple(r) for r in memory.handleInputRows((7,), iter([Row(turn=t, role=r, chars=n) for t, r, n in turns]), None)]
    assert said((1, "assistant", 3), (0, "user", 5)) == [(7, 0, 0, 1, 5), (7, 1, 0, 2, 8)]
    assert said((2, "user", 4)) == [(7, 2, 2, 1, 4)]
    assert said((3, "user", 20)) == [(7, 3, None, 0, 0)] and not store
    assert said((4, "user", 20)) == [(7, 4, None, 0, 0)]
    assert calls == ["get", "update", "get", "update", "get", "clear", "get"]
