"""Streams with keyed state and timers: retries that come due by themselves, and the memory of sessions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETRY_ROWS = "paper_id long, attempts int, due timestamp"
MESSAGE = "id long, role string, content string"
MEMORY_ROWS = "session_id long, messages long, newest long"


def keep_state(spark: SparkSession) -> None:
    """The store that keyed state with timers and lists needs; the setting counts for streams that start later."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Retries(StatefulProcessor):
    """One paper's failures: a timer goes off when its next retry is due.

    State: failures since the last success, when the retry is due (0: it has gone out) and when the last result came,
    all in milliseconds. A success forgets it, as does a month without a result of a retry that went out.
    """

    def __init__(self, base: int = 600, most: int = 86400, forget: int = 30 * 86400):
        self.base, self.most, self.forget = base, most, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retry", "attempts int, due long, last long")

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, due, last = self.state.get() if self.state.exists() else (0, 0, None)
        fired = []
        for row in pd.concat(list(rows)).sort_values(["at", "result_id"]).itertuples():
            at = row.at.value // 1_000_000
            if last is not None and at < last:
                continue
            if due and due <= at:  # it went out before this result came
                fired.append((key[0], attempts, due))
            if attempts and at >= max(due, last or 0) + self.forget * 1000:
                attempts = 0
            attempts = 0 if row.ok else attempts + 1
            due, last = 0 if row.ok else at + 1000 * min(self.base * 2 ** min(attempts, 5), self.most), at
        if attempts:
            self.state.update((attempts, due, last))
            self._timer(due)
        elif self.state.exists():
            self.state.clear()
            self._timer(None)
        yield retry_rows(fired)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, due, last = self.state.get() if self.state.exists() else (0, 0, 0)
        if due:
            self.state.update((attempts, 0, last))
            self.handle.registerTimer(due + self.forget * 1000)
            yield retry_rows([(key[0], attempts, due)])
        else:
            self.state.clear()
            yield retry_rows([])

    def close(self) -> None:
        pass


def retry_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["paper_id", "attempts", "due"])
    return out.assign(paper_id=out.paper_id.astype("int64"), attempts=out.attempts.astype("int32"), due=pd.to_datetime(out.due.astype("int64"), unit="ms"))


def due_retries(results: DataFrame, late: str = "10 minutes", base: int = 600, most: int = 86400) -> DataFrame:
    """``(paper_id, attempts, due)``: a row whenever a paper's retry falls due, from ``(paper_id, result_id, at, ok)``.

    A failure asks for a retry after ``base`` seconds doubled with each failure since the last success, five times and to
    ``most`` at most; the retry goes out once the stream's time is past that, unless another result came first. ``at`` is the stream's
    time: results later than ``late`` are left out, as are those older than the paper's last one; of results at one time
    the order of ``result_id`` counts. Rows without a paper or a time are left out, a null ``ok`` is a failure.
    """
    keep_state(results.sparkSession)
    rows = results.where("paper_id IS NOT NULL AND at IS NOT NULL").select("paper_id", "result_id", F.col("at").cast("timestamp").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.withWatermark("at", late).groupBy("paper_id").transformWithStateInPandas(Retries(base, most), RETRY_ROWS, "Append", "EventTime")


class Memory(StatefulProcessor):
    """One session's last messages, in the order of their ids."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", MESSAGE)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {m[0]: m for m in self.messages.get()} if self.messages.exists() else {}
        seen = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            for row in frame.itertuples():
                seen += row.id not in held
                held.setdefault(row.id, (row.id, row.role, row.content))
            held = dict(sorted(held.items())[-self.most :])
        self.messages.put(list(held.values()))
        self.count.update((seen,))
        yield pd.DataFrame({"session_id": [key[0]], "messages": [seen], "newest": [max(held)]})

    def close(self) -> None:
        pass


def remember(messages: DataFrame, turns: int = 6) -> DataFrame:
    """``(session_id, messages, newest)`` after each batch of ``(session_id, id, role, content)``; the messages are state.

    A session holds its last messages by id, twice ``turns``. A message that comes late takes its place among them, or
    none where all are newer; one that is held already changes nothing. Rows without a session or an id are left out.
    ``memory`` reads what is held.
    """
    keep_state(messages.sparkSession)
    rows = messages.where("session_id IS NOT NULL AND id IS NOT NULL").select("session_id", "id", "role", "content")
    return rows.groupBy("session_id").transformWithStateInPandas(Memory(max(2, 2 * turns)), MEMORY_ROWS, "Update", "None")


def memory(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(session_id, id, role, content)``: what the sessions of a stopped or running stream hold, from its checkpoint."""
    keep_state(spark)
    held = spark.read.format("statestore").option("stateVarName", "messages").load(checkpoint)
    return held.select(F.col("key.session_id").alias("session_id"), "list_element.id", "list_element.role", "list_element.content")


def run_once(stream: DataFrame, checkpoint: str, step=None, mode: str = "append") -> None:
    """Run a stream over what is there now; ``step(batch, number)`` takes its rows, which are dropped without one."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.format("noop") if step is None else writer.foreachBatch(step)).start().awaitTermination()
