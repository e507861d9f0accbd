"""State with timers: messages grouped into chunks as they come, limits counted from a key's first request, values that expire.

The streams need the RocksDB state store. Rows of a key are taken in order of their time within a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import trimmed
from ..functions.tokenize import PatternTokenizer, Tokenizer
from ..operators.chunking import MESSAGE_CHUNK, Conversation, Size

# fixed values: verification codes of an hour and its seconds; minutes that a signup waits
MOST, PERIOD, PENDING_MINUTES = 5, 3600, 15
WINDOWS = "key string, window_start timestamp, requests long, blocked long"
TAKEN = "key string, value string, found boolean"


def _millis(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).tolist()


class MessageGrouping(StatefulProcessor):
    """Keeps each source's open chunk. It is closed when the source has been silent for idle milliseconds of event time: by a timer, or by a
    message that comes later than that, whichever is seen first."""

    def __init__(self, size: Size, tok: Tokenizer, idle: int):
        self.size, self.tok, self.idle = size, tok, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "json string")

    def _loaded(self) -> tuple[Conversation, int, int | None]:
        """The open conversation, how many chunks were sent, and the time of the last message."""
        talk, sent, seen = Conversation(self.size, self.tok), 0, None
        if self.state.exists():
            talk.held, talk.meta, talk.last, sent, seen = json.loads(self.state.get()[0])
        return talk, sent, seen

    def _rows(self, source, chunks: list[dict], sent: int) -> pd.DataFrame:
        rows = [(source, sent + i, c["content"], c["context"], c["authors"], c["source_url"]) for i, c in enumerate(chunks)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE_CHUNK.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        talk, sent, seen = self._loaded()
        batch = pd.concat(list(rows)).sort_values("position", kind="stable")
        chunks = []
        for m, at in zip(batch.itertuples(index=False), _millis(batch["ts"])):
            if seen is not None and at > seen + self.idle:
                chunks += talk.end()
                talk = Conversation(self.size, self.tok)
            seen = at if seen is None else max(seen, at)
            chunks += talk.add(m.content, {"context": m.context, "authors": list(m.authors), "source_url": m.source_url, "merges": bool(m.merges)})
        self.state.update((json.dumps([talk.held, talk.meta, talk.last, sent + len(chunks), seen]),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(seen + self.idle)
        yield self._rows(key[0], chunks, sent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        talk, sent, seen = self._loaded()
        chunks = talk.end()
        self.state.update((json.dumps(["", None, None, sent + len(chunks), None]),))  # numbers go on
        yield self._rows(key[0], chunks, sent)

    def close(self) -> None:
        pass


def grouped_stream(messages: DataFrame, idle: str = "1 hour", delay: str = "5 minutes", size: Size = Size(), tok: Tokenizer | None = None) -> DataFrame:
    """chunking.group_messages() over a stream of messages that also have ts: a chunk is sent when the next one has begun, the last ones when a source falls silent."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)
    spoken = messages.where(trimmed(F.col("content")) != "").withColumn("data_source_id", F.col("data_source_id").cast("string"))
    at = spoken.select("data_source_id", "position", "content", "context", "authors", "source_url", "merges", "ts").withWatermark("ts", delay)
    return at.groupBy("data_source_id").transformWithStateInPandas(MessageGrouping(size, tok or PatternTokenizer(), millis), MESSAGE_CHUNK, "Append", "EventTime")


def first_hit_windows(requests: DataFrame, period: int = PERIOD, most: int = MOST, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, window_start, requests, blocked): a window begins with the first request after the one before has ended.

    Requests of one time are counted before they are sent; a key's times are sorted by Spark and walked with only the open window
    held. Requests without key or time don't count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, start, n = None, 0, 0
        row = lambda: (at, pd.Timestamp(start, unit="us"), n, max(0, n - most))
        for batch in batches:
            out = []
            for k, t, c in zip(batch["key"], batch["t"].tolist(), batch["n"].tolist()):
                if at is not None and k == at and t < start + period * 1_000_000:
                    n += c
                    continue
                if at is not None:
                    out.append(row())
                at, start, n = k, t, c
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])
        if at is not None:
            yield pd.DataFrame([row()], columns=[c.split()[0] for c in WINDOWS.split(", ")])

    each = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("key is not null and t is not null")
    counts = each.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))
    return counts.repartition("key").sortWithinPartitions("key", "t").mapInPandas(run, WINDOWS)


class FirstHit(StatefulProcessor):
    """A key's open window and its count, sent on when it has ended."""

    def __init__(self, period: int, most: int):
        self.period, self.most = period * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start long, n long")

    def _row(self, key, start: int, n: int) -> tuple:
        return key[0], pd.Timestamp(start, unit="ms"), n, max(0, n - self.most)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for t in sorted(_millis(pd.concat(list(rows))["ts"])):
            if start is not None and t < start + self.period:
                n += 1
                continue
            if start is not None:
                self.handle.deleteTimer(start + self.period)
                out.append(self._row(key, start, n))
            start, n = t, 1
            self.handle.registerTimer(start + self.period)
        self.state.update((start, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, n = self.state.get()
        self.state.clear()
        yield pd.DataFrame([self._row(key, start, n)], columns=[c.split()[0] for c in WINDOWS.split(", ")])

    def close(self) -> None:
        pass


def first_hit_stream(requests: DataFrame, period: int = PERIOD, most: int = MOST, delay: str = "5 minutes") -> DataFrame:
    """first_hit_windows() over a stream of (key, ts), to the millisecond; a window is sent when the watermark has passed its end."""
    at = requests.select(F.col("key").cast("string"), "ts").withWatermark("ts", delay)
    return at.groupBy("key").transformWithStateInPandas(FirstHit(period, most), WINDOWS, "Append", "EventTime")


class Pending(StatefulProcessor):
    """A value for each key that is gone after its time, or when it was taken."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", "value string", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.kind == "put":
                self.state.update((r.value,))
                continue
            found = self.state.exists()
            out.append((key[0], self.state.get()[0] if found else None, found))
            if found:
                self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TAKEN.split(", ")])

    def close(self) -> None:
        pass


def pending_stream(events: DataFrame, seconds: float = 60 * PENDING_MINUTES) -> DataFrame:
    """(key, value, found) for each take of a stream of (key, kind, value, seq): what was put last, if it was in time and isn't taken yet."""
    at = events.select(F.col("key").cast("string"), "kind", "value", "seq")
    return at.groupBy("key").transformWithStateInPandas(Pending(round(seconds * 1000)), TAKEN, "Append", "ProcessingTime")
