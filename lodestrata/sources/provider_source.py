"""Provider exports as a Spark data source: a batch reader, and a stream whose offset is each channel's cursor.

A client that pages through a provider puts each page down as `channel=<name>/until=<cursor>/`, JSON lines with an object an
item, until being the cursor that the provider gave with the page. Listing the pages tells the driver how far each
channel has come without reading any of them; Spark keeps the cursors in the stream's checkpoint, and a restarted stream goes on behind them.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .connectors import ENTITIES, PAGE_SIZE

SCHEMA = "channel string, entity string, external_id string, updated_at string, payload string"
#: Pages that a task reads at most, and rows of its batches.
PAGES, ROWS = 64, 4096


@dataclass
class Pages(InputPartition):
    """Some pages of a channel, as paths."""

    channel: str
    paths: tuple[str, ...]


class _Export:
    """Pages below a path in any store that Arrow's file systems reach."""

    def __init__(self, options: dict):
        self.path, self.provider, self.after = options["path"], options["provider"].upper(), options.get("after", "")
        self.channels = {c for c in options.get("channels", "").split(",") if c}
        self.fields = ENTITIES[self.provider]

    def _fs(self):
        from pyarrow import fs

        path = "file://" + self.path[5:] if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(path)

    def _named(self, store, base: str, key: str) -> list[tuple[str, str]]:
        from pyarrow import fs

        found = [x.path for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
        return sorted((unquote(posixpath.basename(p)[len(key) + 1 :]), p) for p in found if posixpath.basename(p).startswith(f"{key}="))

    def pages(self, start: dict | None = None, end: dict | None = None) -> dict[str, list[tuple[str, str]]]:
        """Channel -> (cursor, path) of its pages behind start's cursor and up to end's, in order."""
        store, base = self._fs()
        out = {}
        for channel, at in self._named(store, base, "channel"):
            if self.channels and channel not in self.channels:
                continue
            low = max((start or {}).get(channel, ""), self.after)
            high = None if end is None else end.get(channel, "")
            some = [(until, p) for until, p in self._named(store, at, "until") if until > low and (high is None or until <= high)]
            if some:
                out[channel] = some
        return out

    def parts(self, start: dict | None = None, end: dict | None = None) -> list[Pages]:
        """A long channel is cut into parts, so one that has a third of all items is read by many tasks."""
        return [Pages(c, tuple(p for _, p in some[k : k + PAGES])) for c, some in self.pages(start, end).items() for k in range(0, len(some), PAGES)]

    def rows(self, part: Pages) -> Iterator:
        """Items of known kinds with a cursor value above after, or of kinds without one; lines that are no objects are left out."""
        import pyarrow as pa
        from pyarrow import fs

        store, _ = self._fs()
        held: list[tuple] = []
        schema = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)

        for path in part.paths:
            files = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
            for name in sorted(files):
                with store.open_input_stream(name) as raw:
                    for line in raw.readall().decode("utf-8", "replace").split("\n"):
                        item = self.item(part.channel, line)
                        if item:
                            held.append(item)
                        if len(held) >= ROWS:
                            yield batch()
                            held = []
        if held:
            yield batch()

    def item(self, channel: str, line: str) -> tuple | None:
        try:
            o = json.loads(line)
        except ValueError:
            return None
        if not isinstance(o, dict) or o.get("entity") not in self.fields:
            return None
        field = self.fields[o["entity"]]
        text = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x)
        at = text(o.get(field)) or "" if field else ""
        if field and not at > self.after:
            return None
        return channel, o["entity"], text(next((o[k] for k in ("external_id", "id", "ts") if o.get(k) is not None), None)), at, line


class _Reader(DataSourceReader):
    def __init__(self, export: _Export):
        self.export = export

    def partitions(self) -> list[Pages]:
        return self.export.parts() or [Pages("", ())]

    def read(self, partition: Pages) -> Iterator:
        yield from self.export.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {channel: cursor}. Pages are never taken back, so the latest offset only grows."""

    def __init__(self, export: _Export):
        self.export = export

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {c: some[-1][0] for c, some in self.export.pages().items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.export.parts(start, end)

    def read(self, partition: Pages) -> Iterator:
        yield from self.export.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ProviderSource(DataSource):
    """format("provider"): options path, provider, after (a cursor that items have to be above), channels (names, with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Export(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Export(self.options))


def provider_pages(spark: SparkSession, path: str, provider: str, after: str = "", channels: tuple[str, ...] = (), stream: bool = False) -> DataFrame:
    """SCHEMA's columns of an export's items, in batch or as a stream."""
    spark.dataSource.register(ProviderSource)
    reader = (spark.readStream if stream else spark.read).format("provider").option("path", path).option("provider", provider).option("after", after)
    return (reader.option("channels", ",".join(channels)) if channels else reader).load()


def put_down(items: DataFrame, path: str, size: int = PAGE_SIZE) -> None:
    """An export of items (channel, updated_at, payload) as a client that pages by time leaves it.

    A page has size items and whatever shares the last one's time, so no item falls between two pages.
    """
    order = W.partitionBy("channel").orderBy("updated_at")
    page = F.floor((F.rank().over(order) - 1) / size)
    until = F.max("updated_at").over(W.partitionBy("channel", "page"))
    paged = items.withColumn("page", page).withColumn("until", until)
    paged.select("channel", "until", F.col("payload").alias("value")).write.mode("append").partitionBy("channel", "until").text(path)


def sync_items(spark: SparkSession, path: str, provider: str, to: str, checkpoint: str, after: str = "") -> StreamingQuery:
    """Take what an export has behind the cursors of the checkpoint into a table, each item once, also over restarts."""
    items = provider_pages(spark, path, provider, after, stream=True)
    return items.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def channel_folder(channel: str) -> str:
    """Name of a channel's folder."""
    return f"channel={quote(channel, safe='')}"
