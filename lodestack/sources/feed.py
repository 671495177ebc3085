"""The change feed as a streaming source: a folder of Parquet files of events, read by event id.

    spark.dataSource.register(ChangeFeed)
    spark.readStream.format("change-feed").option("path", folder).option("root", "/vol/root").load()

An offset is the feed's identity and an event id. So a query that is started again from its checkpoint goes on after the
last event of its last batch, and each event comes once. Where ids began anew (the newest id is less than the offset's)
or the feed has another identity, single events can't be trusted: one event asks for the whole root, and reading goes
on from the newest id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "event_id long, ts timestamp, path string, flags int"
FILE_ROWS = 100_000
ROOT_CHANGED = 0x20  # fixed value, as streaming.journal has it
_IDENTITY = "_identity.json"


def write_feed(events: DataFrame, folder: str, identity: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """Append events (event_id, ts, path, flags) to a feed, sorted by id; a given identity is stored beside them."""
    ordered = events.select("event_id", "ts", "path", "flags").repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.write.mode("append").option("maxRecordsPerFile", file_rows).parquet(folder)
    if identity is not None:
        jvm = events.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{_IDENTITY}")
        out = place.getFileSystem(events.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(json.dumps({"identity": identity}).encode()))
        out.close()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeFeed)


class ChangeFeed(DataSource):
    """Options: path, a folder that driver and executors share; root, the watched folder, for events that ask for all of it;
    start, the id after which a new query begins (-1: all events)."""

    @classmethod
    def name(cls) -> str:
        return "change-feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options["path"], self.options.get("root", "/"), int(self.options.get("start", "-1")))


class Part(InputPartition):
    """The events of one file with after < id <= to; without a file, the one that asks for the whole root."""

    def __init__(self, file: str | None, after: int, to: int):
        self.file, self.after, self.to = file, after, to


class FeedReader(DataSourceStreamReader):
    def __init__(self, path: str, root: str, start: int):
        self.path, self.root, self.start = path.rstrip("/"), root, start
        self.known: dict[str, tuple[int, int]] = {}

    def _open(self):
        from lodestack.runtime import arrow_store

        return arrow_store(self.path)

    def _look(self) -> tuple[str, int]:
        """The feed's identity and newest id. Files that are new since the last look have their footers read, no events."""
        from pyarrow import fs

        store, folder = self._open()
        identity, held = "", {}
        for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.base_name == _IDENTITY:
                with store.open_input_file(found.path) as f:
                    identity = json.loads(f.read())["identity"]
            elif found.base_name.endswith(".parquet") and found.base_name[0] not in "._":
                held[found.path] = self.known.get(found.path) or self._range(store, found.path)
        self.known = held
        return identity, max((last for _, last in held.values()), default=-1)

    @staticmethod
    def _range(store, file: str) -> tuple[int, int]:
        import pyarrow.parquet as pq

        with store.open_input_file(file) as f:
            footer = pq.read_metadata(f)
        column = [footer.schema.column(i).path for i in range(footer.num_columns)].index("event_id")
        ids = [footer.row_group(g).column(column).statistics for g in range(footer.num_row_groups)]
        return min((r.min for r in ids), default=0), max((r.max for r in ids), default=-1)

    def initialOffset(self) -> dict:
        return {"identity": self._look()[0], "id": self.start}

    def latestOffset(self) -> dict:
        identity, newest = self._look()
        return {"identity": identity, "id": newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not self.known:
            self._look()
        if start["identity"] != end["identity"] or end["id"] < start["id"]:
            return [Part(None, end["id"], end["id"])]
        return [Part(file, start["id"], end["id"]) for file, (first, last) in sorted(self.known.items()) if last > start["id"] and first <= end["id"]]

    def read(self, part: InputPartition) -> Iterator:
        import datetime

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if part.file is None:
            now = datetime.datetime.now(datetime.timezone.utc)
            yield pa.RecordBatch.from_pydict({"event_id": [part.to], "ts": pa.array([now], pa.timestamp("us", "UTC")), "path": [self.root], "flags": pa.array([ROOT_CHANGED], pa.int32())})
            return
        store, _ = self._open()
        with store.open_input_file(part.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["event_id", "ts", "path", "flags"]):
                ids = batch.column("event_id")
                own = batch.filter(pc.and_(pc.greater(ids, part.after), pc.less_equal(ids, part.to)))
                yield own.set_column(1, "ts", own.column("ts").cast(pa.timestamp("us", "UTC")))

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offset; the feed keeps its files."""
