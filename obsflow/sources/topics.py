"""Ordered topics as files: a batch source and sink and a stream source with offsets, as Spark data sources.

A topic is a folder with a folder for each partition and a Parquet file for each
segment, whose name tells its first offset, its number of records and the batch
that wrote it. Offsets of a partition have no gap. A key always lies in one
partition, so its records keep their order. One query writes to a topic; any
number may read it, each under a ``group`` of its own.

``spark.dataSource.register(TopicSource)`` makes the format ``obsflow-topic`` known.
Options: ``path`` (shared by the whole cluster, read and written through pyarrow's
file systems); ``batch`` (when writing: the micro-batch's id; a repeated batch
leaves what is there); ``ordered`` (when writing: the order of tasks is that of a
partition's records, as :func:`topic_rows` lays them out); ``group``, ``limit`` (records of a partition that a
micro-batch takes, 0 for all) and ``startingOffsets`` (``earliest``, or
``committed`` to go on where the group's last query had ended) when a stream reads.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

_SEGMENT = re.compile(r"(\d{20})-(\d+)-b(-?\d+)\.parquet")
_RECORD = pa.schema([("key", pa.string()), ("value", pa.string())])
#: Rows of a written row group, and of a batch that is read.
ROWS = 4096
#: Records that a task sorts for writing, and offsets that a task reads.
DEALT = 100_000


@dataclass(frozen=True)
class Segment:
    path: str
    first: int
    count: int
    batch: int

    @property
    def end(self) -> int:
        return self.first + self.count


@dataclass
class Slice(InputPartition):
    """Offsets ``start`` to ``end`` (exclusive) of a partition, with the segments that hold them."""

    partition: int
    start: int
    end: int
    segments: list[Segment]


class Topic:
    """The files of a topic."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path)

    def _list(self, path: str) -> list[pafs.FileInfo]:
        return self.fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))

    def segments(self) -> dict[int, list[Segment]]:
        """Segments of each partition, in order, up to the first gap.

        A batch's segments are moved into place from the last to the first, so they count all at once.
        """
        return {p: _gapless(held) for p, held in self.files().items()}

    def files(self) -> dict[int, list[Segment]]:
        """Segments of each partition, in order, also those of a batch that was cut short."""
        found = {}
        for folder in self._list(self.root):
            if not folder.base_name.startswith("partition="):
                continue
            told = [(f.path, _SEGMENT.fullmatch(f.base_name)) for f in self._list(folder.path)]
            found[int(folder.base_name[10:])] = sorted((Segment(p, *map(int, m.groups())) for p, m in told if m), key=lambda s: s.first)
        return found

    def load(self, name: str) -> dict[int, int] | None:
        """Offsets by partition that were kept under a name."""
        path = f"{self.root}/groups/{name}.json"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return {int(p): o for p, o in json.loads(f.read()).items()}

    def keep(self, name: str, offsets: dict[int, int]) -> None:
        """Replace a name's offsets in one step."""
        self.fs.create_dir(f"{self.root}/groups")
        fresh = f"{self.root}/groups/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(fresh) as f:
            f.write(json.dumps(offsets).encode())
        self.fs.move(fresh, f"{self.root}/groups/{name}.json")

    def slices(self, start: dict[int, int], end: dict[int, int]) -> list[Slice]:
        out = []
        for p, held in sorted(self.segments().items()):
            lo, hi = start.get(p, 0), end.get(p, 0)
            inside = [s for s in held if s.end > lo and s.first < hi]
            if lo < hi:
                at = lo
                for s in inside:
                    if s.first > at:
                        break
                    at = s.end
                if at < hi:
                    raise ValueError(f"partition {p} lacks offset {at}")
                for a in range(lo, hi, DEALT):
                    b = min(a + DEALT, hi)
                    out.append(Slice(p, a, b, [s for s in inside if s.end > a and s.first < b]))
        return out

    def records(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """The slice's records in order, a bounded batch at a time."""
        for segment in part.segments:
            at = segment.first
            with self.fs.open_input_file(segment.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(ROWS):
                    lo, hi = max(part.start - at, 0), min(part.end - at, batch.num_rows)
                    if lo < hi:
                        n, held = hi - lo, batch.slice(lo, hi - lo)
                        yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array([part.partition] * n, pa.int32()), pa.array(range(at + lo, at + hi), pa.int64())], ["key", "value", "partition", "offset"])
                    at += batch.num_rows


def _gapless(held: list[Segment]) -> list[Segment]:
    end, out = 0, []
    for s in held:
        if s.first != end:
            break
        out.append(s)
        end = s.end
    return out


class TopicReader(DataSourceReader):
    """A whole topic, in tasks of DEALT offsets."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Slice]:
        topic = Topic(self.path)
        return topic.slices({}, {p: held[-1].end for p, held in topic.segments().items() if held}) or [Slice(0, 0, 0, [])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return Topic(self.path).records(partition)


class TopicStream(DataSourceStreamReader):
    """A topic from offset to offset.

    What a micro-batch may reach is kept before Spark is told, so a restarted
    query's next offset never lies before its last. ``commit`` gets a finished
    batch's end, so what it keeps is the finished prefix of each partition.
    """

    def __init__(self, options: dict):
        self.path, self.group, self.limit = options["path"], options.get("group", "default"), int(options.get("limit", 0))
        self.earliest = options.get("startingOffsets", "earliest") != "committed"
        self.topic = Topic(self.path)

    def initialOffset(self) -> dict:
        # Asked for when a query is new: what an earlier query of the group promised doesn't bind it.
        begin = {} if self.earliest else self.topic.load(f"{self.group}-done") or {}
        self.topic.keep(f"{self.group}-reach", begin)
        return _told(begin)

    def latestOffset(self) -> dict:
        reach = self.topic.load(f"{self.group}-reach") or {}
        for p, held in self.topic.segments().items():
            end, at = held[-1].end if held else 0, reach.get(p, 0)
            reach[p] = max(at, min(end, at + self.limit) if self.limit else end)
        self.topic.keep(f"{self.group}-reach", reach)
        return _told(reach)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.topic.slices(_offsets(start), _offsets(end))

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return Topic(self.path).records(partition)

    def commit(self, end: dict) -> None:
        self.topic.keep(f"{self.group}-done", _offsets(end))


def _told(offsets: dict[int, int]) -> dict:
    return {str(p): o for p, o in sorted(offsets.items())}


def _offsets(told: dict) -> dict[int, int]:
    return {int(p): int(o) for p, o in told.items()}


@dataclass
class Written(WriterCommitMessage):
    """Staged files of a task: partition, path, records."""

    files: list[tuple[int, str, int]]


class TopicWriter(DataSourceArrowWriter):
    """Tasks stage a file for each of their partitions; the driver gives offsets and moves the files into place."""

    def __init__(self, options: dict):
        self.path, self.batch, self.ordered = options["path"], int(options.get("batch", -1)), options.get("ordered", "false") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        topic, files = Topic(self.path), {}
        topic.fs.create_dir(f"{topic.root}/staged")
        for rows in iterator:
            table = pa.Table.from_batches([rows])
            for p in table.column("partition").unique().to_pylist():
                mine = table.filter(pa.compute.equal(table.column("partition"), p)).select(["key", "value"]).cast(_RECORD)
                if p not in files:
                    path = f"{topic.root}/staged/{uuid.uuid4().hex}.parquet"
                    files[p] = [path, pq.ParquetWriter(path, _RECORD, filesystem=topic.fs), 0]
                files[p][1].write_table(mine, row_group_size=ROWS)
                files[p][2] += mine.num_rows
        for _, out, _ in files.values():
            out.close()
        return Written([(p, path, n) for p, (path, _, n) in files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        topic, held = Topic(self.path), Topic(self.path).segments()
        # Messages come in the order of the tasks.
        files = [f for m in messages if m for f in m.files]
        if not self.ordered and len({p for p, _, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("records of a partition come from several tasks; use topic_rows and write_topic")
        for p in {p for p, _, _ in files}:
            before, mine = held.get(p, []), [(path, n) for q, path, n in files if q == p]
            if self.batch >= 0 and any(s.batch == self.batch for s in before):
                for path, _ in mine:
                    topic.fs.delete_file(path)
                continue
            topic.fs.create_dir(f"{topic.root}/partition={p}")
            at = before[-1].end if before else 0
            for s in topic.files().get(p, []):
                if s.first >= at:  # left by a batch that was cut short
                    topic.fs.delete_file(s.path)
            placed = []
            for path, n in mine:
                placed.append((path, f"{topic.root}/partition={p}/{at:020d}-{n}-b{self.batch}.parquet"))
                at += n
            for path, place in reversed(placed):
                topic.fs.move(path, place)

    def abort(self, messages: list[Written | None]) -> None:
        topic = Topic(self.path)
        for _, path, _ in (f for m in messages if m for f in m.files):
            topic.fs.delete_file(path)


class TopicSource(DataSource):
    """The data source ``obsflow-topic``."""

    @classmethod
    def name(cls) -> str:
        return "obsflow-topic"

    def schema(self) -> str:
        return "key string, value string, partition int, offset long"

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> TopicStream:
        return TopicStream(self.options)

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options)


def topic_rows(rows: DataFrame, partitions: int, order: list[str]) -> DataFrame:
    """(key, value) rows laid out for writing: a key in one partition, and partitions one after the other, in order, over tasks of DEALT records."""
    placed = rows.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    n = max(1, math.ceil(rows.count() / DEALT))
    return placed.repartitionByRange(n, "partition", *order).sortWithinPartitions("partition", *order).select("key", "value", "partition")


def write_topic(rows: DataFrame, path: str, batch_id: int = -1, partitions: int = 8, order: tuple[str, ...] = ("event_time", "event_id")) -> None:
    """Append (key, value) rows in order; with a ``batch_id`` each batch once."""
    rows.sparkSession.dataSource.register(TopicSource)
    topic_rows(rows, partitions, list(order)).write.format(TopicSource.name()).mode("append").option("path", path).option("batch", batch_id).option("ordered", "true").save()


def read_topic(spark, path: str) -> DataFrame:
    spark.dataSource.register(TopicSource)
    return spark.read.format(TopicSource.name()).option("path", path).load()


def stream_topic(spark, path: str, group: str = "default", limit: int = 0, start: str = "earliest") -> DataFrame:
    """The topic as a stream of (key, value, partition, offset)."""
    spark.dataSource.register(TopicSource)
    return spark.readStream.format(TopicSource.name()).option("path", path).option("group", group).option("limit", limit).option("startingOffsets", start).load()
