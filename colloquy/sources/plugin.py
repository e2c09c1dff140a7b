"""A chunk collection as a data source of its own: ``spark.read.format("colloquy_chunks")``.

It stands for any store behind the same interface: chunks are written by tasks and count once the driver has committed
them; a reader plans one partition for each file and skips files by the filters that Spark hands over. A collection is
a folder of Parquet files and of numbered manifests. The manifest with the highest number names the files that count,
each with the range of its document ids. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from colloquy.sources.store import CHUNKS

FORMAT = "colloquy_chunks"
KEY = "doc_id"  # the column by which files are skipped
BATCH_ROWS = 4_096


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed over to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def manifest(path: str) -> tuple[int, list[dict]]:
    """Number and files of the manifest that counts; (0, []) for a collection that is not there."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    numbers = [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")]
    if not numbers:
        return 0, []
    with store.open_input_stream(f"{root}/manifests/{max(numbers)}.json") as file:
        return max(numbers), json.loads(file.read())


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ChunkWriter(self.options["path"], overwrite)


@dataclass
class FilePart(InputPartition):
    name: str


@dataclass
class Range:
    """Ids that filters leave: bounds, and a set if there is one."""

    low: float = float("-inf")
    high: float = float("inf")
    ids: set | None = None
    named: bool = False  # nulls are left out

    def narrow(self, f: Filter) -> bool:
        """Take a filter on the key; False for one that this store does not know."""
        if getattr(f, "attribute", None) != (KEY,):
            return False
        if isinstance(f, IsNotNull):
            self.named = True
        elif isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.ids = asked if self.ids is None else self.ids & asked
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value)
        else:
            return False
        return True

    @property
    def open(self) -> bool:
        return not self.named and self.ids is None and self.low == float("-inf") and self.high == float("inf")

    def may_hold(self, low, high) -> bool:
        """Whether a file of ids from ``low`` to ``high`` has one that is asked for; null bounds tell of nulls alone."""
        if self.open:
            return True
        if low is None or high < self.low or low > self.high:
            return False
        return self.ids is None or any(low <= i <= high for i in self.ids)

    def mask(self, column: pa.ChunkedArray):
        keep = pc.is_valid(column)
        if self.ids is not None:
            keep = pc.and_(keep, pc.is_in(column, value_set=pa.array(sorted(self.ids), column.type)))
        for bound, compare in ((self.low, pc.greater_equal), (self.high, pc.less_equal)):
            if bound not in (float("-inf"), float("inf")):
                keep = pc.and_(keep, pc.fill_null(compare(column, pa.scalar(int(bound), column.type)), False))
        return keep


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.asked = path, schema.names, Range()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the id are taken care of here; the others stay with Spark."""
        return [f for f in filters if not self.asked.narrow(f)]

    def partitions(self) -> list[FilePart]:
        wanted = [FilePart(f["name"]) for f in manifest(self.path)[1] if self.asked.may_hold(f["low"], f["high"])]
        return wanted or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as file:
            for batch in pq.ParquetFile(file).iter_batches(BATCH_ROWS, columns=self.names):
                rows = pa.Table.from_batches([batch])
                if not self.asked.open:
                    rows = rows.filter(self.asked.mask(rows.column(KEY)))
                yield from rows.select(self.names).to_batches()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for a task, under a name of its own, so that a task that is run again does no harm."""
        store, root = _store(self.path)
        store.create_dir(f"{root}/chunks", recursive=True)
        name, writer, low, high, rows = f"chunks/{uuid.uuid4().hex}.parquet", None, None, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = pq.ParquetWriter(store.open_output_stream(f"{root}/{name}"), batch.schema)
            writer.write_batch(batch)
            span, rows = pc.min_max(batch.column(KEY)).as_py(), rows + batch.num_rows
            if span["min"] is not None:
                low = span["min"] if low is None else min(low, span["min"])
                high = span["max"] if high is None else max(high, span["max"])
        if writer is None:
            return Written([])
        writer.close()
        return Written([{"name": name, "low": low, "high": high, "rows": rows}])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        number, files = manifest(self.path)
        files = ([] if self.overwrite else files) + [f for m in messages if m for f in m.files]
        store.create_dir(f"{root}/manifests", recursive=True)
        draft = f"{root}/manifests/{uuid.uuid4().hex}.draft"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(files).encode())
        store.move(draft, f"{root}/manifests/{number + 1}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Files of tasks that did end are removed; no manifest names them."""
        store, root = _store(self.path)
        for m in messages:
            for f in m.files if m else ():
                store.delete_file(f"{root}/{f['name']}")
