"""A workbook as a sink: tasks write parts of its sheet, the commit joins them.

`spark.dataSource.register(WorkbookSink)`, then `df.write.format("tally_workbook").mode("overwrite").save(path)`
for a path that the driver and all executors reach. Rows keep the order of the
frame's partitions, so a sorted frame makes a sorted sheet. No row passes the
driver: it copies the parts' bytes, a block at a time, into the file that is
renamed to its name at the very end. A job that fails leaves no workbook.

Options: `sheet` is the sheet's name; `status` a column whose value `matched`
marks clean rows, all others flagged ones; `before` a JSON list of sheets
[name, [[values, style], ...]] that go first, such as a summary.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .sheets import row_xml, write_workbook

BLOCK = 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.sheet, self.status, self.before = options.get("sheet", "Detail"), options.get("status"), json.loads(options.get("before", "[]"))
        self.titles = json.loads(options["titles"]) if "titles" in options else columns
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = _place(self.parts)
        store.create_dir(folder, recursive=True)
        name, n = f"{folder}/{task.partitionId():08}-{task.taskAttemptId()}", 0
        with store.open_output_stream(name) as out:
            packed = zlib.compressobj()
            for batch in iterator:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    style = 0 if self.status is None else 2 if values[self.columns.index(self.status)] == "matched" else 3
                    out.write(packed.compress(row_xml(values, style).encode()))
                    n += 1
            out.write(packed.flush())
        return Part(task.partitionId(), name, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, path = _place(self.path)
        if not self.overwrite and store.get_file_info(path).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)

        def bodies() -> Iterator[str]:
            yield row_xml(self.titles, 1)
            for part in done:
                unpacked = zlib.decompressobj()
                with store.open_input_stream(part.path) as f:
                    rest = b""
                    while block := f.read(BLOCK):
                        rest += unpacked.decompress(block)
                        cut = rest.rfind(b"</row>") + 6 if b"</row>" in rest else 0
                        yield rest[:cut].decode()
                        rest = rest[cut:]
                    yield (rest + unpacked.flush()).decode()

        half = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(half) as out:
            write_workbook(out, {name: [(v, s) for v, s in rows] for name, rows in self.before} | {self.sheet: bodies()})
        store.move(half, path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = _place(self.parts)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_workbook"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.names, overwrite)
