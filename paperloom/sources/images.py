"""A sink of files: rows (folder, name, data) become files, written by the executors, to any file system that pyarrow knows.

Each file is written under a name of its own and then moved to its place, so a file that can be seen is whole, and a task that is
run again writes the same files once more. What a task has written it notes in a list beside the files; the driver gets the lists'
names. When a write is given up, files that were not there before are taken away again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "paperloom_files"


def opened(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + folder.lstrip("/")
    return fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    listing: str
    files: int
    bytes: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.notes = f".sink-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        system, root = opened(self.folder)
        made: set[str] = set()
        fresh, files, size = [], 0, 0
        for batch in iterator:
            for folder, name, data in zip(batch.column("folder"), batch.column("name"), batch.column("data"), strict=True):
                if data.as_py() is None:
                    continue
                place = f"{root}/{folder.as_py()}"
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                target, part = f"{place}/{name.as_py()}", f"{place}/.{uuid.uuid4().hex}"
                there = system.get_file_info(target).type != fs.FileType.NotFound
                with system.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                system.move(part, target)
                if not there:
                    fresh.append(target)
                files, size = files + 1, size + data.as_buffer().size
        listing = f"{root}/{self.notes}/{uuid.uuid4().hex}.json"
        system.create_dir(listing.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(listing) as out:
            out.write(json.dumps(fresh).encode())
        return Written(listing, files, size)

    def _end(self) -> None:
        from pyarrow import fs

        system, root = opened(self.folder)
        if system.get_file_info(f"{root}/{self.notes}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.notes}")

    def commit(self, messages: list[Written | None]) -> None:
        self._end()

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.folder)
        for m in messages:
            if m is not None:
                with system.open_input_stream(m.listing) as f:
                    for target in json.loads(f.read()):
                        system.delete_file(target)
        self._end()


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["folder"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes (folder, name, data) as files folder/<folder>/<name>; existing ones are replaced, one by one. Null data makes no file."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select(F.col("folder").cast("string"), F.col("name").cast("string"), "data").write.format(FORMAT).mode("append").option("folder", folder).save()


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """sha16, name, data of the files folder/<sha16>/<name>, read by the executors; one that has gone has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for batch in batches:
            for sha16, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with system.open_input_stream(f"{root.rstrip('/')}/{sha16}/{name}") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([sha16]), pa.array([name]), pa.array([data], pa.binary())], names=["sha16", "name", "data"])

    return names.select("sha16", "name").mapInArrow(run, "sha16 string, name string, data binary")
