"""Folders of text files as a table that Spark reads in partitions and writes with a commit.

    spark.dataSource.register(TextFiles)
    spark.read.format("glyphward_texts").option("suffix", ".md").load("hdfs://.../notes")
    rows.write.format("glyphward_texts").mode("append").save(folder)      # columns path, and text or content

Any store that Arrow opens by its URI will do. Reading turns CR and CRLF into newlines and bytes that
are no UTF-8 into U+FFFD. Writing puts a file for each row into a hidden folder of the job; files
move to their places only after all tasks have ended, so a lost executor or a failed job leaves
nothing half done, and a task that runs twice leaves one file. A folder that one task alone has written
moves as a whole where the store can do that, so rows dealt by their folders are committed in as many
moves as there are folders. The driver looks at one folder's names at a time.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

TASK_BYTES = 32 << 20
BATCH_FILES, BATCH_BYTES = 1_000, 4 << 20  # of files that a reader hands over together
STAGING = "_staging-"
FOLDERS_MOVE = ("local", "hdfs")  # stores where a folder moves in one step


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What lies in a folder, by name; nothing if there is none."""
    return sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name)


@dataclass
class Files(InputPartition):
    """The files of a task: folders below the base, and of each its names, with slashes between them."""

    runs: tuple[tuple[str, str], ...]


@dataclass
class Written(WriterCommitMessage):
    """Where a task has staged its files, under their final names, and a path that it had twice."""

    folder: str
    twice: str | None


class TextReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        """Files folder by folder, in the order of their names, in runs of ``taskBytes``; hidden ones, and those without the suffix, are passed over."""
        system, base = _opened(self.uri)
        out: list[list[tuple[str, str]]] = []
        held = 0
        folders = [""]
        while folders:
            folder = folders.pop()
            found = [f for f in _listed(system, posixpath.join(base, folder)) if f.base_name[:1] not in "._"]
            names: list[str] = []
            for f in found:
                if not f.is_file or not f.base_name.endswith(self.suffix):
                    continue
                if not out or held + f.size > self.size:
                    if names:
                        out[-1].append((folder, "/".join(names)))
                    names, held = [], 0
                    out.append([])
                names.append(f.base_name)
                held += f.size
            if names:
                out[-1].append((folder, "/".join(names)))
            folders += [posixpath.join(folder, f.base_name) for f in reversed(found) if f.type == fs.FileType.Directory]
        return [Files(tuple(x)) for x in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, base = _opened(self.uri)
        paths: list[str] = []
        texts: list[str] = []
        size = 0
        for folder, names in partition.runs if partition else ():
            for path in (posixpath.join(folder, n) for n in names.split("/")):
                with system.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                if paths and (len(paths) == BATCH_FILES or size + len(data) > BATCH_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], names=["path", "text"])
                    paths, texts, size = [], [], 0
                paths.append(path)
                texts.append(data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
                size += len(data)
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], names=["path", "text"])


class TextWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = options["path"], overwrite, f"{STAGING}{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Stage the rows of a task; what a task that fails has staged goes at once."""
        system, base = _opened(self.uri)
        own, twice = f"{base}/{self.job}/{uuid.uuid4().hex}", None
        made: set[str] = set()
        places: set[str] = set()
        try:
            for b in batches:
                held = "content" if "content" in b.schema.names else "text"
                for name, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", held)), strict=True):
                    place = posixpath.normpath(name or "")
                    if not name or place.startswith(("/", "..")) or place == ".":
                        raise ValueError(f"{name!r} is no path below the folder")
                    if place in places:
                        twice = place
                        continue
                    places.add(place)
                    at = f"{own}/{place}"
                    if (folder := posixpath.dirname(at)) not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    with system.open_output_stream(at) as f:
                        f.write(data if isinstance(data, bytes) else (data or "").encode())
        except BaseException:
            if made:
                system.delete_dir(own)
            raise
        return Written(own if made else "", twice)

    def commit(self, messages: list[Written | None]) -> None:
        """All files go to their places; two rows of one path are an error, as is a path that is there unless it is to be overwritten."""
        system, base = _opened(self.uri)
        staged = [w.folder for w in messages if w and w.folder]
        try:
            for w in messages:
                if w and w.twice:
                    raise FileExistsError(f"several rows have one path: {w.twice}")
            for _ in self._moves(system, staged, base):  # before anything moves
                pass
        except BaseException:
            self.abort(messages)
            raise
        system.create_dir(base, recursive=True)
        made = base
        for at, place in self._moves(system, staged, base):
            if (folder := posixpath.dirname(place)) != made:
                system.create_dir(folder, recursive=True)
                made = folder
            system.move(at, place)
        self._clear()

    def _moves(self, system: fs.FileSystem, sources: list[str], target: str) -> Iterator[tuple[str, str]]:
        """From where to where what lies in ``sources`` moves, to be below ``target``: folders as a whole if no other source and nothing in ``target`` has their name."""
        there = {f.base_name: f.type for f in _listed(system, target)} if sources else {}
        found = defaultdict(list)
        for source in sources:
            for f in _listed(system, source):
                found[f.base_name].append(f)
        for name, same in found.items():
            place, folders = f"{target}/{name}", [f.path for f in same if f.type == fs.FileType.Directory]
            if folders:
                clash = len(folders) < len(same) or there.get(name) == fs.FileType.File
            else:
                clash = len(same) > 1 or name in there and (not self.overwrite or there[name] == fs.FileType.Directory)
            if clash:
                raise FileExistsError(f"several rows have one path, or it is there: {place}")
            if folders and (len(same) > 1 or name in there or system.type_name not in FOLDERS_MOVE):
                yield from self._moves(system, folders, place)
            else:
                yield same[0].path, place

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = _opened(self.uri)
        if system.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.job}")


class TextFiles(DataSource):
    """Format glyphward_texts: path (below the folder) and text of each file."""

    @classmethod
    def name(cls) -> str:
        return "glyphward_texts"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: StructType) -> TextReader:
        return TextReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TextWriter:
        return TextWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TextFiles)


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder: what lies in it by tasks, as stores without a step for whole trees take time for each file."""

    def cleared(path: str) -> None:
        system = _opened(uri)[0]
        if system.get_file_info(path).type == fs.FileType.Directory:  # gone if the task runs again
            system.delete_dir(path)

    system, base = _opened(uri)
    inner = [f.path for f in _listed(system, base) if f.type == fs.FileType.Directory]
    if inner:
        spark.sparkContext.parallelize(inner, min(len(inner), 1_000)).foreach(cleared)
    system.delete_dir(base)
