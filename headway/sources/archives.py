"""A data source of dumps in folders and tar archives: `spark.read.format("dumps")`, also as a stream.

Planning reads the folder and the headers of plain tar archives, an entry of some hundred bytes a dump; the dumps
themselves are read by tasks of about PART_BYTES, which seek to their members, so an archive of any size is read by many
tasks and none holds more than one dump. A compressed archive can't be entered in the middle: it is one task, which
unpacks member by member. Paths are local (a mount that all executors have) or those of a file system that Arrow knows.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of dumps that a task reads, about.
PART_BYTES = 64 << 20
_PLAIN, _PACKED = re.compile(r"\.tar$"), re.compile(r"\.(tar\.gz|tgz)$")


class OutOfOrder(ValueError):
    """An archive's members don't follow each other in time, or a file came behind what a stream has read."""


@dataclass(frozen=True)
class Entry:
    """A dump: the file, the member's name in it ('' for a loose file), where its bytes are, and how many. A compressed archive is one entry, from member `start` to `end`, with the size -1."""

    file: str
    member: str
    start: int
    size: int
    end: int = 0


class Part(InputPartition):
    def __init__(self, entries: list[Entry]):
        super().__init__(entries)
        self.entries = entries


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if local := re.match(r"file:/+", path):
        return fs.LocalFileSystem(), "/" + path[local.end() :]
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


class Guard:
    """Names of a folder must not fall, if order matters."""

    def __init__(self, file: str, ordered: bool):
        self.file, self.ordered, self.last = file, ordered, {}

    def see(self, member: str) -> None:
        folder, _, name = member.rpartition("/")
        if self.ordered and name < self.last.get(folder, ""):
            raise OutOfOrder(f"{self.file}: {member} comes after {self.last[folder]}")
        self.last[folder] = name


class Dumps:
    """What is below a path."""

    def __init__(self, path: str, ordered: bool):
        self.root, self.ordered = path, ordered
        self.fs, self.path = opened(path)

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of dumps and archives, in the order of their paths."""
        found = self.fs.get_file_info(self.path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        infos = [found] if found.is_file else self.fs.get_file_info(fs.FileSelector(self.path, recursive=True))
        return sorted((i.path, i.size) for i in infos if i.is_file and (i.path.endswith(".pb") or _PLAIN.search(i.path) or _PACKED.search(i.path)))

    def entries(self, file: str, size: int) -> list[Entry]:
        if _PACKED.search(file):
            return [Entry(file, "", 0, -1, 1 << 62)]
        if not _PLAIN.search(file):
            return [Entry(file, "", 0, size)]
        out, guard = [], Guard(file, self.ordered)
        with self.fs.open_input_file(file) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(".pb"):
                    guard.see(m.name)
                    out.append(Entry(file, m.name, m.offset_data, m.size))
        return out

    def members(self, file: str, size: int) -> int:
        """How many dumps a file has so far; a compressed archive has to be read for that."""
        if not _PACKED.search(file):
            return len(self.entries(file, size))
        return sum(1 for _ in _unpacked(self.fs, Entry(file, "", 0, -1, 1 << 62), False))


def _unpacked(files: fs.FileSystem, entry: Entry, ordered: bool) -> Iterator[tuple[tarfile.TarInfo, tarfile.TarFile]]:
    guard, k = Guard(entry.file, ordered), 0
    with files.open_input_stream(entry.file, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
        for m in tar:
            if m.isfile() and m.name.endswith(".pb"):
                guard.see(m.name)
                if entry.start <= k < entry.end:
                    yield m, tar
                k += 1


def parts(entries: Iterable[Entry]) -> list[Part]:
    """The entries in runs of about PART_BYTES; a compressed archive is alone."""
    out, run, held = [], [], 0
    for e in entries:
        if run and (e.size < 0 or held + e.size > PART_BYTES or run[-1].size < 0):
            out.append(Part(run))
            run, held = [], 0
        run.append(e)
        held += max(0, e.size)
    return [*out, Part(run)] if run else out


def _read(part: Part, root: str, ordered: bool, content: bool) -> Iterator[tuple]:
    files, _ = opened(root)
    file, stream = None, None
    try:
        for e in part.entries:
            if e.size < 0:
                for m, tar in _unpacked(files, e, ordered):
                    yield f"{e.file}!{m.name}", m.name.rpartition("/")[2], tar.extractfile(m).read() if content else None, m.size
                continue
            data = None
            if content:
                if file != e.file:
                    if stream is not None:
                        stream.close()
                    file, stream = e.file, files.open_input_file(e.file)
                data = stream.read_at(e.size, e.start)
            name = (e.member or e.file).rpartition("/")[2]
            yield f"{e.file}!{e.member}" if e.member else e.file, name, data, e.size
    finally:
        if stream is not None:
            stream.close()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.ordered, self.content = _options(options)

    def partitions(self) -> list[Part]:
        dumps = Dumps(self.root, self.ordered)
        return parts(e for file, size in dumps.files() for e in dumps.entries(file, size)) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read(partition, self.root, self.ordered, self.content)


class _StreamReader(DataSourceStreamReader):
    """Offsets: the last file by path, how many of its dumps have been read, and how many files there were up to it."""

    def __init__(self, options):
        self.root, self.ordered, self.content = _options(options)

    def initialOffset(self) -> dict:
        return {"file": "", "members": 0, "files": 0}

    def latestOffset(self) -> dict:
        dumps = Dumps(self.root, self.ordered)
        files = dumps.files()
        return {"file": files[-1][0], "members": dumps.members(*files[-1]), "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        dumps, out = Dumps(self.root, self.ordered), []
        files = [f for f in dumps.files() if f[0] <= end["file"]]
        if self.ordered and sum(f[0] <= start["file"] for f in files) != start["files"]:
            raise OutOfOrder(f"{self.root}: files came or went up to {start['file']}, which have been read")
        for file, size in files:
            if file < start["file"]:
                continue
            first = start["members"] if file == start["file"] else 0
            last = end["members"] if file == end["file"] else 1 << 62
            if first >= last:
                continue
            if _PACKED.search(file):
                out.append(Entry(file, "", first, -1, last))
            else:
                out += dumps.entries(file, size)[first:last]
        return parts(out)

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read(partition, self.root, self.ordered, self.content)

    def commit(self, end: dict) -> None:
        pass


def _options(options) -> tuple[str, bool, bool]:
    flag = lambda name, default: str(options.get(name, default)).lower() == "true"
    return options["path"], flag("ordered", False), flag("content", True)


class DumpSource(DataSource):
    """(path, name, content, bytes) of the .pb files below a path and in the tar archives there.

    Options: ordered (members of an archive's folder must come in the order of their names; a stream's files in that of
    their paths), content (false: the bytes aren't read, only counted).
    """

    @classmethod
    def name(cls) -> str:
        return "dumps"

    def schema(self) -> str:
        return "path string, name string, content binary, bytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
