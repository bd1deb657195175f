"""Header blocks of a library's image files as a data source of Spark, for batches and streams.

    spark.dataSource.register(FrameHeaders)
    spark.read.format("frame_headers").option("path", library).load()
    spark.readStream.format("frame_headers").option("path", library).option("state", folder).load()

Rows are path, modificationTime, length and head (the header blocks up to the END card; NULL for a file that cannot be
opened).  Partitions are ranges of the listing.  A stream lists the library in rounds: files that are new, or whose time
differs from that of the round before in either direction, are that round's changes, kept in chunks of files_per_batch.
An offset names a chunk and its last (path, mtime), so a replayed batch reads the same files.  The driver walks one folder
at a time and compares two sorted listings, so it holds one folder and one chunk, however big the library is.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from itertools import chain, islice

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from nightledger.config import DEFAULTS
from nightledger.sources.headers import IMAGE_FILE, head_of

SCHEMA = "path string, modificationTime timestamp, length bigint, head binary"
#: Files of one partition, and of one Arrow batch.
FILES_A_TASK, FILES_A_BATCH = 200, 50
File = tuple[str, int, int]


def file_system(uri: str):
    """(pyarrow file system, path in it, what to put before its paths)."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri, ""
    scheme = uri.split("://")[0] + "://"
    return *fs.FileSystem.from_uri(uri), "" if scheme == "file://" else scheme


def order(path: str) -> list[str]:
    """Files are listed in the order of their paths' names."""
    return path.split("/")


def walk(root: str) -> Iterator[File]:
    """(path, time in microseconds, length) of the image files below a folder, in order; dot-folders are left out."""
    from pyarrow import fs

    system, top, prefix = file_system(root.rstrip("/"))

    def below(folder: str) -> Iterator[File]:
        for entry in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda e: e.base_name):
            if entry.type == fs.FileType.Directory:
                if not entry.base_name.startswith("."):
                    yield from below(entry.path)
            elif IMAGE_FILE.search(entry.base_name):
                yield prefix + entry.path, (entry.mtime_ns or 0) // 1000, entry.size

    return below(top)


def compared(now: Iterable[File], before: Iterable[File], tolerance_us: int) -> Iterator[tuple[File, bool]]:
    """Every file of `now`, and whether it is new or has another time than in `before`; both are in order."""
    known = iter(before)
    last = next(known, None)
    for file in now:
        while last is not None and order(last[0]) < order(file[0]):
            last = next(known, None)
        same = last is not None and last[0] == file[0] and abs(last[1] - file[1]) <= tolerance_us
        # What counts as unchanged keeps the time it was read at, so that small steps add up.
        yield (last if same else file), not same


class Rounds:
    """The listings and changes of a stream, in its state folder."""

    def __init__(self, folder: str, root: str, chunk: int):
        self.system, self.folder, _ = file_system(folder.rstrip("/"))
        self.root, self.chunk = root, chunk
        self.system.create_dir(self.folder)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        from pyarrow import fs

        return self.system.get_file_info(self._path(name)).type == fs.FileType.File

    def _lines(self, name: str) -> Iterator[File]:
        with self.system.open_input_stream(self._path(name), buffer_size=1 << 20) as raw:
            rest = b""
            while block := raw.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (tuple(json.loads(line)) for line in lines)

    def put(self, name: str, value: dict) -> None:
        """Written beside and moved into place, so that a crash leaves the old value or the new one."""
        with self.system.open_output_stream(self._path(name + ".new")) as out:
            out.write(json.dumps(value).encode())
        self.system.move(self._path(name + ".new"), self._path(name))

    def get(self, name: str) -> dict | None:
        if not self._exists(name):
            return None
        with self.system.open_input_stream(self._path(name)) as f:
            return json.loads(f.read())

    def chunks(self, number: int) -> int:
        return (self.get(f"round-{number}.json") or {"chunks": 0})["chunks"]

    def files(self, number: int, chunk: int) -> list[File]:
        """The changes of a chunk, which are numbered from 1."""
        return list(self._lines(f"changes-{number}-{chunk}.jsonl"))

    def take(self, number: int) -> int:
        """List the library as round `number`; how many chunks of changes it has.  A round without changes is not kept."""
        before = self._lines(f"listing-{number - 1}.jsonl") if self._exists(f"listing-{number - 1}.jsonl") else ()
        changes, count = [], 0

        def flush():
            with self.system.open_output_stream(self._path(f"changes-{number}-{count}.jsonl")) as out:
                out.write(b"".join(json.dumps(f).encode() + b"\n" for f in changes))
            changes.clear()

        with self.system.open_output_stream(self._path(f"listing-{number}.jsonl"), buffer_size=1 << 20) as listing:
            for file, changed in compared(walk(self.root), before, int(DEFAULTS.mtime_tolerance_s * 1e6)):
                listing.write(json.dumps(file).encode() + b"\n")
                if changed:
                    changes.append(file)
                    if len(changes) == self.chunk:
                        count += 1
                        flush()
            if changes:
                count += 1
                flush()
        if count:
            self.put(f"round-{number}.json", {"chunks": count})
        return count

    def forget_before(self, number: int) -> None:
        """Files of rounds that no offset can ask for any more."""
        earlier = number - 1
        for chunk in range(1, self.chunks(earlier) + 1):
            self.system.delete_file(self._path(f"changes-{earlier}-{chunk}.jsonl"))
        for name in (f"round-{earlier}.json", f"listing-{earlier}.jsonl"):
            if self._exists(name):
                self.system.delete_file(self._path(name))


class FileRange(InputPartition):
    def __init__(self, files: list[File]):
        super().__init__(None)
        self.files = files


def ranges(files: Iterable[File]) -> list[FileRange]:
    files = iter(files)
    return [FileRange([first, *islice(files, FILES_A_TASK - 1)]) for first in files]


def heads(files: list[File]):
    """Arrow batches of the files' header blocks."""
    import pyarrow as pa

    for at in range(0, len(files), FILES_A_BATCH):
        paths, times, lengths = zip(*files[at : at + FILES_A_BATCH])
        times = [datetime.fromtimestamp(t / 1e6, timezone.utc) for t in times]
        columns = [pa.array(paths), pa.array(times, pa.timestamp("us", tz="UTC")), pa.array(lengths, pa.int64()), pa.array([head_of(p) for p in paths], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "modificationTime", "length", "head"])


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]

    def partitions(self):
        return ranges(walk(self.root)) or [FileRange([])]

    def read(self, partition: FileRange):
        return heads(partition.files)


class HeaderStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)
        self._rounds: Rounds | None = None

    @property
    def rounds(self) -> Rounds:
        if self._rounds is None:
            self._rounds = Rounds(self.options["state"], self.options["path"], int(self.options.get("files_per_batch", 10_000)))
        return self._rounds

    def initialOffset(self) -> dict:
        return {"round": 0, "chunk": 0, "path": "", "mtime": 0}

    def latestOffset(self) -> dict:
        """One chunk further; a new round once all chunks of the last one have been handed out."""
        at = self.rounds.get("position.json") or self.initialOffset()
        number, chunk = at["round"], at["chunk"]
        if chunk == self.rounds.chunks(number):
            number, chunk = number + 1, 0
            if not self.rounds.take(number):
                return at
        path, mtime, _ = self.rounds.files(number, chunk + 1)[-1]
        at = {"round": number, "chunk": chunk + 1, "path": path, "mtime": mtime}
        self.rounds.put("position.json", at)
        return at

    def partitions(self, start: dict, end: dict):
        wanted = []
        for number in range(start["round"], end["round"] + 1):
            first = start["chunk"] if number == start["round"] else 0
            last = end["chunk"] if number == end["round"] else self.rounds.chunks(number)
            wanted += [(number, chunk) for chunk in range(first + 1, last + 1)]
        return ranges(chain.from_iterable(self.rounds.files(*w) for w in wanted))

    def read(self, partition: FileRange):
        return heads(partition.files)

    def commit(self, end: dict) -> None:
        if end["round"] > 1:
            self.rounds.forget_before(end["round"])

    def __getstate__(self):
        return {"options": self.options, "_rounds": None}


class FrameHeaders(DataSource):
    """Options: path (the library); for streams also state (a folder the driver keeps the listings in) and files_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "frame_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)

    def streamReader(self, schema) -> HeaderStreamReader:
        return HeaderStreamReader(self.options)
