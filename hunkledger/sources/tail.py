"""Files that grow by append, as a stream: Spark's file source takes a file once and never looks at it again.

``log_tail`` is a Python data source whose offset is how many bytes of each file have been read, always up to a line end, so a line
that is still being written waits for its newline.  What was appended since is cut into regions of bounded size, one task each; a region's
lines are those that start in it.  Files are found, measured and read with Arrow's file systems, so the folder may be local, on HDFS or
in an object store.

Each line has its file (relative to the folder), its place (byte of its first character, which orders a file's lines) and
its text; bytes that are not UTF-8 become U+FFFD.  Names that begin with ``_`` or ``.`` are no logs.  A file that is shorter than
what was read of it has been replaced and is read from its beginning.  The offset has one entry for each file.

The module refers to nothing else in the package and travels to the tasks by value, so executors need no installation of it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "log_tail"
#: Bytes a task reads, and how many opening a file counts for; bytes and lines that are handed on together.
SPLIT_BYTES, OPEN_BYTES = 64 << 20, 4 << 20
CHUNK_BYTES, BATCH_LINES = 1 << 20, 10_000


class Regions(InputPartition):
    """What one task reads: of each region its file, its bytes [start, end), whether a line starts at ``start``, and by where its lines end."""

    def __init__(self, regions: list[tuple[str, int, int, bool, int]]):
        super().__init__(regions)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.ends: dict[str, tuple[int, int]] = {}  # file: its size when last seen, and its last line end

    def store(self):
        """The file system and the folder in it."""
        from pyarrow import fs

        path = self.path
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)

    def files(self) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        store, root = self.store()
        for found in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = found.path[len(root) :].lstrip("/")
            if found.type == fs.FileType.File and not any(part[:1] in ("_", ".") for part in name.split("/")):
                yield name, found.size

    def line_end(self, file: str, size: int) -> int:
        """Bytes up to and with the last newline."""
        store, root = self.store()
        with store.open_input_file(f"{root}/{file}") as handle:
            upto = size
            while upto:
                start = max(upto - CHUNK_BYTES, 0)
                handle.seek(start)
                at = handle.read(upto - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                upto = start
        return 0

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for file, size in sorted(self.files()):
            if self.ends.get(file, (-1, 0))[0] != size:
                self.ends[file] = (size, self.line_end(file, size))
            if self.ends[file][1]:
                out[file] = self.ends[file][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Regions]:
        out, held, weight = [], [], 0
        for file, stop in end.items():
            begin = start.get(file, 0)
            begin = 0 if stop < begin else begin
            for at in range(begin, stop, self.split):
                region = (file, at, min(at + self.split, stop), at == begin, stop)
                cost = min(region[2] - at + OPEN_BYTES, self.split)
                if held and weight + cost > self.split:
                    out.append(Regions(held))
                    held, weight = [], 0
                held.append(region)
                weight += cost
        return [*out, Regions(held)] if held else out

    @staticmethod
    def lines(handle, at: int, upto: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(start, line) of the lines that start in [at, upto), from a place where one starts."""
        handle.seek(at)
        held: list[bytes] = []
        start = read = at
        while start < upto and read < stop:
            chunk = handle.read(min(CHUNK_BYTES, stop - read))
            if not chunk:
                return
            read += len(chunk)
            first, *others = chunk.split(b"\n")
            held.append(first)
            for other in others:
                if start >= upto:
                    return
                line = b"".join(held)
                yield start, line
                start += len(line) + 1
                held = [other]

    def read(self, partition: InputPartition):
        import pyarrow as pa

        store, root = self.store()

        def batch(file, rows):
            places, texts = zip(*rows)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([file] * len(rows), pa.string()), "place": pa.array(places, pa.int64()),
                "value": pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
            })

        for file, start, end, first, stop in partition.value:
            held, size = [], 0
            with store.open_input_file(f"{root}/{file}") as handle:
                # what lies before the first line end belongs to the region before
                for place, line in self.lines(handle, start if first else start - 1, end, stop):
                    if place < start:
                        continue
                    held.append((place, line))
                    size += len(line)
                    if len(held) >= BATCH_LINES or size >= 4 * CHUNK_BYTES:
                        yield batch(file, held)
                        held, size = [], 0
            if held:
                yield batch(file, held)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, place bigint, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stream of the lines of all files below a folder, also of those appended later: file, place, value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailSource)
    return spark.readStream.format(FORMAT).option("path", path).option("splitBytes", split_bytes).load()


def repo_of(file: Column) -> Column:
    """Repository of a log file: the value of its ``repo=`` folder, or the name of the folder that holds it."""
    named = F.regexp_extract(file, r"(?:^|/)repo=([^/]*)/", 1)
    decoded = F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    return F.when(named != "", decoded).otherwise(F.coalesce(F.try_element_at(F.split(file, "/"), F.lit(-2)), F.lit("")))
