"""Byte ranges of growing log files: a stream of appended lines, listings, and lines of tails.

Files are opened on the executors by their URI, through Arrow's file systems. A
range is cut into pieces at line ends, so a long file is read by many tasks.
"""

from __future__ import annotations

import fnmatch
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sessionloom.functions import text as T

BLANK = b" \t\r\n\x0b\x0c"
#: Bytes before a position by which a file is known to be the same up to there.
PROOF = 64
#: Directory of lane files, which are never read on from a position (fixed value).
LANES = "/.codexl/"
TAIL_BYTES = 256 * 1024
#: Files whose ends are looked at at once.
LOOKERS = 8


def opened(uri: str):
    """(file system, path in it) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def lines_between(file, low: int, high: int, end: int, skip: bool, block: int = 1 << 20):
    """(position, bytes) of the lines that begin in [low, high), the last one up to ``end``; with ``skip``, of those after the first line end."""
    file.seek(low)
    at, held, position = low, b"", low
    while True:
        more = file.read(min(block, end - position)) if position < end else b""
        if not more:
            if held and not skip and at < high:
                yield at, held
            return
        position += len(more)
        parts = (held + more).split(b"\n")
        held = parts.pop()
        block = block if parts else 2 * block
        for line in parts:
            if skip:
                skip = False
            elif at < high:
                yield at, line
            at += len(line) + 1
        if at >= high and not skip:
            return


def packed(rows, names: list[str], kinds: list[pa.DataType], size: int = 10_000):
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def write_files(lines: DataFrame, root: str) -> None:
    """Text files below ``root`` from lines (file, value), those of a file one after the other in one partition; ``file`` is a path below the root.

    A file appears under its name when it is whole, so a task may run again.
    Spark's writers give each value of a column a folder of its own, and one after the other of them is moved by the driver.
    """

    def write(batches):
        system, base = opened(root)
        own, folders, name, out = f"{TaskContext.get().taskAttemptId()}", set(), None, None

        def part(name: str) -> str:
            folder, _, last = f"{base}/{name}".rpartition("/")
            if folder not in folders:
                system.create_dir(folder, recursive=True)
                folders.add(folder)
            return f"{folder}/.{last}.{own}"

        def close() -> None:
            out.close()
            try:
                system.move(part(name), f"{base}/{name}")
            except OSError:  # where a move replaces nothing, an attempt before this one has written the same
                if not system.get_file_info(f"{base}/{name}").is_file:
                    raise
                system.delete_file(part(name))

        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            at = 0
            for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if file != name:
                    if out:
                        close()
                    name, out = file, system.open_output_stream(part(file))
                out.write("".join(f"{line or ''}\n" for line in batch.column(1).slice(at, end - at).to_pylist()).encode())
                at = end
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([len(folders)])], ["folders"])

    system, base = opened(root)
    system.create_dir(base, recursive=True)
    lines.select("file", "value").mapInArrow(write, "folders long").write.format("noop").mode("overwrite").save()


@dataclass
class Ranges(InputPartition):
    """(uri, from, to, end of the file's range, whether the first line is cut off, whether the file is read anew) of some files."""

    ranges: list[tuple[str, int, int, int, bool, bool]]


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.piece = int(options.get("piece", 64 << 20))
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file [size, time of change, checksum of the last bytes]; only files that changed since the last look are opened."""
        from pyarrow import fs

        system, base = opened(self.root)
        scheme = self.root[: self.root.index(base)] if base in self.root else ""
        seen, changed = {}, []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            path = info.path
            if info.type == fs.FileType.File and fnmatch.fnmatchcase(path.rpartition("/")[2], self.glob):
                uri, now = scheme + path, [info.size, info.mtime_ns]
                old = self.known.get(uri)
                if old and old[:2] == now:
                    seen[uri] = old
                else:
                    changed.append((uri, path, now))
        slices = [changed[i : i + 1000] for i in range(0, len(changed), 1000)]
        with ThreadPoolExecutor(LOOKERS) as pool:  # most of it is waiting, where files are not local
            for some, crcs in zip(slices, pool.map(lambda some: [self.proof(system, path, now[0])[0] for _, path, now in some], slices), strict=True):
                seen |= {uri: [*now, crc] for (uri, _, now), crc in zip(some, crcs, strict=True)}
        self.known = seen
        return seen

    def proof(self, system, path: str, size: int) -> tuple[int, bool]:
        """Checksum of the bytes before a position, and whether the last of them ends a line."""
        with system.open_input_file(path) as file:
            low = max(0, size - PROOF)
            file.seek(low)
            held = file.read(size - low)
        return zlib.crc32(held), held.endswith(b"\n")

    def goes_on(self, uri: str, old: list | None, new: list) -> bool:
        """Whether what follows the old end can be read alone: the file grew, its old end is unchanged and ended a line, and it is no lane file."""
        if not old or not old[0] or new[0] <= old[0] or LANES in uri:
            return False
        return self.proof(*opened(uri), old[0]) == (old[2], True)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out, held, size = [], [], 0
        for uri, new in sorted(end.items()):
            old = start.get(uri)
            if old == new:
                continue
            on = self.goes_on(uri, old, new)
            begin = old[0] if on else 0
            cuts = [*range(begin, new[0], self.piece), new[0]] if new[0] > begin else [0, 0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                held.append((uri, low - 1 if low > begin else low, high, new[0], low > begin, not on))
                size += high - low
                if size >= self.piece or len(held) >= 1000:
                    out, held, size = [*out, Ranges(held)], [], 0
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges):
        def rows():
            for uri, low, high, end, skip, fresh in partition.ranges:
                if not end:
                    yield uri, 0, True, None
                    continue
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    for at, line in lines_between(file, low, high, end, skip):
                        if stripped := line.strip(BLANK):
                            yield uri, at, fresh, stripped.decode("utf-8", "replace")

        return packed(rows(), ["path", "at", "fresh", "value"], [pa.string(), pa.int64(), pa.bool_(), pa.string()])


class AppendedLines(DataSource):
    """The lines of files below ``path`` as they grow: path, at (its byte position), fresh, value.

    A file that only grew, and whose last line had ended, costs its new bytes; any other change (shorter,
    rewritten, a half line completed, a lane file) has it read anew with ``fresh`` set, an emptied one as a single row
    without value. The last line counts without a line end too; blank lines are left out. The offset is a position for
    each file below the root, so it is as large as their list. Options: path (a URI), glob, piece (bytes a task reads).
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, at long, fresh boolean, value string"

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options)


def appended_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", piece: int = 64 << 20) -> DataFrame:
    """The stream of ``AppendedLines``."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("glob", glob).option("piece", piece).load(root)


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that are short and cost much, which adaptive execution would give to one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def listing(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Files below ``root`` (path, size, mtime) by their metadata alone: no content is read. Spark lists no empty files; they hold no events."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.coalesce(tasks(spark))  # Spark plans a task for every 32 files, as if each were 4 MB long
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def tail_lines(files: DataFrame, tail_bytes: int = TAIL_BYTES) -> DataFrame:
    """(path, at, value) of the non-blank lines in the last bytes of files (path, size); what stands before the first line end there is left out, unless the file is no longer."""

    def tails(batches):
        def rows(batch):
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = opened(uri)
                low = max(0, size - tail_bytes)
                with system.open_input_file(path) as file:
                    for at, line in lines_between(file, low, size, size, low > 0):
                        if stripped := line.strip(BLANK):
                            yield uri, at, stripped.decode("utf-8", "replace")

        for batch in batches:
            yield from packed(rows(batch), ["path", "at", "value"], [pa.string(), pa.int64(), pa.string()])

    return files.where("size > 0").select("path", "size").repartition(tasks(files.sparkSession), "path").mapInArrow(tails, "path string, at long, value string")


def may_hold_events_after(files: DataFrame, cutoff_us: int | None, tail_bytes: int = TAIL_BYTES) -> DataFrame:
    """``files`` with may_hold: not for empty files and those changed before the cutoff; else unless the last line with a timestamp, in the tail, lies before it.

    Without a cutoff every file may hold some. Only the tails of files that are neither empty nor old are read.
    """
    if cutoff_us is None:
        return files.withColumn("may_hold", F.lit(True))
    recent = (F.col("size") > 0) & (F.unix_micros(F.col("mtime").cast("timestamp")) >= cutoff_us)
    stamped = tail_lines(files.where(recent), tail_bytes).withColumn("ts", T.observed_time(T.json_first_field("value", "timestamp")))
    last = stamped.where("ts is not null").groupBy("path").agg(F.max_by("ts", "at").alias("last_ts"))
    late = F.coalesce(F.unix_micros("last_ts") >= cutoff_us, F.lit(True))
    return files.join(last, "path", "left").withColumn("may_hold", recent & late).drop("last_ts")
