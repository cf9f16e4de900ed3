"""Log files that grow: a streaming source whose offset is a byte position in each file.

Spark's file source reads a file once. This one reads what was appended since, up to the last whole line; a half-written line waits for its
end. A file is known by hashes of its first bytes, so one that was renamed by a rotation goes on where it was, and one that was cut and
started anew is read from its beginning.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
#: Lengths of the beginnings that tell files apart.
HEADS = [16, 64, 256, 1024, 4096]
#: Bytes read at once, and bytes of a file that one task reads.
BLOCK = 1 << 20
SPLIT = 64 << 20


@dataclass
class Stretch(InputPartition):
    """Lines of a file that start in ``[start, stop)``; ``first`` and ``end`` bound what the batch may read."""

    path: str
    first: int
    start: int
    stop: int
    end: int
    heads: dict[str, str]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _head(file, size: int) -> str:
    file.seek(0)
    return sha256(file.read(size)).hexdigest()[:32]


def _heads(file, end: int) -> dict[str, str]:
    """Hashes of the beginnings that lie before ``end``; of the whole if none does."""
    return {str(n): _head(file, n) for n in HEADS if n <= end} or {str(end): _head(file, end)}


def _whole_lines(file, size: int) -> int:
    """Position after the last line end."""
    stop = size
    while stop > 0:
        start = max(0, stop - 65536)
        file.seek(start)
        at = file.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


def same_file(before: dict, after: dict) -> bool:
    """Whether the later state continues the earlier one: it is no shorter and begins alike."""
    size = max(before["heads"], key=int)
    if after["end"] < before["end"]:
        return False
    return after["heads"].get(size, after["heads"].get("=" + size)) == before["heads"][size]


def continued(start: dict, end: dict) -> list[tuple[str, int]]:
    """Each file of ``end`` with the position from which it is new.

    The file of the same path goes first; then files that were renamed; the rest is new.
    """
    free, out = dict(start), []
    for path in sorted(end):
        if path in free and same_file(free[path], end[path]):
            out.append((path, free.pop(path)["end"]))
    for path in sorted(set(end) - {p for p, _ in out}):
        match = next((p for p in sorted(free) if same_file(free[p], end[path])), None)
        out.append((path, free.pop(match)["end"] if match else 0))
    return sorted(out)


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines")``: ``file``, ``at`` (byte position) and ``line`` of appended lines.

    Options: ``path`` of a folder; ``pattern`` of file names (default ``*``; names that start with a dot or an underscore are skipped);
    ``closed``, a pattern of files whose last line counts without a line end; ``split``, the bytes that one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*")
        self.closed = options.get("closed", "")
        self.split = int(options.get("split", SPLIT))
        self.seen: dict[str, tuple[tuple, dict]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """A function of the files alone, so it means the same after a restart."""
        for _ in range(20):
            try:
                return {"files": self._files()}
            except FileNotFoundError:  # a file was renamed since it was listed; without it the offset would forget what was read
                continue
        raise FileNotFoundError(f"the files of {self.folder} are renamed faster than they can be listed")

    def _files(self) -> dict:
        system, root = _open(self.folder)
        files, seen = {}, {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name[0] in "._" or not fnmatch(info.base_name, self.pattern):
                continue
            mark = (info.size, info.mtime_ns)
            if self.seen.get(info.path, (None,))[0] == mark:
                state = self.seen[info.path][1]
            else:
                with system.open_input_file(info.path) as file:
                    end = info.size if self.closed and fnmatch(info.base_name, self.closed) else _whole_lines(file, info.size)
                    state = {"end": end, "heads": _heads(file, end)}
            seen[info.path] = (mark, state)
            if state["end"]:
                files[info.path] = state
        self.seen = seen
        return files

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        system, _ = _open(self.folder)
        before, after = start["files"], {p: dict(s, heads=dict(s["heads"])) for p, s in end["files"].items()}
        for path, state in after.items():  # a short beginning that has been read must be compared too
            for size in {max(s["heads"], key=int) for s in before.values()} - set(state["heads"]):
                if int(size) <= state["end"]:
                    with system.open_input_file(_located(system, path, state)) as file:
                        state["heads"]["=" + size] = _head(file, int(size))
        for path, first in continued(before, after):
            stop = after[path]["end"]
            out += [Stretch(path, first, at, min(at + self.split, stop), stop, end["files"][path]["heads"]) for at in range(first, stop, self.split)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.folder)
        path = _located(system, partition.path, {"end": partition.end, "heads": partition.heads})
        with system.open_input_file(path) as file:
            for at, lines in _lines(file, partition):
                columns = [pa.array([partition.path] * len(lines), pa.string()), pa.array(at, pa.int64()), pa.array([line.decode("utf-8", "replace") for line in lines])]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "at", "line"])


def _located(system: fs.FileSystem, path: str, state: dict) -> str:
    """Where the file of an offset is now: a batch that is run again may find it renamed."""

    def fits(candidate: str) -> bool:
        try:
            with system.open_input_file(candidate) as file:
                return file.size() >= state["end"] and all(_head(file, int(n)) == h for n, h in state["heads"].items() if n.isdigit())
        except FileNotFoundError:
            return False

    if fits(path):
        return path
    folder = path.rpartition("/")[0]
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.File and info.path != path and fits(info.path):
            return info.path
    raise FileNotFoundError(f"{path} is gone, or no longer begins as it did")


def _lines(file, part: Stretch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Positions and texts of the lines of a stretch, by blocks."""
    inside = part.start > part.first  # then the line that holds the byte before belongs to the stretch before
    at = part.start - inside
    file.seek(at)
    rest = bytearray()
    while at < part.stop:
        block = file.read(min(BLOCK, part.end - at - len(rest)))
        searched = len(rest)
        rest += block
        cut = rest.rfind(b"\n", searched) + 1
        if not block:
            cut = len(rest)  # the end of a closed file
            if not cut:
                return
        elif not cut:
            continue
        whole = bytes(rest[:cut])
        del rest[:cut]
        lines = whole.split(b"\n")
        if whole.endswith(b"\n"):
            lines.pop()
        positions = []
        for line in lines:
            positions.append(at)
            at += len(line) + 1
        if inside:
            lines, positions, inside = lines[1:], positions[1:], False
        keep = sum(p < part.stop for p in positions)
        if keep:
            yield positions[:keep], [line.removesuffix(b"\r") for line in lines[:keep]]


def growing_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Stream of the lines that are appended to the files of a folder."""
    # workers get the source with the plan and need not have the package installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", folder)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def append_texts(texts: DataFrame, folder: str, file: str = "file", order: str = "at", text: str = "text") -> None:
    """Append texts as they are, in order, to the files they name; a task writes whole files.

    A task that runs again cuts its files back to the length they had before.
    """
    system, root = _open(folder)
    system.create_dir(root)
    sizes = {info.base_name: info.size for info in system.get_file_info(fs.FileSelector(root))}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, out = None, None
        for batch in batches:
            for wanted, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if wanted != name:
                    if out:
                        out.close()
                    name, path = wanted, f"{root}/{wanted}"
                    kept = b""
                    if sizes.get(name, 0):
                        with system.open_input_file(path) as old:
                            if old.size() != sizes[name]:
                                kept = old.read(sizes[name])
                    if kept or not sizes.get(name, 0):
                        out = system.open_output_stream(path)
                        out.write(kept)
                    else:
                        out = system.open_append_stream(path)
                out.write(value.encode("utf-8"))
        if out:
            out.close()
        yield from ()

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    dealt = texts.repartition(F.col(file)).sortWithinPartitions(file, order).select(file, text)
    dealt.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def rotate(folder: str, name: str, new_name: str) -> None:
    """Rename a file of the folder, if it is there."""
    system, root = _open(folder)
    if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
        system.move(f"{root}/{name}", f"{root}/{new_name}")
