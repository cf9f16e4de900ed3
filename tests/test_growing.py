"""Growing log files: appended lines, cut lines, rotation, restarts."""

from __future__ import annotations

import os
import random

import pyarrow.fs as fs
import pytest

from ledgerlake.sources import growing
from ledgerlake.sources.growing import GrowingReader, Stretch, continued


def _append(folder, name, data: bytes):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "ab") as out:
        out.write(data)


def _read(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += [(r["file"].rpartition("/")[2], r["at"], r["line"]) for r in batch.to_pylist()]
    return out


def _steps(folder, **options):
    reader = GrowingReader({"path": str(folder), **options})
    offset = reader.initialOffset()

    def step(fresh=True):
        nonlocal reader, offset
        if fresh:  # a restart: only the offset is known
            reader = GrowingReader({"path": str(folder), **options})
        before, offset = offset, reader.latestOffset()
        return _read(reader, before, offset)

    return step


@pytest.mark.parametrize("fresh", [True, False])
def test_appended_and_cut_lines(tmp_path, fresh):
    step = _steps(tmp_path / "log")
    assert step(fresh) == []
    _append(tmp_path / "log", "a", b"one\ntwo\nhal")
    assert step(fresh) == [("a", 0, "one"), ("a", 4, "two")]
    assert step(fresh) == []
    _append(tmp_path / "log", "a", "f é\r\n\nlast".encode())
    _append(tmp_path / "log", "b", b"new\n")
    _append(tmp_path / "log", ".hidden", b"no\n")
    assert step(fresh) == [("a", 8, "half é"), ("a", 17, ""), ("b", 0, "new")]
    _append(tmp_path / "log", "a", b"\xff\n")
    assert step(fresh) == [("a", 18, "last�")]


def test_rotation_by_renaming_and_by_copying(tmp_path):
    folder = tmp_path / "log"
    step = _steps(folder)
    _append(folder, "app.log", b"2024 first line of the log\nsecond\n")
    assert len(step()) == 2
    _append(folder, "app.log", b"third\n")
    os.rename(folder / "app.log", folder / "app.log.1")
    _append(folder, "app.log", b"2025 first line of the next log\n")
    assert [r[2] for r in step()] == ["2025 first line of the next log", "third"]
    os.rename(folder / "app.log.1", folder / "app.log.2")
    os.rename(folder / "app.log", folder / "app.log.1")
    assert step() == []
    # copied and cut
    _append(folder, "copied.log", b"a line that is long enough to tell\nmore\n")
    assert len(step()) == 2
    _append(folder, "copied.log", b"late\n")
    (folder / "copied.log.1").write_bytes((folder / "copied.log").read_bytes())
    (folder / "copied.log").write_bytes(b"anew\n")
    assert sorted(r[2] for r in step()) == ["anew", "late"]
    # removed and written anew, shorter and longer than before
    (folder / "copied.log").write_bytes(b"x\n")
    assert [r[2] for r in step()] == ["x"]
    (folder / "copied.log").write_bytes(b"quite another text\nand more\n")
    assert [r[2] for r in step()] == ["quite another text", "and more"]
    os.remove(folder / "app.log.2")
    assert step() == []


def test_a_batch_runs_again_after_a_rename(tmp_path):
    folder = tmp_path / "log"
    _append(folder, "app.log", b"some line that is known\nnext\n")
    reader = GrowingReader({"path": str(folder)})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    os.rename(folder / "app.log", folder / "old")
    _append(folder, "app.log", b"other text\n")
    assert [r["line"] for p in parts for b in reader.read(p) for r in b.to_pylist()] == ["some line that is known", "next"]
    os.remove(folder / "old")
    with pytest.raises(FileNotFoundError):
        [list(reader.read(p)) for p in parts]


def test_closed_files_and_patterns(tmp_path):
    folder = tmp_path / "log"
    _append(folder, "a.log", b"open")
    _append(folder, "a.log.1", b"whole\nlast")
    _append(folder, "other", b"no\n")
    step = _steps(folder, pattern="*.log*", closed="*.log.*")
    assert [r[2] for r in step()] == ["whole", "last"]


@pytest.mark.parametrize("split", [1, 7, 50, 10_000])
def test_stretches_cover_every_line_once(tmp_path, split, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 16)
    rng = random.Random(split)
    lines = ["x" * rng.choice([0, 1, 5, 40]) for _ in range(60)]
    _append(tmp_path / "log", "a", "".join(line + "\n" for line in lines).encode() + b"rest")
    reader = GrowingReader({"path": str(tmp_path / "log"), "split": str(split)})
    got = _read(reader, reader.initialOffset(), reader.latestOffset())
    assert [r[2] for r in got] == lines
    assert [r[1] for r in got] == [sum(len(x) + 1 for x in lines[:i]) for i in range(60)]


def test_same_beginnings():
    state = lambda end, head: {"end": end, "heads": {"16": head}}
    before = {"a": state(100, "h"), "b": state(50, "h")}
    assert continued(before, {"a": state(100, "h"), "b": state(60, "h"), "c": state(70, "h")}) == [("a", 100), ("b", 50), ("c", 0)]
    assert continued(before, {"a": state(20, "h"), "c": state(120, "h"), "b": state(50, "h")}) == [("a", 0), ("b", 50), ("c", 100)]
    assert isinstance(Stretch("p", 0, 0, 1, 1, {}), Stretch)


def test_stream_over_restarts(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def run():
        stream = growing.growing_lines(spark, folder, split=64)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    _append(folder, "a", b"".join(b"line %03d\n" % i for i in range(100)) + b"li")
    assert run() == [f"line {i:03d}" for i in range(100)]
    _append(folder, "a", b"ne 100\n")
    os.rename(os.path.join(folder, "a"), os.path.join(folder, "a.1"))
    _append(folder, "a", b"next 000\n")
    assert run() == sorted([f"line {i:03d}" for i in range(101)] + ["next 000"])


def test_append_texts(spark, rows, tmp_path):
    folder = str(tmp_path / "texts")
    growing.append_texts(rows("file STRING, at INT, text STRING", ("a", 2, "two\n"), ("a", 1, "one\n"), ("b", 1, "x\n")), folder)
    growing.append_texts(rows("file STRING, at INT, text STRING", ("a", 1, "three")), folder)
    assert open(f"{folder}/a").read() == "one\ntwo\nthree" and open(f"{folder}/b").read() == "x\n"
    growing.rotate(f"file://{folder}", "a", "a.1")
    growing.rotate(folder, "nothing", "else")
    assert {i.base_name for i in fs.LocalFileSystem().get_file_info(fs.FileSelector(folder))} == {"a.1", "b"}
