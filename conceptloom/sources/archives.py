"""Ontology files out of zip archives, with what an archive may do wrong."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class ArchiveFault(ValueError):
    """An archive without the one regular member that it should hold."""


def only_member(archive: zipfile.ZipFile, expected: str, suffix: str = ".owl") -> zipfile.ZipInfo:
    """The only member with ``suffix``, which must have the expected name and be a regular file: no folder, link or path that leads elsewhere."""
    found = [m for m in archive.infolist() if m.filename.lower().endswith(suffix)]
    names = [m.filename for m in found]
    if names != [expected]:
        raise ArchiveFault(f"wanted {expected} alone, found {names}")
    if found[0].is_dir() or stat.S_ISLNK(found[0].external_attr >> 16) or expected.startswith(("/", "\\")) or ".." in expected.replace("\\", "/").split("/"):
        raise ArchiveFault(f"{expected} is no regular file")
    if found[0].flag_bits & 1:
        raise ArchiveFault(f"{expected} is encrypted")
    return found[0]


def member_lines(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """``archive``, ``line_no``, ``value``: the lines of the expected member of each zip file under ``path``, inflated as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(memoryview(content.as_buffer()))) as archive, archive.open(only_member(archive, expected)) as member:
                    lines: list[str] = []
                    at = 0
                    for line in io.TextIOWrapper(member, encoding="utf-8"):
                        lines.append(line.rstrip("\r\n"))
                        if len(lines) == 5000:
                            yield _numbered(name, at, lines)
                            at, lines = at + len(lines), []
                    if lines:
                        yield _numbered(name, at, lines)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, line_no long, value string")


def _numbered(name: str, at: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), type=pa.int64()), pa.array(lines)], names=["archive", "line_no", "value"])
