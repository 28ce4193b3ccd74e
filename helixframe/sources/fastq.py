"""A data source for FASTQ and FASTA; each file is one partition, as gzip can't be split."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, seq string, qual string"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """id, sequence, quality of each record; ends at the first whose quality and sequence differ in length."""
    line = next(lines, None)
    while line is not None:
        if not line or line[0] not in "@>":
            line = next(lines, None)
            continue
        name, seq, qual = (line[1:].split() or [""])[0], [], None
        line = next(lines, None)
        while line is not None and line[:1] not in ("@", ">", "+"):
            seq.append(line.strip())
            line = next(lines, None)
        bases = "".join(seq)
        if line is not None and line.startswith("+"):
            parts, size = [], 0
            while size < len(bases) and (line := next(lines, None)) is not None:
                parts.append(line.rstrip("\r\n"))
                size += len(parts[-1])
            qual = "".join(parts)
            if len(qual) != len(bases):
                return
            line = next(lines, None)
        yield name, bases, qual


def open_lines(path: str) -> Iterator[str]:
    fs, at = located(path)
    with fs.open_input_stream(at, compression=None) as raw:
        yield from lines_of(raw, at)


def lines_of(raw: io.IOBase, name: str) -> Iterator[str]:
    text = io.TextIOWrapper(gzip.open(raw) if name.endswith(".gz") else raw, encoding="latin-1")
    yield from (line.rstrip("\r\n") for line in text)


def listed(path: str) -> list[str]:
    fs, at = located(path)
    info = fs.get_file_info(at)
    if info.is_file:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastqReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in listed(self.path)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        yield from records(open_lines(partition.path))


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hf_fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options["path"])
