"""A data source for BAM: alignments as in SAM text, with names, flags, places and CIGAR strings. A file is one partition."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from helixframe.sources.fastq import FilePart, listed, located

SCHEMA = "ord long, qname string, flag int, ref string, pos int, cigar string, sa string"
OPS = "MIDNSHP=X"
#: Bytes of a value of each tag type.
WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def tag(data: bytes, name: bytes) -> str | None:
    """A text tag of a record's optional fields."""
    at = 0
    while at < len(data):
        key, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if key == name:
                return data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + WIDTH[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += WIDTH[kind]
    return None


def alignments(stream) -> Iterator[tuple]:
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        size = struct.unpack("<i", stream.read(4))[0]
        names.append(stream.read(size)[:-1].decode())
        stream.read(4)
    number = 0
    while head := stream.read(4):
        block = stream.read(struct.unpack("<i", head)[0])
        ref, pos, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", block)
        at = 32 + l_name
        ops = struct.unpack_from(f"<{n_cigar}I", block, at)
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
        rest = block[at + 4 * n_cigar + (l_seq + 1) // 2 + l_seq :]
        yield number, block[32 : at - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, cigar, tag(rest, b"SA")
        number += 1


class BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in listed(self.path)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        fs, at = located(partition.path)
        with fs.open_input_stream(at, compression=None) as raw, gzip.open(raw) as stream:
            yield from alignments(stream)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hf_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("hf_bam").load(path)
