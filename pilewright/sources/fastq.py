"""FASTQ files, plain or gzipped, as a Spark data source: one partition a file."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
BATCH_READS = 10_000
SCHEMA = "file string, ord bigint, name string, seq string, qual string"


def fastq_paths(path: str) -> list[str]:
    """The FASTQ files of a folder by name, without hidden ones; a file itself; nothing where there is none."""
    if not os.path.isdir(path):
        return [path] if os.path.exists(path) else []
    names = sorted(n for n in os.listdir(path) if not n.startswith(".") and n.endswith(SUFFIXES))
    return [p for p in (os.path.join(path, n) for n in names) if os.path.isfile(p)]


class FastqFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class FastqReader(DataSourceReader):
    """Reads files as Arrow batches; what a name must contain and the least length are applied before a batch is made."""

    def __init__(self, paths: list[str], name_contains: str, min_len: int) -> None:
        self.paths, self.name_contains, self.min_len = paths, name_contains, min_len

    def partitions(self) -> list[FastqFile]:
        return [FastqFile(p) for p in self.paths]

    def read(self, partition: FastqFile) -> Iterator[pa.RecordBatch]:
        opener = gzip.open if partition.path.endswith(".gz") else open
        file, before = os.path.basename(partition.path), 0
        with opener(partition.path, "rt") as text:
            while lines := list(islice(text, 4 * BATCH_READS)):
                n = -(-len(lines) // 4)
                lines += [""] * (4 * n - len(lines))
                names = [(h[1:].split() or [""])[0] for h in lines[::4]]
                seqs, quals = [x.strip() for x in lines[1::4]], [x.strip() or None for x in lines[3::4]]
                kept = [i for i in range(n) if self.name_contains in names[i] and len(seqs[i]) >= self.min_len]
                columns = [pa.array([before + i for i in kept], pa.int64()), *(pa.array([c[i] for i in kept], pa.string()) for c in (names, seqs, quals))]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(kept), pa.string()), *columns], names=["file", "ord", "name", "seq", "qual"])
                before += n


class FastqSource(DataSource):
    """Option ``path``: a file or a folder; ``name_contains`` and ``min_len`` leave out other reads."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FastqReader:
        return FastqReader(fastq_paths(self.options["path"]), self.options.get("name_contains", ""), int(self.options.get("min_len", "0")))


def read_fastq(spark: SparkSession, path: str, name_contains: str | None = None, min_len: int = 0, limit: int | None = None) -> DataFrame:
    """``file, ord, name, seq, qual`` of the reads at ``path`` whose name contains a text and that are long enough.

    The name is the header's first word ('' for a bare header), an empty quality is null. ``limit`` keeps the first
    so many by file and order.
    """
    if not fastq_paths(path):
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(FastqSource)
    reads = spark.read.format("fastq").option("name_contains", name_contains or "").option("min_len", str(min_len)).load(path)
    return reads if limit is None else reads.orderBy("file", "ord").limit(limit)


def keep_reads(reads: DataFrame, name_contains: str | None = None, min_len: int = 0) -> DataFrame:
    kept = reads.filter(F.contains("name", F.lit(name_contains))) if name_contains else reads
    return kept.filter(F.length("seq") >= min_len) if min_len else kept
