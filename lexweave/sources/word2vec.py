"""word2vec binary files: a header line ``rows dimensions``, then for each row the word, a space and float32 numbers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FormatError

SCHEMA = "row_id bigint, word string, embedding array<float>"
BLOCK = 1 << 22


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """A file, or all files below a directory, in the order of their names."""
    system, p = _at(path)
    if system.get_file_info(p).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(p, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return [p]


def _header(f) -> tuple[int, int]:
    line = bytearray()
    while len(line) < 64 and (c := f.read(1)) not in (b"", b"\n"):
        line += c
    try:
        rows, dim = (int(x) for x in line.split())
        return rows, dim
    except ValueError as e:
        raise FormatError(f"not a word2vec file: {e}") from e


def _read(path: str, system: fs.FileSystem, first: int, batch: int) -> Iterator[pa.RecordBatch]:
    with system.open_input_stream(path, compression=None, buffer_size=BLOCK) as f:
        rows, dim = _header(f)
        buffer, at, words, vectors, start = b"", 0, [], [], first
        for i in range(rows):
            while (space := buffer.find(b" ", at)) < 0 or len(buffer) < space + 1 + 4 * dim:
                more = f.read(BLOCK)
                if not more:
                    raise FormatError(f"{path}: ends in row {i}")
                buffer, at = buffer[at:] + more, 0
            words.append(buffer[at:space].replace(b"\n", b"").decode("utf-8", "replace"))
            at = space + 1 + 4 * dim
            vectors.append(buffer[space + 1 : at])
            if len(words) == batch or i == rows - 1:
                flat = pa.array(np.frombuffer(b"".join(vectors), "<f4"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(words))), pa.array(words), lists], names=["row_id", "word", "embedding"])
                start, words, vectors = start + len(words), [], []


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("batch", 4096))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((f, i << 40)) for i, f in enumerate(_files(self.path))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, first = partition.value
        yield from _read(name, _at(self.path)[0], first, self.batch)


class Word2VecSource(DataSource):
    """``spark.read.format("word2vec").load(path)``: a file, or all files of a directory, a task each; the path (or URI) has to be readable
    by the executors. A file can't be split, as words have no fixed length: write many (``save_word2vec``), or store it as Parquet."""

    @classmethod
    def name(cls) -> str:
        return "word2vec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, word, embedding`` in the order of the file, not normalised; the n-th file of a directory begins at n * 2**40."""
    spark.dataSource.register(Word2VecSource)
    return spark.read.format("word2vec").load(path)


def write_word2vec(rows: list[tuple[str, list[float]]], path: str) -> None:
    """A small file from (word, vector) rows, for exchange and tests."""
    with open(path, "wb") as f:
        f.write(f"{len(rows)} {len(rows[0][1]) if rows else 0}\n".encode())
        for word, v in rows:
            f.write(word.encode() + b" " + struct.pack(f"<{len(v)}f", *v) + b"\n")


def save_word2vec(rows: DataFrame, path: str) -> int:
    """A directory of files from ``word, embedding`` rows, written by the tasks that hold them (a file for each batch); the number of rows.
    Rows without word or embedding are left out; a task that runs again writes the same files. White space in a word becomes ``_``."""
    system, root = _at(path)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            pairs = [(w, v) for w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if pairs:
                with _at(path)[0].open_output_stream(f"{root}/part-{part:06}-{n:06}.bin", compression=None) as f:
                    f.write(f"{len(pairs)} {len(pairs[0][1])}\n".encode())
                    for word, v in pairs:
                        f.write("_".join(word.split()).encode() + b" " + np.asarray(v, "<f4").tobytes() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([len(pairs)])], names=["n"])

    usable = rows.filter(F.col("word").isNotNull() & F.col("embedding").isNotNull()).select("word", F.col("embedding").cast("array<float>"))
    return usable.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
