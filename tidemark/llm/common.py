"""Helpers shared by the operators: reading tables, Arrow texts, shared folders, files of a shared store."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ensure_checkpoint_dir

# Bytes of text that a Python worker holds at once beside its Arrow batch.
CHUNK_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` bytes (a longer text is a range by itself)."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the store that the driver and all executors share."""
    return posixpath.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, codec: str = "zstd", level: int = 3) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) of a URI in the shared store; a plain path is a local or mounted one."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write: Callable) -> None:
    """Write a whole file under another name, then move it: repeated or lost tasks leave no partial file."""
    store, path = filesystem(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, path)
