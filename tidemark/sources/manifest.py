"""File manifests and content hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import (
    AUDIO_TYPES,
    PHOTO_TYPES,
    VIDEO_TYPES,
    extension,
    file_name,
    media_kind,
    nice_title,
    short_id,
    stem,
)
from tidemark.session import cut

# entries of a folder that are passed on at once
LISTED = 10_000

# Directory names that are never descended into.
SKIPPED_DIRECTORIES = ["$RECYCLE.BIN", "System Volume Information", "@eaDir", "node_modules"]


def _opened(uri: str):
    """(file system, path) of a URI; a plain path is a local or mounted one."""
    from urllib.parse import quote

    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(quote(uri, safe=":/@?&=%"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder: (folder, path, size, mtime_ns)."""
    from pyarrow import fs

    names = ["folder", "path", "size", "mtime_ns"]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = _opened(uri)
            found = [x for x in store.get_file_info(fs.FileSelector(path)) if x.type in (fs.FileType.File, fs.FileType.Directory)]
            paths = [f"{uri.rstrip('/')}/{x.base_name}" for x in found]
            for low in range(0, len(found), LISTED):
                some = found[low : low + LISTED]
                columns = [pa.array([x.type == fs.FileType.Directory for x in some]), pa.array(paths[low : low + LISTED]), pa.array([x.size for x in some], pa.int64()), pa.array([x.mtime_ns for x in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)


def _with_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            store, path = _opened(batch.column(0)[i].as_py())
            with store.open_input_file(path) as file:
                content = pa.array([file.read()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, content], [*batch.schema.names, "content"])


def list_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, rel_path, size, mtime_ns[, content]) of all files below ``root``, hidden ones too.

    Spark's own lister leaves out names that start with '_' or '.'. Here the folders of one level are a
    table and are listed side by side, level by level, so that there are as many rounds as the tree is
    deep and the driver sees no names.
    """
    root = root.rstrip("/")
    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        found = cut(folders.mapInArrow(_entries, "folder boolean, path string, size bigint, mtime_ns bigint"))
        levels.append(found.where("not folder").drop("folder"))
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            break
        # folders of one parent come from one task
        folders = folders.repartition("path")
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    rows = files.select("path", F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path")).alias("rel_path"), "size", "mtime_ns")
    if not with_content:
        return rows
    return rows.repartition("path").mapInArrow(_with_content, "path string, rel_path string, size bigint, mtime_ns bigint, content binary")


def in_skipped_directory(rel_path: Column, skipped: list[str]) -> Column:
    folders = F.slice(F.split(rel_path, "/"), F.lit(1), F.size(F.split(rel_path, "/")) - 1)
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(skipped))


def media_files(files: DataFrame) -> DataFrame:
    """Supported files outside hidden and system folders, with name, extension and kind.

    Resource forks ('._*') are left out, other hidden files are kept.
    """
    rel = F.col("rel_path")
    return files.where(
        extension(rel).isin(PHOTO_TYPES + VIDEO_TYPES)
        & ~file_name(rel).startswith("._")
        & ~in_skipped_directory(rel, SKIPPED_DIRECTORIES)
    ).select(
        "*", file_name(rel).alias("filename"), extension(rel).alias("ext"), media_kind(rel).alias("kind")
    )


def audio_files(files: DataFrame) -> DataFrame:
    """Songs outside hidden folders: short id, title, path, size; sorted ignoring case."""
    rel = F.col("rel_path")
    return (
        files.where(
            extension(rel).isin(AUDIO_TYPES) & ~file_name(rel).startswith(".") & ~in_skipped_directory(rel, [])
        )
        .select(short_id(rel).alias("id"), nice_title(stem(rel)).alias("title"), "rel_path", "size")
        .orderBy(F.lower("rel_path"), "rel_path")
    )


def with_sha256(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256))
