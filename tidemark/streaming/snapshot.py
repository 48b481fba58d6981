"""A table that micro-batches change bucket by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def committed(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers N of the folders ``name=N`` that a writer has finished, in order."""
    return sorted(int(x.partition("=")[2]) for x in _children(spark, folder) if x.startswith(f"{name}=") and "_SUCCESS" in _children(spark, f"{folder}/{x}"))


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> list[str]:
    store, hadoop = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(hadoop)] if store.exists(hadoop) else []


def remove(spark: SparkSession, path: str) -> None:
    store, hadoop = _store(spark, path)
    store.delete(hadoop, True)


class BucketedSnapshot:
    """Rows by key, dealt to buckets by hash: a base of each bucket, and the changes that came after it.

    ``base/upto=N/bucket=B`` is all of bucket B after batch N, ``delta/batch=N/bucket=B`` what batch N changed in it.
    A folder counts once its writer has finished it. A batch reads the buckets its keys fall into, writes a delta
    of its changed rows, and only a bucket with ``max_deltas`` deltas is written anew. A batch that is
    repeated after a failure reads what was there before it (``before``) and writes the same folders again;
    what bases of earlier batches have replaced is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 64, max_deltas: int = 8):
        self.spark, self.folder, self.schema, self.keys = spark, folder, schema, keys
        self.buckets, self.max_deltas = buckets, max_deltas
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)

    def start(self, rows: DataFrame) -> None:
        self._write(rows.select(*self.columns), f"{self.folder}/base/upto=-1")

    def _numbers(self, kind: str) -> dict[int, list[int]]:
        """Buckets of every finished folder of ``kind``; there are as many as deltas are left to merge."""
        top, name = f"{self.folder}/{kind}", {"base": "upto", "delta": "batch"}[kind]
        found = {n: _children(self.spark, f"{top}/{name}={n}") for n in committed(self.spark, top, name)}
        return {n: [int(x.partition("=")[2]) for x in names if x.startswith("bucket=")] for n, names in found.items()}

    def _layout(self, before: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """(newest base of each bucket, (batch, bucket) of the deltas after it), both before a batch."""
        base = {b: n for n, held in sorted(self._numbers("base").items()) if n < before for b in held}
        deltas = [(n, b) for n, held in self._numbers("delta").items() if n < before for b in held if n > base.get(b, -1)]
        return base, deltas

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """All rows as they were before a batch, of some buckets or all."""
        base, deltas = self._layout(before)
        wanted = (lambda b: True) if buckets is None else set(buckets).__contains__
        whole = self._load([f"{self.folder}/base/upto={n}/bucket={b}" for b, n in base.items() if wanted(b)], self.schema)
        paths = [f"{self.folder}/delta/batch={n}/bucket={b}" for n, b in deltas if wanted(b)]
        if not paths:
            return whole
        others = [c for c in self.columns if c not in self.keys]
        changed = self._load(paths, f"{self.schema}, _batch bigint")
        newest = changed.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row")).select(*self.keys, "_row.*")
        return whole.join(newest, self.keys, "left_anti").unionByName(newest).select(*self.columns)

    def append(self, rows: DataFrame, batch: int) -> None:
        self._write(rows.select(*self.columns, F.lit(batch).cast("bigint").alias("_batch")), f"{self.folder}/delta/batch={batch}")

    def compact(self, batch: int) -> list[int]:
        """Write the buckets with many deltas anew; which they are."""
        _, deltas = self._layout(batch + 1)
        counts: dict[int, int] = {}
        for _, b in deltas:
            counts[b] = counts.get(b, 0) + 1
        full = sorted(b for b, n in counts.items() if n >= self.max_deltas)
        if full:
            self._write(self.read(batch + 1, full), f"{self.folder}/base/upto={batch}")
        return full

    def purge(self, batch: int) -> None:
        """Delete what no batch from ``batch`` on reads."""
        base, _ = self._layout(batch)
        for kind, name in (("base", "upto"), ("delta", "batch")):
            for n, held in self._numbers(kind).items():
                old = [b for b in held if n < base.get(b, -1) or (kind == "delta" and n == base.get(b, -1))]
                for b in old:
                    remove(self.spark, f"{self.folder}/{kind}/{name}={n}/bucket={b}")
                if n < batch and len(old) == len(held):
                    remove(self.spark, f"{self.folder}/{kind}/{name}={n}")
