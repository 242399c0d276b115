"""Tables in hash buckets whose runs rewrite only the buckets that they touch.

A table is a folder: ``data/gm_version=N/gm_bucket=B`` holds the rows of bucket B
as run N left them, and ``commits/N.json`` says which version of each bucket
belongs to the table after run N. A run reads the buckets of its keys, writes
these under its number, and then puts its commit beside the others; until that
is there, readers see the version before. A run that comes again writes the same
version again. What is kept on the driver is one number for each bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, VERSION = "gm_bucket", "gm_version"


@dataclass(frozen=True)
class Buckets:
    """The table under ``folder`` with rows of ``schema`` (a DDL string), dealt
    by ``key`` to ``count`` buckets of up to ``files`` files each. Give so many buckets
    that one is a few gigabytes; their number can't change afterwards."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    schema: str
    count: int = 64
    files: int = 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.count)).cast("int")

    def _store(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the committed versions."""
        path, store = self._store(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows, after the newest run (before ``before``)."""
        there = [v for v in self.versions() if before is None or v < before]
        if not there:
            return {}
        text = self.spark.read.text(f"{self.folder}/commits/{max(there):012d}.json", wholetext=True).first()[0]
        told = json.loads(text)
        if told["count"] != self.count:
            raise ValueError(f"the table has {told['count']} buckets, not {self.count}")
        return {int(b): v for b, v in told["buckets"].items()}

    def _rows(self, buckets: dict[int, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/{VERSION}={v:012d}/{BUCKET}={b}" for b, v in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table after its newest run; without one, empty."""
        return self._rows(self.manifest())

    def merge(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> list[int]:
        """Run ``version``: the rows of the buckets that ``batch`` touches become
        ``how(old rows, batch)``, which must keep every key. Gives these buckets;
        an empty batch touches none and commits nothing."""
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # at most ``count``
        if touched:
            self._write(how(self._rows({b: v for b, v in self.manifest(version).items() if b in set(touched)}), batch), len(touched), version)
            self._commit(touched, version)
        return touched

    def _write(self, rows: DataFrame, touched: int, version: int) -> None:
        names = self.spark.createDataFrame([], self.schema).columns
        part = F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(self.files))
        dealt = rows.select(*names).withColumn(BUCKET, self.bucket()).repartition(touched * self.files, BUCKET, part)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/data/{VERSION}={version:012d}")

    def _commit(self, touched: list[int], version: int) -> None:
        """Puts the marker in place by a rename, so that it is there whole or not at all."""
        told = json.dumps({"count": self.count, "buckets": self.manifest(version) | dict.fromkeys(touched, version)})
        at, store = self._store(f"{self.folder}/commits/{version:012d}.json")
        aside, _ = self._store(f"{self.folder}/commits/_{version:012d}")
        out = store.create(aside, True)
        out.write(bytearray(told.encode()))
        out.close()
        if store.exists(at):
            store.delete(at, False)
        if not store.rename(aside, at):
            raise OSError(f"can't commit version {version} under {self.folder}")

    def vacuum(self) -> None:
        """Removes the data that the newest version doesn't read, and older commits."""
        kept, newest = {(v, b) for b, v in self.manifest().items()}, max(self.versions(), default=0)
        data, store = self._store(f"{self.folder}/data")
        for folder in store.listStatus(data) if store.exists(data) else []:
            version = int(folder.getPath().getName().split("=")[1])
            for part in store.listStatus(folder.getPath()) if version <= newest else []:
                name = part.getPath().getName()
                if name.startswith(BUCKET) and (version, int(name.split("=")[1])) not in kept:
                    store.delete(part.getPath(), True)
        for v in self.versions():
            if v < newest:
                store.delete(self._store(f"{self.folder}/commits/{v:012d}.json")[0], False)
