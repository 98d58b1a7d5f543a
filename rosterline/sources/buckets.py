"""A table kept as hash buckets that batches add to (used by X1 and X5).

A batch writes one version folder with the rows it changed, one sub-folder a
bucket: ``v=<place>-<run>-<batch>/b=<bucket>``.  What is current in a bucket is
``merge`` of all its versions, so a batch writes in proportion to its own rows
and reads the buckets it touches, never the whole table.  When a bucket has more than
``compact_after`` versions it is merged into one, in a version of its own; the
folders that it replaces stay for readers that hold them and go with the next
compaction.  So the number of folders stays bounded, and each row is rewritten
once in ``compact_after`` batches that touch its bucket.

A version counts once its ``_SUCCESS`` file is there.  Names hold the run and the
batch id, so a replayed batch is known; what a failed one left behind is
overwritten by its replay.  Beside the data, ``ids`` has the largest id of each list
per version, so the next ids need no scan of the table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["BucketStore", "newest_per"]

_COMPACT = "compact"


def newest_per(*identity: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the row of the newest version for each identity."""
    def merge(df: DataFrame) -> DataFrame:
        last = df.groupBy(*identity).agg(F.max("_place").alias("_last"))
        on = [F.col(c).eqNullSafe(F.col(f"_i{i}")) for i, c in enumerate(identity)] + [F.col("_place") == F.col("_last")]
        return df.join(last.select("_last", *[F.col(c).alias(f"_i{i}") for i, c in enumerate(identity)]), on, "left_semi")
    return merge


class BucketStore:
    """``keys`` place a row in its bucket; a NULL among them is a value of its own, ``spread`` deals such rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame] | None = None,
                 buckets: int = 64, compact_after: int = 8, spread: str | None = None):
        self.spark, self.path, self.keys, self.merge = spark, path, keys, merge
        self.n, self.compact_after, self.spread = buckets, compact_after, spread

    # --- folders --------------------------------------------------------------

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _glob(self, pattern: str) -> list[str]:
        """Paths below the store that match."""
        jvm = self.spark._jvm
        found = self._fs().globStatus(jvm.org.apache.hadoop.fs.Path(self.path, pattern))
        if found is None:
            return []
        return [p.toString() for p in jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)]

    def _delete(self, name: str) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path, name), True)

    @staticmethod
    def place_of(version: str) -> int:
        return int(version[2:].split("-")[0])

    def versions(self) -> list[str]:
        """Names of the committed versions, oldest first."""
        names = [m[1] for p in self._glob("v=*/_SUCCESS") if (m := re.search(r"(v=[^/]+)/_SUCCESS$", p))]
        return sorted(names, key=self.place_of)

    def folders(self, versions: list[str] | None = None) -> dict[int, list[str]]:
        """Bucket to the committed versions that have rows in it, oldest first, replaced ones included."""
        done = set(self.versions() if versions is None else versions)
        out: dict[int, list[str]] = {}
        for p in self._glob("v=*/b=*"):
            m = re.search(r"(v=[^/]+)/b=(\d+)$", p)
            if m and m[1] in done:
                out.setdefault(int(m[2]), []).append(m[1])
        return {b: sorted(vs, key=self.place_of) for b, vs in out.items()}

    @staticmethod
    def _current(vs: list[str]) -> list[str]:
        """The versions of a bucket from its last compaction on."""
        last = max((i for i, v in enumerate(vs) if _COMPACT in v), default=0)
        return vs[last:]

    # --- reading --------------------------------------------------------------

    def bucket_of(self, keys: list[Column] | None = None) -> Column:
        cols = keys or [F.col(k) for k in self.keys]
        if self.spread:
            cols = [*cols[:-1], F.coalesce(cols[-1].cast("string"), F.col(self.spread).cast("string"))]
        return F.pmod(F.xxhash64(*[c.cast("string") for c in cols]), F.lit(self.n)).cast("int")

    def _load(self, dirs: list[str]) -> DataFrame:
        df = self.spark.read.option("basePath", self.path).parquet(*dirs)
        return df.withColumn("_place", F.regexp_extract("v", r"^(\d+)", 1).cast("bigint")).drop("v", "b")

    def raw(self, buckets: list[int] | None = None, folders: dict[int, list[str]] | None = None) -> DataFrame | None:
        """Rows of all current versions, with ``_place``, not merged; None if there are none."""
        at = self.folders() if folders is None else folders
        dirs = [f"{self.path}/{v}/b={b}" for b, vs in at.items() if buckets is None or b in set(buckets) for v in self._current(vs)]
        return self._load(dirs) if dirs else None

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The current rows; buckets of one version are read as they are."""
        at = {b: vs for b, vs in self.folders().items() if buckets is None or b in set(buckets)}
        one = self.raw(folders={b: vs for b, vs in at.items() if len(self._current(vs)) == 1})
        more = self.raw(folders={b: vs for b, vs in at.items() if len(self._current(vs)) > 1})
        if more is not None and self.merge is not None:
            more = self.merge(more)
        parts = [p.drop("_place") for p in (one, more) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def touched(self, batch: DataFrame, keys: list[Column] | None = None) -> list[int]:
        """The buckets that a batch's keys fall into: at most ``buckets`` numbers."""
        return [r[0] for r in batch.select(self.bucket_of(keys).alias("b")).distinct().collect()]

    def largest_ids(self) -> DataFrame | None:
        """(list_id, base): the largest id of each list."""
        done = self.versions()
        last = max((i for i, v in enumerate(done) if _COMPACT in v), default=0)
        dirs = [f"{self.path}/ids/{v}" for v in done[last:]]
        if not dirs:
            return None
        return self.spark.read.schema("list_id bigint, base bigint").parquet(*dirs).groupBy("list_id").agg(F.max("base").alias("base"))

    # --- writing --------------------------------------------------------------

    @staticmethod
    def mark(run: str) -> str:
        return hashlib.sha256(run.encode()).hexdigest()[:16]

    def has(self, run: str, batch_id: int) -> bool:
        return any(v.split("-")[1:] == [self.mark(run), str(batch_id)] for v in self.versions())

    def _write(self, rows: DataFrame, version: str, ids: DataFrame | None) -> None:
        if ids is not None:
            ids.write.mode("overwrite").parquet(f"{self.path}/ids/{version}")
        (rows.withColumn("b", self.bucket_of()).repartition("b").write.mode("overwrite")
         .partitionBy("b").parquet(f"{self.path}/{version}"))

    def add(self, rows: DataFrame, run: str, batch_id: int, with_ids: bool = False) -> str:
        """Writes the rows a batch changed as a version and compacts what has grown too many of them."""
        done = self.versions()
        place = self.place_of(done[-1]) + 1 if done else 0
        version = f"v={place:08d}-{self.mark(run)}-{batch_id}"
        ids = rows.groupBy("list_id").agg(F.max("id").alias("base")) if with_ids else None
        self._write(rows, version, ids)
        self.compact(with_ids)
        return version

    def compact(self, with_ids: bool = False) -> list[int]:
        """Merges the buckets of more than ``compact_after`` versions into one; returns their numbers."""
        done = self.versions()
        at = self.folders(done)
        many = [b for b, vs in at.items() if len(self._current(vs)) > self.compact_after]
        if not many:
            return []
        rows = self.raw(many, at)
        if self.merge is not None:
            rows = self.merge(rows)
        place = self.place_of(done[-1]) + 1
        self._write(rows.drop("_place"), f"v={place:08d}-{_COMPACT}-{place}", self.largest_ids() if with_ids else None)
        self._forget(done, at)
        return many

    def _forget(self, done: list[str], at: dict[int, list[str]]) -> None:
        """Deletes what compactions before the one just written have replaced, and versions left without rows."""
        left = {v: 0 for v in done}
        for b, vs in at.items():
            keep = set(self._current(vs))
            for v in vs:
                if v in keep:
                    left[v] += 1
                else:
                    self._delete(f"{v}/b={b}")
        newest: dict[str, str] = {}
        for v in done:
            newest[v.split("-")[1]] = v       # a run may replay its last batch only
        last = max((i for i, v in enumerate(done) if _COMPACT in v), default=0)
        for i, v in enumerate(done):
            if not left[v] and newest[v.split("-")[1]] != v:
                self._delete(v)
            if i < last:
                self._delete(f"ids/{v}")
