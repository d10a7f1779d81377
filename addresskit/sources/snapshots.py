"""Partitioned tables in committed snapshots: append, upsert, rollback, retention, truncate.

A snapshot is a manifest, one row per folder of rows: the values of its partition, the folder, its number of rows. Folders
are written once and never changed. A change writes new folders for the partitions it touches and a manifest that takes
over the folders of all others; the manifest's ``_SUCCESS`` is the commit, so readers see a change whole or not at all,
and a writer that dies leaves folders that nobody refers to. One writer at a time. Rows are range-partitioned by partition and order columns
and sorted inside each file, so a hot partition is spread over several files of disjoint ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import upsert


class SnapshotTable:
    """A table of ``schema`` under ``root``, partitioned by ``partition`` and sorted by ``order``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, partition: Sequence[str], order: Sequence[str]):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.partition, self.order = list(partition), list(order)
        self.manifest_schema = T.StructType([*(schema[c] for c in partition), T.StructField("folder", T.StringType()),
                                             T.StructField("rows", T.LongType())])

    # ---------------------------------------------------------------- versions
    def _files(self, pattern: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, fs.globStatus(path) or []

    def versions(self) -> list[int]:
        """Numbers of the committed snapshots, ascending."""
        _, found = self._files(f"{self.root}/manifest/v*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in found)

    def _before(self, version: int | None) -> int | None:
        return max((v for v in self.versions() if version is None or v < version), default=None)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The manifest of a snapshot (the newest one if none is named); empty where there is none."""
        version = self._before(None) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.manifest_schema)
        return self.spark.read.schema(self.manifest_schema).parquet(f"{self.root}/manifest/v{version:09d}")

    # ------------------------------------------------------------------ reading
    def read(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """Rows of a snapshot; ``where`` on the partition columns leaves out folders before anything is listed."""
        m = self.manifest(version)
        return self._folders(m if where is None else m.where(where))

    def _folders(self, manifest: DataFrame) -> DataFrame:
        paths = sorted(r["folder"] for r in manifest.select("folder").collect())  # as many as there are partitions, not rows
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # ------------------------------------------------------------------ writing
    def _write(self, rows: DataFrame) -> DataFrame:
        """``rows`` in new folders; their part of a manifest."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        part = F.md5(F.to_json(F.struct(*self.partition)))
        ranges = [*self.partition, *self.order]
        laid = rows.select(*self.schema.names).repartitionByRange(*ranges).withColumn("_part", part)
        # the folder comes first, or the writer would sort by it anew
        laid.sortWithinPartitions("_part", *self.order).write.partitionBy("_part").parquet(folder)
        new = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_part", T.StringType())])).parquet(folder)
        return new.groupBy(*self.partition, "_part").agg(F.count(F.lit(1)).alias("rows")).select(
            *self.partition, F.concat(F.lit(f"{folder}/_part="), "_part").alias("folder"), "rows")

    def _commit(self, manifest: DataFrame, version: int | None) -> int:
        """A number after all others, finished or not, or the named one, which a retry replaces."""
        if version is None:
            _, found = self._files(f"{self.root}/manifest/v*")
            version = 1 + max((int(s.getPath().getName()[1:]) for s in found), default=-1)
        kept = manifest.select(*self.manifest_schema.names).coalesce(1)
        kept.write.mode("overwrite").parquet(f"{self.root}/manifest/v{version:09d}")
        return version

    def _touched(self, rows: DataFrame) -> DataFrame:
        """The partitions of ``rows``, found once: as many as there are partitions, not rows."""
        found = rows.select(*self.partition).distinct().collect()
        return self.spark.createDataFrame(found, T.StructType([self.schema[c] for c in self.partition]))

    def _without(self, manifest: DataFrame, partitions: DataFrame) -> DataFrame:
        p = partitions.select(*[F.col(c).alias(f"_{c}") for c in self.partition])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.partition]
        return manifest.join(p, same, "left_anti")

    def _base(self, version: int | None) -> DataFrame:
        before = self._before(version)
        return self.manifest(before) if before is not None else self.spark.createDataFrame([], self.manifest_schema)

    def append(self, rows: DataFrame, version: int | None = None, check: Callable[[int], None] | None = None) -> int:
        """``rows`` added; no folder is rewritten. ``check`` gets the number of rows written and may raise: no commit then."""
        base, new = self._base(version), self._write(rows)
        if check is not None:
            check(new.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        return self._commit(base.unionByName(new), version)

    def replace(self, partitions: DataFrame, rows: DataFrame, version: int | None = None) -> int:
        """The folders of ``partitions`` give way to ``rows``; rows of other partitions are added to them."""
        base = self._base(version)
        return self._commit(self._without(base, partitions).unionByName(self._write(rows)), version)

    def upsert(self, rows: DataFrame, key: str, update: Sequence[str], order: str, version: int | None = None) -> int:
        """The partitions that hold a key of ``rows`` are rewritten, new keys are added to theirs.

        ``order`` names a column of ``rows`` that says which row of a key is the last.
        """
        base = self._base(version)
        if base.isEmpty():
            return self._commit(self._write(upsert(self._folders(base), rows, key, update, order)), version)
        keys = rows.select(key).distinct()
        kept = self._without(base, self._touched(self._folders(base).join(keys, key, "left_semi")))
        current = self._folders(self._without(base, kept))
        return self._commit(kept.unionByName(self._write(upsert(current, rows, key, update, order))), version)

    def delete(self, condition: Column, version: int | None = None) -> int:
        """Rows that meet ``condition`` go; only partitions that hold one are rewritten."""
        base = self._base(version)
        gone = F.coalesce(condition, F.lit(False))
        kept = self._without(base, self._touched(self._folders(base).where(gone)))
        left = self._folders(self._without(base, kept)).where(~gone)
        return self._commit(kept.unionByName(self._write(left)), version)

    def drop(self, condition: Column, version: int | None = None) -> int:
        """Partitions that meet ``condition`` (``lit(True)``: all) leave the manifest; nothing is rewritten."""
        return self._commit(self._base(version).where(~F.coalesce(condition, F.lit(False))), version)

    def expire(self, keep: int = 2) -> int:
        """Deletes all but the newest ``keep`` snapshots and the folders that none of these refers to; returns how many.

        Not to be run beside a writer: folders of a change that is not committed yet are referred to by nobody.
        """
        versions = self.versions()
        stay = versions[-keep:]
        used = {r["folder"] for v in stay for r in self.manifest(v).select("folder").collect()}
        fs, found = self._files(f"{self.root}/data/*/_part=*")
        old = [s.getPath() for s in found if not any(s.getPath().toString().endswith(u.split(":", 1)[-1]) for u in used)]
        _, manifests = self._files(f"{self.root}/manifest/v*")
        old += [s.getPath() for s in manifests if int(s.getPath().getName()[1:]) not in stay]
        for path in old:
            fs.delete(path, True)
        return len(old)


class RejectBudgetExceeded(RuntimeError):
    """more rows were rejected than a load may lose."""


def within_budget(processed: int, budget: int) -> Callable[[int], None]:
    """A check for ``append``: of ``processed`` rows at most ``budget`` may be missing from what was written."""

    def check(written: int) -> None:
        if processed - written > budget:
            raise RejectBudgetExceeded(f"{processed - written} of {processed} rows rejected, at most {budget} may be")

    return check
