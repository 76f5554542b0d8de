"""Keyed state in versions: each commit rewrites the buckets it touches, and a manifest names the files of every bucket.

A commit writes its buckets first and its manifest last, by one rename; readers take the newest manifest and so see one version. What a commit
that did not end has written is in no manifest, and the next commit that ends removes it. A read has one folder for each bucket, however many commits there were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class VersionedState:
    """Rows by key under a folder; ``merged`` makes one row for each key of old and new rows."""

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...], merged: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.merged, self.buckets = spark, folder.rstrip("/"), key, merged, buckets
        path = self._path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self._path(folder))] if self.files.exists(self._path(folder)) else []

    def manifest(self) -> dict | None:
        """The newest version, or None."""
        done = sorted(n for n in self._names(f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith("."))
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{done[-1]}", wholetext=True).first()[0]) if done else None

    def _read(self, manifest: dict | None, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of some buckets or all, None where there are none."""
        paths = [p for b, p in sorted((manifest or {"buckets": {}})["buckets"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*[f"{self.folder}/data/{p}" for p in paths]) if paths else None

    def rows(self) -> DataFrame | None:
        return self._read(self.manifest())

    def commit(self, batch: int, new: DataFrame) -> bool:
        """Merge new rows in as a batch; a batch that is in already, or is earlier than one that is, changes nothing."""
        before = self.manifest()
        if before and batch <= before["batch"]:
            return False
        own = new.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        name, schema = f"{batch:012d}-{uuid.uuid4().hex}", new.schema
        # the new rows first, so that the stream's input is read once
        own.write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}-new")
        touched = sorted(int(n.split("=")[1]) for n in self._names(f"{self.folder}/data/{name}-new") if n.startswith("_bucket="))
        paths = dict(before["buckets"]) if before else {}
        if touched:
            fresh = self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{name}-new/_bucket={b}" for b in touched])
            old = self._read(before, touched)
            both = fresh if old is None else old.unionByName(fresh)
            out = self.merged(both).select(*schema.names).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
            out.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
            paths |= {str(b): f"{name}/_bucket={b}" for b in touched}
        self._publish({"batch": batch, "schema": schema.jsonValue(), "buckets": paths})
        self._clean(paths)
        return True

    def _publish(self, manifest: dict) -> None:
        """The manifest under a name of its own, then by one rename under the batch's."""
        draft, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{manifest['batch']:012d}.json")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.files.rename(draft, final):
            raise RuntimeError(f"batch {manifest['batch']} has a manifest already")

    def _clean(self, paths: dict[str, str]) -> None:
        """Remove what no manifest names any more; the manifest before the newest stays, with its files, for those who read it now."""
        done = sorted(n for n in self._names(f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith("."))
        kept = set(paths.values())
        for n in done[-2:-1]:
            kept |= set(json.loads(self.spark.read.text(f"{self.folder}/manifests/{n}", wholetext=True).first()[0])["buckets"].values())
        for n in done[:-2]:
            self.files.delete(self._path(f"{self.folder}/manifests/{n}"), False)
        for n in self._names(f"{self.folder}/data"):
            inside = [x for x in self._names(f"{self.folder}/data/{n}") if x.startswith("_bucket=")]
            stay = [x for x in inside if f"{n}/{x}" in kept]
            for x in ([] if not stay else [x for x in inside if x not in stay]):
                self.files.delete(self._path(f"{self.folder}/data/{n}/{x}"), True)
            if not stay:
                self.files.delete(self._path(f"{self.folder}/data/{n}"), True)
