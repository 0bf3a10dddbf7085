"""A table that changes: bucketed Parquet, and a manifest for each version that says which folders hold each bucket.

A change rewrites the buckets that hold its keys and no others, an append only adds folders; either then publishes a manifest by a rename that fails where the version is
taken. So readers see whole versions only, a writer that lost the race finds out and starts again, and old versions stay readable. On an
object store without atomic renames, publish through its conditional writes instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIES = 5


class Taken(Exception):
    """Another writer published the version first."""


@dataclass
class Versions:
    """``keys`` name a row, ``columns`` is a DDL string, ``buckets`` says how finely changes are kept apart."""

    spark: SparkSession
    path: str
    columns: str
    keys: tuple[str, ...]
    buckets: int = 16

    def __post_init__(self) -> None:
        self.schema: StructType = self.spark.createDataFrame([], self.columns).schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[int, str]:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return {int(n[1:]): n for n in names if n.startswith("v") and n[1:].isdigit()}

    def version(self) -> int:
        """The latest version; 0 before the first change."""
        return max(self._manifests(), default=0)

    def _manifest(self, version: int) -> dict[int, list[str]]:
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/v{version}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; ``only``: of these buckets."""
        manifest = self._manifest(self.version() if version is None else version)
        paths = [p for b, held in sorted(manifest.items()) if only is None or b in only for p in held]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _publish(self, version: int, manifest: dict[int, list[str]]) -> None:
        jvm, fs = self._fs()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{name}")
        draft = path(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(path(f"v{version}")), never)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Taken(f"version {version}") from e
            raise

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        jvm, fs = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))]
        return {int(n.removeprefix("bucket=")): [f"{folder}/{n}"] for n in found if n.startswith("bucket=")}

    def append(self, rows: DataFrame, base: int) -> int:
        """Publishes version ``base`` + 1 with ``rows`` added. Where another writer was first, raises ``Taken``: what was worked out from ``base`` may no longer hold."""
        manifest, made = self._manifest(base), self._write(rows)
        self._publish(base + 1, {b: [*manifest.get(b, []), *made.get(b, [])] for b in {*manifest, *made}})
        return base + 1

    def change(self, touched: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> int:
        """Publishes the version in which ``rewrite`` has replaced the rows of every bucket that ``touched`` (the keys) falls into, and
        returns its number. ``rewrite`` gets those rows as they stand and may only return rows of the same buckets. Nothing touched: no new
        version. A lost race starts again from what the winner left."""
        hit = sorted(r[0] for r in touched.select(self.bucket().alias("b")).distinct().collect())
        if not hit:
            return self.version()
        for attempt in range(TRIES):
            base = self.version()
            manifest = self._manifest(base)
            made = self._write(rewrite(self.read(base, hit)))
            try:
                self._publish(base + 1, {b: p for b, p in manifest.items() if b not in hit} | made)
                return base + 1
            except Taken:
                if attempt == TRIES - 1:
                    raise
        raise AssertionError

    def upsert(self, batch: DataFrame, merged: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Rows of the batch replace those of equal keys; keys are never null. ``merged`` may compute the new rows from a join that holds the batch's columns
        and the stored row as struct ``old`` (null if there is none)."""

        def rewrite(stored: DataFrame) -> DataFrame:
            old = stored.select(*self.keys, F.struct(*stored.columns).alias("old"))
            new = batch.join(old, list(self.keys), "left")
            new = merged(new) if merged else new.drop("old")
            kept = stored.join(batch.select(*self.keys), list(self.keys), "left_anti")
            return kept.select(*self.schema.names).unionByName(new.select(*self.schema.names))

        return self.change(batch.select(*self.keys), rewrite)

    def update_from(self, changes: DataFrame, **columns) -> int:
        """Sets ``columns`` (expressions over the row and the matching row of ``changes`` as struct ``new``) where a change has the row's keys; changes hold a key once."""
        new = changes.select(*self.keys, F.struct(*changes.columns).alias("new"))

        def rewrite(stored: DataFrame) -> DataFrame:
            met = stored.join(new, list(self.keys), "left")
            return met.select(*[F.when(F.col("new").isNotNull(), columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in self.schema.names])

        return self.change(changes.select(*self.keys), rewrite)

    def delete_using(self, gone: DataFrame) -> int:
        """Drops the rows whose keys ``gone`` holds."""
        return self.change(gone.select(*self.keys), lambda stored: stored.join(gone.select(*self.keys).distinct(), list(self.keys), "left_anti"))
