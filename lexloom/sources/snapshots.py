"""Tables that change together: staged Parquet and one manifest, renamed into place.

A commit writes the new files of all its tables first and then one manifest that
names them; readers follow the newest manifest. A crash before the rename leaves
the old state, whatever was staged; two writers cannot both take a version.

Tables are dealt into buckets by the hash of their key column. A commit rewrites
only the buckets that hold one of its keys, so a batch costs what it touches. A
commit is named by (writer, number), as a streaming query and its batch are; one
that is already in is not repeated.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import file_system

BUCKETS = 64
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer took the version; read the new state and commit again."""


@dataclass(frozen=True)
class Change:
    """Rows of one table: stored rows whose key is in ``keys`` go, ``rows`` come."""

    keys: DataFrame
    rows: DataFrame


class SnapshotStore:
    """Versioned tables below ``root``; ``keys``: the key column of each table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def _files(self, folder: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(f[:-5]) for f in self._files("manifests") if f.endswith(".json") and f[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, writers: last number of each, tables: {name: {schema, buckets: {bucket: folder}}}}."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "writers": {}, "tables": {}}
            version = found[-1]
        row = self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()
        return json.loads(row[0])

    def read(self, name: str, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """A table at a version (the newest by default); ``schema`` is that of a table never written."""
        return self._read(self.manifest(version)["tables"].get(name), schema)

    def _read(self, table: dict | None, schema: T.StructType | None = None, only: set[str] | None = None) -> DataFrame:
        own = T.StructType.fromJson(table["schema"]) if table else schema
        if own is None:
            raise LookupError("no such table")
        paths = [f"{self.root}/{p}" for b, p in sorted((table or {"buckets": {}})["buckets"].items()) if only is None or b in only]
        return self.spark.read.schema(own).parquet(*paths) if paths else self.spark.createDataFrame([], own)

    def commit(self, writer: str, number: int, changes: dict[str, Change]) -> int:
        """The version that holds the changes: all of them or, on any error, none."""
        head = self.manifest()
        if head["writers"].get(writer, -1) >= number:
            return head["version"]
        tables = dict(head["tables"])
        for name, change in changes.items():
            tables[name] = self._stage(name, tables.get(name), change)
        new = {"version": head["version"] + 1, "writers": head["writers"] | {writer: number}, "tables": tables}
        self._publish(new)
        return new["version"]

    def _stage(self, name: str, table: dict | None, change: Change) -> dict:
        key = self.keys[name]
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")
        keys = change.keys.select(key).unionByName(change.rows.select(key)).distinct()
        touched = {str(r[0]) for r in keys.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets`` rows
        if not touched:
            return table or {"schema": change.rows.schema.jsonValue(), "buckets": {}}
        old = self._read(table, change.rows.schema, touched)
        rows = old.join(keys, key, "left_anti").unionByName(change.rows, allowMissingColumns=True)
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        written = {f.partition("=")[2]: f"{folder}/{f}" for f in self._files(folder) if f.startswith(f"{BUCKET}=")}
        kept = {b: p for b, p in (table["buckets"] if table else {}).items() if b not in touched}
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        return {"schema": schema.jsonValue(), "buckets": kept | written}

    def _publish(self, manifest: dict) -> None:
        """Writes the manifest beside its place and renames it there, which fails if the place is taken."""
        jvm = self.spark.sparkContext._jvm
        final = f"{self.root}/manifests/{manifest['version']:012d}.json"
        fs, tmp = file_system(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, place = file_system(self.spark, final)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(place), none)
        except Exception as e:
            if fs.exists(place):
                raise Conflict(f"version {manifest['version']} was written by another commit") from e
            raise

    def vacuum(self, keep: int = 10) -> int:
        """Deletes manifests but the newest ``keep`` and the bucket folders that these do not name; returns how many folders.

        Not to be run beside a commit: what is staged is not named yet.
        """
        versions = self.versions()
        old, new = (versions[:-keep], versions[-keep:]) if keep else (versions, [])
        named = {p for v in new for t in self.manifest(v)["tables"].values() for p in t["buckets"].values()}
        found = [f"data/{name}/{f}/{b}" for name in self._files("data") for f in self._files(f"data/{name}") for b in self._files(f"data/{name}/{f}") if b.startswith(f"{BUCKET}=")]
        gone = [p for p in found if p not in named]
        for p in [*(f"manifests/{v:012d}.json" for v in old), *gone]:
            fs, path = file_system(self.spark, f"{self.root}/{p}")
            fs.delete(path, True)
        return len(gone)
