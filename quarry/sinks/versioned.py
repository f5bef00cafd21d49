"""A keyed chunk table in buckets of files and numbered versions.

A version is a small manifest that names the data folders of every bucket. A write adds folders for the
buckets it touches and then creates the next manifest, which fails if it exists; readers keep theirs. The
newest manifest that can be read counts, so a crash at any point leaves the version before it.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normal_path


class VersionedTable:
    """Manifests ``_manifests/000001.json`` ... and data ``data/v000001/bucket=7`` ... under ``folder`` on any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self._buckets = spark, folder.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests
    def _manifest(self, version: int) -> dict | None:
        """A version's manifest; None where it is missing or was not written to its end."""
        path = self._path(f"{self.folder}/_manifests/{version:06d}.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.folder}/_manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """Newest complete version; 0 before the first write."""
        return next((n for n in reversed(self._numbers()) if self._manifest(n)), 0)

    def _publish(self, manifest: dict) -> int:
        """Create the next manifest; of two writers at once the later one fails, with its data unseen."""
        number = max(self._numbers(), default=0) + 1
        stream = self._fs.create(self._path(f"{self.folder}/_manifests/{number:06d}.json"), False)
        stream.write(bytearray(json.dumps(manifest | {"version": number, "at": int(time.time())}).encode()))
        stream.close()
        return number

    # -- data
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(normal_path(F.col("filepath"))), F.lit(self._buckets)).cast("int")

    def _write(self, df: DataFrame, files: int = 1) -> dict[str, list[str]]:
        """Rows into a folder of their own, one part a bucket (times ``files``): bucket -> folders."""
        name = f"data/{int(time.time() * 1000):x}-{self.version() + 1:06d}"
        out = df.withColumn("bucket", self._bucket())
        spread = ["bucket"] if files == 1 else ["bucket", F.pmod(F.xxhash64("id"), F.lit(files))]
        out.repartition(*spread).write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        found = self._fs.listStatus(self._path(f"{self.folder}/{name}"))
        return {f.getPath().getName()[7:]: [f"{name}/{f.getPath().getName()}"] for f in found if f.getPath().getName().startswith("bucket=")}

    def _parts(self, parts: dict[str, list[str]], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        folders = [f"{self.folder}/{x}" for xs in parts.values() for x in xs]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        m = self._manifest(version or self.version())
        if m is None:
            raise ValueError("no such version")
        return self._parts(m["parts"], m["schema"])

    def overwrite(self, df: DataFrame) -> int:
        return self._publish({"parts": self._write(df), "schema": df.schema.json(), "buckets": self._buckets})

    def append(self, df: DataFrame) -> int:
        """New rows beside the old ones; no old file is read."""
        current = self._current(df)
        parts, new = dict(current["parts"]), self._write(df.select(*[f["name"] for f in json.loads(current["schema"])["fields"]]))
        for bucket, folders in new.items():
            parts[bucket] = parts.get(bucket, []) + folders
        return self._publish(current | {"parts": parts})

    def _current(self, df: DataFrame) -> dict:
        m = self._manifest(self.version())
        if m is None:
            return {"parts": {}, "schema": df.schema.json(), "buckets": self._buckets}
        self._buckets = m["buckets"]
        return m

    def replace_files(self, rows: DataFrame, paths: DataFrame) -> int:
        """Rows of the given files replaced by ``rows``; none for a file deletes it. Repeated ids and rows of other files are refused.

        Only the buckets of the given files are read and written.
        """
        bad = rows.groupBy("id").count().where("count > 1").limit(1).count() or rows.join(paths.select(normal_path(F.col("filepath")).alias("_p")).distinct(), normal_path(F.col("filepath")) == F.col("_p"), "left_anti").limit(1).count()
        if bad:
            raise ValueError("repeated ids, or rows of files that aren't replaced")
        current = self._current(rows)
        touched = {str(r[0]) for r in paths.select(self._bucket()).distinct().collect()}  # at most the number of buckets
        old = self._parts({b: current["parts"].get(b, []) for b in touched}, current["schema"])
        new = self._write(replaced(old, rows.select(*old.columns), paths))
        kept = {b: f for b, f in current["parts"].items() if b not in touched}
        return self._publish(current | {"parts": kept | new})

    def delete_files(self, paths: DataFrame) -> int:
        return self.replace_files(self.read().limit(0), paths)

    # -- upkeep
    def compact(self, partitions: int = 1, keep: int | None = None, days: int | None = None) -> int:
        """Rewrite into ``partitions`` files a bucket; drop versions beyond the ``keep`` newest, or older than ``days`` (0 to 3650), and data that none names."""
        now = self._manifest(self.version())
        new = self._publish(now | {"parts": self._write(self.read(), partitions)})
        for old in self._numbers():
            m = self._manifest(old)
            aged = days is not None and (m is None or m["at"] <= time.time() - 86400 * min(3650, max(0, days)))
            if old != new and (keep is not None and old <= new - max(1, keep) or aged):
                self._fs.delete(self._path(f"{self.folder}/_manifests/{old:06d}.json"), False)
        used = {x.split("/")[1] for n in self._numbers() for xs in (self._manifest(n) or {"parts": {}})["parts"].values() for x in xs}
        for f in self._fs.listStatus(self._path(f"{self.folder}/data")):
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)
        return new

    def status(self) -> dict:
        current = self.read()
        files = current.inputFiles()
        versions = [n for n in self._numbers() if self._manifest(n)]
        return {"version": self.version(), "versions": len(versions), "oldest": min(versions, default=0), "rows": current.count(), "fragments": len(files), "bytes": sum(self._fs.getFileStatus(self._path(f)).getLen() for f in files)}

    def restore(self, version: int) -> int:
        """An older version as the newest; its data stays where it is."""
        m = self._manifest(version)
        if m is None:
            raise ValueError("no such version")
        return self._publish(m)

    # -- snapshots
    def snapshot(self, target: str) -> dict:
        """A copy of the current version with the SHA-256 of every file."""
        m = self._manifest(self.version())
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = self._path(target).getFileSystem(conf)
        for folders in m["parts"].values():
            for x in folders:
                jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(f"{self.folder}/{x}"), fs, self._path(f"{target}/{x}"), False, conf)
        listing = {"manifest": m, "files": self._digests(target)}
        stream = fs.create(self._path(f"{target}/snapshot.json"), False)
        stream.write(bytearray(json.dumps(listing).encode()))
        stream.close()
        return listing

    def _digests(self, folder: str) -> dict[str, str]:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{folder}/data")
        place = F.regexp_extract("path", r"(data/.*)$", 1)
        return {r[0]: r[1] for r in files.select(place, F.sha2("content", 256)).collect()}  # one short row a file of the snapshot

    def restore_snapshot(self, source: str) -> int:
        """The table of a snapshot as the newest version, after its files have been verified; ValueError where one differs or is missing."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = self._path(source).getFileSystem(conf)
        stream = fs.open(self._path(f"{source}/snapshot.json"))
        listing = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if self._digests(source) != listing["files"]:
            raise ValueError("the snapshot is damaged")
        m = listing["manifest"]
        kind = T.StructType.fromJson(json.loads(m["schema"]))
        folders = [f"{source}/{x}" for xs in m["parts"].values() for x in xs]
        return self.overwrite(self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind))


def replaced(old: DataFrame, rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The table after a replacement by file: rows of other files stay. Paths compare normalised."""
    gone = paths.select(normal_path(F.col("filepath")).alias("_p")).distinct()
    return old.join(gone, normal_path(F.col("filepath")) == F.col("_p"), "left_anti").unionByName(rows)


_PACKED = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("text", pa.binary()), ("files", pa.int64())])


def fingerprint(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(fingerprint, files) of a source tree: the first 16 digits of the SHA-256 over its ``path NUL hash`` lines in order of path.

    Ranges of paths are sorted in parallel and packed to a text a batch; one task hashes the texts in order as
    they stream by, for the hash of one text is sequential, and holds none but the last. Null paths take no part.
    """
    lines = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.concat_ws("\0", path, digest).alias("line"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"part": [part], "batch": [k], "text": ["\n".join(batch.column("line").to_pylist()).encode()], "files": [batch.num_rows]}, _PACKED)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for text, files in zip(batch.column("text"), batch.column("files").to_pylist(), strict=True):
                whole.update(b"\n" if n else b"")
                whole.update(text.as_buffer())
                n += files
        yield pa.RecordBatch.from_pydict({"fingerprint": [whole.hexdigest()[:16]], "files": [n]})

    packed = lines.repartitionByRange("path").sortWithinPartitions("path", "line").mapInArrow(pack, "part int, batch int, text binary, files long")
    total = packed.repartition(1).sortWithinPartitions("part", "batch").select("text", "files").mapInArrow(hashed, "fingerprint string, files long")
    # an empty tree may have no task at all; it has the hash of the empty text
    return total.agg(F.coalesce(F.max("fingerprint"), F.lit(hashlib.sha256().hexdigest()[:16])).alias("fingerprint"), F.coalesce(F.max("files"), F.lit(0)).alias("files"))


def wide_fingerprint(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(fingerprint) of a tree of any size: 16 hexadecimal digits that change with any path or hash, another value than ``fingerprint``.

    The sorted ``path NUL hash`` lines are hashed in 65 536 buckets of the path's hash, then the
    sorted bucket hashes, so that no task holds all files. An empty tree has the hash of the empty text.
    """
    bucket = F.substring(F.sha2(F.col(path), 256), 1, 4).alias("bucket")
    lines = files.where(F.col(path).isNotNull()).groupBy(bucket).agg(F.sort_array(F.collect_list(F.concat_ws("\0", path, digest))).alias("lines"))
    parts = lines.select(F.concat_ws(":", "bucket", F.sha2(F.array_join("lines", "\n"), 256)).alias("part"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256), 1, 16).alias("fingerprint"))


def keep_snapshots(entries: list[tuple[str, int]], most: int, quota: int) -> list[str]:
    """Names kept of snapshots (name, bytes), newest first: while fewer than ``most`` are kept and the quota holds; one too large is skipped, the newest always stays."""
    kept, used = [], 0
    for k, (name, size) in enumerate(entries):
        if k == 0 or len(kept) < most and used + size <= quota:
            kept.append(name)
            used += size
    return kept


def last_events(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of an audit log."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def optimistic_upsert(old: DataFrame, change: DataFrame, cap: int = 500) -> DataFrame:
    """Records (id, updated_at, ...) after changes (id, expected, ...): applied where the record is new or still has the expected time; at most ``cap``, newest first."""
    joined = change.join(old.select("id", F.col("updated_at").alias("_have")), "id", "left")
    ok = joined.where(F.col("_have").isNull() | F.col("_have").eqNullSafe(F.col("expected"))).drop("_have", "expected")
    both = old.join(ok.select("id"), "id", "left_anti").unionByName(ok)
    return both.orderBy(F.desc("updated_at"), "id").limit(cap)
