"""Tables whose rows lie in hash shards; a write rewrites the shards that it touches and no other.

A version is a manifest that names the folder of every shard. A write puts the
new rows of its shards into a folder of its own and commits by making the next
manifest, which only one writer can do. A writer that comes second keeps its
files if the first one touched other shards, and does its work again on the new
version if not, so no row is lost either way. Old files stay for readers and
``rollback`` until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.operators.records import delete_where, last_wins
from lodestone.sources.shared import exact_variants, written

#: Tries of a write that other writers overtake, and seconds between tries while one of them commits.
TRIES = 20
WAIT = 0.25


class Conflict(RuntimeError):
    """Other writers kept changing the same shards."""


@dataclass
class Manifest:
    """What a version consists of: the folders of each shard, relative to the table, and its rows; and the version that it followed."""

    version: int
    shards: int
    before: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


class ShardedTable:
    """A table with a key, under one folder. ``schema`` and ``shards`` are fixed by its first version."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", shards: int = 16, rows_per_file: int = 1_000_000):
        self.spark, self.root, self.key, self.rows_per_file = spark, root.rstrip("/"), key, rows_per_file
        self.empty = spark.createDataFrame([], schema)
        known = self.manifest()
        self.shards = known.shards if known.version else shards

    # Files

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _files(self):  # noqa: ANN202
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return []
        return sorted(int(x.getPath().getName()[1:-5]) for x in self._files.listStatus(folder) if x.getPath().getName().endswith(".json"))

    def _load(self, version: int) -> Manifest:
        stream = self._files.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, or the latest; version 0 is the empty table."""
        found = self._versions()
        at = version if version is not None else (found[-1] if found else 0)
        return self._load(at) if at else Manifest(0, getattr(self, "shards", 0))

    def _commit(self, manifest: Manifest) -> bool:
        """Make the manifest's file; False if another writer has made that version.

        The text is complete in a file of its own before the version's name is
        taken, and creating without overwriting lets one writer take it.
        """
        files, target = self._files, self._path(f"manifests/v{manifest.version:08d}.json")
        files.mkdirs(target.getParent())
        claim = self._path(f"claims/v{manifest.version:08d}")
        files.mkdirs(claim.getParent())
        try:
            files.create(claim, False).close()
        except Exception as error:  # noqa: BLE001 - the file system's own kinds of "exists"
            if files.exists(claim):
                return False
            raise error
        draft = self._path(f"claims/{uuid.uuid4().hex}")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        return files.rename(draft, target)

    # Reading

    def _shard(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast("string")), F.lit(self.shards)).cast("int")

    def _rows(self, manifest: Manifest, shards: list[int] | None = None) -> DataFrame:
        wanted = manifest.folders if shards is None else {str(s): manifest.folders.get(str(s), []) for s in shards}
        paths = [f"{self.root}/{p}" for folders in wanted.values() for p in folders]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest if none is named."""
        return self._rows(self.manifest(version))

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; only files of their shards are opened."""
        if not keys:
            return self.empty
        kind = self.empty.schema[self.key].dataType.simpleString()
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {kind}")
        shards = [r[0] for r in wanted.select(self._shard()).distinct().collect()]
        return self._rows(self.manifest(), shards).where(F.col(self.key).isin(keys))

    def stats(self) -> DataFrame:
        """(shard, n) of every shard, from the manifest; no data is read."""
        rows = self.manifest().rows
        return self.spark.createDataFrame([(s, int(rows.get(str(s), 0))) for s in range(self.shards)], "shard int, n long")

    # Writing

    def _write(self, rows: DataFrame, touched: list[int]) -> tuple[dict[str, list[str]], dict[str, int]]:
        """New folders of the touched shards, and their rows. Ranges of (shard, key hash) make files of bounded size, however large a shard is."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("shard_", self._shard()).withColumn("spread_", F.xxhash64(F.col(self.key).cast("string"), F.lit(1)))
        with exact_variants(self.spark):
            dealt.repartitionByRange("shard_", "spread_").drop("spread_").write.option("maxRecordsPerFile", self.rows_per_file).partitionBy("shard_").parquet(f"{self.root}/{name}")
        files = self._files
        counted = {s: 0 for s in touched}
        found = [s for s in touched if files.exists(self._path(f"{name}/shard_={s}"))]
        if found:
            counts = self.spark.read.schema(StructType([*self.empty.schema.fields, StructField("shard_", IntegerType())])).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/shard_={s}" for s in found)).groupBy("shard_").count()
            counted |= {r["shard_"]: r["count"] for r in counts.collect()}
        return {str(s): [f"{name}/shard_={s}"] if s in found else [] for s in touched}, {str(s): n for s, n in counted.items()}

    def _change(self, touched: list[int], make: Callable[[DataFrame], DataFrame | None]) -> int | None:
        """Replace the touched shards' rows by ``make`` of them; the new version, or None if ``make`` gives None."""
        ready: tuple | None = None
        base = self.manifest()
        for _ in range(TRIES):
            if ready is None:
                rows = make(self._rows(base, touched))
                if rows is None:
                    return None
                ready = self._write(rows, touched)
            folders, counts = ready
            following = Manifest(base.version + 1, self.shards, base.version, base.folders | folders, base.rows | counts)
            if self._commit(following):
                return following.version
            latest = self.manifest()
            if latest.version == base.version:  # its writer is about to make it, or dead
                time.sleep(WAIT)
                continue
            if any(latest.folders.get(str(s)) != base.folders.get(str(s)) for s in touched):
                ready = None
            base = latest
        raise Conflict(f"other writers came first {TRIES} times; see unfinished() if none is at work")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._shard()).distinct().collect())

    def upsert(self, rows: DataFrame, sequence: list[str]) -> int | None:
        """Rows by key; of several for one key the last of the sequence columns counts. The new version, or None without rows."""
        # Written first, so that rows without a key keep the one that they get, however often they are read.
        given = F.col(self.key).isNotNull() & (F.col(self.key).cast("string") != "")
        keyed = rows.withColumn(self.key, F.when(given, F.col(self.key)).otherwise(F.uuid())) if self.empty.schema[self.key].dataType.simpleString() == "string" else rows
        new = written(last_wins(keyed, [self.key], sequence).select(*self.empty.columns))
        touched = self._touched(new)
        if not touched:
            return None
        return self._change(touched, lambda old: old.join(new.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(new))

    def insert_absent(self, rows: DataFrame, sequence: list[str]) -> int | None:
        """Only keys that aren't there; of several rows for one the last of the sequence columns counts."""
        new = written(last_wins(rows, [self.key], sequence).select(*self.empty.columns))
        touched = self._touched(new)
        return self._change(touched, lambda old: old.unionByName(new.join(old.select(self.key), self.key, "left_anti").select(*old.columns))) if touched else None

    def update(self, rows: DataFrame, sequence: list[str]) -> bool:
        """Replace rows that are there; if any key isn't, nothing changes and the result is False."""
        new = written(last_wins(rows, [self.key], sequence).select(*self.empty.columns))
        touched = self._touched(new)
        if not touched:
            return True

        def make(old: DataFrame) -> DataFrame | None:
            if not new.join(old.select(self.key), self.key, "left_anti").isEmpty():
                return None
            return old.join(new.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(new)

        return self._change(touched, make) is not None

    def delete(self, keys: DataFrame) -> int | None:
        """The rows of these keys go; only their shards are rewritten."""
        gone = written(keys.select(self.key).distinct())
        touched = self._touched(gone)
        return self._change(touched, lambda old: old.join(gone, self.key, "left_anti").select(*old.columns)) if touched else None

    def delete_where(self, predicate: Column) -> int:
        """Rows that match go, from the shards that hold any; how many went."""
        hit = F.coalesce(predicate, F.lit(False))
        found = {r[0]: r[1] for r in self.read().where(hit).groupBy(self._shard()).count().collect()}
        if found:
            self._change(sorted(found), lambda old: delete_where(old, predicate))
        return sum(found.values())

    def clear(self) -> int:
        """A version without rows."""
        version = self._change(list(range(self.shards)), lambda old: self.empty)
        assert version is not None
        return version

    def rollback(self) -> bool:
        """Make the version that the current one followed current again, as a new version; whether there is one left."""
        base = self.manifest()
        if base.before not in self._versions():
            return False
        old = self._load(base.before)
        return self._commit(Manifest(base.version + 1, self.shards, old.before, old.folders, old.rows))

    def unfinished(self) -> bool:
        """Whether a writer took the next version's name and hasn't made its manifest; ``release`` frees it once that writer is known to be dead."""
        following = self.manifest().version + 1
        return self._files.exists(self._path(f"claims/v{following:08d}"))

    def release(self) -> bool:
        """Free the name that a dead writer took."""
        return self._files.delete(self._path(f"claims/v{self.manifest().version + 1:08d}"), False)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests but the last ``keep``, and the folders that none of these names, which nothing may be reading or writing; how many folders went."""
        files, found = self._files, self._versions()
        used = {p.split("/")[1] + "/" + p.split("/")[2] for v in found[-max(1, keep) :] for folders in self._load(v).folders.values() for p in folders}
        for v in found[: -max(1, keep)]:
            files.delete(self._path(f"manifests/v{v:08d}.json"), False)
            files.delete(self._path(f"claims/v{v:08d}"), False)
        gone = 0
        if files.exists(self._path("data")):
            for write in files.listStatus(self._path("data")):
                shards = [x.getPath() for x in files.listStatus(write.getPath()) if x.getPath().getName().startswith("shard_=")]
                old = [x for x in shards if f"{write.getPath().getName()}/{x.getName()}" not in used]
                gone += len(old)
                for x in old if len(old) < len(shards) else [write.getPath()]:
                    files.delete(x, True)
        return gone
