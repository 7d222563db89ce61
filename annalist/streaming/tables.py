"""Keyed tables in a folder that several changes move together.

A table's rows lie in buckets by a hash of its key.  A change writes new files for the buckets that it touches, for all its tables, and then one
numbered entry of the log, which lists the files of every bucket.  The highest whole entry counts: readers see all of a change or nothing,
and a crash at any step leaves the entry before it in force.  An entry also holds the last batch of each stream, so a batch that runs again after
its entry was written changes nothing.  One writer at a time; files of older entries stay until ``vacuum``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Tables:
    """The tables below a folder.  buckets: how many each has; a change rewrites the touched ones, so tables of many rows want many."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _entries(self) -> list[int]:
        """Numbers of the log's whole entries."""
        files, path = self._files()
        log = path(f"{self.root}/_log")
        if not files.exists(log):
            return []
        found = [x.getPath() for x in files.listStatus(log)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(path(f"{p}/_SUCCESS")))

    def snapshot(self) -> Snapshot:
        entries = self._entries()
        if not entries:
            return Snapshot(self, 0, {}, {}, {})
        rows = self.spark.read.schema("kind string, name string, bucket int, value string").json(f"{self.root}/_log/{entries[-1]:010d}").collect()  # a row per bucket
        of = lambda kind: [r for r in rows if r.kind == kind]
        return Snapshot(self, entries[-1], {(r.name, r.bucket): r.value for r in of("bucket")}, {r.name: r.value for r in of("schema")}, {r.name: int(r.value) for r in of("stream")})

    def read(self, name: str) -> DataFrame | None:
        return self.snapshot().read(name)

    def change(self, stream: str = "", batch: int = -1) -> Change | None:
        """A change to fill and commit; None where this batch of the stream is in the tables already."""
        now = self.snapshot()
        return None if batch >= 0 and now.streams.get(stream, -1) >= batch else Change(now, stream, batch)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes log entries but the last ones and the files that none of these names: how many files' folders went."""
        files, path = self._files()
        entries = self._entries()
        for number in entries[:-keep]:
            files.delete(path(f"{self.root}/_log/{number:010d}"), True)
        used = set()
        for number in entries[-keep:]:
            rows = self.spark.read.schema("kind string, value string").json(f"{self.root}/_log/{number:010d}").where("kind = 'bucket'").select("value").distinct().collect()
            used |= {r.value for r in rows}
        gone = 0
        for table in files.listStatus(path(self.root)):
            if table.getPath().getName() != "_log":
                for version in files.listStatus(table.getPath()):
                    for bucket in files.listStatus(version.getPath()):
                        place = "/".join([table.getPath().getName(), version.getPath().getName(), bucket.getPath().getName()])
                        if bucket.isDirectory() and place not in used:
                            gone += files.delete(bucket.getPath(), True)
        return gone


class Snapshot:
    """The tables as one log entry has them."""

    def __init__(self, tables: Tables, number: int, places: dict, schemas: dict, streams: dict):
        self.tables, self.number, self.places, self.schemas, self.streams = tables, number, places, schemas, streams

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None where there is no such table."""
        if name not in self.schemas:
            return None
        spark, schema = self.tables.spark, StructType.fromJson(json.loads(self.schemas[name]))
        paths = [f"{self.tables.root}/{p}" for (n, b), p in sorted(self.places.items()) if n == name and (buckets is None or b in buckets)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class Change:
    """What a change writes; nothing of it is seen before ``commit``."""

    def __init__(self, before: Snapshot, stream: str, batch: int):
        self.before, self.number, self.written = before, before.number + 1, []
        self.places, self.schemas, self.streams = dict(before.places), dict(before.schemas), before.streams | ({stream: batch} if batch >= 0 else {})

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.before.tables.buckets)).cast("int")

    def touched(self, rows: DataFrame, *key: str) -> list[int]:
        """The buckets that rows' keys lie in (at most as many as there are)."""
        return sorted(r[0] for r in rows.select(self.bucket(*key).alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as this change leaves it."""
        return Snapshot(self.before.tables, self.number, self.places, self.schemas, self.streams).read(name, buckets)

    def replace(self, name: str, rows: DataFrame, buckets: list[int], *by: str) -> None:
        """Puts rows in place of all that some buckets hold; by: the columns that deal rows into buckets."""
        tables = self.before.tables
        version = f"v{self.number:010d}"
        out = f"{tables.root}/{name}/{version}"
        self.schemas[name] = rows.schema.json()
        rows.withColumn("_bucket", self.bucket(*by)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(out)
        files, path = tables._files()
        made = {int(x.getPath().getName().rpartition("=")[2]) for x in files.listStatus(path(out)) if x.isDirectory() and "=" in x.getPath().getName()}
        if made - set(buckets):
            raise ValueError(f"rows outside the buckets: {sorted(made - set(buckets))}")
        for b in buckets:
            self.places.pop((name, b), None)
            if b in made:
                self.places[(name, b)] = f"{name}/{version}/_bucket={b}"

    def put(self, name: str, bucket: int, rows: DataFrame) -> None:
        """Writes one bucket whole, for tables whose buckets are no hashes."""
        place = f"{name}/v{self.number:010d}/_bucket={bucket}"
        if self.places.get((name, bucket)) == place:  # written before in this change, and perhaps read by rows
            place += f"-{sum(1 for p in self.written if p.startswith(place))}"
        self.written.append(place)
        self.schemas[name] = rows.schema.json()
        rows.write.mode("overwrite").parquet(f"{self.before.tables.root}/{place}")
        self.places[(name, bucket)] = place

    def merge(self, name: str, rows: DataFrame, key: str = "id", gone: DataFrame | None = None) -> None:
        """Puts rows in by key, with the time of their first version as created_at; of several rows of one key in a change the greatest stays.

        gone: keys to take out.  Only the buckets of the keys are read and written.
        """
        stamp = F.lit(self.number).cast("long")
        columns = sorted(c for c in rows.columns if c != key)
        new = rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("r")).select(key, "r.*").withColumn("created_at", stamp).withColumn("version", stamp)
        keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
        buckets = self.touched(keys, key)
        old = self.read(name, buckets)
        if old is not None:
            first = old.select(F.col(key).alias("_key"), F.col("created_at").alias("_first"))
            new = new.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_key", "_first")
            new = old.join(keys.distinct(), key, "left_anti").select(*new.columns).unionByName(new)
        self.replace(name, new, buckets, key)

    def commit(self) -> None:
        """Writes the log's entry.  An entry of this number that a crash left half-written is no entry and is written anew."""
        tables = self.before.tables
        if self.number in tables._entries():
            raise RuntimeError(f"entry {self.number} of {tables.root} exists: there is another writer")
        rows = [("bucket", n, b, p) for (n, b), p in self.places.items()] + [("schema", n, None, s) for n, s in self.schemas.items()] + [("stream", n, None, str(b)) for n, b in self.streams.items()]
        tables.spark.createDataFrame(rows, "kind string, name string, bucket int, value string").coalesce(1).write.mode("overwrite").json(f"{tables.root}/_log/{self.number:010d}")
