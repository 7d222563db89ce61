"""Checkpoints in the folder that driver and executors share, and keyed writes of the knowledge tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; sets a folder only where none is set, in local mode alone: elsewhere no other machine sees it."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="annalist-")
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder as compressed columns and read from there.

    A later plan knows the size of the files, where that of a checkpoint is guessed from the plan before it and can be far too low, so that
    a large table is broadcast; rows take a fraction of a checkpoint's space.
    """
    return _stored(df, "cut")


def _stored(df: DataFrame, name: str) -> DataFrame:
    with_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple, tuple[str, object]] = {}


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """What tells one state of some Parquet tables from another: their files and the time of their folder."""
    out = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        out.append((path, status.getModificationTime(), hash(tuple(sorted(spark.read.parquet(path).inputFiles())))))
    return tuple(out)


def once(spark: SparkSession, key: tuple, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build gives, written to the shared folder at its first use in this application and read from there afterwards.

    key: what the table depends on (see ``fingerprint``); a changed input gives a new table.
    """
    known = (spark.sparkContext.applicationId, key, name)
    if known not in _kept:
        with_checkpoints(spark)
        df, path = build(), f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        _kept[known] = (path, df.schema)
    path, schema = _kept[known]
    return spark.read.schema(schema).parquet(path)


def kept(spark: SparkSession, key: tuple, name: str) -> bool:
    """Whether ``once`` has written a table in this application."""
    return (spark.sparkContext.applicationId, key, name) in _kept


def upsert(old: DataFrame, new: DataFrame, key: str = "id", kept: tuple[str, ...] = ("created_at",), version: str = "version") -> DataFrame:
    """old with new's rows put in by key: the last version wins; the kept columns stay as they were first written.

    Both ends come from one aggregate, which combines on the map side, so a key that many rows share is no hot task.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    at = F.struct("_new", version)
    rest = [c for c in old.columns if c != key]
    firsts = [F.min_by(F.struct(c), at).alias(f"_{c}") for c in kept]
    rows = both.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_last"), *firsts)
    return rows.select(key, *[F.col(f"_{c}.{c}").alias(c) if c in kept else F.col(f"_last.{c}").alias(c) for c in rest]).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and those rows of new (one per key) whose key old lacks."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def replace_modules(entities: DataFrame, relations: DataFrame, modules: DataFrame, new_entities: DataFrame, new_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces all of some modules: their entities, and the relations that touch one at either end."""
    gone = entities.join(modules, "module", "left_semi").select("id")
    kept = relations.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return entities.join(modules, "module", "left_anti").select(*entities.columns).unionByName(new_entities), kept.select(*relations.columns).unionByName(new_relations)


def replace_partition(df: DataFrame, path: str, by: str = "repository_id") -> None:
    """Overwrites the partitions that df has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows without those of the given sources (source_id)."""
    return rows.join(sources.select("source_id"), "source_id", "left_anti").select(*rows.columns)
