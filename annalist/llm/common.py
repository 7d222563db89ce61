"""Helpers that the operators share: the shared folder, table access, text slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, beside single longer texts.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing a temporary folder is set once per session, in local mode alone: elsewhere no other machine sees it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the lineage so that
    what follows survives lost executors without computing ``df`` again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(filesystem, path) of a folder for workers; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])


def publish(uri: str, data: bytes) -> None:
    """Writes a whole file under a temporary name and renames it.  With ``attempt`` in the name no two attempts of a task write the same
    file, and only those that a finished task lists are read."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temp, compression=None) as out:
        out.write(data)
    files.move(temp, path)


def attempt() -> str:
    """A name for files of this attempt of a task; names of later partitions sort later."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId():08d}"


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about SLICE_BYTES with their text as UTF-8 bytes and row offsets; null texts are empty."""
    texts = batch.column(column).cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function of one RecordBatch that returns lists or arrays by column name."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def with_clear_names(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns: extra columns, whatever their names, can't clash with the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def named(docs: DataFrame):
    """docs' columns by their exact names, whatever characters they hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def with_statistics(docs: DataFrame, text: str, names: tuple[str, ...], measure) -> tuple[DataFrame, str]:
    """docs with one struct column of a double for each name, and that column's name, which no other column has.

    ``measure`` takes the bytes and offsets of texts and returns a row of numbers per text.  All other columns pass through as
    they are, in the JVM, so rows need no join.
    """
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    def measured(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        found = [measure(data, offsets) for _, data, offsets in text_slices(batch, 0)]
        return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, len(names))), columns=list(names))

    measured.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    measured = F.pandas_udf(measured, StructType([StructField(n, DoubleType()) for n in names]))
    column, taken = "measured", {c.lower() for c in docs.columns}
    while column in taken:
        column += "_"
    return docs.select(*named(docs), measured(F.col(f"`{text}`").cast("string")).alias(column)), column
