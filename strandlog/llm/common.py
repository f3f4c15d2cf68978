"""Shared helpers: table access, scratch tables, bounded batches, hashing folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract here: space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Spark's setting that drops shuffle files when a query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a Python batch holds before it is worked on.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names.

    Only where that setting is absent (tests, one machine) is a local folder
    used and set for the session.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/strandlog"
        context.setCheckpointDir(root)
    # A path without a scheme belongs to the cluster's default file system.
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def store_fs(uri: str):
    """The file system and path of a folder in any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage in a way that survives lost executors, and gives the reader
    exact sizes and column pruning. The shuffle files of the write are dropped
    when it ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*scratch: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing will read again."""
    for df in scratch:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(*cols: Column | str) -> Column:
    """A stable number in [0, 1) from the columns, for deterministic samples; give doc_id and text, as ids may be null or repeat."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12) / F.lit(float(1 << 52))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression.

    A lambda variable is bound once per row, whereas a projected column can be
    inlined again by the optimizer wherever it is used.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text (null: none) as an array, JVM-side."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bounded(batches: Iterator, limit: int = BATCH_BYTES, column: str = "text") -> Iterator:
    """Slice Arrow batches so that each holds about ``limit`` bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < n:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def doc_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text as UTF-8 bytes (null: empty), nothing else."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
