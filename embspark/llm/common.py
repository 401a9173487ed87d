"""Helpers shared by the text operators: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch are handled in slices of about this many bytes of text.
SLICE_BYTES = 8 << 20
#: Estimates of a table's bytes beyond this say nothing; it is Spark's own for a table that it knows nothing of.
UNKNOWN_BYTES = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
    none is set and Spark runs in this one process (tests, notebooks) is a temporary
    one chosen. On a cluster without that setting this is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="embspark-checkpoint-"))
    return with_bounded_size(df.checkpoint())


def with_bounded_size(cut: DataFrame) -> DataFrame:
    """A checkpointed table, without its estimated size if that is beyond any table's.

    A checkpoint keeps the estimate of the plan it cuts, and that of a join is the product
    of its sides'. Where joins and checkpoints follow each other in a loop, the number of
    its digits is multiplied in every round, until they fill the driver's memory.
    """
    plan, session, jvm = cut._jdf.logicalPlan(), cut.sparkSession, cut.sparkSession._jvm
    try:
        if plan.stats().sizeInBytes() <= UNKNOWN_BYTES:
            return cut
    except ValueError:  # more digits than Python reads
        pass
    none, own = jvm.scala.Option.empty(), session._jsparkSession
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), own, none, none)
    return type(cut)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, bare), session)


def width(df: DataFrame) -> int:
    """Number of shuffle partitions of the session, for keyed repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``most`` bytes of text; no row is split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
