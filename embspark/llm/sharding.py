"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Only DataFrame functions touch the rows. The driver draws one matrix of fixed shape:
how many rows each source bucket sends to each shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint, documents

#: Source buckets (rows of the matrix) and buckets inside a shard.
SOURCES, INNER = 1024, 256


def communication_matrix(sent: np.ndarray, received: np.ndarray, seed: int) -> np.ndarray:
    """A random matrix with these row and column sums, as a uniform permutation would give it."""
    rng, left = np.random.default_rng(seed), received.astype(np.int64).copy()
    out = np.zeros((len(sent), len(received)), np.int64)
    for p, n in enumerate(sent):
        out[p] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= out[p]
    return out


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs(doc_id, text, ...)``.

    Law ``rows``: shard sizes differ by one at most, and every arrangement of the rows
    over shards and slots is equally likely. Rows are dealt into ``SOURCES`` buckets by
    hash; the matrix says how many of a bucket's rows go to each shard; a random order
    inside the bucket says which; after the exchange a random order inside the shard
    gives the slots, gapless from 0. All draws follow from ``seed`` and the rows, so a
    lost task gives the same rows again. Null text: size 16, checksum 0. Null ids and
    repeated rows take part like any other. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = ("doc_id", "size", "text_crc32")

    def draw(k: int) -> Column:
        return F.xxhash64(F.lit(seed * 8 + k), *own)

    rows = checkpoint(rows.withColumn("source", F.pmod(draw(0), F.lit(SOURCES)).cast("int")))
    sent = np.zeros(SOURCES, np.int64)
    for r in rows.groupBy("source").count().collect():
        sent[r["source"]] = r["count"]
    n = int(sent.sum())
    received = np.full(shards, n // shards)
    received[np.random.default_rng(seed).permutation(shards)[: n % shards]] += 1
    ends = np.cumsum(communication_matrix(sent, received, seed), axis=1)
    matrix = docs.sparkSession.createDataFrame([(p, e) for p, e in enumerate(ends.tolist())], "source int, ends array<long>")

    first = Window.partitionBy("source").orderBy(draw(1), *own)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")
    dealt = rows.withColumn("place", F.row_number().over(first) - 1).join(F.broadcast(matrix), "source")
    dealt = checkpoint(dealt.select(*own, shard.alias("shard"), F.pmod(draw(2), F.lit(INNER)).cast("int").alias("inner")))

    ahead = Window.partitionBy("shard").orderBy("inner").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "inner").count().select("shard", "inner", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    second = Window.partitionBy("shard", "inner").orderBy(draw(3), *own)
    out = dealt.withColumn("place", F.row_number().over(second) - 1).join(F.broadcast(starts), ["shard", "inner"])
    return out.select(
        *own, F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir), 40)
