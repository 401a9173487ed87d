"""Serving-side accounting: shards, response frames, wire bytes, replica versions, cache and checkpoint schedules."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the wire format: message header, count field, rows of a response chunk.
HEADER, COUNT, CHUNK = 12, 4, 64


def shard(feat_id: Column, n: int) -> Column:
    return F.pmod(feat_id, F.lit(n))


def pull_frames(responses: DataFrame) -> DataFrame:
    """``responses(request, nth, dim)``: rows and bytes of each streamed frame; the first one also carries the total."""
    rows = responses.withColumn("chunk", F.floor(F.col("nth") / CHUNK).cast("long"))
    out = rows.groupBy("request", "chunk").agg(F.count("*").alias("n_rows"), F.sum(4 + 4 * F.col("dim")).alias("body"))
    size = F.col("body") + COUNT + F.when(F.col("chunk") == 0, COUNT).otherwise(0)
    return out.select("request", "chunk", "n_rows", size.cast("long").alias("frame_bytes"))


def wire_bytes(responses: DataFrame) -> DataFrame:
    """Bytes of each pull request and its response, and of a push of the rows found."""
    found = F.when(F.col("dim") > 0, 12 + 4 * F.col("dim")).otherwise(0)
    sums = responses.groupBy("request").agg(F.count("*").alias("n"), F.sum(4 + 4 * F.col("dim")).alias("body"), F.sum(found).alias("push"))
    fixed = HEADER + COUNT
    return sums.select("request", (8 * F.col("n") + fixed).alias("pull_request"), (F.col("body") + fixed).cast("long").alias("pull_response"), (F.col("push") + fixed).cast("long").alias("push_request"))


def as_of(reads: DataFrame, versions: DataFrame, width: int) -> DataFrame:
    """``reads(t, ...)`` with the greatest ``version`` published at or before t; ``versions(t, version)``.

    Time is cut into buckets of ``width``. Each starts from the last version before it
    (one row a bucket), and within a bucket reads and versions are merged in order.
    """
    bucket = F.floor(F.col("t") / width).cast("long")
    reads = reads.withColumn("bucket", bucket)
    per = versions.groupBy(bucket.alias("bucket")).agg(F.max("version").alias("last"))
    carried = F.max("last").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    both = per.join(reads.select("bucket").distinct(), "bucket", "full").withColumn("carried", carried)
    starts = both.select("bucket", "carried")
    merged = reads.withColumn("version", F.lit(None).cast("long")).withColumn("is_read", F.lit(1)).unionByName(
        versions.withColumn("bucket", bucket).withColumn("is_read", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy("bucket").orderBy("t", "is_read").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("own", F.max("version").over(order)).where("is_read = 1").drop("version", "is_read")
    return merged.join(starts, "bucket").withColumn("version", F.coalesce("own", "carried")).drop("own", "carried", "bucket")


def lru_hits(accesses: DataFrame, capacity: int, shards: int = 1) -> DataFrame:
    """``shard, n_accesses, n_hits`` of ``accesses(pos, feat_id)``: one LRU cache of ``capacity`` for each shard of ids.

    A cache sees its accesses in order, so a shard is one sorted stream; a task holds the cache alone.
    """
    rows = accesses.select("pos", "feat_id", shard(F.col("feat_id"), shards).alias("shard"))

    def run(batches):
        caches: dict[int, OrderedDict] = {}
        counts: dict[int, list[int]] = {}
        for b in batches:
            for key, s in zip(b.column("feat_id").to_pylist(), b.column("shard").to_pylist(), strict=True):
                cache, n = caches.setdefault(s, OrderedDict()), counts.setdefault(s, [0, 0])
                n[0] += 1
                if key in cache:
                    n[1] += 1
                    cache.move_to_end(key)
                else:
                    cache[key] = None
                    if len(cache) > capacity:
                        cache.popitem(last=False)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()]), pa.array([c[1] for c in counts.values()])], names=["shard", "n_accesses", "n_hits"])

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "pos")
    return dealt.mapInArrow(run, "shard long, n_accesses long, n_hits long")


def hot_set(accesses: DataFrame, k: int) -> DataFrame:
    counts = accesses.groupBy("feat_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "feat_id").limit(k)


def ticks_fired(ticks: DataFrame, step: int, flush_every: int, checkpoint_every: int) -> DataFrame:
    """``ticks(tick)`` at ``step`` ms: those at which a flush or a checkpoint is due, each counted from its last."""
    period = lambda every: -(-every // step)
    fired = ticks.where("tick > 0").select(
        "tick", (F.col("tick") % period(flush_every) == 0).alias("flush"), (F.col("tick") % period(checkpoint_every) == 0).alias("checkpoint")
    )
    return fired.where("flush or checkpoint")


def single_flight(requests: DataFrame, length: int) -> DataFrame:
    """Requests (``seq``) that come in one window of ``length`` are served by one checkpoint."""
    return requests.groupBy(F.floor(F.col("seq") / length).cast("long").alias("checkpoint_id")).agg(F.count("*").alias("n_requests"), F.min("seq").alias("first_seq"))


def lineage(checkpoints: DataFrame, width: int = 4096) -> DataFrame:
    """``checkpoints(generation, is_full)`` with ``base``, the last full one at or before, and ``chain``, the deltas since."""
    fulls = checkpoints.where("is_full").select(F.col("generation").alias("t"), F.col("generation").alias("version"))
    out = as_of(checkpoints.withColumn("t", F.col("generation")), fulls, width)
    return out.select("generation", "is_full", F.col("version").alias("base"))


def purgeable(checkpoints: DataFrame) -> DataFrame:
    """Deltas that the last full checkpoint covers."""
    last = checkpoints.where("is_full").agg(F.max("generation").alias("full"))
    return checkpoints.where("not is_full").join(F.broadcast(last), F.col("generation") <= F.col("full")).select("generation")


def zipf(spark, dims: list[int], alpha: float) -> DataFrame:
    """``dim, low, cdf``: the share of each dim by its rank, added up; the last is 1."""
    weights = [(i + 1) ** -alpha for i in range(len(dims))]
    ends = [sum(weights[: i + 1]) / sum(weights) for i in range(len(dims))]
    ends[-1] = 1.0
    return spark.createDataFrame(list(zip(dims, [0.0, *ends[:-1]], ends, strict=True)), "dim int, low double, cdf double")
