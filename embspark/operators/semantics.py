"""What puts, deletes and lookups mean, as functions from DataFrames to DataFrames.

A mutation log has ``seq, op ('P' or 'D'), feat_id, dim`` and any value columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESERVED = 0


def accepted(rows: DataFrame, value: str) -> DataFrame:
    """Rows that a put takes: the reserved id and null vectors are skipped, not errors."""
    return rows.where((F.col("feat_id") != RESERVED) & F.col(value).isNotNull())


def batch_get(requests: DataFrame, store: DataFrame, columns: Sequence[str] = ("embedding",)) -> DataFrame:
    """One row for each request (``pos, feat_id``), duplicates too; a miss has dim 0 and null columns.

    The store side is wide, so it is reduced to the requested ids before the join back to places.
    """
    wanted = requests.where(F.col("feat_id") != RESERVED).select("feat_id").distinct()
    found = store.join(wanted, "feat_id", "left_semi").select("feat_id", "dim", *columns)
    return requests.join(found, "feat_id", "left").select("pos", "feat_id", F.coalesce("dim", F.lit(0)).alias("dim"), *columns)


def preview(rows: DataFrame, n: int = 4) -> DataFrame:
    """``feat_id, nth, value``: the first ``n`` elements of each vector, counted from 1."""
    return rows.select("feat_id", F.posexplode(F.slice("embedding", 1, n)).alias("at", "value")).select("feat_id", (F.col("at") + 1).cast("long").alias("nth"), "value")


def of_dims(rows: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Rows of these dims alone; on a store's files a filter of partitions."""
    return rows.where(F.col("dim").isin([int(d) for d in dims]))


def cache_split(requests: DataFrame, cache: DataFrame, store: DataFrame, columns: Sequence[str] = ("embedding",)) -> DataFrame:
    """``batch_get`` through a read cache: ids that ``cache`` holds are answered from it, the others alone are looked up; ``source`` says which.

    A cached row wins over the store's. ``source`` is "cache", "store", or "none" for a miss.
    """
    hit = batch_get(requests, cache, columns)
    cached = hit.where("dim > 0").withColumn("source", F.lit("cache"))
    rest = batch_get(hit.where("dim = 0").select("pos", "feat_id"), store, columns)
    return cached.unionByName(rest.withColumn("source", F.when(F.col("dim") > 0, "store").otherwise("none")))


def row_checksums(rows: DataFrame, body: Column | None = None) -> DataFrame:
    """``rows`` with ``checksum``: MD5 of id, dim and ``body`` (the vector's text if none is given), for deltas that are verified when they are read."""
    if body is None:
        body = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",", "null")
    return rows.withColumn("checksum", F.md5(F.concat_ws("|", F.col("feat_id").cast("string"), F.col("dim").cast("string"), body.cast("string")).cast("binary")))


def corrupt_rows(rows: DataFrame, body: Column | None = None) -> DataFrame:
    """Rows whose ``checksum`` is not that of their contents."""
    return row_checksums(rows.withColumnRenamed("checksum", "_told"), body).where("not (checksum <=> _told)").drop("_told")


def probe(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Dims of the requested ids, without reading a vector."""
    return batch_get(requests, store.select("feat_id", "dim"), ())


def anti_delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Store rows that are left; missing ids and the reserved one are ignored."""
    return store.join(ids.where(F.col("feat_id") != RESERVED), "feat_id", "left_anti")


def last_write(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = ("feat_id",)) -> DataFrame:
    """The last row of each key by ``order``: one shuffle, partly aggregated before it."""
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")


def latest_live(log: DataFrame) -> DataFrame:
    """Rows of ids whose last operation is a put; for logs in which no id changes its dim."""
    return last_write(log, ["seq"]).where("op = 'P'").drop("op")


def apply_log(log: DataFrame) -> DataFrame:
    """The live rows after a log, whatever it holds.

    Deletes cut each id's history into segments. The first put of a segment fixes the
    dim, puts with another are rejected, and the last accepted put of the last segment is the row.
    """
    so_far = Window.partitionBy("feat_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = log.where(F.col("feat_id") != RESERVED).withColumn("segment", F.sum(F.when(F.col("op") == "D", 1).otherwise(0)).over(so_far))
    whole = Window.partitionBy("feat_id")
    puts = cut.withColumn("last_segment", F.max("segment").over(whole)).where("op = 'P' and segment = last_segment")
    first = Window.partitionBy("feat_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    puts = puts.withColumn("live_dim", F.first("dim").over(first)).where("dim = live_dim")
    return last_write(puts.drop("segment", "last_segment", "live_dim", "op"), ["seq"])


def put_status(puts: DataFrame, registered: Sequence[int]) -> DataFrame:
    """``puts(batch, pos, feat_id, dim, ...)`` with a ``status`` for each row.

    A batch is taken in ascending dim. From the first unregistered dim on it is INVALID;
    among the rest an id keeps the dim it was first stored with, other dims are DIM_MISMATCH.
    Where a batch stops is a partial aggregate (one row for each batch that does), so one
    large batch is not one task's.
    """
    unknown = ~F.col("dim").isin([int(d) for d in registered])
    stops = puts.where(unknown).groupBy("batch").agg(F.min("dim").alias("_stop"))
    rows = puts.join(stops, "batch", "left").withColumn("invalid", F.coalesce(F.col("dim") >= F.col("_stop"), F.lit(False)))
    tried = F.when(~F.col("invalid"), F.col("dim"))
    order = Window.partitionBy("feat_id").orderBy("batch", "dim", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = F.first(tried, ignorenulls=True).over(order)
    status = F.when(F.col("invalid"), "INVALID").when(F.col("dim") != live, "DIM_MISMATCH").otherwise("OK")
    return rows.withColumn("status", status).select(*puts.columns, "status")


def put_batch_status(batch: DataFrame, live: DataFrame, registered: Sequence[int]) -> DataFrame:
    """``batch(pos, feat_id, dim, ...)`` with a ``status`` for each row, taken as one batch against ``live(feat_id, dim)``.

    Ids are joined to the dims they have; no window sees the batch as a whole.
    """
    stop = batch.where(~F.col("dim").isin([int(d) for d in registered])).agg(F.min("dim")).first()[0]
    invalid = F.lit(False) if stop is None else F.col("dim") >= stop
    now = live.select("feat_id", F.col("dim").alias("_now"))
    first = batch.where(~invalid).groupBy("feat_id").agg(F.min("dim").alias("_first"))
    rows = batch.join(first, "feat_id", "left").join(now, "feat_id", "left")
    status = F.when(invalid, "INVALID").when(F.col("dim") != F.coalesce("_now", "_first"), "DIM_MISMATCH").otherwise("OK")
    return rows.withColumn("status", status).select(*batch.columns, "status")


def batch_status(rows: DataFrame) -> DataFrame:
    """The batch's own code: the last status in its order that is not OK."""
    order = F.when(F.col("status") != "OK", F.struct("dim", "pos"))
    return rows.groupBy("batch").agg(F.coalesce(F.max_by("status", order), F.lit("OK")).alias("status"))


def registered_dims(puts: DataFrame) -> DataFrame:
    """``batch, n_dims``: dims known after each batch if new ones are registered on first use."""
    first = puts.groupBy("dim").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new"))
    # as many rows with a new dim as there are dims; each batch looks up the last one at or before it
    known = first.select("batch", F.sum("new").over(Window.orderBy("batch")).alias("n"), F.lead("batch").over(Window.orderBy("batch")).alias("until"))
    batches = puts.select("batch").distinct().alias("b")
    at = (F.col("b.batch") >= F.col("k.batch")) & (F.col("k.until").isNull() | (F.col("b.batch") < F.col("k.until")))
    return batches.join(F.broadcast(known.alias("k")), at).select("b.batch", F.col("k.n").alias("n_dims"))


def settled_changes(log: DataFrame, live: DataFrame) -> DataFrame:
    """What a stretch of mutations, each taken by itself in order of ``seq``, does to ``live(feat_id, dim, ...)``.

    One row (``op, feat_id, seq`` and the log's other columns) for each id that changes: its last accepted put, or a delete.
    Puts of an id under another dim than it has then are ignored, whatever comes after.
    """
    log = log.where(F.col("feat_id") != RESERVED)
    touched = log.select("feat_id").distinct()
    before = live.join(touched, "feat_id", "left_semi")
    none = {c: F.lit(None) for c in log.columns if c not in before.columns} | {"seq": F.lit(-1).cast("long"), "op": F.lit("P")}
    start = before.select(*(none[c].cast(log.schema[c].dataType).alias(c) if c in none else F.col(c) for c in log.columns))
    after = apply_log(start.unionByName(log))
    puts = after.where("seq >= 0").withColumn("op", F.lit("P")).select(*log.columns)
    gone = before.select("feat_id").join(after, "feat_id", "left_anti")
    gone = gone.select(*(F.lit("D").alias(c) if c == "op" else F.col(c) if c == "feat_id" else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns))
    return puts.unionByName(gone)


def layered(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Reads during a checkpoint: a row of the overlay hides the base's."""
    rows = base.withColumn("layer", F.lit(0)).unionByName(overlay.withColumn("layer", F.lit(1)))
    return last_write(rows, ["layer"])


def import_outcome(incoming: DataFrame, live: DataFrame) -> DataFrame:
    """``incoming`` with ``outcome``: insert, update, or reject where the live row has another dim."""
    now = live.select("feat_id", F.col("dim").alias("live_dim"))
    outcome = F.when(F.col("live_dim").isNull(), "insert").when(F.col("live_dim") == F.col("dim"), "update").otherwise("reject")
    return incoming.join(now, "feat_id", "left").withColumn("outcome", outcome).drop("live_dim")


def recovered_keys(keys: DataFrame) -> DataFrame:
    """Ids found under one dim alone; an id under two is dropped from both."""
    one = keys.groupBy("feat_id").agg(F.min("dim").alias("dim"), F.max("dim").alias("most"))
    return one.where("dim = most and feat_id <> 0").drop("most")


def row_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``."""
    only = lambda a, b, name: a.exceptAll(b).withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def live_by_generation(log: DataFrame) -> DataFrame:
    """``generation, n_live``: ids whose last operation up to each generation is a put."""
    last = last_write(log.select("generation", "feat_id", "op", "seq"), ["seq"], ["feat_id", "generation"])
    until = F.lead("generation").over(Window.partitionBy("feat_id").orderBy("generation"))
    end = log.agg(F.max("generation").alias("end"))
    held = last.withColumn("until", until).crossJoin(F.broadcast(end)).where("op = 'P'")
    spans = F.explode(F.sequence("generation", F.coalesce(F.col("until") - 1, F.col("end"))))
    return held.select(spans.alias("generation")).groupBy("generation").agg(F.count("*").alias("n_live"))


def changed_between(log: DataFrame, after: int, upto: int) -> DataFrame:
    """The last operation of each id in generations after .. upto."""
    return last_write(log.where((F.col("generation") > after) & (F.col("generation") <= upto)), ["seq"])


def generation(seq: Column, per: Column) -> Column:
    return F.floor(seq / per).cast("long") + 1
