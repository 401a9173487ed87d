"""Continuous ingest of mutations: into a store by micro-batch, or as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embspark.plans.store import Store


def last_values(stream: DataFrame, order: str = "seq") -> DataFrame:
    """Running last write of every id, for complete or update mode; late rows lose by ``order``, so arrival does not matter."""
    rest = [c for c in stream.columns if c != "feat_id"]
    return stream.where("feat_id <> 0").groupBy("feat_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("feat_id", "r.*")


def ingest(stream: DataFrame, store: Store, checkpoint_dir: str, checkpoint_every: int = 10, **trigger) -> StreamingQuery:
    """Puts and deletes (``seq, op, feat_id, dim, embedding``) of each micro-batch are applied in order of ``seq`` and committed.

    Each mutation counts by itself, so an id keeps the dim it was first put with until it
    is deleted, however the stream is cut. How much a micro-batch holds is the source's
    own option (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``); a batch is committed before the next is read.
    """

    def merge(batch: DataFrame, n: int) -> None:
        store.apply(batch)
        store.flush()
        if (n + 1) % checkpoint_every == 0:
            store.checkpoint()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def live_state(stream: DataFrame, dims: tuple[int, ...] = ()) -> DataFrame:
    """Keyed state with deletes: after each micro-batch the ids that changed, ``feat_id, op, dim, seq, embedding`` (update mode).

    The state of an id is its dim, its last accepted put and that put's ``seq``. Mutations of
    one micro-batch are taken in order of ``seq``; one that is older than the state is late and
    ignored. A put under another dim than the id has, or an unregistered one (``dims``
    empty: any), is ignored; a delete ends the id, and it may come back with another dim.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kept = "dim int, seq long, live boolean"
    out = "feat_id long, op string, dim int, seq long, embedding array<float>"

    def step(key, parts, state):
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        dim, last, live = state.get if state.exists else (0, -1, False)
        change = None
        for op, d, seq, vector in zip(rows["op"], rows["dim"], rows["seq"], rows["embedding"], strict=True):
            if seq <= last:
                continue
            if op == "D" and live:
                live, change, last = False, ("D", dim, seq, None), seq
            elif op == "P" and vector is not None and (d == dim if live else not dims or d in dims):
                dim, live, change, last = int(d), True, ("P", int(d), seq, vector), seq
        if change:
            state.update((dim, int(last), live))
            yield pd.DataFrame([(key[0], *change)], columns=["feat_id", "op", "dim", "seq", "embedding"])

    grouped = stream.where("feat_id <> 0").groupBy("feat_id")
    return grouped.applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events and ids by event-time window (an addition: the mutation stream itself carries no time)."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("n_ids")).select(F.col("w.start").alias("start"), "n", "n_ids")
