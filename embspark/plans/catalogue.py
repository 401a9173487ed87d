"""The query catalogue: each operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embspark.functions import latency
from embspark.operators import layout, semantics, serving
from embspark.schema import signed, unsigned
from embspark.sources import dump

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REGISTERED = (32, 64, 128)
DIMS = [8, 16, 32, 64, 128, 256, 512, 1024]
# Ids of the reference's range test: fixed values.
EXTREME_IDS = [1, 2, 2**64 - 2, 2**64 - 3, 2**63, 2**63 + 1, 0xFFFFFFFF00000000, 0xFFFFFFFF, 0xDEADBEEFCAFEBABE, 0x0123456789ABCDEF]


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store0(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id <> 0")
    return e.select(F.col("vec_id").alias("feat_id"), F.size("embedding").cast("int").alias("dim"), "embedding", "label")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("feat_id"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id <> 0")
    n = table(spark, sf_dir, "events").count()
    dim = F.when((F.col("event_id") % 13 == 0) | (F.col("user_id") % 3 == 0), 32).when(F.col("user_id") % 3 == 1, 64).otherwise(128)
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("user_id").alias("feat_id"), dim.alias("dim"), "value",
        semantics.generation(F.col("event_id"), F.lit(max(1, n // 5))).alias("generation"),
    )


def only_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations(spark, sf_dir).where("op = 'P'").drop("op")


def put_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("seq") % 997 == 0, 96).otherwise(F.col("dim"))
    return only_puts(spark, sf_dir).select(F.floor(F.col("seq") / 256).cast("long").alias("batch"), F.col("seq").alias("pos"), "feat_id", odd.alias("dim"), "value")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantics.probe(requests(spark, sf_dir), store0(spark, sf_dir))
    return rows.select(F.floor(F.col("pos") / 1000).cast("long").alias("request"), (F.col("pos") % 1000).alias("nth"), "dim")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("value") * 1000).cast("long").alias("latency"), (F.col("event_id") % 10 == 0).alias("ckpt_active"), "ts", "event_id", F.octet_length("props").alias("bytes"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 100 = 0 and event_id > 0")
    g = (F.col("event_id") / 100).cast("long")
    return e.select(g.alias("generation"), (g % 7 == 1).alias("is_full"))


STORE0 = "store0 AS (SELECT vec_id AS feat_id, len(embedding)::INT AS dim, embedding, label FROM embeddings WHERE vec_id <> 0)"
REQ = "req AS (SELECT event_id AS pos, user_id AS feat_id FROM events)"
GOT = f"{STORE0}, {REQ}, got AS (SELECT pos, r.feat_id, coalesce(dim, 0)::INT AS dim, embedding FROM req r LEFT JOIN store0 s ON r.feat_id = s.feat_id AND r.feat_id <> 0)"
MUT = """mut AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, user_id AS feat_id,
 (CASE WHEN event_id % 13 = 0 OR user_id % 3 = 0 THEN 32 WHEN user_id % 3 = 1 THEN 64 ELSE 128 END)::INT AS dim, value,
 (event_id // greatest(1, (SELECT count(*) FROM events) // 5) + 1)::BIGINT AS generation FROM events WHERE user_id <> 0)"""
PUTS = f"{MUT}, puts AS (SELECT * FROM mut WHERE op = 'P')"
BATCHES = f"{PUTS}, batches AS (SELECT seq // 256 AS batch, seq AS pos, feat_id, (CASE WHEN seq % 997 = 0 THEN 96 ELSE dim END)::INT AS dim, value FROM puts)"
STATUS = f"""{BATCHES}, stops AS (SELECT *, coalesce(dim >= min(CASE WHEN dim NOT IN (32, 64, 128) THEN dim END) OVER (PARTITION BY batch), false) AS invalid FROM batches),
 lives AS (SELECT *, first_value(CASE WHEN NOT invalid THEN dim END IGNORE NULLS) OVER (PARTITION BY feat_id ORDER BY batch, dim, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS live FROM stops),
 statuses AS (SELECT *, CASE WHEN invalid THEN 'INVALID' WHEN dim <> live THEN 'DIM_MISMATCH' ELSE 'OK' END AS status FROM lives)"""
SLOTS = f"""{PUTS}, slots AS (SELECT dim, feat_id, entry_idx, entry_idx // (4096 // (4 * dim)) AS page FROM (SELECT dim, feat_id, row_number() OVER (PARTITION BY dim ORDER BY min(seq)) - 1 AS entry_idx FROM puts GROUP BY dim, feat_id)),
 dirty AS (SELECT DISTINCT generation, p.dim, page FROM puts p JOIN slots s ON p.dim = s.dim AND p.feat_id = s.feat_id)"""


def state_sql(where: str) -> str:
    """Replay of the part of the log that ``where`` leaves, as CTEs ending in ``state``."""
    return f"""cut AS (SELECT *, sum(CASE WHEN op = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY feat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM mut WHERE {where}),
 ends AS (SELECT *, max(seg) OVER (PARTITION BY feat_id) AS last_seg FROM cut),
 tail AS (SELECT *, first_value(dim) OVER (PARTITION BY feat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live FROM ends WHERE op = 'P' AND seg = last_seg),
 state AS (SELECT feat_id, arg_max(dim, seq) AS dim, arg_max(value, seq) AS value, max(seq) AS seq FROM tail WHERE dim = live GROUP BY feat_id)"""


LAT = "lat AS (SELECT CAST(trunc(value * 1000) AS BIGINT) AS latency, event_id % 10 = 0 AS ckpt_active, ts, event_id, strlen(props) AS bytes FROM events)"
HIST = f"""{LAT}, parts AS (SELECT CASE WHEN latency = 0 THEN 0 ELSE (length(bin(latency)) - 1) * 64 + ((latency - (1::BIGINT << (length(bin(latency)) - 1))) * 64) // (1::BIGINT << (length(bin(latency)) - 1)) END AS bucket FROM lat),
 hist AS (SELECT bucket, count(*) AS n, sum(count(*)) OVER (ORDER BY bucket) AS upto, sum(count(*)) OVER () AS total FROM parts GROUP BY bucket)"""
CKPT = "ck AS (SELECT event_id // 100 AS generation, (event_id // 100) % 7 = 1 AS is_full FROM events WHERE event_id % 100 = 0 AND event_id > 0)"
RESP = f"{GOT}, resp AS (SELECT pos // 1000 AS request, pos % 1000 AS nth, dim FROM got)"
PERCENTS = [50.0, 90.0, 99.0, 99.9, 99.99]


@query("q01_batch_get", f"WITH {GOT} SELECT pos, feat_id, dim, round(embedding[1]::DOUBLE, 6) AS value FROM got")
def q01(spark, d):
    return semantics.batch_get(requests(spark, d), store0(spark, d)).select("pos", "feat_id", "dim", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("value"))


@query("q02_probe", f"WITH {GOT} SELECT pos, dim FROM got")
def q02(spark, d):
    return semantics.probe(requests(spark, d), store0(spark, d)).select("pos", "dim")


@query("q03_upsert_lww", f"WITH {PUTS} SELECT feat_id, arg_max(value, seq) AS value, max(seq) AS seq FROM puts GROUP BY feat_id")
def q03(spark, d):
    return semantics.last_write(only_puts(spark, d).select("feat_id", "value", "seq"), ["seq"])


@query("q04_skip_reserved", "SELECT sum((user_id <> 0 AND value IS NOT NULL)::INT)::BIGINT AS n_accepted, sum((user_id = 0 OR value IS NULL)::INT)::BIGINT AS n_skipped FROM events")
def q04(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("feat_id"), "value")
    return semantics.accepted(e, "value").agg(F.count("*").alias("n_accepted")).crossJoin(e.agg(F.count("*").alias("n"))).select("n_accepted", (F.col("n") - F.col("n_accepted")).alias("n_skipped"))


@query("q05_log_replay", f"WITH {MUT}, {state_sql('true')} SELECT feat_id, dim, value, seq FROM state")
def q05(spark, d):
    return semantics.apply_log(mutations(spark, d)).select("feat_id", "dim", "value", "seq")


@query("q06_put_status", f"WITH {STATUS} SELECT status, count(*) AS n FROM statuses GROUP BY status")
def q06(spark, d):
    return semantics.put_status(put_batches(spark, d), REGISTERED).groupBy("status").agg(F.count("*").alias("n"))


@query("q06b_batch_status", f"WITH {STATUS} SELECT batch, coalesce(arg_max(status, dim::BIGINT * 1000000000 + pos) FILTER (WHERE status <> 'OK'), 'OK') AS status FROM statuses GROUP BY batch")
def q06b(spark, d):
    return semantics.batch_status(semantics.put_status(put_batches(spark, d), REGISTERED))


@query("q07_auto_create_dims", f"WITH {BATCHES}, f AS (SELECT dim, min(batch) AS first FROM batches GROUP BY dim) SELECT batch, (SELECT count(*) FROM f WHERE first <= b.batch) AS n_dims FROM (SELECT DISTINCT batch FROM batches) b")
def q07(spark, d):
    return semantics.registered_dims(put_batches(spark, d))


@query("q08_intra_batch_dup", f"WITH {STATUS} SELECT batch, feat_id, count(*) AS n, arg_max(value, pos) AS value FROM statuses WHERE status = 'OK' GROUP BY batch, feat_id")
def q08(spark, d):
    ok = semantics.put_status(put_batches(spark, d), REGISTERED).where("status = 'OK'")
    return ok.groupBy("batch", "feat_id").agg(F.count("*").alias("n"), F.max_by("value", "pos").alias("value"))


@query("q09_delete", f"WITH {STORE0} SELECT feat_id, dim FROM store0 WHERE feat_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def q09(spark, d):
    gone = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("feat_id"))
    return semantics.anti_delete(store0(spark, d).select("feat_id", "dim"), gone)


@query("q10_latest_op_tombstone", f"WITH {MUT}, l AS (SELECT feat_id, arg_max(op, seq) AS op, max(seq) AS seq, arg_max(value, seq) AS value FROM mut GROUP BY feat_id) SELECT feat_id, seq, value FROM l WHERE op = 'P'")
def q10(spark, d):
    return semantics.latest_live(mutations(spark, d)).select("feat_id", "seq", "value")


@query("q11_stats", f"""WITH {MUT}, {state_sql('true')} SELECT count(*) AS total_features, count(DISTINCT dim) AS n_dims, sum(4 * dim)::BIGINT AS bytes,
 (SELECT max(generation) FROM mut) AS checkpoint_generation, 0::BIGINT AS buffer_hits, 0::BIGINT AS buffer_misses, 0::BIGINT AS buffer_evictions FROM state""")
def q11(spark, d):
    log = mutations(spark, d)
    live = semantics.apply_log(log).agg(F.count("*").alias("total_features"), F.countDistinct("dim").alias("n_dims"), F.sum(F.col("dim") * 4).cast("long").alias("bytes"))
    none = [F.lit(0).cast("long").alias(c) for c in ("buffer_hits", "buffer_misses", "buffer_evictions")]
    return live.crossJoin(F.broadcast(log.agg(F.max("generation").alias("checkpoint_generation")))).select("*", *none)


@query("q12_rows_per_dim", f"WITH {PUTS} SELECT dim, count(*) AS n FROM puts GROUP BY dim")
def q12(spark, d):
    return only_puts(spark, d).groupBy("dim").agg(F.count("*").alias("n"))


@query("q13_layout", f"""WITH {PUTS} SELECT dim, 4 * dim AS entry_size, (4096 // (4 * dim))::BIGINT AS rows_per_page, count(DISTINCT feat_id) AS n_entries,
 ((count(DISTINCT feat_id) + 4096 // (4 * dim) - 1) // (4096 // (4 * dim)))::BIGINT AS pages FROM puts GROUP BY dim""")
def q13(spark, d):
    return layout.layout(only_puts(spark, d))


@query("q14_dirty_pages", f"WITH {SLOTS} SELECT generation, dim, count(*) AS n_pages FROM dirty GROUP BY generation, dim")
def q14(spark, d):
    return layout.dirty_pages(only_puts(spark, d)).groupBy("generation", "dim").agg(F.count("*").alias("n_pages"))


@query("q15_dirty_runs", f"""WITH {SLOTS}, i AS (SELECT *, page - row_number() OVER (PARTITION BY generation, dim ORDER BY page) AS island FROM dirty)
 SELECT generation, dim, min(page) AS pg_start, count(*) AS pg_count FROM i GROUP BY generation, dim, island""")
def q15(spark, d):
    return layout.dirty_runs(layout.dirty_pages(only_puts(spark, d)))


@query("q16_peephole", f"""WITH {SLOTS}, sparse AS (SELECT * FROM dirty WHERE page % 7 NOT IN (1, 2, 3, 4, 5) OR page % 14 = 3),
 l AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY generation, dim ORDER BY page) <= 5 THEN 0 ELSE 1 END AS new FROM sparse),
 g AS (SELECT *, sum(new) OVER (PARTITION BY generation, dim ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM l)
 SELECT generation, dim, min(page) AS pg_first, max(page) AS pg_last, count(*) AS n_pages FROM g GROUP BY generation, dim, g""")
def q16(spark, d):
    pages = layout.dirty_pages(only_puts(spark, d)).where("page % 7 NOT IN (1, 2, 3, 4, 5) OR page % 14 = 3")
    return layout.peephole_groups(pages)


@query("q16b_peephole_all", f"""WITH {SLOTS},
 l AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY generation, dim ORDER BY page) <= 5 THEN 0 ELSE 1 END AS new FROM dirty),
 g AS (SELECT *, sum(new) OVER (PARTITION BY generation, dim ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM l)
 SELECT generation, dim, min(page) AS pg_first, max(page) AS pg_last, count(*) AS n_pages FROM g GROUP BY generation, dim, g""")
def q16b(spark, d):
    return layout.peephole_groups(layout.dirty_pages(only_puts(spark, d)))


@query("q17_step_budget", f"""WITH {SLOTS}, s AS (SELECT *, (row_number() OVER (PARTITION BY generation ORDER BY dim, page) - 1) // 64 AS step FROM dirty),
 n AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY generation, step, dim ORDER BY page) = 1 THEN 0 ELSE 1 END AS new FROM s)
 SELECT generation, step, count(*) AS pages, sum(new)::BIGINT AS pieces FROM n GROUP BY generation, step""")
def q17(spark, d):
    return layout.step_pieces(layout.dirty_pages(only_puts(spark, d)), 64)


@query("q18_full_export", f"WITH {MUT}, {state_sql('generation <= 3')} SELECT feat_id, dim, value FROM state")
def q18(spark, d):
    return semantics.apply_log(mutations(spark, d).where("generation <= 3")).select("feat_id", "dim", "value")


@query("q19_delta_export", f"WITH {MUT} SELECT feat_id, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM mut WHERE generation > 2 AND generation <= 4 GROUP BY feat_id")
def q19(spark, d):
    return semantics.changed_between(mutations(spark, d), 2, 4).select("feat_id", "op", "value")


@query("q20_delta_page_granular", f"WITH {SLOTS} SELECT s.feat_id, s.dim, s.entry_idx FROM slots s JOIN (SELECT dim, page FROM dirty WHERE generation = 3) t ON s.dim = t.dim AND s.page = t.page")
def q20(spark, d):
    return layout.rows_on_dirty_pages(only_puts(spark, d), 3)


@query("q21_replay_chain", f"WITH {PUTS} SELECT feat_id, max(seq) AS seq, arg_max(value, seq) AS value FROM puts GROUP BY feat_id")
def q21(spark, d):
    puts = only_puts(spark, d).select("feat_id", "seq", "value", "generation")
    chain = semantics.last_write(puts.where("generation <= 2"), ["seq"])
    for g in (3, 4, 5, 6):
        chain = chain.unionByName(semantics.last_write(puts.where(F.col("generation") == g), ["seq"]))
    return semantics.last_write(chain, ["generation", "seq"]).drop("generation")


@query("q22_overlay_read", f"""WITH {PUTS}, b AS (SELECT feat_id, arg_max(value, seq) AS value FROM puts WHERE generation <= 3 GROUP BY feat_id),
 o AS (SELECT feat_id, arg_max(value, seq) AS value FROM puts WHERE generation > 3 GROUP BY feat_id)
 SELECT coalesce(o.feat_id, b.feat_id) AS feat_id, coalesce(o.value, b.value) AS value, (o.feat_id IS NOT NULL)::INT AS layer FROM b FULL JOIN o ON b.feat_id = o.feat_id""")
def q22(spark, d):
    puts = only_puts(spark, d).select("feat_id", "value", "seq", "generation")
    last = lambda rows: semantics.last_write(rows.select("feat_id", "value", "seq"), ["seq"]).drop("seq")
    return semantics.layered(last(puts.where("generation <= 3")), last(puts.where("generation > 3")))


@query("q23_snapshot_isolation", f"""WITH {MUT}, g AS (SELECT DISTINCT generation FROM mut), l AS (SELECT g.generation, feat_id, arg_max(op, seq) AS op FROM mut m JOIN g ON m.generation <= g.generation GROUP BY g.generation, feat_id)
 SELECT generation, count(*) AS n_live FROM l WHERE op = 'P' GROUP BY generation""")
def q23(spark, d):
    return semantics.live_by_generation(mutations(spark, d))


@query("q24_import_merge", f"""WITH {MUT}, {state_sql('generation <= 4')}, inc AS (SELECT feat_id, arg_max(dim, seq) AS dim FROM mut WHERE generation > 4 AND op = 'P' GROUP BY feat_id)
 SELECT CASE WHEN s.feat_id IS NULL THEN 'insert' WHEN s.dim = i.dim THEN 'update' ELSE 'reject' END AS outcome, count(*) AS n FROM inc i LEFT JOIN state s ON i.feat_id = s.feat_id GROUP BY 1""")
def q24(spark, d):
    log = mutations(spark, d)
    incoming = semantics.last_write(log.where("generation > 4 and op = 'P'").select("feat_id", "dim", "seq"), ["seq"])
    return semantics.import_outcome(incoming, semantics.apply_log(log.where("generation <= 4"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("q25_parse_limit", f"WITH {PUTS} SELECT seq, feat_id, dim, value FROM puts WHERE generation = 2 ORDER BY seq LIMIT 100")
def q25(spark, d):
    return only_puts(spark, d).where("generation = 2").orderBy("seq").limit(100).select("seq", "feat_id", "dim", "value")


@query("q26_recover_conflict", f"WITH {PUTS} SELECT feat_id, min(dim) AS dim FROM puts GROUP BY feat_id HAVING count(DISTINCT dim) = 1")
def q26(spark, d):
    return semantics.recovered_keys(only_puts(spark, d).select("feat_id", "dim"))


@query("q27_generation_lineage", f"WITH {CKPT}, b AS (SELECT *, max(CASE WHEN is_full THEN generation END) OVER (ORDER BY generation) AS base FROM ck) SELECT generation, is_full, base, generation - base AS chain FROM b")
def q27(spark, d):
    return serving.lineage(checkpoints(spark, d)).withColumn("chain", F.col("generation") - F.col("base"))


@query("q28_purge", f"WITH {CKPT} SELECT generation FROM ck WHERE NOT is_full AND generation <= (SELECT max(generation) FROM ck WHERE is_full)")
def q28(spark, d):
    return serving.purgeable(checkpoints(spark, d))


@query("q29_shard_route", "SELECT user_id % 8 AS shard, count(*) AS n FROM events GROUP BY 1")
def q29(spark, d):
    return requests(spark, d).groupBy(serving.shard(F.col("feat_id"), 8).alias("shard")).agg(F.count("*").alias("n"))


@query("q30_pull_frames", f"WITH {RESP} SELECT request, nth // 64 AS chunk, count(*) AS n_rows, (sum(4 + 4 * dim) + 4 + CASE WHEN nth // 64 = 0 THEN 4 ELSE 0 END)::BIGINT AS frame_bytes FROM resp GROUP BY request, nth // 64")
def q30(spark, d):
    return serving.pull_frames(responses(spark, d))


@query("q31_wire_bytes", f"""WITH {RESP} SELECT request, (16 + 8 * count(*))::BIGINT AS pull_request, (16 + sum(4 + 4 * dim))::BIGINT AS pull_response,
 (16 + sum(CASE WHEN dim > 0 THEN 12 + 4 * dim ELSE 0 END))::BIGINT AS push_request FROM resp GROUP BY request""")
def q31(spark, d):
    return serving.wire_bytes(responses(spark, d))


@query("q32_lru_hit_rate", """WITH acc AS (SELECT event_id AS pos, user_id AS feat_id FROM events WHERE user_id <> 0),
 p AS (SELECT *, lag(pos) OVER (PARTITION BY feat_id ORDER BY pos) AS prev, lead(pos) OVER (PARTITION BY feat_id ORDER BY pos) AS nxt FROM acc),
 dist AS (SELECT a.pos, count(b.pos) AS between_ids FROM p a LEFT JOIN p b ON b.pos > a.prev AND b.pos < a.pos AND (b.nxt IS NULL OR b.nxt >= a.pos) WHERE a.prev IS NOT NULL GROUP BY a.pos)
 SELECT 0::BIGINT AS shard, (SELECT count(*) FROM acc) AS n_accesses, (SELECT count(*) FROM dist WHERE between_ids < 50) AS n_hits""")
def q32(spark, d):
    return serving.lru_hits(requests(spark, d).where("feat_id <> 0"), 50)


@query("q33_hot_set", "SELECT user_id AS feat_id, count(*) AS n FROM events WHERE user_id <> 0 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def q33(spark, d):
    return serving.hot_set(requests(spark, d).where("feat_id <> 0"), 20)


@query("q34_replica_version", """WITH v AS (SELECT event_id + 50 AS t, event_id // 500 AS version FROM events WHERE event_id % 500 = 0)
 SELECT coalesce((SELECT max(version) FROM v WHERE v.t <= e.event_id), -1) AS version, count(*) AS n_reads FROM events e GROUP BY 1""")
def q34(spark, d):
    e = table(spark, d, "events")
    versions = e.where("event_id % 500 = 0").select((F.col("event_id") + 50).alias("t"), (F.col("event_id") / 500).cast("long").alias("version"))
    read = serving.as_of(e.select(F.col("event_id").alias("t")), versions, 4096)
    return read.groupBy(F.coalesce("version", F.lit(-1).cast("long")).alias("version")).agg(F.count("*").alias("n_reads"))


@query("q35_sched_ticks", "SELECT event_id AS tick, event_id % 4 = 0 AS flush, event_id % 34 = 0 AS checkpoint FROM events WHERE event_id > 0 AND (event_id % 4 = 0 OR event_id % 34 = 0)")
def q35(spark, d):
    return serving.ticks_fired(table(spark, d, "events").select(F.col("event_id").alias("tick")), 30, 100, 1000)


@query("q36_singleflight", "SELECT event_id // 20 AS checkpoint_id, count(*) AS n_requests, min(event_id) AS first_seq FROM events WHERE event_type = 'purchase' GROUP BY 1")
def q36(spark, d):
    return serving.single_flight(table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("seq")), 20)


@query("q37_hist_percentiles", f"""WITH {HIST}, w AS (SELECT unnest([50.0, 90.0, 99.0, 99.9, 99.99])::DOUBLE AS percentile),
 r AS (SELECT percentile, min(bucket) AS b FROM hist, w WHERE upto >= greatest(1, floor(total * percentile / 100)) GROUP BY percentile)
 SELECT percentile, ((1::BIGINT << (b // 64)) + ((b % 64) * (1::BIGINT << (b // 64))) // 64)::BIGINT AS latency FROM r""")
def q37(spark, d):
    return latency.histogram_percentiles(samples(spark, d), "latency", PERCENTS)


@query("q38_exact_percentiles", f"""WITH {LAT}, o AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM lat), w AS (SELECT unnest([50.0, 90.0, 99.0, 99.9, 99.99])::DOUBLE AS percentile)
 SELECT percentile, latency FROM o, w WHERE i = least(floor(n * percentile / 100), n - 1)""")
def q38(spark, d):
    return latency.sample_percentiles(samples(spark, d), "latency", PERCENTS)


@query("q39_throughput_curve", f"WITH {LAT} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM lat GROUP BY 1")
def q39(spark, d):
    curve = latency.throughput(samples(spark, d), "ts", "1 hour")
    return curve.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("q40_ckpt_amplification", f"""WITH {LAT}, a AS (SELECT quantile_cont(latency, 0.99) FILTER (WHERE ckpt_active) AS during, quantile_cont(latency, 0.99) FILTER (WHERE NOT ckpt_active) AS quiet FROM lat)
 SELECT round(during, 6) AS during, round(quiet, 6) AS quiet, round(during / quiet, 6) AS ratio FROM a""")
def q40(spark, d):
    out = latency.amplification(samples(spark, d), "latency", "ckpt_active")
    return out.select(F.round("during", 6).alias("during"), F.round("quiet", 6).alias("quiet"), "ratio")


@query("q41_mixed_workload", f"""WITH {GOT} SELECT CASE WHEN pos % 5 < 4 THEN 'read' ELSE 'write' END AS op, count(*) AS n, sum((dim > 0)::INT)::BIGINT AS n_found, sum(4 * dim)::BIGINT AS bytes FROM got GROUP BY 1""")
def q41(spark, d):
    rows = semantics.probe(requests(spark, d), store0(spark, d))
    op = F.when(F.col("pos") % 5 < 4, "read").otherwise("write").alias("op")
    return rows.groupBy(op).agg(F.count("*").alias("n"), F.count_if(F.col("dim") > 0).alias("n_found"), F.sum(F.col("dim") * 4).cast("long").alias("bytes"))


@query("q42_zipf_dims", """WITH w AS (SELECT unnest(range(8)) AS i), c AS (SELECT (8 * pow(2, i))::INT AS dim, sum(pow(i + 1.0, -1.2)) OVER (ORDER BY i) / sum(pow(i + 1.0, -1.2)) OVER () AS cdf, (sum(pow(i + 1.0, -1.2)) OVER (ORDER BY i) - pow(i + 1.0, -1.2)) / sum(pow(i + 1.0, -1.2)) OVER () AS low FROM w),
 u AS (SELECT ((event_id * 7919) % 100000 + 0.5) / 100000 AS u FROM events), a AS (SELECT dim FROM u JOIN c ON u > low AND u <= cdf)
 SELECT dim, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM a GROUP BY dim""")
def q42(spark, d):
    u = table(spark, d, "events").select((((F.col("event_id") * 7919) % 100000 + 0.5) / 100000).alias("u"))
    # eight rows on the other side
    a = u.join(F.broadcast(serving.zipf(spark, DIMS, 1.2)), (F.col("u") > F.col("low")) & (F.col("u") <= F.col("cdf")))
    counts = a.groupBy("dim").agg(F.count("*").alias("n"))
    total = F.broadcast(a.agg(F.count("*").alias("total")))
    return counts.crossJoin(total).select("dim", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("pct"))


@query("q43_unsigned_ids", "SELECT unnest([" + ", ".join(str(signed(i)) for i in EXTREME_IDS) + "])::BIGINT AS feat_id, unnest([" + ", ".join(f"'{i}'" for i in EXTREME_IDS) + "]) AS unsigned_id")
def q43(spark, d):
    ids = spark.createDataFrame([(signed(i),) for i in EXTREME_IDS], "feat_id long")
    return ids.select("feat_id", unsigned("feat_id").cast("string").alias("unsigned_id"))


_DIFF = state_sql("generation <= 3")
_NEW = _DIFF.replace("cut AS", "cut2 AS").replace("FROM cut)", "FROM cut2)").replace("ends AS", "ends2 AS").replace("FROM ends ", "FROM ends2 ").replace("tail AS", "tail2 AS").replace("FROM tail ", "FROM tail2 ").replace("state AS", "state2 AS").replace("generation <= 3", "generation <= 5")


@query("q44_row_diff", f"""WITH {MUT}, {_DIFF}, {_NEW} SELECT 'left' AS side, count(*) AS n FROM (SELECT feat_id, dim, value FROM state EXCEPT ALL SELECT feat_id, dim, value FROM state2)
 UNION ALL SELECT 'right', count(*) FROM (SELECT feat_id, dim, value FROM state2 EXCEPT ALL SELECT feat_id, dim, value FROM state)""")
def q44(spark, d):
    log = mutations(spark, d)
    old, new = (semantics.apply_log(log.where(F.col("generation") <= g)).select("feat_id", "dim", "value") for g in (3, 5))
    return semantics.row_diff(old, new).groupBy("side").agg(F.count("*").alias("n"))


@query("q45_dump_round_trip", f"WITH {STORE0} SELECT 7::BIGINT AS generation, feat_id, dim, round(embedding[1]::DOUBLE, 6) AS value FROM store0")
def q45(spark, d):
    files = dump.dump_table(store0(spark, d).select("feat_id", "dim", "embedding"), 7, rows_per_file=1000)
    return dump.decoded(files).select("generation", "feat_id", "dim", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("value"))


@query("q46_checkpoint_steps", f"""WITH {SLOTS}, s AS (SELECT *, (row_number() OVER (PARTITION BY generation ORDER BY dim, page) - 1) // 64 AS step, count(*) OVER (PARTITION BY generation) AS total FROM dirty)
 SELECT generation, step, count(*) AS pages, least((step + 1) * 64, max(total))::BIGINT AS done, CASE WHEN (step + 1) * 64 < max(total) THEN 'AGAIN' ELSE 'OK' END AS status FROM s GROUP BY generation, step""")
def q46(spark, d):
    return layout.step_progress(layout.dirty_pages(only_puts(spark, d)), 64)


@query("q47_histogram_stats", f"WITH {LAT} SELECT ckpt_active, count(*) AS n, sum(latency)::BIGINT AS total, min(latency) AS least, max(latency) AS most, round(sum(latency) / count(*), 6) AS mean FROM lat GROUP BY ckpt_active")
def q47(spark, d):
    hours = latency.full_histogram(samples(spark, d).withColumn("hour", F.hour("ts")), "latency", "ckpt_active", "hour")
    stats = latency.histogram_stats(latency.merged_histogram(hours, "ckpt_active"), "ckpt_active")
    return stats.withColumn("mean", F.round("mean", 6))


@query("q48_cache_miss_join", f"""WITH {GOT}, hot AS (SELECT feat_id FROM store0 WHERE label < 3)
 SELECT pos, dim, CASE WHEN dim = 0 THEN 'none' WHEN feat_id IN (SELECT feat_id FROM hot) THEN 'cache' ELSE 'store' END AS source, round(embedding[1]::DOUBLE, 6) AS value FROM got""")
def q48(spark, d):
    store = store0(spark, d)
    got = semantics.cache_split(requests(spark, d), store.where("label < 3").drop("label"), store)
    return got.select("pos", "dim", "source", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("value"))


@query("q49_row_checksum", f"WITH {MUT} SELECT seq, feat_id, md5(concat_ws('|', feat_id, dim, CAST(trunc(value * 1000) AS BIGINT))) AS checksum FROM mut WHERE op = 'P'")
def q49(spark, d):
    return semantics.row_checksums(only_puts(spark, d), (F.col("value") * 1000).cast("long")).select("seq", "feat_id", "checksum")


@query("q50_mixed_dim_stream", f"WITH {MUT}, {state_sql('true')} SELECT feat_id, dim, value, seq FROM state")
def q50(spark, d):
    log = mutations(spark, d).drop("generation")
    # cut in the middle as micro-batches would, and applied one after the other
    half = log.agg(F.max("seq")).first()[0] // 2
    parts = [log.where(F.col("seq") <= half), log.where(F.col("seq") > half)]
    live = None
    for part in parts:
        now = part.limit(0) if live is None else live
        changes = semantics.settled_changes(part, now.select("feat_id", "dim", "value"))
        rest = now.join(changes.select("feat_id"), "feat_id", "left_anti")
        live = rest.select("feat_id", "dim", "value", "seq").unionByName(changes.where("op = 'P'").select("feat_id", "dim", "value", "seq"))
    return live


@query("q51_preview", f"WITH {STORE0} SELECT feat_id, i::BIGINT AS nth, round(embedding[i]::DOUBLE, 6) AS value FROM store0, (SELECT unnest(range(1, 5)) AS i)")
def q51(spark, d):
    return semantics.preview(store0(spark, d), 4).select("feat_id", "nth", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("q52_export_of_dims", f"WITH {MUT}, {state_sql('generation <= 3')} SELECT feat_id, dim, value FROM state WHERE dim IN (32, 128)")
def q52(spark, d):
    state = semantics.apply_log(mutations(spark, d).where("generation <= 3")).select("feat_id", "dim", "value")
    return semantics.of_dims(state, (32, 128))


@query("q53_partial_flush", f"""WITH {SLOTS}, o AS (SELECT DISTINCT dim, feat_id FROM puts WHERE generation = 2), r AS (SELECT s.feat_id, s.dim, s.page FROM slots s JOIN o ON s.dim = o.dim AND s.feat_id = o.feat_id),
 p AS (SELECT dim, page, row_number() OVER (ORDER BY dim, page) AS nth FROM (SELECT DISTINCT dim, page FROM r)) SELECT r.feat_id, r.dim, r.page FROM r JOIN p ON r.dim = p.dim AND r.page = p.page WHERE nth > 8""")
def q53(spark, d):
    return layout.unflushed(only_puts(spark, d), 2, 8)


@query("q54_run_chunks", f"""WITH {SLOTS}, i AS (SELECT *, page - row_number() OVER (PARTITION BY generation, dim ORDER BY page) AS island FROM dirty),
 r AS (SELECT generation, dim, min(page) AS pg_start, count(*) AS pg_count FROM i GROUP BY generation, dim, island), n AS (SELECT *, (row_number() OVER (PARTITION BY generation, dim ORDER BY pg_start) - 1) // 2 AS chunk FROM r)
 SELECT generation, dim, chunk, count(*) AS n_runs, sum(pg_count)::BIGINT AS n_pages FROM n GROUP BY generation, dim, chunk""")
def q54(spark, d):
    return layout.run_chunks(layout.dirty_runs(layout.dirty_pages(only_puts(spark, d))), 2)


@query("q55_entry_ranges", f"""WITH {SLOTS}, r AS (SELECT s.dim, s.entry_idx FROM slots s JOIN (SELECT DISTINCT dim, feat_id FROM puts WHERE generation = 3) t ON s.dim = t.dim AND s.feat_id = t.feat_id),
 i AS (SELECT *, entry_idx - row_number() OVER (PARTITION BY dim ORDER BY entry_idx) AS island FROM r) SELECT dim, min(entry_idx) AS first, count(*) AS n FROM i GROUP BY dim, island""")
def q55(spark, d):
    puts = only_puts(spark, d)
    own = puts.where("generation = 3").select("dim", "feat_id").distinct()
    return layout.entry_ranges(layout.slots(puts).join(own, ["dim", "feat_id"], "left_semi"))
