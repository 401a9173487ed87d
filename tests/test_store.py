import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embspark.config import Status, StoreConfig
from embspark.operators import semantics
from embspark.plans.store import Store, StoreError
from embspark.schema import signed
from embspark.sources import dump

ROW = "pos long, feat_id long, dim int, embedding array<float>"


def rows(spark, items):
    return spark.createDataFrame([(p, i, d, None if v is None else [float(v)] * d) for p, (i, d, v) in enumerate(items)], ROW)


def state(df):
    return {r["feat_id"]: (r["dim"], r["embedding"][0]) for r in df.collect()}


def test_put_delete_checkpoint_reopen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2, 4)))
    status = store.put(rows(spark, [(1, 2, 1), (2, 4, 2), (0, 2, 9), (3, 2, None), (1, 2, 5), (5, 4, 1), (5, 2, 7)]))
    got = sorted((r["feat_id"], r["dim"], r["status"]) for r in status.collect())
    assert got == [(1, 2, "OK"), (1, 2, "OK"), (2, 4, "OK"), (5, 2, "OK"), (5, 4, "DIM_MISMATCH")]
    assert store.checkpoint() == 1
    store.delete(spark.createDataFrame([(2,), (77,), (0,)], "feat_id long"))
    store.put(rows(spark, [(2, 2, 8), (9, 3, 1), (1, 4, 1)]))
    assert state(store.live()) == {1: (2, 5.0), 5: (2, 7.0), 2: (2, 8.0)}
    assert store.checkpoint() == 2
    assert state(store.snapshot(1)) == {1: (2, 5.0), 2: (4, 2.0), 5: (2, 7.0)}
    again = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2, 4), mode="r"))
    assert state(again.live()) == state(store.live()) and again.stats().first()["total_features"] == 3
    with pytest.raises(StoreError) as e:
        again.put(rows(spark, [(1, 2, 1)]))
    assert e.value.status == Status.INVALID
    pinned = state(again.live())
    store.compact()
    store.put(rows(spark, [(1, 2, 99)]))
    store.flush()
    assert state(again.live()) == pinned and state(Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2,))).live())[1] == (2, 99.0)
    reply = {r["pos"]: r["dim"] for r in store.get(spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 404)], "pos long, feat_id long")).collect()}
    assert reply == {0: 2, 1: 0, 2: 2, 3: 0}


def test_log_replay_equals_a_dict_model(spark):
    rng = random.Random(1)
    ops = [(s, rng.choice("PPPD"), rng.randrange(6), rng.choice([2, 4]), float(s)) for s in range(200)]
    live = {}
    for s, op, i, dim, v in ops:
        if i == 0:
            continue
        if op == "D":
            live.pop(i, None)
        elif i not in live or live[i][0] == dim:
            live[i] = (dim, v)
    df = spark.createDataFrame(ops, "seq long, op string, feat_id long, dim int, value double").orderBy(F.rand(3))
    assert {r["feat_id"]: (r["dim"], r["value"]) for r in semantics.apply_log(df).collect()} == live


def test_dump_round_trip(spark, tmp_path):
    ids = [1, dump.MAGIC, signed(2**64 - 2), signed((5 << 32) | dump.MAGIC)]
    df = spark.createDataFrame([(i, 3, [float(k), 0.5, -1.0]) for k, i in enumerate(ids)] + [(9, 2, [1.0, 2.0])], "feat_id long, dim int, embedding array<float>")
    dump.write_dumps(df, str(tmp_path / "d"), 7)
    got = dump.read_dumps(spark, str(tmp_path / "d"))
    assert sorted((r["feat_id"], r["dim"], r["embedding"]) for r in got.collect()) == sorted((r["feat_id"], r["dim"], r["embedding"]) for r in df.collect())
    assert {r["generation"] for r in got.collect()} == {7}
    data = dump.encode(np.array([1, 2]), np.ones((2, 3), np.float32), 1)
    assert len(dump.decode(data[: -dump.TRAILER.size])[1]) == 2 and len(dump.decode(data, 1)[1]) == 1
    with pytest.raises(ValueError):
        dump.decode(b"x" * 80)


def test_streamed_mutations_equal_the_batch(spark, tmp_path):
    from embspark.streaming.ingest import ingest, last_values

    ops = [(s, "D" if s % 7 == 3 else "P", s % 5, 2, [float(s), 0.0]) for s in range(40)]
    df = spark.createDataFrame(ops, "seq long, op string, feat_id long, dim int, embedding array<float>")
    for k in range(2):
        df.where(F.floor(F.col("seq") / 20) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2,)))
    ingest(stream, store, str(tmp_path / "c")).awaitTermination(120)
    want = {r["feat_id"]: r["embedding"][0] for r in semantics.apply_log(df).collect()}
    assert {i: v for i, (_, v) in state(store.live()).items()} == want
    q = last_values(stream).writeStream.outputMode("complete").format("memory").queryName("lww").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["feat_id"]: r["seq"] for r in spark.table("lww").collect()} == {i: max(s for s, _, j, *_ in ops if j == i) for i in range(1, 5)}


def test_mixed_dims_of_a_stream_equal_the_log(spark, tmp_path):
    from embspark.streaming.ingest import ingest, live_state

    rng = random.Random(4)
    ops = [(s, rng.choice("PPPD"), rng.randrange(7), rng.choice([2, 4, 3])) for s in range(300)]
    rows = [(s, op, i, d, [float(s)] * d if op == "P" else None) for s, op, i, d in ops]
    df = spark.createDataFrame(rows, "seq long, op string, feat_id long, dim int, embedding array<float>")
    for k in range(4):
        df.where(F.floor(F.col("seq") / 75) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r["feat_id"]: (r["dim"], r["seq"]) for r in semantics.apply_log(df.where("op = 'D' or dim in (2, 4)")).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2, 4)))
    ingest(stream, store, str(tmp_path / "c"), checkpoint_every=2).awaitTermination(300)
    assert {i: (d, int(v)) for i, (d, v) in state(store.live()).items()} == want
    assert store.verify().count() == 0
    q = live_state(stream, (2, 4)).writeStream.outputMode("update").format("memory").queryName("keyed").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    last = {}
    for r in spark.table("keyed").collect():
        if r["feat_id"] not in last or r["seq"] > last[r["feat_id"]]["seq"]:
            last[r["feat_id"]] = r
    assert {i: (r["dim"], r["seq"]) for i, r in last.items() if r["op"] == "P"} == want


def test_export_import_steps_and_purge(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2, 4), buckets=5))
    store.put(rows(spark, [(i, 2 if i % 2 else 4, i) for i in range(1, 60)]))
    first = store.checkpoint()
    store.put(rows(spark, [(i, 2, -i) for i in range(1, 20, 2)]))
    store.delete(spark.createDataFrame([(2,)], "feat_id long"))
    second = store.checkpoint()
    assert not store.checkpoint_in_progress and store.checkpoint_step() == Status.INVALID
    store.checkpoint_begin()
    with pytest.raises(StoreError):
        store.checkpoint_begin()
    steps = 1
    store.put(rows(spark, [(99, 2, 9)]))
    while store.checkpoint_step(2) == Status.AGAIN:
        assert store.checkpoint_in_progress
        steps += 1
    want = {i: (2 if i % 2 else 4, float(-i if i % 2 and i < 20 else i)) for i in range(1, 60) if i != 2}
    assert steps == 3 and state(store.snapshot(second)) == want and store.manifest["base"][0] == second
    assert state(store.live()) == want | {99: (2, 9.0)}
    store.flush()
    assert store.purge(1) > 0 and state(Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2, 4))).live()) == want | {99: (2, 9.0)}

    other = Store(spark, str(tmp_path / "t"), StoreConfig(auto_create=True))
    store.export(str(tmp_path / "dump"))
    names = [dump.file_facts(f.name) for f in (tmp_path / "dump").glob("*.dump")]
    assert {n[:2] for n in names} == {(second, 2), (second, 4)} and not [f for f in (tmp_path / "dump").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    out = other.import_dumps(str(tmp_path / "dump"))
    assert {r["outcome"] for r in out.collect()} == {"insert"} and state(other.live()) == want
    assert first == 1


def test_delta_export_holds_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2,)))
    store.put(rows(spark, [(i, 2, i) for i in range(1, 9)]))
    store.checkpoint()
    store.put(rows(spark, [(3, 2, 30), (20, 2, 20)]))
    store.delete(spark.createDataFrame([(4,)], "feat_id long"))
    g = store.checkpoint()
    store.export(str(tmp_path / "d"), base_gen=1)
    got = dump.read_dumps(spark, str(tmp_path / "d")).collect()
    assert {(r["feat_id"], r["embedding"][0], r["generation"], r["base_gen"], r["kind"]) for r in got} == {(3, 30.0, g, 1, dump.DELTA), (20, 20.0, g, 1, dump.DELTA)}


def test_lookups_poll_cancel_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2,), batch_limit=500))
    store.put(rows(spark, [(i, 2, i) for i in range(1, 300)]))
    store.checkpoint()
    store.compact()
    asked = spark.createDataFrame([(p, p % 400) for p in range(1000)], "pos long, feat_id long")
    look = store.get_async(asked)
    assert look.result(120).num_rows == 1000 and look.poll() == Status.OK and not look.cancel()
    slow = store.get_async(asked.repartition(2).mapInArrow(lambda bs: ((__import__("time").sleep(20), b)[1] for b in bs), "pos long, feat_id long"))
    assert slow.poll() == Status.AGAIN and slow.cancel()
    with pytest.raises(BaseException):
        slow.result(60)
    assert slow.poll() in (Status.IO, Status.NOT_FOUND)
    chunks = list(store.get_stream(asked))
    assert [len(c) for c in chunks] == [64] * 15 + [40] and [r["pos"] for c in chunks for r in c] == list(range(1000))
    assert {r["pos"]: r["dim"] for r in store.probe(asked).collect()} == {p: 2 if 0 < p % 400 < 300 else 0 for p in range(1000)}
    with pytest.raises(StoreError):
        store.put(rows(spark, [(i, 2, i) for i in range(1, 600)]))


def test_plans_of_put_and_get(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), StoreConfig(dims=(2,)))
    store.put(rows(spark, [(i, 2, i) for i in range(1, 50)]))
    store.checkpoint()
    store.compact()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = plan(store.get(spark.createDataFrame([(0, 1)], "pos long, feat_id long")))
    # base and logs meet the requested ids before they are folded
    assert got.index("max_by") < got.rindex("Join LeftSemi") and got.count("Join LeftSemi") >= 2
    status = plan(semantics.put_batch_status(rows(spark, [(1, 2, 1)]), store.live(), [2]))
    assert "Window" not in status
    assert "Window" not in got


def test_sums_over_ranges_equal_windows(spark):
    from embspark.operators import layout

    rng = random.Random(3)
    data = [(k, o, rng.randrange(5)) for k in range(3) for o in rng.sample(range(-500, 500), 200)]
    df = spark.createDataFrame(data, "k int, o long, v long")
    got = {(r["k"], r["o"]): r["s"] for r in layout.running(df, ["k"], "o", F.col("v"), "s", width=37).collect()}
    assert got == {(k, o): sum(v for a, b, v in data if a == k and b <= o) for k, o, _ in data}


def test_histograms_merge(spark):
    from embspark.functions import latency

    rng = random.Random(9)
    values = [(k % 3, rng.randrange(10**6)) for k in range(500)]
    df = spark.createDataFrame(values, "part int, v long")
    merged = latency.merged_histogram(latency.full_histogram(df, "v", "part"))
    r = latency.histogram_stats(merged).first()
    v = [x for _, x in values]
    assert (r["n"], r["total"], r["least"], r["most"], r["mean"]) == (500, sum(v), min(v), max(v), sum(v) / 500)
    assert sorted(map(tuple, merged.select("bucket", "n").collect())) == sorted(map(tuple, latency.histogram(df, "v").collect()))
