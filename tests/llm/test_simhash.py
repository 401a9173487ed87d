import random

import numpy as np
import pytest
import xxhash

import embspark.llm.simhash as m
from embspark.llm.components import components
from tests.llm.common import fixture_rows, sample, table


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("source", ["sample", "fixture"])
def test_documents(spark, source):
    df, rows = fixture_rows(spark) if source == "fixture" else (table(spark, sample()), sample())
    fps = {i: brute_print(t) for i, t in rows}
    want = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = m.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{fps[i]:016x}", want[i]) for i in fps)


def clusters(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randint(0, 12)):
            out.add(base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    return list(out)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_of_fingerprints_at_every_distance(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET", bucket)
    fps = clusters(500, 5) + [k for k in range(40)]
    fps = list(dict.fromkeys(fps))
    want = brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    df = spark.createDataFrame([(m.signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    links = m.print_links(df, 2)
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links.collect())
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == want


@pytest.mark.parametrize("radius", [0, 1, 2, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64))
    fps[200:] = fps[:100] ^ np.uint64(0b1110001111)
    for lag in (1, 63, 64, 100, 200, 299):
        alive = np.zeros(320, np.uint8)
        alive[: 300 - lag] = 1
        mask = m.within(m.planes_of(fps), lag, np.packbits(alive, bitorder="little").view("<u8"), radius)
        got = np.unpackbits(mask.view(np.uint8), bitorder="little")[: 300 - lag]
        assert got.tolist() == [int(int(fps[i] ^ fps[i + lag]).bit_count() <= radius) for i in range(300 - lag)]


def test_odd_tables(spark):
    assert m.near_duplicates(table(spark, [])).count() == 0
    got = m.near_duplicates(table(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "other words here")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got if r["component_id"]) == [(-1, 4), (4, 4), (4, 4)]


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 201: 200}


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


@pytest.mark.parametrize("bucket", [4096, 4])
def test_similar_texts_are_grouped_and_others_are_not(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET", bucket)
    rng = random.Random(9)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(120, 400))]
        for edits in (0, 0, 1, 2, rng.randint(20, 60)):
            text = base[:]
            for _ in range(edits):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, "a b")]
    sets = {i: shingles(t) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    sure = brute_components(sets, lambda a, b: near(a, b) >= 0.84)
    most = brute_components(sets, lambda a, b: near(a, b) >= 0.75)
    df = table(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(df).collect()}
    for a in sets:
        for b in sets:
            if sure[a] == sure[b]:
                assert got[a] == got[b]
            if got[a] == got[b]:
                assert most[a] == most[b]
    kept = {r["doc_id"] for r in m.first_of_each_group(df).collect()}
    assert kept == set(got.values()) and m.first_of_each_group(df).columns == df.columns
    assert m.first_of_each_group(table(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [1024, 7])
def test_similar_texts_are_linked_by_the_exact_limit(spark, monkeypatch, tile):
    monkeypatch.setattr(m, "TILE", tile)
    rows, want = [], {}
    for g in range(60):
        # 100 shingles; the other text has the first 80 or 79 of them, or all but a few
        base = [f"w{g}x{j}" for j in range(104)]
        for left in (104, 84 if g % 2 else 83):
            want[len(rows)] = 2 * g + (g % 2 == 0 and left == 83)
            rows.append((len(rows), " ".join(base[:left])))
    shared = [f"s{j}" for j in range(154)]
    for k in range(60):  # one template, 150 shingles of 200 in common: none is a copy of another
        want[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(shared + [f"t{k}x{j}" for j in range(25)])))
    got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(table(spark, rows)).collect()}
    assert got == want


def test_dense_clusters_larger_than_a_bucket_lose_no_link(spark):
    # fingerprints that differ in 14 bits alone; one has a single neighbour two bits away
    far = 0b11_1111_1111_1111
    values = [v for v in range(1 << 14) if v == far or (v ^ far).bit_count() > 2]
    values.append(far ^ 0b101)
    fps = [v << 7 for v in values]
    assert len(fps) > 10_000 > 2 * m.BUCKET
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long").repartition(20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        links = m.print_links(df, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    got = {r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    # brute force: breadth first over all values that differ in one or two bits
    known, todo = {values[0]}, [values[0]]
    every = set(values)
    steps = [1 << a | 1 << b for a in range(14) for b in range(a + 1)]
    while todo:
        v = todo.pop()
        for s in steps:
            if (w := v ^ s) in every and w not in known:
                known.add(w)
                todo.append(w)
    assert len(known) == len(values) and got == {0}


@pytest.mark.parametrize("most", [500_000, 3])
def test_components_of_random_links_and_hubs(spark, monkeypatch, most):
    import embspark.llm.components as c

    monkeypatch.setattr(c, "CONTRACTED", most)
    monkeypatch.setattr(c, "BROADCAST_NODES", most)
    rng = random.Random(most)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1001 + k) for k in range(300)] + [(2000 + k, 2001 + k) for k in range(60)]
    want = brute_components({x for p in links for x in p}, lambda a, b: False)
    up = dict(want)

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {n: root(n) for n in up if root(n) != n}


def test_large_groups_are_linked_in_parts_without_copies_of_their_main_tree(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", 40)
    monkeypatch.setattr(m, "TILE", 30)
    seen = []
    kept = m.tile_rows
    monkeypatch.setattr(m, "tile_rows", lambda rows, key: seen.append(rows.select(m.F.size("tiles").alias("n"))) or kept(rows, key))
    rng = random.Random(21)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(400):  # a hub of near copies, and a few that are near to some of them alone
        text = base[:]
        text[rng.randrange(300)] = f"e{k}"
        rows.append((k, " ".join(text)))
    for k in range(6):
        text = rows[7 * k][1].split(" ")
        for at in rng.sample(range(300), 4):
            text[at] = f"f{k}x{at}"
        rows.append((1000 + k, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(table(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert got == brute_components(sets, near)
    # the first look at a group has every row twice at most, and then only rows outside its main tree are copied
    assert len(seen) == 4 and all(df.agg(m.F.max("n")).first()[0] <= 2 for df in seen[::2])
    assert all(df.where("n > 2").count() <= 12 * 8 for df in seen[1::2])


def test_nothing_is_broadcast_whose_rows_grow_with_a_group(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE", 10)
    kinds, kept = [], m.F.broadcast
    monkeypatch.setattr(m.F, "broadcast", lambda df: kinds.append(dict(df.dtypes)) or kept(df))
    shared = [f"s{j}" for j in range(154)]
    rows = [(k, " ".join(shared + [f"t{k // 2}x{j}" for j in range(25 - k % 2)])) for k in range(120)]
    # one group of candidates, whose rows outside the main tree go to each of its 12 parts
    got = {r["doc_id"]: r["component_id"] for r in m.similar_documents(table(spark, rows)).collect()}
    assert got == {k: k - k % 2 for k in range(120)}
    assert {"node", "digest"} in [set(k) for k in kinds]
    assert {kind for k in kinds for kind in k.values()} == {"bigint"}


def test_size_estimates_do_not_grow_from_checkpoint_to_checkpoint(spark):
    rows = spark.range(200).select(m.F.col("id").alias("a"), (m.F.col("id") + 1).alias("b"))
    for _ in range(5):
        rows = m.checkpoint(rows.join(rows.select("a", m.F.col("b").alias("c")), "a").join(rows.select("a", m.F.col("b").alias("d")), "a").select("a", "b"))
        assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert sorted(map(tuple, rows.collect())) == [(k, k + 1) for k in range(200)]
    twice = rows.union(rows).groupBy("a").count().where("count = 2")
    assert twice.join(rows, "a").count() == 200
