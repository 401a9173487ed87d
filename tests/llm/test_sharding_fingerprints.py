import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from embspark.llm.fingerprints import fingerprint_edits
from embspark.llm.sharding import communication_matrix, shard_rows
from tests.llm.common import fixture_rows, sample, table


def test_shards_are_exact_and_slots_gapless(spark):
    rows = [*sample(), (None, "a"), (None, "a"), (7000, "b"), (7000, "b")]
    got = shard_rows(table(spark, rows), 7).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_same_seed_same_shards_other_seed_others(spark):
    df, _ = fixture_rows(spark)
    run = lambda seed: sorted(tuple(r)[:6] for r in shard_rows(df, 40, seed).collect())
    assert run(1) == run(1) != run(2)
    assert shard_rows(table(spark, [])).count() == 0


def test_matrix_has_the_sums_and_the_expected_mean():
    sent, received = np.array([5, 0, 15]), np.array([8, 12])
    draws = [communication_matrix(sent, received, k) for k in range(400)]
    assert all((d.sum(1) == sent).all() and (d.sum(0) == received).all() for d in draws)
    assert abs(np.mean([d[0, 0] for d in draws]) - 2) < 0.2


def fold(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())).strip()


def test_fingerprints_of_edited_texts(spark):
    for df, rows in (fixture_rows(spark), (table(spark, sample()), sample())):
        got = {r["doc_id"]: r for r in fingerprint_edits(df).collect()}
        assert len(got) == len(rows)
        rows = sorted(rows, key=lambda r: -r[0])
        groups = {}
        for i, t in rows:
            groups.setdefault(fold(t or ""), []).append(i)
        for (i, t), (j, u) in zip(rows, [*rows[1:], rows[0]], strict=True):
            t, u = t or "", u or ""
            edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r["near_edited"] == float(fold(t) == fold(edited)) == float(r["fingerprint"] == r["edited_fingerprint"])
            assert r["near_next"] == float(fold(t) == fold(u)) == float(r["fingerprint"] == got[j]["fingerprint"])
            assert r["group_id"] == min(groups[fold(t)])


def test_folding_and_odd_rows(spark):
    rows = [(1, "Ｆｕｌｌ  Width"), (2, "full width "), (3, "é"), (4, "É"), (5, None), (6, ""), (None, "x"), (8, "STRASSE"), (9, "straße"), (9, "straße")]
    got = fingerprint_edits(table(spark, rows)).collect()
    fp = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len(got) == len(rows) and fp[1] == fp[2] != fp[3] == fp[4] and fp[5] == fp[6] and fp[8] == fp[9]
    assert fingerprint_edits(table(spark, [])).count() == 0
    assert [r["near_next"] for r in fingerprint_edits(table(spark, [(1, "a b")])).collect()] == [1.0]


def test_ranges_join_at_their_ends(spark, monkeypatch):
    import embspark.llm.fingerprints as m

    monkeypatch.setattr(m, "GROUP_ROWS", 3)
    df, rows = table(spark, sample()), sorted(sample(), key=lambda r: -r[0])
    got = {r["doc_id"]: r["next_text"] for r in m.with_next(df).collect()}
    assert got == {i: u or "" for (i, _), (_, u) in zip(rows, [*rows[1:], rows[0]], strict=True)}


def test_ids_at_both_ends_outliers_and_rows_without_an_id(spark, monkeypatch):
    import embspark.llm.fingerprints as m

    monkeypatch.setattr(m, "GROUP_ROWS", 5)
    monkeypatch.setattr(m, "STEP", 4)
    low, high = -(2**63), 2**63 - 1
    rows = [(i, f"text {i % 7} {'x' * (i % 11)}") for i in range(200)] + [(low, "least"), (high, "most"), (2**62, "far"), (-(2**62), "away")]
    df = table(spark, rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r["next_text"] for r in m.with_next(df).collect()}
    assert got == {i: u for (i, _), (_, u) in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    sizes = sorted(r["count"] for r in m.ordered_ranges(df).where("guest = 0").groupBy("bucket").count().collect())
    assert sizes[-1] <= 15 and len(sizes) >= 20
    assert fingerprint_edits(df).count() == len(rows)
    rows += [(None, f"none {i % 30}") for i in range(90)]
    out = fingerprint_edits(table(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    # of three equal rows without an id two are followed by a copy of their own
    assert Counter(r["near_next"] for r in out if r["doc_id"] is None) == Counter({1.0: 60, 0.0: 30})
    with_none = m.with_next(table(spark, rows)).collect()
    assert Counter(r["next_text"] for r in with_none) == Counter(t for _, t in rows)


def test_matrices_are_drawn_with_their_joint_probabilities():
    # four rows, two buckets of two, two shards of two: 6 arrangements, of which 1, 4 and 1 have 0, 1 and 2 of the first bucket in the first shard
    draws = Counter(int(communication_matrix(np.array([2, 2]), np.array([2, 2]), k)[0, 0]) for k in range(3000))
    assert all(abs(draws[n] / 3000 - p) < 0.04 for n, p in ((0, 1 / 6), (1, 4 / 6), (2, 1 / 6)))
